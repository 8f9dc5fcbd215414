"""Sessions from clicks: gap rule, first click per article, positions, labels."""

from pyspark.sql import Window, functions as F

from newsloom.functions.numeric import session_hour, session_key
from newsloom.schema import KEY, MAX_SESSION_ITEMS, MS_DAY

GAP_MS = 30 * 60 * 1000
HOT_ROWS = 5_000_000


def _member(rows, name):
    """Array of one field of an array of structs."""
    return F.transform(rows, lambda r: r[name])


def hot_users(clicks, rows=HOT_ROWS):
    """Users with more clicks than one task should hold; at most clicks/rows users."""
    return clicks.groupBy("user_id").count().filter(F.col("count") > rows).select("user_id")


def sessionize(clicks, gap_ms=GAP_MS, hot_rows=HOT_ROWS, chunk_ms=MS_DAY):
    """Add ``elapsed_ms`` (since the user's previous raw click) and ``session_seq``.

    Each user's clicks are read in (ts_ms, event_id) order and a new session
    starts after a gap of more than ``gap_ms``.  Users above ``hot_rows`` clicks
    are cut into time chunks: each chunk is one window group, and a small table
    with one row per (user, chunk) carries the last time stamp and the number of
    sessions across the cuts.  Other users are one chunk.
    """
    hot = hot_users(clicks, hot_rows).withColumn("_hot", F.lit(True))
    chunk = F.when(F.col("_hot"), F.floor(F.col("ts_ms") / chunk_ms)).otherwise(F.lit(0))
    # The hot set has at most (all clicks / hot_rows) rows.
    marked = (clicks.join(F.broadcast(hot), "user_id", "left")
              .withColumn("_chunk", chunk).drop("_hot"))
    in_chunk = Window.partitionBy("user_id", "_chunk").orderBy("ts_ms", "event_id")
    local = (marked
             .withColumn("_prev", F.lag("ts_ms").over(in_chunk))
             .withColumn("_break", F.when(F.col("ts_ms") - F.col("_prev") > gap_ms, 1).otherwise(0))
             .withColumn("_seq", F.sum("_break").over(in_chunk)))
    by_user = Window.partitionBy("user_id").orderBy("_chunk")
    cuts = (local.groupBy("user_id", "_chunk")
            .agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"),
                 F.sum("_break").alias("_breaks"))
            .withColumn("_before", F.lag("_last").over(by_user))
            .withColumn("_opens", F.when(
                F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap_ms), 1)
                .otherwise(0))
            .withColumn("_offset", F.sum(
                F.col("_opens") + F.coalesce(F.lag("_breaks").over(by_user), F.lit(0)))
                .over(by_user))
            .select("user_id", "_chunk", "_before", "_offset"))
    previous = F.coalesce("_prev", "_before")
    return (local.join(cuts, ["user_id", "_chunk"])
            .withColumn("elapsed_ms", F.coalesce(F.col("ts_ms") - previous, F.lit(0)))
            .withColumn("session_seq", F.col("_offset") + F.col("_seq"))
            .drop("_chunk", "_prev", "_break", "_seq", "_before", "_offset"))


def dedupe_sessions(clicks, min_items=2):
    """First click per article of each session; sessions below ``min_items`` go.

    The group is (user, session, article) and is reduced before the shuffle, so a
    reload loop on one article is one row per task.
    """
    keys = ["user_id", "session_seq", "article_id"]
    rest = [c for c in clicks.columns if c not in keys + ["ts_ms", "event_id"]]
    first = clicks.groupBy(*keys).agg(
        F.min(F.struct("ts_ms", "event_id", *rest)).alias("_first"))
    flat = first.select(*keys, "_first.*")
    session = Window.partitionBy("user_id", "session_seq")
    return (flat.withColumn("session_size", F.count("*").over(session).cast("int"))
            .filter(F.col("session_size") >= min_items))


def session_positions(clicks):
    """Position (1-based) and start of each session; a session holds distinct articles."""
    session = Window.partitionBy("user_id", "session_seq")
    ordered = session.orderBy("ts_ms", "event_id")
    return (clicks.withColumn("session_start", F.min("ts_ms").over(session))
            .withColumn("pos", F.row_number().over(ordered)))


def time_origin(clicks):
    return clicks.agg(F.min("ts_ms").alias("origin_ms"))


def session_clicks(clicks, gap_ms=GAP_MS, min_items=2, hot_rows=HOT_ROWS, chunk_ms=MS_DAY):
    """Flat session table: one row per kept click, keyed (user_id, session_id, pos)."""
    found = session_positions(dedupe_sessions(
        sessionize(clicks, gap_ms, hot_rows, chunk_ms), min_items))
    return (found
            .withColumn("session_id", session_key("session_start", "user_id"))
            .withColumn("session_hour", session_hour("session_start", time_origin(clicks).scalar()))
            .withColumnRenamed("article_id", "item_id")
            .drop("session_seq"))


def nest_sessions(flat):
    """Session rows with their ordered clicks as an array of structs."""
    keep = KEY + ["session_hour", "session_size", "session_start"]
    rest = [c for c in flat.columns if c not in keep]
    rest = ["pos"] + [c for c in rest if c != "pos"]
    return flat.groupBy(*keep).agg(
        F.sort_array(F.collect_list(F.struct(*rest))).alias("clicks"))


def truncate_sessions(flat, max_len=MAX_SESSION_ITEMS):
    return (flat.filter(F.col("pos") <= max_len)
            .withColumn("session_size", F.least("session_size", F.lit(max_len))))


def next_item_labels(flat):
    """Next item of each click and last item of its session."""
    ordered = Window.partitionBy(*KEY).orderBy("pos")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (flat.withColumn("label_next_item", F.lead("item_id").over(ordered))
            .withColumn("label_last_item", F.last("item_id").over(whole)))


def shift_labels(flat, max_len=MAX_SESSION_ITEMS):
    """Model inputs: the truncated session without its last click, with labels."""
    return (next_item_labels(truncate_sessions(flat, max_len))
            .filter(F.col("label_next_item").isNotNull()))


def session_lists(flat, cols, max_len=MAX_SESSION_ITEMS):
    """One row per session with one array per click attribute."""
    cut = truncate_sessions(flat, max_len)
    packed = cut.groupBy(*KEY).agg(
        F.first("session_size").alias("session_size"),
        F.min("session_start").alias("session_start"),
        F.first("session_hour").alias("session_hour"),
        F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("_rows"))
    arrays = [_member("_rows", c).alias(c) for c in cols]
    return packed.select(*KEY, "session_size", "session_start", "session_hour", *arrays)


def order_sessions(sessions):
    """Sessions sorted by id inside their hour partition."""
    return (sessions.repartition("session_hour")
            .sortWithinPartitions("session_hour", "session_id", "user_id"))


def assemble_sessions(clicks, key, order_cols, list_cols, min_cols=()):
    """Clicks that carry a session id -> one row per session with ordered lists."""
    rows = clicks.groupBy(key).agg(
        *[F.min(c).alias(c) for c in min_cols],
        F.sort_array(F.collect_list(F.struct(*order_cols, *list_cols))).alias("_rows"))
    arrays = [_member("_rows", c).alias(c) for c in list_cols]
    return rows.select(key, *min_cols, *arrays)


def restrict_to_train_items(test, train, min_clicks=2):
    """Test clicks whose item occurs in training, in sessions that keep 2+ clicks."""
    known = test.join(train.select("item_id").distinct(), "item_id", "left_semi")
    size = F.count("*").over(Window.partitionBy(*KEY))
    return known.withColumn("_n", size).filter(F.col("_n") >= min_clicks).drop("_n")


def flat_training_table(flat, max_len=MAX_SESSION_ITEMS):
    """(SessionId, ItemId, Time) rows; the last label repeats the previous click's time."""
    ordered = Window.partitionBy(*KEY).orderBy("pos")
    cut = truncate_sessions(flat, max_len)
    previous = F.lag("ts_ms").over(ordered)
    is_last = F.lead("item_id").over(ordered).isNull()
    return cut.select(
        "user_id", F.col("session_id").alias("SessionId"), "pos",
        F.col("item_id").alias("ItemId"),
        F.when(is_last, F.coalesce(previous, F.col("ts_ms"))).otherwise(F.col("ts_ms")).alias("Time"))
