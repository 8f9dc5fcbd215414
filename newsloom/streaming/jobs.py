"""Structured Streaming twins of the session, popularity, rule and evaluation jobs.

Click streams carry ``ts`` (timestamp), user_id, article_id, event_id.  Late rows
past the watermark are dropped; results leave in append mode once final.
"""

from functools import reduce

import pandas as pd
from pyspark.sql import Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from newsloom.functions.numeric import session_key
from newsloom.operators import metrics as M, recommenders as R, rules as U, sessions as S
from newsloom.operators.joins import lookup_join
from newsloom.operators.popularity import support
from newsloom.schema import CLICK, KEY


def _ms(c):
    return F.floor(F.unix_micros(c) / 1000)


def run_available(stream, path, checkpoint, mode="append"):
    """Process everything available into Parquet files and stop."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return path


def run_batches(stream, handle, checkpoint, mode="append"):
    """Process everything available through ``handle(batch, batch_id)`` and stop."""
    query = (stream.writeStream.foreachBatch(handle).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


# ---- sessions ---------------------------------------------------------------

def _firsts(rows):
    """The first click of each article; rows are (ts_ms, event_id, article_id), a missing event comes last of its time."""
    out, seen = [], set()
    for row in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
        if row[2] not in seen:
            seen.add(row[2])
            out.append(row)
    return out


def _merged(parts, gap_ms):
    """Open stretches of one user, joined where they are at most ``gap_ms`` apart.

    A stretch is (start, end, its articles' first clicks): one row per article.
    """
    out = []
    for start, end, firsts in sorted(parts, key=lambda p: (p[0], p[1])):
        if out and start - out[-1][1] <= gap_ms:
            out[-1] = (out[-1][0], max(end, out[-1][1]), _firsts(out[-1][2] + firsts))
        else:
            out.append((start, end, firsts))
    return out


def _stretches(rows, gap_ms):
    """Clicks of one user cut at gaps: (start, end, first click per article) of each stretch."""
    parts = []
    for row in sorted(rows, key=lambda r: r[0]):
        if not parts or row[0] - parts[-1][-1][0] > gap_ms:
            parts.append([])
        parts[-1].append(row)
    return [(part[0][0], part[-1][0], _firsts(part)) for part in parts]


def _numbers(column):
    """Whole numbers of a column (floats where pandas met nulls)."""
    return [None if v != v else int(v) for v in column.tolist()]


def stream_sessions(clicks, gap="30 minutes", delay="10 minutes", min_items=2):
    """Closed sessions per user: first click per article, ``min_items`` or more.

    A user's state is the first click per article of each open stretch, so it is
    bounded by the different articles, not by the clicks.  A user has few clicks a call:
    they are plain rows, since a data frame per stretch would cost more than its clicks.  Clicks may come late
    within ``delay`` and join stretches.  An event-time timer closes a stretch
    when the watermark is ``gap`` past its last click.
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    names = ["ts_ms", "event_id", "article_id"]

    def update(group, chunks, state):
        parts = []
        if state.exists:
            starts, ends, sizes, times, events, articles = state.get
            held = list(zip(times, events, articles))
            at = 0
            for start, end, size in zip(starts, ends, sizes):
                parts.append((start, end, held[at:at + size]))
                at += size
        if not state.hasTimedOut:
            for chunk in chunks:
                rows = list(zip(*[_numbers(chunk[n]) for n in names]))
                parts = _merged(parts + _stretches(rows, gap_ms), gap_ms)
        mark = state.getCurrentWatermarkMs()
        done = [p for p in parts if p[1] + gap_ms < mark]
        left = [p for p in parts if p[1] + gap_ms >= mark]
        if left:
            firsts = [row for p in left for row in p[2]]
            state.update(([p[0] for p in left], [p[1] for p in left], [len(p[2]) for p in left],
                          *[[row[k] for row in firsts] for k in range(len(names))]))
            state.setTimeoutTimestamp(max(mark, min(p[1] for p in left) + gap_ms))
        elif state.exists:
            state.remove()
        sent = [p[2] for p in done if len(p[2]) >= min_items]
        if sent:
            yield pd.DataFrame({"user_id": [group[0]] * len(sent), "clicks": [[dict(zip(names, row)) for row in f] for f in sent]})

    rows = clicks.withWatermark("ts", delay).select(
        "ts", F.col("user_id").cast("string").alias("user_id"), _ms("ts").alias("ts_ms"), F.col("event_id").cast("long").alias("event_id"),
        F.col("article_id").cast("long").alias("article_id"))
    kind = "array<struct<ts_ms:bigint,event_id:bigint,article_id:bigint>>"
    closed = rows.groupBy("user_id").applyInPandasWithState(
        update, f"user_id string, clicks {kind}",
        "starts array<long>, ends array<long>, sizes array<long>, times array<long>, events array<long>, articles array<long>",
        "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select("user_id", session_key(F.col("clicks")[0]["ts_ms"], "user_id").alias("session_id"),
                         F.col("clicks")[0]["ts_ms"].alias("session_start"),
                         F.size("clicks").alias("session_size"), "clicks")


def flatten_sessions(sessions):
    """Nested sessions -> the flat session table."""
    return sessions.select(
        *KEY, "session_start", "session_size", F.posexplode("clicks").alias("_p", "c")).select(
        *KEY, "session_start", "session_size", (F.col("_p") + 1).alias("pos"),
        F.col("c.article_id").alias("item_id"), F.col("c.ts_ms").alias("ts_ms"))


# ---- windows ----------------------------------------------------------------

def stream_popularity(clicks, window="1 hour", slide="5 minutes", delay="10 minutes"):
    """Clicks per article in a sliding window; ``ref_ts`` is the window's end."""
    counts = (clicks.withWatermark("ts", delay)
              .groupBy(F.window("ts", window, slide).alias("w"), F.col("article_id").alias("item_id"))
              .agg(F.count("*").alias("clicks")))
    return counts.select(_ms("w.end").alias("ref_ts"), "item_id", "clicks")


def stream_hourly_stats(clicks, delay="10 minutes"):
    """Clicks, articles and popularity share per hour.

    Two chained aggregations: (hour, article) counts, then the hour.
    """
    per_article = (clicks.withWatermark("ts", delay)
                   .groupBy(F.window("ts", "1 hour").alias("w"), "article_id")
                   .agg(F.count("*").alias("c")))
    stats = (per_article.groupBy(F.window(F.window_time("w"), "1 hour").alias("h"))
             .agg(F.sum("c").alias("clicks"), F.count("*").alias("unique_articles"),
                  F.expr("percentile(c, 0.5)").alias("median")))
    n = F.col("unique_articles")
    return stats.select(
        _ms("h.start").alias("hour_ms"), "clicks", "unique_articles",
        (F.col("clicks") / n).alias("clicks_by_article"), (1.0 / n).alias("norm_pop_mean"),
        (F.col("median") / F.col("clicks")).alias("norm_pop_median"))


# ---- maintained tables --------------------------------------------------------

def write_delta(df, path, batch_id):
    """One folder per micro-batch; a repeated batch replaces its folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


#: Micro-batches whose changes are kept apart before they are summed.
FOLD_EVERY = 32


def write_change(df, path, batch_id, keys, every=FOLD_EVERY):
    """Add a batch's changes (``keys`` and numbers to sum) below ``path``.

    Every ``every`` batches an epoch begins: the sums of the epoch before are its
    first part, so a reader opens one sum and fewer than ``every`` changes
    however many batches there were.  A repeated batch replaces what it wrote.
    """
    epoch = batch_id // every
    if epoch and batch_id % every == 0:
        write_delta(_summed(df.sparkSession.read.parquet(f"{path}/epoch={epoch - 1}"), keys), f"{path}/epoch={epoch}", batch_id - 1)
    write_delta(df, f"{path}/epoch={epoch}", batch_id)


def _summed(changes, keys):
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def epochs(spark, path):
    """Numbers of the epochs below ``path``, falling; empty before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted((int(n.split("=")[1]) for n in names if n.startswith("epoch=")), reverse=True)


def read_changes(spark, path, keys, before=None, every=FOLD_EVERY):
    """Sums over the micro-batches (below ``before``); None where there is none yet."""
    if before is not None:
        newest = [(before - 1) // every] if before > 0 else []
    else:
        newest = epochs(spark, path)[:1]
    if not newest:
        return None
    changes = spark.read.parquet(f"{path}/epoch={newest[0]}")
    if before is not None:
        changes = changes.filter(F.col("batch") < before)
    return _summed(changes, keys)


RULE, PAIR, ITEM = ["antecedent", "consequent"], ["item_a", "item_b"], ["item_id"]


def write_tables(flat, path, batch_id, max_dist=10, decay="div", every=FOLD_EVERY):
    """Rule, co-occurrence and support changes of a batch of sessions."""
    write_change(U.train_rules(flat, max_dist, decay), f"{path}/rules", batch_id, RULE, every)
    write_change(U.cooccurrence(flat), f"{path}/cooccurrence", batch_id, PAIR, every)
    write_change(support(S.truncate_sessions(flat)), f"{path}/support", batch_id, ITEM, every)


def maintain_rules(sessions_stream, path, checkpoint, max_dist=10, decay="div", every=FOLD_EVERY):
    """Keep the rule, co-occurrence and support tables up to date; old rows are not rewritten."""
    def handle(batch, batch_id):
        write_tables(flatten_sessions(batch), path, batch_id, max_dist, decay, every)
    run_batches(sessions_stream, handle, checkpoint)


# ---- keyed state ------------------------------------------------------------------

def stream_last_n(clicks, n=20, ttl="1 hour", key="article_id", delay="10 minutes", salt=16):
    """Newest n clicks per (key, salt), sent on every change; silent state is dropped after ``ttl``.

    The first of two levels: a hot key, or with ``key`` None all clicks, is spread
    over ``salt`` states by event id.  ``last_n`` makes the lists per key.  Rows
    arrive in Arrow chunks and each chunk is cut to n before the next one.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def update(group, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        times, ids = state.get if state.exists else ([], [])
        kept = pd.DataFrame({"ts_ms": list(times), "event_id": list(ids)}, dtype="int64")
        for chunk in chunks:
            kept = (pd.concat([kept, chunk[["ts_ms", "event_id"]]])
                    .sort_values(["ts_ms", "event_id"], ascending=False).head(n))
        state.update((kept.ts_ms.tolist(), kept.event_id.tolist()))
        latest = int(kept.ts_ms.iloc[0])
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"key": [group[0]], "salt": [group[1]], "times": [kept.ts_ms.tolist()], "event_ids": [kept.event_id.tolist()]})

    name = F.lit(0).cast("long") if key is None else F.col(key).cast("long")
    rows = clicks.withWatermark("ts", delay).select(
        "ts", name.alias("key"), F.pmod(F.xxhash64("event_id"), F.lit(salt)).cast("int").alias("salt"), _ms("ts").alias("ts_ms"), "event_id")
    return rows.groupBy("key", "salt").applyInPandasWithState(
        update, "key long, salt int, times array<long>, event_ids array<long>",
        "times array<long>, event_ids array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def last_n(changes, n=20, upto=None):
    """Second level: the newest n clicks per key from the newest list of each (key, salt).

    ``changes`` are the rows of ``stream_last_n`` with their ``batch``; ``upto``
    reads the state after that batch.  At most salt * n rows per key remain.
    """
    if upto is not None:
        changes = changes.filter(F.col("batch") <= upto)
    lists = changes.groupBy("key", "salt").agg(F.max_by(F.arrays_zip("times", "event_ids"), "batch").alias("_l"))
    rows = lists.select("key", F.inline("_l")).toDF("key", "ts_ms", "event_id")
    newest = Window.partitionBy("key").orderBy(F.desc("ts_ms"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


# ---- live lists and metrics -----------------------------------------------------------

def packed_rules(rules, k):
    """Top-k consequents per item as one row, ready for a stream-static join."""
    best = U.top_rules(rules, k)
    return best.groupBy(F.col("antecedent").alias("article_id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "consequent"))).alias("recs"))


def stream_recommend(clicks, packed):
    """Each click with the ready list of its article (a static lookup, no state)."""
    joined = lookup_join(clicks.select("event_id", "user_id", "article_id"), packed, "article_id", "inner")
    return joined.select("event_id", "user_id", "article_id", F.inline("recs"))


def live_lists(clicks, tables, path, checkpoint, catalog, k=100, columns=()):
    """Lists for each batch of clicks from the tables as they are by then, written per batch.

    ``tables`` is the folder of ``maintain_rules``, read anew in every batch, so
    lists follow the rules while the query runs.  An article outside the
    ``catalog`` or without rules gets the most clicked articles; only articles of
    the catalogue are listed, with its ``columns``.
    """
    known = catalog.select("article_id")

    def handle(batch, batch_id):
        spark = batch.sparkSession
        rules = read_changes(spark, f"{tables}/rules", RULE)
        counts = read_changes(spark, f"{tables}/support", ITEM)
        if rules is None or counts is None:
            return
        for side in RULE:
            rules = rules.join(known.withColumnRenamed("article_id", side), side, "left_semi")
        best = U.top_rules(rules, k).select(F.col("antecedent").alias("item_id"), F.col("consequent").alias("rec_item"), "rank")
        popular = counts.join(known.withColumnRenamed("article_id", "item_id"), "item_id", "left_semi")
        popular = popular.orderBy(F.desc("support"), "item_id").limit(k)
        place = Window.partitionBy(F.lit(0)).orderBy(F.desc("support"), "item_id")  # of k rows
        popular = popular.select(F.row_number().over(place).alias("rank"), F.col("item_id").alias("rec_item"))
        lists = R.with_fallback(best, popular, batch.select(F.col("article_id").alias("item_id")).distinct(), k)
        rows = batch.join(lists.withColumnRenamed("item_id", "article_id"), "article_id")
        details = catalog.select(F.col("article_id").alias("rec_item"), *columns)
        write_delta(rows.join(details, "rec_item"), path, batch_id)
    run_batches(clicks, handle, checkpoint)


def stream_evaluate(sessions_stream, path, checkpoint, top_n=5, max_dist=10, decay="div", every=FOLD_EVERY):
    """Per batch: score every recommender with the tables of earlier batches, write metrics, then add the batch.

    Metrics per recommender: hit rate, MRR, NDCG, the share of the clicked
    articles so far that is listed, and the mean novelty of the listed articles.
    """
    def handle(batch, batch_id):
        spark = batch.sparkSession
        flat = flatten_sessions(batch)
        if batch_id > 0:
            rules, pairs, counts = (read_changes(spark, f"{path}/{name}", keys, batch_id, every) for name, keys in (
                ("rules", RULE), ("cooccurrence", PAIR), ("support", ITEM)))
            write_delta(batch_metrics(S.shift_labels(flat), rules, pairs, counts, top_n), f"{path}/metrics", batch_id)
        write_tables(flat, path, batch_id, max_dist, decay, every)
    run_batches(sessions_stream, handle, checkpoint)


def batch_metrics(labels, rules, pairs, counts, top_n):
    """One row per recommender over the labelled clicks of a batch."""
    every_click = labels.select(*CLICK, "item_id")
    popular = counts.orderBy(F.desc("support"), "item_id").limit(top_n)
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("support"), "item_id")  # of top_n rows
    popular = popular.select(F.col("item_id").alias("rec_item"), F.row_number().over(place).alias("rank"))
    lists = {
        "popular": every_click.select(*CLICK).crossJoin(F.broadcast(popular)),  # top_n rows
        "coocurrent": R.recommend_cooccurrence(pairs, every_click, top_n),
        "item_knn": R.recommend_item_knn(pairs, counts, every_click, top_n),
        "sr": R.recommend_rules(rules, every_click, top_n),
    }
    both = reduce(lambda a, b: a.unionByName(b), [
        t.select(*CLICK, "rank", F.col("rec_item").alias("item_id"), F.lit(name).alias("recommender")) for name, t in lists.items()])
    total = counts.agg(F.sum("support").alias("_all"), F.count("*").alias("items"))
    share = counts.crossJoin(F.broadcast(total)).select("item_id", (F.col("support") / F.col("_all")).alias("norm_pop"))  # one row
    preds = lookup_join(both, share, "item_id", "inner")
    wanted = labels.select(*CLICK, F.col("label_next_item").alias("label"),
                           F.explode(F.array(*[F.lit(name) for name in lists])).alias("recommender"))
    by = ["recommender"]
    scores = M.click_scores(preds, wanted, top_n, by).groupBy(*by).agg(
        F.count("*").alias("clicks"), F.avg("hit").alias("hitrate"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"),
        (F.sum("nov_sum") / F.sum("listed")).alias("novelty"))
    shown = preds.groupBy(*by).agg(F.count_distinct("item_id").alias("_shown")).crossJoin(F.broadcast(total.select("items")))
    shown = shown.select(*by, (F.col("_shown") / F.col("items")).alias("coverage"))
    return scores.join(shown, "recommender", "left")
