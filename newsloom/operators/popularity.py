"""Recent-click buffer, popularity, first clicks and hourly statistics."""

from pyspark.sql import Window, functions as F

from newsloom.functions.numeric import log_base
from newsloom.operators.joins import lookup_join
from newsloom.operators.ranking import global_rank
from newsloom.schema import MS_HOUR


def recent_clicks(clicks, refs, hours, hourly_refs=False):
    """Clicks in the ``hours`` before each reference time (as-of buffer).

    Each reference is repeated once per hour bucket it can reach (hours + 1 rows),
    which turns the range condition into an equi-join on the bucket.  With
    ``hourly_refs`` there is at most one reference per hour of the log; that bounds
    the reference side, and it is broadcast so a hot hour is not shuffled.
    """
    span = hours * MS_HOUR
    reach = refs.withColumn("_bucket", F.explode(F.sequence(
        F.floor((F.col("ref_ts") - span) / MS_HOUR), F.floor(F.col("ref_ts") / MS_HOUR))))
    if hourly_refs:
        reach = F.broadcast(reach)
    return (clicks.withColumn("_bucket", F.floor(F.col("ts_ms") / MS_HOUR))
            .join(reach, "_bucket")
            .filter((F.col("ts_ms") >= F.col("ref_ts") - span) & (F.col("ts_ms") < F.col("ref_ts")))
            .drop("_bucket"))


def click_buffer(clicks, refs, hours=1, max_size=20_000, ref="state_step", hourly_refs=False):
    """The newest ``max_size`` clicks of each reference's range, newest first.

    ``row_number() <= max_size`` is pushed below the shuffle as a group limit.
    """
    newest = Window.partitionBy(ref).orderBy(F.desc("ts_ms"), F.desc("event_id"))
    return (recent_clicks(clicks, refs, hours, hourly_refs)
            .withColumn("buffer_pos", F.row_number().over(newest))
            .filter(F.col("buffer_pos") <= max_size))


def support(flat, by=()):
    return flat.groupBy(*by, "item_id").agg(F.count("*").alias("support"))


def recent_popularity(buffer, norm_clicks=1000, by=("state_step",)):
    """Clicks per item in the buffer and their share, floored at 1/norm_clicks."""
    counts = buffer.groupBy(*by, "item_id").agg(F.count("*").alias("clicks"))
    totals = counts.groupBy(*by).agg(F.sum("clicks").alias("_total"))
    joined = lookup_join(counts, totals, list(by), "inner") if by else counts.withColumn(
        "_total", totals.scalar())
    return (joined
            .withColumn("norm_pop", F.greatest(
                F.col("clicks") / (F.col("_total") + 1), F.lit(1.0 / norm_clicks)))
            .drop("_total"))


def with_norm_pop(rows, popularity, norm_clicks=1000, by=("state_step",)):
    """Attach ``norm_pop``; items not in the buffer get the floor."""
    out = lookup_join(rows, popularity.select(*by, "item_id", "norm_pop"), list(by) + ["item_id"])
    return out.withColumn("norm_pop", F.coalesce("norm_pop", F.lit(1.0 / norm_clicks)))


def novelty_of(norm_pop, base=2.0):
    return -log_base(norm_pop, base)


def clicks_by_article(flat):
    return flat.groupBy("item_id").agg(F.count("*").alias("clicks"))


def first_click(flat, step="session_hour"):
    """First click time and first step of each item."""
    return flat.groupBy("item_id").agg(
        F.min("ts_ms").alias("first_ts"), F.min(step).alias("first_step"))


def gini(df, value, by):
    """Gini index of the values per group (each value shifted by 1e-7).

    Equal values share one row with their frequency and ranks of equal values are
    summed in closed form.  Running counts come from a bucketed order over all
    groups, shifted by each group's start, so a hot group is spread as well.
    """
    by = list(by)
    freq = df.groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_f"))
    running = global_rank(freq, [*[(c, True) for c in by], ("_x", True)], "_cum", weight="_f")
    start = running.groupBy(*by).agg(F.min(F.col("_cum") - F.col("_f")).alias("_start"))
    ranked = lookup_join(running, start, by, "inner").withColumn("_end", F.col("_cum") - F.col("_start"))
    # sum of 2*i over the ranks end-f+1..end
    twice = F.col("_f") * (2 * F.col("_end") - F.col("_f") + 1)
    x = F.col("_x") + 1e-7
    sums = ranked.groupBy(*by).agg(
        F.sum("_f").alias("_n"), F.sum(twice * x).alias("_ix"),
        F.sum(F.col("_f") * x).alias("_sx"))
    index = (F.col("_ix") - (F.col("_n") + 1) * F.col("_sx")) / (F.col("_n") * F.col("_sx"))
    return sums.select(*by, index.alias("gini"))


def hourly_stats(flat, hour="session_hour"):
    """Sessions, clicks, unique articles, popularity share and Gini per hour.

    Clicks shrink to (hour, article) and then to (hour, click count) rows; the
    session count is the number of first clicks.
    """
    per_article = flat.groupBy(hour, "item_id").agg(
        F.count("*").alias("c"), F.sum((F.col("pos") == 1).cast("long")).alias("s"))
    per_count = per_article.groupBy(hour, "c").agg(
        F.count("*").alias("f"), F.sum("s").alias("s"))
    upto = Window.partitionBy(hour).orderBy("c")
    ranked = per_count.withColumn("_end", F.sum("f").over(upto))
    x = F.col("c") + 1e-7
    twice = F.col("f") * (2 * F.col("_end") - F.col("f") + 1)
    stats = ranked.groupBy(hour).agg(
        F.sum("s").alias("session_count"),
        F.sum(F.col("c") * F.col("f")).alias("clicks"),
        F.sum("f").alias("unique_articles"),
        F.expr("percentile(c, 0.5, f)").alias("_median"),
        F.sum(twice * x).alias("_ix"), F.sum(F.col("f") * x).alias("_sx"))
    n = F.col("unique_articles")
    return stats.select(
        hour, "session_count", "clicks",
        (F.col("clicks") / F.col("session_count")).alias("clicks_by_session"),
        "unique_articles",
        (F.col("clicks") / n).alias("clicks_by_article"),
        (1.0 / n).alias("norm_pop_mean"),
        (F.col("_median") / F.col("clicks")).alias("norm_pop_median"),
        ((F.col("_ix") - (n + 1) * F.col("_sx")) / (n * F.col("_sx"))).alias("gini_index"))


def fold_counters(flat, by=("session_hour",)):
    """Clicks, unique items and sessions per evaluation hour."""
    return flat.groupBy(*by).agg(
        F.count("*").alias("clicks"),
        F.countDistinct("item_id").alias("unique_items"),
        F.sum((F.col("pos") == 1).cast("long")).alias("sessions"))
