"""Ranks, top-k lists and the global rank used to number encoder values."""

from pyspark.sql import Window, functions as F

from newsloom.schema import CLICK
from newsloom.session import materialize


def rank_rows(df, by, order, out="rank"):
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_n(df, by, score, n, tie="item_id"):
    """Best ``n`` rows per group, ties by ``tie``.

    Catalyst turns ``row_number() <= n`` into a group limit before the shuffle, so
    a hot group sends at most n rows per task.
    """
    order = [F.desc(score), F.asc(tie)]
    return rank_rows(df, by, order).filter(F.col("rank") <= n)


def rank_candidates(scored, n=None, click=CLICK):
    """Candidates of each click by score (9 digits), ties by item."""
    order = [F.desc(F.round("score", 9)), F.asc("item_id")]
    ranked = rank_rows(scored, click, order)
    return ranked.filter(F.col("rank") <= n) if n else ranked


def most_common(df, col, n):
    return df.groupBy(col).count().orderBy(F.desc("count"), F.asc(col)).limit(n)


def top_valid(scored, candidates, k, click=CLICK):
    """Top k of the scored items that are candidates of the click."""
    valid = scored.join(candidates.select(*click, "item_id").distinct(), click + ["item_id"], "left_semi")
    return rank_candidates(valid, k, click)


def pad_lists(ranked, k, click=CLICK):
    """One row per click with exactly k item ids; missing places are null, not 0."""
    lists = ranked.groupBy(*click).agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("_l"))
    ids = F.transform("_l", lambda x: x["item_id"])
    padding = F.array_repeat(F.lit(None).cast("long"), k)
    return lists.select(*click, F.slice(F.concat(ids, padding), 1, k).alias("items"))


def exclude_items(scored, seen, on=None):
    return scored.join(seen, on or ["item_id"], "left_anti")


def global_rank(df, order, out="rn", buckets=None, weight=None):
    """1-based rank over the whole table without pulling it into one task.

    With ``weight`` the result is the running sum of that column instead.
    ``order`` lists (column, ascending) pairs that order the rows totally.
    The rows are sorted by ranges, as many as the session's shuffle partitions (or
    ``buckets``), and written once with their place, so that all later steps and lost
    tasks see the same ranges.  A range's offset is the total of the ranges before it.
    """
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c, ascending in order]
    ranged = df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys) if buckets else df.orderBy(*keys)
    # The upper bits of the generated id are the partition, the lower 33 the place in it.
    placed = materialize(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_b", F.shiftright("_m", 33))
    totals = placed.groupBy("_b").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    # One row per range: one small window group.
    running = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_o"))
    if weight:
        upto = Window.partitionBy("_b").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
        local = F.sum(weight).over(upto)
    else:
        local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (placed.withColumn("_r", local)
            .join(F.broadcast(offsets), "_b")
            .withColumn(out, F.col("_r") + F.col("_o"))
            .drop("_b", "_r", "_o", "_m"))
