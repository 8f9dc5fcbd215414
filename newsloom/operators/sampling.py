"""Negative sampling and candidate tables."""

from hashlib import md5

import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from newsloom.operators.joins import lookup_join
from newsloom.schema import CLICK, KEY
from newsloom.session import task_count


def hash_key(*cols):
    """A stable pseudo-random text key: md5 over the '|'-joined values."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def negative_pool(batch, buffer, size, seed=42):
    """Bag of item copies per state step, cut to ``size`` in hash order.

    ``batch`` (step clicks, with repeats) and ``buffer`` are united without
    removing repeats: popular items keep more copies.  The cut is a group limit.
    """
    bag = batch.select("state_step", "item_id", F.concat_ws(":", F.lit("b"), "copy_id").alias("copy")).unionByName(
        buffer.select("state_step", "item_id", F.concat_ws(":", F.lit("r"), "copy_id").alias("copy")))
    order = Window.partitionBy("state_step").orderBy("_h", "copy")
    return (bag.withColumn("_h", hash_key(F.lit(seed), F.col("state_step"), F.col("copy")))
            .withColumn("pool_pos", F.row_number().over(order))
            .filter(F.col("pool_pos") <= size).drop("_h"))


def sample_negatives(clicks, buffer, n=50, seed=42, factor=20, buffer_sample=None, hourly_steps=False):
    """First ``n`` distinct items per click from the shuffled pool, none of its session.

    ``clicks`` carry CLICK, item_id, state_step and event_id; ``buffer`` carries
    state_step, item_id and event_id.  The pool of a step is one array of at most
    factor * n copies; each click orders it by its own hash key.  With ``hourly_steps``
    there is at most one step per hour of the log: that bounds the pools, and they are
    broadcast, so that the sessions keep their even parts (a shuffled join would merge
    them by bytes into a few long tasks).
    """
    batch = clicks.select("state_step", "item_id", F.col("event_id").alias("copy_id"))
    recent = buffer.select("state_step", "item_id", F.col("event_id").alias("copy_id"))
    if buffer_sample:
        order = Window.partitionBy("state_step").orderBy("_h", "copy_id")
        recent = (recent.withColumn("_h", hash_key(F.lit(seed), F.lit("s"), F.col("copy_id")))
                  .withColumn("_r", F.row_number().over(order))
                  .filter(F.col("_r") <= buffer_sample).drop("_h", "_r"))
    pools = negative_pool(batch, recent, factor * n, seed).groupBy("state_step").agg(
        F.collect_list(F.struct("item_id", "copy")).alias("_pool"))
    pools = pools.select("state_step", F.col("_pool.item_id").alias("_items"), F.col("_pool.copy").alias("_copies"))
    session_items = clicks.groupBy(*KEY, "state_step").agg(
        F.collect_set("item_id").alias("_own"),
        F.collect_list("pos").alias("_at"))
    # Each click hashes a whole pool: cost follows sessions, not bytes.
    session_items = session_items.repartition(task_count(clicks.sparkSession), *KEY)
    keys = F.transform("_at", lambda p: F.concat_ws(
        "|", F.lit(str(seed)), "user_id", F.col("session_id").cast("string"), p.cast("string")))
    joined = lookup_join(session_items.withColumn("_keys", keys), F.broadcast(pools) if hourly_steps else pools, "state_step", "inner")
    picked = T.ArrayType(T.ArrayType(clicks.schema["item_id"].dataType))
    schema = T.StructType([*[joined.schema[c] for c in [*KEY, "state_step", "_at"]], T.StructField("_picked", picked)])
    lists = joined.select(*KEY, "state_step", "_at", "_own", "_keys", "_items", "_copies").mapInArrow(_first_items(n), schema)
    return (lists.select(*KEY, "state_step", F.inline(F.arrays_zip(F.col("_at").alias("pos"), F.col("_picked").alias("_picked"))))
            .select(*CLICK, "state_step", F.posexplode("_picked").alias("neg_pos", "item_id")))


#: Pools that a task keeps decoded.
KEPT_POOLS = 256


def _first_items(n):
    """Per session row: the first ``n`` distinct pool items of each click in the order of the copies' hashes.

    A column expression that hashes and sorts a pool costs some five times as much.
    """
    def order(key, free):
        head = key.encode() + b"|"
        hashed = sorted([(md5(head + copy).digest(), item) for copy, item in free])
        return list(dict.fromkeys([item for _, item in hashed]))[:n]

    def run(batches):
        pools = {}
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            picked = []
            for r, (step, own, keys) in enumerate(zip(*[col[c].to_pylist() for c in ("state_step", "_own", "_keys")])):
                if step not in pools:
                    if len(pools) >= KEPT_POOLS:
                        pools.clear()
                    pools[step] = [(c.encode(), i) for c, i in zip(col["_copies"][r].as_py(), col["_items"][r].as_py()) if i is not None]
                own = set(own)
                free = [c for c in pools[step] if c[1] not in own]
                picked.append([order(key, free) for key in keys])
            kind = pa.list_(pa.list_(col["_items"].type.value_type))
            yield pa.RecordBatch.from_arrays(
                [*[col[c] for c in [*KEY, "state_step", "_at"]], pa.array(picked, kind)], [*KEY, "state_step", "_at", "_picked"])
    return run


def exclude_session_items(candidates, sessions):
    return candidates.join(sessions.select(*KEY, "item_id").distinct(), KEY + ["item_id"], "left_anti")


def build_candidates(labels, negatives):
    """Positive and negatives per click: (CLICK, active_item, item_id, is_label, state_step)."""
    base = labels.select(*CLICK, F.col("item_id").alias("active_item"),
                         F.col("label_next_item").alias("label"), "state_step")
    positive = base.withColumn("item_id", F.col("label")).withColumn("is_label", F.lit(1))
    negative = (base.join(negatives.select(*CLICK, "item_id"), CLICK)
                .withColumn("is_label", F.lit(0)))
    return positive.unionByName(negative)


def attach_negatives(test, negatives):
    """Sessions with their logged negatives; sessions without are dropped."""
    logged = negatives.groupBy(*CLICK).agg(
        F.sort_array(F.collect_list("item_id")).alias("negative_items"))
    return test.join(logged, CLICK)
