"""Model state per evaluation step.

Every session enters the state at its ``step``.  A probe with ``state_step`` t
sees the steps below t.  History is kept as changes (deltas), one row per key and
step, and is never copied per fold.  Probes read it as of their step: probes and
changes of a key pass one window in step order, so the work is the rows of both.
"""

from pyspark.sql import Window, functions as F

from newsloom.operators.joins import lookup_join

FOREVER = (1 << 62)


def cumulative_state(deltas, keys, values, step="step"):
    """Per-step changes -> running totals with (valid_from, valid_to]."""
    by_key = Window.partitionBy(*keys).orderBy(step)
    return deltas.select(
        *keys,
        *[F.sum(v).over(by_key).alias(v) for v in values],
        F.col(step).cast("long").alias("valid_from"),
        F.coalesce(F.lead(step).over(by_key).cast("long"), F.lit(FOREVER)).alias("valid_to"))


def state_at(state, steps, keys, values):
    """State rows visible at each of the given steps (a short list of folds)."""
    wanted = steps.agg(F.sort_array(F.collect_set("state_step"))).scalar()
    visible = F.filter("_all", lambda t: (F.col("valid_from") < t) & (t <= F.col("valid_to")))
    return (state.withColumn("_all", wanted)
            .select(F.explode(visible).alias("state_step"), *keys, *values))


def asof_totals(probes, deltas, keys, values):
    """Probes with the sums of their key's changes before ``state_step``; probes that see none are left out.

    A key's probes and changes meet in one task.  That suits keys of which a click
    has one, such as pairs of items.  For a key that may hold a third of all probes
    (an item), look up its distinct steps and join those to the probes.
    """
    known = lambda df: df.filter(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    kinds = deltas.select(*values).schema
    asked = known(probes).select(
        *keys, F.col("state_step").cast("long").alias("_at"), F.lit(0).alias("_kind"),
        F.struct(*probes.columns).alias("_probe"), *[F.lit(None).cast(kinds[v].dataType).alias(v) for v in values])
    changes = known(deltas).select(
        *[F.col(k).cast(probes.schema[k].dataType).alias(k) for k in keys], F.col("step").cast("long").alias("_at"),
        F.lit(1).alias("_kind"), F.lit(None).cast(asked.schema["_probe"].dataType).alias("_probe"), *values)
    # a probe comes before the changes of its own step: it does not see them
    so_far = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    totals = asked.union(changes).select("_probe", *[F.sum(v).over(so_far).alias(f"_{v}") for v in values])
    seen = totals.filter(F.col("_probe").isNotNull() & F.col(f"_{values[0]}").isNotNull())
    return seen.select("_probe.*", *[F.col(f"_{v}").alias(v) for v in values])


def visible_rows(state, probes, keys, values):
    """The rows of ``state`` that each (key, state_step) of the probes sees, where a key has many.

    A key's steps come as one list (one entry per fold at most), so each state row
    is joined once, however many versions and probes there are.
    """
    asked = probes.groupBy(*keys).agg(F.collect_set("state_step").alias("_all"))
    visible = F.filter("_all", lambda t: (F.col("valid_from") < t) & (t <= F.col("valid_to")))
    return lookup_join(state, asked, keys, "inner").select(F.explode(visible).alias("state_step"), *keys, *values)
