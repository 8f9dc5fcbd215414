"""Lookup, semi and anti joins.

Joins carry no hints: Spark broadcasts a side that it measures to be small, and splits the
partitions of a hot key otherwise (adaptive execution, set in ``build_session``).
"""

from pyspark.sql import functions as F


def lookup_join(left, right, on, how="left"):
    """Join many rows to a table that is unique on ``on``."""
    return left.join(right, [on] if isinstance(on, str) else list(on), how)


def attach_article(clicks, articles, on="url"):
    """Clicks of known articles; clicks on unknown URLs are dropped."""
    return lookup_join(clicks, articles, on, "inner")


def encode(df, col, encoder, default=1, out=None):
    """Value -> code through (value, code); values not in the encoder get ``default``."""
    codes = encoder.select(F.col("value").alias(col), F.col("code").alias("_code"))
    out = out or f"{col}_code"
    return (lookup_join(df, codes, col)
            .withColumn(out, F.coalesce("_code", F.lit(default))).drop("_code"))


def decode(df, col, encoder, out=None):
    """Code -> original value; unknown codes give null (no pad item)."""
    values = encoder.select(F.col("code").alias(col), F.col("value").alias("_value"))
    out = out or f"{col}_value"
    return lookup_join(df, values, col).withColumnRenamed("_value", out)


def attach_metadata(df, catalog, cols, on="article_id"):
    return lookup_join(df, catalog.select(on, *cols), on)


def drop_known(new, known, on="id"):
    return new.join(known.select(on), on, "left_anti")


def split_known(new, known, on="id"):
    """Ids of the batch with a flag: already known or new."""
    marks = known.select(on).distinct().withColumn("known", F.lit(True))
    return (new.select(on).distinct().join(marks, on, "left")
            .withColumn("known", F.coalesce("known", F.lit(False))))
