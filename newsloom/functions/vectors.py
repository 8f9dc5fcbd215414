"""Vector expressions over ``ARRAY<DOUBLE>`` columns."""

from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a, b):
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(F.aggregate(
        _col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b):
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(a, scale=1.0):
    """Unit vector times ``scale``; a zero vector stays zero."""
    a = _col(a)
    n = norm(a)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / n * F.lit(float(scale)))


def multi_hot(codes, size):
    """0/1 vector with a one at every listed code; slot 0 (pad) stays zero."""
    codes = _col(codes)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.when((i > 0) & F.array_contains(codes, i), 1).otherwise(0))


def min_max_scale(df, id_col, vec_col, lo=-1.0, hi=1.0):
    """Scale every component to [lo, hi] over the table.

    Component ranges come from one partially aggregated group per component
    (the dimension count bounds them) and travel back as a single row.
    """
    parts = df.select(id_col, F.posexplode(vec_col).alias("dim", "x"))
    ranges = (parts.groupBy("dim")
              .agg(F.min("x").cast("double").alias("mn"), F.max("x").cast("double").alias("mx"))
              .agg(F.sort_array(F.collect_list(F.struct("dim", "mn", "mx"))).alias("r")))
    span = ranges.select("r").scalar()
    scaled = F.zip_with(
        F.col(vec_col), F.col("_r"),
        lambda x, r: F.when(r["mx"] == r["mn"], F.lit(float(lo))).otherwise(
            (x.cast("double") - r["mn"]) / (r["mx"] - r["mn"]) * (hi - lo) + lo))
    return df.withColumn("_r", span).select(id_col, scaled.alias(vec_col))
