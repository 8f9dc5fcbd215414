"""Value encoders: (value, code) tables fitted by frequency or domain."""

from pyspark.sql import functions as F

from newsloom.operators.ranking import global_rank
from newsloom.operators.joins import lookup_join
from newsloom.schema import PAD_TOKEN, UNFREQUENT_TOKEN


def value_counts(df, col):
    return (df.groupBy(F.col(col).cast("string").alias("value"))
            .agg(F.count("*").alias("count")).filter(F.col("value").isNotNull()))


def _reserved(spark, pad, unf):
    rows = ([PAD_TOKEN] if pad else []) + ([UNFREQUENT_TOKEN] if unf else [])
    return spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "value string, code int"), len(rows)


def _number(counts, pad, unf, order):
    reserved, shift = _reserved(counts.sparkSession, pad, unf)
    numbered = global_rank(counts, order).select(
        "value", (F.col("rn") - 1 + shift).cast("int").alias("code"))
    return reserved.unionByName(numbered)


def fit_encoder(df, col, min_freq=100, pad=True, unf=True):
    """Codes for frequent values: 0 pad, 1 infrequent, then by falling count."""
    counts = value_counts(df, col).filter(F.col("count") >= min_freq)
    return _number(counts, pad, unf, [("count", False), ("value", True)])


def fit_full_encoder(df, col, pad=True, unf=False):
    """Codes for every value in sorted order."""
    return _number(value_counts(df, col), pad, unf, [("value", True)])


def fit_list_encoder(df, col, min_freq=100, pad=True, unf=False):
    """Frequency encoder over the members of a list column."""
    return fit_encoder(df.select(F.explode(col).alias(col)), col, min_freq, pad, unf)


def extend_encoder(encoder, new_values):
    """Append values not yet known with codes max+1, max+2, ... in value order."""
    fresh = (new_values.select(F.col("value").cast("string").alias("value")).distinct()
             .join(encoder.select("value"), "value", "left_anti"))
    top = encoder.agg(F.max("code")).scalar()
    numbered = global_rank(fresh, [("value", True)]).select(
        "value", (F.col("rn") + top).cast("int").alias("code"))
    return encoder.select("value", "code").unionByName(numbered)


def encode_known(df, col, encoder, default=0):
    """Re-encode with a stored encoder: unseen scalar values get ``default`` (pad)."""
    codes = encoder.select(F.col("value").alias(col), F.col("code").alias("_code"))
    return (lookup_join(df, codes, col)
            .withColumn(f"{col}_code", F.coalesce("_code", F.lit(default))).drop("_code"))


def encode_known_list(df, id_col, col, encoder, default=0, keep_unseen=True):
    """Re-encode the members of a list, keeping their order.

    Unseen members become ``default``, or are left out with ``keep_unseen=False``.
    """
    rows = df.select(id_col, F.posexplode_outer(col).alias("_i", "value"))
    coded = lookup_join(rows, encoder.select("value", "code"), "value")
    code = F.coalesce("code", F.lit(default)) if keep_unseen else F.col("code")
    member = F.when(F.col("value").isNotNull() & code.isNotNull(), F.struct(F.col("_i"), code.alias("code")))
    return (coded.groupBy(id_col)
            .agg(F.sort_array(F.collect_list(member)).alias("_c"))
            .select(id_col, F.transform("_c", lambda x: x["code"]).alias(f"{col}_codes")))


def encode_dims_again(clicks, encoder, dims, min_freq=100, default=1):
    """Re-encode click dimensions with stored (feature, value, code) rows.

    Values below ``min_freq`` in this batch are treated as infrequent, and
    unseen values get ``default``.
    """
    out = clicks
    for dim in dims:
        frequent = (value_counts(clicks, dim).filter(F.col("count") >= min_freq)
                    .select("value"))
        codes = (encoder.filter(F.col("feature") == dim)
                 .join(frequent, "value", "left_semi")
                 .select(F.col("value").alias(dim), F.col("code").alias("_code")))
        out = (lookup_join(out.withColumn(dim, F.col(dim).cast("string")), codes, dim)
               .withColumn(f"{dim}_code", F.coalesce("_code", F.lit(default))).drop("_code"))
    return out
