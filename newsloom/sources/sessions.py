"""Session tables on disk: hour partitions, example rows, retention, last hours."""

from pyspark.sql import functions as F

from newsloom.operators.joins import decode
from newsloom.operators.sessions import truncate_sessions
from newsloom.schema import KEY


def write_sessions(df, path, fmt="parquet", mode="error"):
    """Sessions partitioned by hour (Parquet, or JSON lines).

    The rebalance hint gives small hours one file and splits a hot hour by size.
    """
    (df.hint("rebalance", F.col("session_hour"))
     .write.mode(mode).partitionBy("session_hour").format(fmt).save(path))


def read_session_hours(spark, path, upto=None, fmt="parquet", schema=None):
    """Hour partitions 0..upto; the bound prunes folders before any file is opened."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.filter(F.col("session_hour") <= upto) if upto is not None else df


def write_examples(df, path, rows_per_file=None, by=("session_hour",), mode="error"):
    """Struct-of-arrays rows, one folder per hour or files of at most N rows."""
    if by:
        df = df.hint("rebalance", *[F.col(c) for c in by])
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)


def retain_hours(df, n, col="session_hour"):
    """Rows of the newest n hours counted back from the last one."""
    last = df.agg(F.max(col)).scalar()
    return df.filter(F.col(col) > last - n)


def last_hours_sessions(flat, encoder, n, max_len=20):
    """Sessions of the newest n hours as lists of original article ids."""
    recent = truncate_sessions(retain_hours(flat, n), max_len)
    named = decode(recent.select(*KEY, "session_hour", "pos", "item_id"), "item_id", encoder, "article")
    return named.groupBy(*KEY, "session_hour").agg(
        F.sort_array(F.collect_list(F.struct("pos", "article"))).alias("_l")).select(
        *KEY, "session_hour", F.transform("_l", lambda x: x["article"]).alias("items"))
