"""Views of the sample tables in the shapes the jobs read."""

from pyspark.sql import Window, functions as F

from newsloom.functions.numeric import hash_digits
from newsloom.operators.sessions import session_clicks
from newsloom.schema import MS_HOUR
from newsloom.session import FILE_FACTOR, spread


def tune(spark):
    """Session settings the jobs rely on (all can be set at run time)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Many steps give several rows a row (pairs, lists): parts merged up to the default 64 MB fill a task's memory.
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)


def table(spark, folder, name):
    tune(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder):
    """Article texts, spread over the cores: text jobs cost per row."""
    return spread(table(spark, folder, "documents"))


def clicks(spark, folder):
    """events -> clicks: article_id = props.k + 1, time in whole milliseconds."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user_id"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("article_id"),
        F.floor(F.unix_micros(ts) / 1000).alias("ts_ms"),
        F.col("value").alias("active_time_secs"), "event_type")


def sessions(spark, folder, hours=6.0, min_items=2):
    return session_clicks(clicks(spark, folder), int(hours * MS_HOUR), min_items)


def catalog(spark, folder):
    """Articles 1..100: category and text from the sample tables, creation from the first click."""
    first = clicks(spark, folder).groupBy("article_id").agg(F.min("ts_ms").alias("first_ts"))
    emb = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("label").alias("category_id"))
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("article_id"), "n_chars")
    return (first.join(emb, "article_id").join(docs, "article_id")
            .select("article_id", "category_id",
                    (F.col("first_ts") - (F.col("article_id") % 48) * MS_HOUR).alias("created_at_ts"),
                    F.greatest(F.floor(F.col("n_chars") / 6), F.lit(1)).alias("text_length")))


def embeddings(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def baskets(spark, folder):
    """Order lines as sessions of parts: distinct parts in shipping order.

    The lines are shuffled once, by order: repeated parts and places are found in the same task.
    """
    lines = table(spark, folder, "lineitem").repartition("l_orderkey")
    first = lines.groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct(
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        "l_linenumber", "l_suppkey")).alias("f"))
    order = Window.partitionBy("l_orderkey").orderBy("f.ts_ms", "f.l_linenumber", "l_partkey", "f.l_suppkey")
    whole = Window.partitionBy("l_orderkey")
    user = F.col("l_orderkey").cast("string")
    return first.select(
        user.alias("user_id"), F.col("l_orderkey").alias("session_id"),
        F.row_number().over(order).alias("pos"),
        F.count("*").over(whole).cast("int").alias("session_size"),
        F.col("l_partkey").alias("item_id"), F.col("f.ts_ms").alias("ts_ms"),
        F.min("f.ts_ms").over(whole).alias("session_start"),
        hash_digits(user, 3).alias("user_hash"))
