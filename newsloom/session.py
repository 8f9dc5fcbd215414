"""Spark session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Times its file that a table takes in memory.  Tables of clicks and candidates repeat their keys, so the files are
#: that much smaller than the hash table which the driver builds of a broadcast side.
FILE_FACTOR = "20"


def build_session(app="newsloom", master=None, shuffle_partitions=None, **conf):
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
        .config("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would lose its data with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="newsloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def task_count(spark):
    """Tasks for a step whose cost is per row, not per byte.

    A given count keeps adaptive execution from merging small but expensive
    partitions into a few tasks.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df):
    """Shuffle a scan only when it has fewer splits than the cluster has cores."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def fresh_path(spark, name):
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark drops a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name, **options):
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Nothing reads the shuffles of the write again: their files go when it ends, not when the driver collects its garbage.
    """
    conf, path = df.sparkSession.conf, fresh_path(df.sparkSession, name)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df):
    """Delete the files of a table that ``materialize`` wrote and no later step reads."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
