"""Versioned table bundles and the newest version of a dated folder."""

from pyspark.sql import functions as F


def write_catalog_bundle(path, version, **tables):
    """Encoders, catalogue and embeddings under one version folder."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}/version={version}")


def latest_version(spark, path, column="version"):
    """Rows of the newest version partition (a partition filter, so only it is read)."""
    df = spark.read.parquet(path)
    newest = df.select(column).distinct().agg(F.max(column)).scalar()
    return df.filter(F.col(column) == newest)


def read_catalog_bundle(spark, path, names):
    return {name: latest_version(spark, f"{path}/{name}").drop("version") for name in names}
