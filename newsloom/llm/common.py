"""Word expressions, running totals and staging shared by the operators of this folder."""

import os
import shutil
import tempfile

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.session import materialize

#: The blanks that part words; every other character belongs to a word.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


_shipped = set()


def ship(spark):
    """Send this package to the Python workers, once per application: they need not share the driver's folders."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        base = os.path.join(tempfile.mkdtemp(prefix="ship-"), "newsloom")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "newsloom"))
        _shipped.add(sc.applicationId)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(docs):
    return F.coalesce(docs["text"], F.lit(""))


def word_list(text):
    return F.array_remove(F.split(text, BLANK + "+"), "")


def word_count(text):
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def staged(df, name):
    """``df`` written below the shared folder and read back."""
    return materialize(df, name)


def unused(df, *names):
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df, rows=500_000):
    """A written table, marked for broadcast if it has at most ``rows`` rows; the join shuffles both sides otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def bucket_count(rows, size=50_000, least=32):
    """How many buckets hold ``rows`` rows at about ``size`` each."""
    return max(least, -(-rows // size))


def running(df, key, order, value, buckets, name):
    """Add ``name``: the sum of ``value`` over the rows of the same ``key`` that come earlier. Both may be lists of columns.

    Rows are ordered by ``order``, a list of columns of which the first is a 64-bit hash.
    One key may hold most rows: its hash range is cut into buckets, each bucket is summed by
    itself, and the sums of earlier buckets are added. No task holds more than a bucket.
    """
    values, names = ([value], [name]) if isinstance(value, str) else (value, name)
    width = 2 ** 64 // buckets + 1
    bucket = F.floor(F.col(order[0]) / F.lit(float(width))).cast("long")  # grows with the hash
    rows = df.withColumn("_bucket", bucket)
    keys = [F.col(k) for k in key]
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_sum{i}") for i, v in enumerate(values)])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in range(len(values))])
    rows = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_inside{i}") for i, v in enumerate(values)])
    same = [rows[k].eqNullSafe(totals[k]) for k in key] + [rows["_bucket"] == totals["_bucket"]]
    return rows.join(totals, same).select(*[rows[c] for c in df.columns], *[
        (rows[f"_inside{i}"] + totals[f"_before{i}"]).cast("long").alias(n) for i, n in enumerate(names)])
