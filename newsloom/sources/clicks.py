"""Click scans: JSON days, Parquet log, CSV with session ids, page-view lines."""

from datetime import date, timedelta

from pyspark.sql import functions as F, types as T

from newsloom.operators.sessions import assemble_sessions
from newsloom.schema import CLICKS_CSV, CLICKS_JSON


def read_clicks_json(spark, paths, schema=CLICKS_JSON):
    """JSON clicks of a list of days; malformed rows stay, with their text."""
    if "_corrupt_record" not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(paths)


def day_list(start, end):
    """ISO dates from start to end, both included."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return [(first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]


def month_list(start, end):
    """yyyy-MM months from start to end, both included."""
    return sorted({d[:7] for d in day_list(start, end)})


def click_log(df, start=None, end=None, domain=None):
    """One domain's clicks of known users with ``full_url`` and epoch ``time``.

    ``start``/``end`` bound the ``dt`` text as dates, so the range reaches the scan.
    """
    out = df
    if start is not None:
        out = out.filter(F.col("dt") >= start)
    if end is not None:
        out = out.filter(F.col("dt") < (date.fromisoformat(end) + timedelta(days=1)).isoformat())
    if domain is not None:
        out = out.filter(F.col("domain") == domain)
    return (out.filter(F.col("guid") != "-1")
            .withColumn("full_url", F.concat("domain", "path"))
            .withColumn("time", F.unix_timestamp("dt", "yyyy-MM-dd HH:mm:ss")))


def read_click_log(spark, path, start=None, end=None, domain=None, month_col=None):
    """Parquet log scan; with ``month_col`` (yyyy-MM partitions) only those months are read."""
    df = spark.read.parquet(path)
    if month_col and start and end:
        df = df.filter(F.col(month_col).isin(month_list(start, end)))
    return click_log(df, start, end, domain)


def read_clicks_csv(spark, paths):
    return spark.read.schema(CLICKS_CSV).option("header", True).csv(paths)


CSV_LISTS = ["click_article_id", "click_timestamp", "click_environment", "click_deviceGroup",
             "click_os", "click_country", "click_region", "click_referrer_type"]


def sessions_from_csv(clicks):
    """One row per session with its click columns as lists in time order."""
    ordered = ["click_timestamp"] + [c for c in CSV_LISTS if c != "click_timestamp"]
    packed = clicks.withColumnRenamed("click_timestamp", "_t").withColumn("click_timestamp", F.col("_t"))
    return assemble_sessions(packed, "session_id", ["_t"], ordered, ["user_id", "session_start", "session_size"])


PAGE_VIEW = [("url", "string"), ("time_now", "long"), ("time_on_site", "long"), ("time_on_read", "long")]


def parse_page_views(lines, col="value"):
    """Tab-separated page views -> (typed rows, rejected lines).

    A line is good when it has four fields and three whole numbers.
    """
    parts = F.split(col, "\t")
    typed = [F.get(parts, i).alias(n) if t == "string" else
             F.get(parts, i).try_cast(t).alias(n) for i, (n, t) in enumerate(PAGE_VIEW)]
    parsed = lines.select(F.col(col).alias("_line"), F.size(parts).alias("_n"), *typed)
    good = F.col("_n") == 4
    for name, kind in PAGE_VIEW[1:]:
        good = good & F.col(name).isNotNull()
    names = [n for n, _ in PAGE_VIEW]
    return parsed.filter(good).select(*names), parsed.filter(~good).select(F.col("_line").alias(col))
