"""Article catalogue scans."""

from pyspark.sql import functions as F, types as T

from newsloom.functions.numeric import publish_secs
from newsloom.functions.text import assemble_text
from newsloom.operators.catalog import clean_articles

FIELD_LIST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
])


def _scalar(fields, name):
    """A text value of the key/value list; a one-member JSON list gives its member."""
    raw = F.try_element_at(fields, F.lit(name))
    listed = F.from_json(raw, "array<string>")
    return F.coalesce(F.when(raw.startswith("["), F.get(listed, 0)).otherwise(raw), F.lit(""))


def _list(fields, name):
    raw = F.try_element_at(fields, F.lit(name))
    return F.coalesce(
        F.when(raw.startswith("["), F.from_json(raw, "array<string>")),
        F.when(raw.isNotNull() & (raw != ""), F.array(raw)),
        F.array().cast("array<string>"))


def parse_articles(lines, col="value"):
    """One JSON article per row -> catalogue columns; 'null' bodies are left out.

    The last value of a repeated field wins.
    """
    rows = lines.filter(F.trim(col) != "null").select(F.from_json(col, FIELD_LIST).alias("a"))
    entries = F.col("a.fields")
    names = F.transform(entries, lambda e: e["field"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(
        F.slice(names, i + 2, F.size(names)), e["field"]))
    rows = rows.select("a.id", "a.url", "a.title", F.map_from_entries(
        F.transform(last, lambda e: F.struct(e["field"], e["value"]))).alias("f"))
    f = F.col("f")
    publish = F.when(_scalar(f, "publishtime") != "", _scalar(f, "publishtime")).otherwise(_scalar(f, "createtime"))
    heading = F.array_join(F.array_distinct(_list(f, "heading")), ". ")
    body = F.array_join(_list(f, "body"), " ")
    title = F.coalesce("title", _scalar(f, "title"))
    return rows.select(
        "id", F.coalesce("url", _scalar(f, "url")).alias("url"),
        _scalar(f, "og-site-name").alias("site"),
        _scalar(f, "adressa-access").alias("adressa-access"),
        _scalar(f, "author").alias("author_1st"),
        publish.alias("publishtime"),
        (publish_secs(publish) * 1000).alias("created_at_ts"),
        assemble_text([title, _scalar(f, "teaser"), heading, body]).alias("text_highlights"),
        *[F.array_join(_list(f, f"kw-{k}"), ",").alias(c) for k, c in
          [("concept", "concepts"), ("entity", "entities"), ("location", "locations"), ("person", "persons")]],
        *[_scalar(f, c).alias(c) for c in ("category0", "category1", "category2", "keywords")])


def read_articles_json(spark, path):
    """Article folder -> (catalogue, counts of read, empty and invalid files).

    Each file repeats one article, so its first line is used.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.split("value", "\n")[0].alias("value"))
    empty = F.trim("value") == "null"
    counts = files.agg(
        F.count("*").alias("files"), F.sum(empty.cast("long")).alias("empty"),
        F.sum((~empty & F.from_json("value", FIELD_LIST)["id"].isNull()).cast("long")).alias("invalid"))
    catalog = parse_articles(files).filter(F.col("id").isNotNull())
    return clean_articles(catalog, order=["url"]), counts
