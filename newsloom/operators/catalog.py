"""Article catalogue: cleaning, incremental reads, merging, slices."""

from pyspark.sql import Window, functions as F

from newsloom.functions import text as X
from newsloom.operators.joins import drop_known, lookup_join
from newsloom.operators.ranking import global_rank

# Categories and sites left out of the catalogue.
CATEGORIES_TO_IGNORE = ["bolig", "abonnement"]
SITES_TO_IGNORE = ["kundeservice.adressa.no"]


def first_per_id(df, id_col, order):
    """First row per id by (order columns); a group limit keeps one row per task and id."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    return ranked.filter(F.col("_r") == 1).drop("_r")


def clean_clicks(clicks, domain=None, anonymous="-1", deny=None, required=()):
    """Row filters of the click job: domain, anonymous users, deny-lists, nulls."""
    out = clicks
    if domain is not None:
        out = out.filter(F.col("domain") == domain)
    if "guid" in clicks.columns:
        out = out.filter(F.col("guid") != anonymous)
    for col, values in (deny or {}).items():
        out = out.filter(~F.col(col).isin(values))
    return out.dropna(subset=list(required)) if required else out


def clean_articles(articles, id_col="id", order=("id",), categories=CATEGORIES_TO_IGNORE, sites=SITES_TO_IGNORE):
    kept = articles.filter(
        ~F.col("category0").isin(categories) & ~F.col("site").cast("string").isin(sites))
    return first_per_id(kept, id_col, order)


def resolve_article_fields(articles):
    """Publish time (else creation time), first author, distinct headings."""
    publish = F.when(F.coalesce("publishtime", F.lit("")) != "", F.col("publishtime")).otherwise(F.col("createtime"))
    return (articles.withColumn("publishtime", publish)
            .withColumn("author_1st", F.coalesce(F.get("author", 0), F.lit("")))
            .withColumn("heading", F.array_distinct("heading")))


def read_incremental(df, ts_col, watermark, end):
    """Rows after the stored mark up to ``end``, and the new mark.

    The mark is a one-row table; an empty read keeps it.
    """
    mark = watermark.agg(F.max("mark")).scalar()
    rows = df.filter((F.col(ts_col) > mark) & (F.col(ts_col) <= end))
    new_mark = rows.agg(F.coalesce(F.max(ts_col), mark).alias("mark"))
    return rows, new_mark


def append_catalog(old, new):
    return old.unionByName(new, allowMissingColumns=True)


def merge_catalog(old, new, id_col="article_id", pad_id=0):
    """Stored rows plus new ones; stored ids win and the pad row is kept once."""
    fresh = new.filter(F.col(id_col) != pad_id).join(old.select(id_col), id_col, "left_anti")
    return old.unionByName(fresh)


def latest_slice(catalog, n=600, id_col="article_id", ts="created_at_ts"):
    """The newest n articles with ids renumbered 1..n in age order (0 stays free for the pad)."""
    newest = catalog.orderBy(F.desc(ts), F.desc(id_col)).limit(n)
    # At most n rows: one small window group.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(ts, id_col))
    return newest.withColumn("new_id", place)


def number_articles(articles, id_col="id", ts="created_at_ts"):
    """Contiguous article codes from 1 in (time, id) order over the whole catalogue."""
    return global_rank(articles, [(ts, True), (id_col, True)], "article_id")


def prepare_articles(raw, known=None, domain=None, ner=None, remove_bad_chars=False):
    """Portal article job: filters, HTML to text, keywords, text assembly, new ids only.

    ``ner`` adds ``persons`` and ``locations`` to a frame (a user's own function).
    """
    rows = raw
    if domain is not None:
        rows = rows.filter(F.col("sourceNews") == domain)
    rows = rows.dropna().filter(F.col("is_deleted") == 0)
    rows = rows.withColumn("content", X.html_to_text("content", remove_bad_chars))
    if ner is not None:
        rows = ner(rows)
    out = rows.select(
        F.col("newsId").alias("id"), "content",
        F.unix_timestamp(F.col("publishDate").cast("timestamp")).alias("created_at_ts"),
        F.col("sapo").alias("teaser"), F.col("sourceNews").alias("domain"),
        X.semicolons_to_commas("tags").alias("keywords"), "title", "url",
        F.col("catId").alias("category0"),
        *[c for c in ("persons", "locations") if c in rows.columns],
        F.concat_ws("|", "title", "sapo", "content").alias("text_highlights"))
    return drop_known(out, known) if known is not None else out


def attach_url(clicks, articles):
    """Clicks with a canonical URL joined to the article ids of known URLs."""
    canon = clicks.withColumn("url", X.canonical_url("url"))
    known = first_per_id(articles.select(X.canonical_url("url").alias("url"), "article_id"), "url", ["article_id"])
    return lookup_join(canon, known, "url", "inner")
