"""URL, text, time and number expressions inside their cleaning jobs."""

from pyspark.sql import functions as F

from newsloom.checks.base import CATALOG, CLICKS, check, session_ctes, with_sql
from newsloom.functions import numeric as N, text as X, vectors as V
from newsloom.operators import catalog as C, content as Z, features as Q
from newsloom.schema import KEY
from newsloom.sources import samples
from newsloom.sources.clicks import parse_page_views

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
SP = X.SPACE
P = X.PUNCTUATION


def q(text):
    return "'" + text.replace("'", "''") + "'"


def rx(expr, pattern, replacement):
    return f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"


def clean_sql(expr):
    """The cleaning steps for an engine without look-around."""
    e = f"lower(replace({expr}, chr(10), ' '))"
    for pattern, replacement in [
        ("…", "..."), (r"\.\.\.", ""), (r"\{.*\}", ""), ("–", "-"), (r"<(/|\\)?.+?>", " "),
        (r"\p{Nd}", "0"), (rf"(http|https)://[^{SP}]+", "URL"), (rf"[^{SP}]+@[^{SP}]+", "EMAIL"),
        (rf"(^|{NW})[‘’′`']", r'\1"'), (rf"[‘’`′']({NW}|$)", r'"\1'), ("[‘’`′“”]", '"'), ('"', ""),
        # two passes: neighbours of a match cannot be shared without look-around
        (r"(^|[^.])\.\.([^.]|$)", r"\1.\2"), (r"(^|[^.])\.\.([^.]|$)", r"\1.\2"),
        (r'([,";:]){2},', r"\1"), (r" -(\p{L})", r" - \1"),
        (rf"({W}+)([{P}])([ {P}])", r"\1 \2 \3"), (rf"([ {P}])([{P}])({W}+)", r"\1 \2 \3"),
        (rf"({W}+)([{P}])$", r"\1 \2"), ("''", "'"), (" +", " "),
        (rf"^[{SP}]+|[{SP}]+$", ""),
    ]:
        e = rx(e, pattern, replacement)
    return e


SENT = f"string_split({rx('{0}', rf'([.!?])[{SP}]+', chr(92) + '1' + chr(1))}, chr(1))"
TOK = f"regexp_extract_all({{0}}, {q(rf'[{chr(92)}p{{L}}{chr(92)}p{{N}}_]+|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{SP}]')})"


def tok(expr):
    return TOK.replace("{0}", expr)


def sent(expr):
    return SENT.replace("{0}", expr)


@check("b1_canonical_url", r"SELECT page_id, regexp_replace(url, 'https?://', '', 'g') AS url FROM pages")
def b1(spark, d):
    return samples.table(spark, d, "pages").select("page_id", X.canonical_url("url").alias("url"))


PORTAL_URL = """(url || '-' || CAST(page_id + 20190000000 AS VARCHAR)
  || CASE WHEN page_id % 3 = 0 THEN 'rf' || CAST(page_id AS VARCHAR) ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN '.htm' ELSE '.chn' END)"""


@check("b2_article_id_from_url", f"""
SELECT page_id, CAST(nullif(regexp_extract({PORTAL_URL}, '-([0-9]+)(rf[0-9]+)?.chn', 1), '') AS BIGINT)
  AS article_id FROM pages""")
def b2(spark, d):
    pages = samples.table(spark, d, "pages").withColumn("url", F.expr(PORTAL_URL.replace("VARCHAR", "STRING")))
    return pages.select("page_id", X.article_id_from_url("url").alias("article_id"))


HOST = r"^(?:https?://)?(?:[^@/\n]+@)?(?:www\.)?([^:/\n]+)"


@check("b3_url_host", f"""
SELECT page_id, regexp_extract(url, {q(HOST)}, 1) AS host, regexp_extract(url, {q(HOST)}, 0) AS full_match FROM pages""")
def b3(spark, d):
    return samples.table(spark, d, "pages").select(
        "page_id", X.url_host("url").alias("host"), X.url_host("url", full=True).alias("full_match"))


@check("b4_url_encode_decode", """
SELECT page_id, replace(url_encode(u), '%2F', '/') AS encoded, u AS decoded, u AS plain
FROM (SELECT page_id, url || ' a+b~c*d/100%' AS u FROM pages)""")
def b4(spark, d):
    urls = samples.table(spark, d, "pages").select("page_id", F.concat("url", F.lit(" a+b~c*d/100%")).alias("u"))
    coded = urls.withColumn("encoded", X.url_encode("u"))
    return coded.select("page_id", "encoded", X.url_decode("encoded").alias("decoded"), X.url_decode(
        F.regexp_replace("u", "%(?=[0-9A-Fa-f]{2})", "%25")).alias("plain"))


FAMILY = """CASE CAST(c_custkey % 7 AS INTEGER) WHEN 0 THEN 'Symbian^3' WHEN 1 THEN 'BlackBerry Tablet'
  WHEN 2 THEN 'iOS' WHEN 3 THEN 'Android' WHEN 4 THEN 'Windows' WHEN 5 THEN 'Plan 9' ELSE c_mktsegment END"""


@check("b5_normalize_os", f"""
SELECT os, count(*) AS n FROM (
  SELECT CASE WHEN contains(f, 'Symbian') THEN 'Symbian OS' WHEN contains(f, 'BlackBerry') THEN 'BlackBerry OS'
              WHEN f IN ({', '.join(q(x) for x in X.OS_FAMILIES)}) THEN f ELSE 'Other' END AS os
  FROM (SELECT {FAMILY} AS f FROM customer)) GROUP BY os""")
def b5(spark, d):
    rows = samples.table(spark, d, "customer").select(F.expr(FAMILY.replace("INTEGER", "INT")).alias("f"))
    return rows.groupBy(X.normalize_os("f").alias("os")).agg(F.count("*").alias("n"))


@check("b6_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def b6(spark, d):
    return samples.documents(spark, d).select(
        "doc_id", F.md5(X.strip_accents("text").cast("binary")).alias("h"))


@check("b7_row_filters", """
SELECT doc_id, source, lang FROM (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents WHERE lang NOT IN ('de') AND source NOT IN ('src1') AND n_chars IS NOT NULL)
WHERE rn = 1""")
def b7(spark, d):
    docs = samples.documents(spark, d)
    kept = C.clean_clicks(docs, deny={"lang": ["de"], "source": ["src1"]}, required=["n_chars"])
    return C.first_per_id(kept, "text", ["doc_id"]).select("doc_id", "source", "lang")


@check("b8_elapsed_since_published", with_sql([CLICKS, CATALOG], """
SELECT event_id, CAST(trunc((ts_ms // 1000 - created_at_ts // 1000) / 60.0) AS INTEGER) AS elapsed_min_since_published,
       strftime(to_timestamp(created_at_ts // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS publishtime
FROM clicks JOIN catalog USING (article_id)"""))
def b8(spark, d):
    cat = samples.catalog(spark, d).select("article_id", F.date_format(
        F.timestamp_seconds(F.floor(F.col("created_at_ts") / 1000)), "yyyy-MM-dd'T'HH:mm:ss").alias("publishtime"))
    joined = samples.clicks(spark, d).join(cat, "article_id")
    return joined.select("event_id", "publishtime", N.elapsed_minutes(
        F.floor(F.col("ts_ms") / 1000), N.publish_secs("publishtime")).alias("elapsed_min_since_published"))


@check("b9_resolve_article_fields", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS publishtime,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS author_1st,
       CASE WHEN lang = source THEN lang ELSE lang || '. ' || source END AS heading
FROM documents""")
def b9(spark, d):
    docs = samples.documents(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("publishtime"),
        F.col("source").alias("createtime"),
        F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("author"),
        F.array("lang", "source", "lang").alias("heading"))
    return C.resolve_article_fields(docs).select(
        "doc_id", "publishtime", "author_1st", F.array_join("heading", ". ").alias("heading"))


ZONES = [("oslo", "Europe/Oslo"), ("sao_paulo", "America/Sao_Paulo"), ("ho_chi_minh", "Asia/Ho_Chi_Minh")]


@check("b10_local_time", with_sql([CLICKS], "SELECT event_id, " + ", ".join(
    f"hour(t_{n}) + minute(t_{n}) / 60.0 AS hour_{n}, isodow(t_{n}) - 1 AS weekday_{n}" for n, _ in ZONES).replace(
    "hour(t_", "hour(t_") + " FROM (SELECT event_id, " + ", ".join(
    f"(to_timestamp(ts_ms // 1000) AT TIME ZONE '{z}') AS t_{n}" for n, z in ZONES) + " FROM clicks)"))
def b10(spark, d):
    cols = [c for n, z in ZONES for c in (
        N.local_hour("ts_ms", z).alias(f"hour_{n}"), N.local_weekday("ts_ms", z).alias(f"weekday_{n}"))]
    return samples.clicks(spark, d).select("event_id", *cols)


@check("b11_b12_cyclic_hour_and_weekday", with_sql([CLICKS], """
SELECT event_id, round(sin(a), 6) AS hour_sin, round(cos(a), 6) AS hour_cos,
       round((wd + 1 - 3.5) / 7, 6) AS weekday_centered, round((wd + 1) / 7, 6) AS weekday_plain
FROM (SELECT event_id, isodow(t) - 1 AS wd,
             (hour(t) + minute(t) / 60.0 + 0.000001) / 24.0 * 2 * pi() AS a
      FROM (SELECT event_id, to_timestamp(ts_ms // 1000) AT TIME ZONE 'Europe/Oslo' AS t FROM clicks))"""))
def b11(spark, d):
    sin, cos = N.cyclic(N.local_hour("ts_ms", "Europe/Oslo"))
    wd = N.local_weekday("ts_ms", "Europe/Oslo")
    return samples.clicks(spark, d).select(
        "event_id", F.round(sin, 6).alias("hour_sin"), F.round(cos, 6).alias("hour_cos"),
        F.round(N.scale_weekday(wd), 6).alias("weekday_centered"),
        F.round(N.scale_weekday(wd, centered=False), 6).alias("weekday_plain"))


@check("b13_standardize_capped", with_sql(session_ctes(0.5)[:3], """
SELECT event_id, round((least(elapsed_ms, 3600000.0) - 789935.7) / 1371436.0, 6) AS elapsed,
       round((least(trunc(active_time_secs), 900.0) - 65.0) / 69.37, 6) AS active_time FROM seq"""))
def b13(spark, d):
    from newsloom.operators.sessions import sessionize
    rows = sessionize(samples.clicks(spark, d))
    return rows.select("event_id", F.round(N.standardize("elapsed_ms", "elapsed_ms"), 6).alias("elapsed"),
                       F.round(N.standardize("active_time_secs", "active_time_secs"), 6).alias("active_time"))


@check("b14_active_time_by_word", with_sql([CLICKS, CATALOG], """
SELECT event_id, round((least(trunc(
    coalesce(CASE WHEN event_id % 4 <> 0 THEN active_time_secs * 100 END, 65.0)
    / coalesce(c.text_length, 728)), 10.0) - 1.854) / 1.474, 6) AS active_time_secs_by_word
FROM clicks k LEFT JOIN (SELECT * FROM catalog WHERE article_id <= 80) c USING (article_id)"""))
def b14(spark, d):
    clicks = samples.clicks(spark, d).withColumn("active_time_secs", F.when(
        F.col("event_id") % 4 != 0, F.col("active_time_secs") * 100))
    known = samples.catalog(spark, d).filter("article_id <= 80")
    out = Q.active_time_by_word(clicks, known, on="article_id")
    return out.select("event_id", F.round("active_time_secs_by_word", 6).alias("active_time_secs_by_word"))


@check("b15_assemble_text", """
SELECT doc_id, md5(replace(replace(lang || ' | ' || source || ' |  | ' || text, '"', ''), chr(173), '')) AS h FROM documents""")
def b15(spark, d):
    docs = samples.documents(spark, d)
    text = X.assemble_text(["lang", "source", F.lit(None).cast("string"), "text"])
    return docs.select("doc_id", F.md5(text.cast("binary")).alias("h"))


# References that the tables hold, and some they do not.
NAMED = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("middot", "·"), ("copy", "©"), ("reg", "®"),
         ("laquo", "«"), ("raquo", "»"), ("euro", "€"), ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"),
         ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("eacute", "é"), ("oslash", "ø"), ("times", "×")]


def html_sql(expr, drop):
    e = rx(expr, r"(?s)<!--.*?-->", "")
    e = rx(e, r"(?is)<script\b.*?</script>", "")
    e = rx(e, r"(?is)<style\b.*?</style>", "")
    e = rx(e, r"""(?s)<(/?[A-Za-z]([^>"']|"[^"]*"|'[^']*')*|[!?][^>]*)>""", "")
    e = rx(e, r"(?s)</?[A-Za-z][^>]*>", "")
    for name, char in NAMED:
        e = f"replace({e}, '&{name};', {q(char)})"
    e = f"replace({e}, '&amp;', '&')"
    return f"translate({e}, {q(X.BAD_CHARACTERS)}, '')" if drop else e


@check("b16_html_to_text", f"""
SELECT page_id, md5({html_sql('html', False)}) AS text_hash, length({html_sql('html', False)}) AS n_chars,
       md5({html_sql('html', True)}) AS filtered_hash FROM pages""")
def b16(spark, d):
    text = X.html_to_text("html")
    return samples.table(spark, d, "pages").select(
        "page_id", F.md5(text.cast("binary")).alias("text_hash"), F.length(text).cast("long").alias("n_chars"),
        F.md5(X.html_to_text("html", remove_bad_chars=True).cast("binary")).alias("filtered_hash"))


@check("b17_clean_text", f"SELECT doc_id, md5({clean_sql('text')}) AS h FROM documents")
def b17(spark, d):
    return samples.documents(spark, d).select(
        "doc_id", F.md5(X.clean_text("text").cast("binary")).alias("h"))


@check("b18_first_sentences", f"""
SELECT doc_id, md5(array_to_string(list_transform(list_slice(list_filter({sent('text')},
    lambda s: length(s) - length(replace(s, ' ', '')) >= 3 AND right(s, 1) IN ('.', '!', '?', ';')), 1, 8),
    lambda s: {clean_sql('s')}), ' ')) AS h FROM documents""")
def b18(spark, d):
    return samples.documents(spark, d).select(
        "doc_id", F.md5(X.first_sentences("text").cast("binary")).alias("h"))


@check("b19_sentence_tokens", f"""
SELECT doc_id, array_to_string(list_slice(flatten(list_slice(list_filter(
    list_transform({sent("replace(text, '|', '.')")}, lambda s: {tok('s')}),
    lambda t: len(t) >= 3 AND t[-1] IN ('.', '!', '?', ';') AND t <> ['Saken', 'oppdateres', '.']), 1, 12)),
    1, 1000), ' ') AS tokens FROM documents""")
def b19(spark, d):
    return samples.documents(spark, d).select(
        "doc_id", F.array_join(X.sentence_tokens("text"), " ").alias("tokens"))


@check("b20_tokenize", f"""
SELECT doc_id, md5(array_to_string(list_transform(t, lambda x, i:
    CASE WHEN i > 1 AND t[i - 1] IN ('.', '?', '!') AND x NOT IN ('.', '?', '!') THEN lower(x) ELSE x END), ' ')) AS h,
    CAST(len(t) AS BIGINT) AS n
FROM (SELECT doc_id, {tok('text')} AS t FROM documents)""")
def b20(spark, d):
    tokens = Z.tokenize_articles(samples.documents(spark, d), "doc_id", "text", lower_first=True)
    return tokens.select("doc_id", F.md5(F.array_join("tokens", " ").cast("binary")).alias("h"),
                         F.size("tokens").cast("long").alias("n"))


@check("b22_split_list", """
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','),
    lambda x: trim(x)), lambda x: x <> ''), '|') AS parts,
    replace(p_name || ';' || p_type, ';', ',') AS commas FROM part""")
def b22(spark, d):
    part = samples.table(spark, d, "part")
    listed = F.concat_ws(", ,", "p_name", "p_type")
    return part.select("p_partkey", F.array_join(X.split_list(listed), "|").alias("parts"),
                       X.semicolons_to_commas(F.concat_ws(";", "p_name", "p_type")).alias("commas"))


@check("b23_log_base", """
SELECT event_id, round(ln(value + 0.01) / ln(2), 6) AS log2, round(ln(1 + value) / ln(1.3), 6) AS log1p_13 FROM events""")
def b23(spark, d):
    return samples.table(spark, d, "events").select(
        "event_id", F.round(N.log_base(F.col("value") + 0.01, 2), 6).alias("log2"),
        F.round(N.log1p_base("value", 1.3), 6).alias("log1p_13"))


@check("b24_time_decay", with_sql([CLICKS, CATALOG], """
SELECT event_id, CAST(ts_ms // 1000 - created_at_ts // 1000 AS DOUBLE) / 86400 AS days,
       round(1.0 / pow(1.5, (ts_ms // 1000 - created_at_ts // 1000) / 86400.0), 6) AS decay
FROM clicks JOIN catalog USING (article_id)"""))
def b24(spark, d):
    joined = samples.clicks(spark, d).join(samples.catalog(spark, d), "article_id")
    new, old = F.floor(F.col("ts_ms") / 1000), F.floor(F.col("created_at_ts") / 1000)
    return joined.select("event_id", N.days_between(new, old).alias("days"),
                         F.round(N.time_decay(new, old), 6).alias("decay"))


@check("b28_l2_normalize", """
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(x / sqrt(n2) * 2.5, 6) AS x FROM (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim,
         list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS n2 FROM embeddings)""")
def b28(spark, d):
    emb = samples.table(spark, d, "embeddings").select("vec_id", V.l2_normalize("embedding", 2.5).alias("e"))
    return emb.select("vec_id", F.posexplode("e").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("long"), F.round("x", 6).alias("x"))


@check("b29_min_max_scale", """
SELECT vec_id, dim, round((x - mn) / (mx - mn) * 2 - 1, 6) AS x FROM (
  SELECT vec_id, dim, x, min(x) OVER (PARTITION BY dim) AS mn, max(x) OVER (PARTITION BY dim) AS mx FROM (
    SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
           CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim FROM embeddings))""")
def b29(spark, d):
    scaled = V.min_max_scale(samples.table(spark, d, "embeddings"), "vec_id", "embedding")
    return scaled.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("long"), F.round("x", 6).alias("x"))


@check("b30_multi_hot", with_sql(session_ctes(24), """
SELECT user_id, session_id, (SELECT string_agg(CASE WHEN i > 0 AND list_contains(items, i) THEN '1' ELSE '0' END, '' ORDER BY i)
   FROM range(0, 101) r(i)) AS hot
FROM (SELECT user_id, session_id, list(item_id) AS items FROM sc GROUP BY ALL)"""))
def b30(spark, d):
    items = samples.sessions(spark, d, 24).groupBy(*KEY).agg(
        F.collect_list(F.col("item_id").cast("int")).alias("items"))
    return items.select(*KEY, F.array_join(V.multi_hot("items", 101).cast("array<string>"), "").alias("hot"))


LINE = """CASE WHEN event_id % 10 = 0 THEN event_type || chr(9) || 'x'
  WHEN event_id % 10 = 1 THEN event_type || chr(9) || '1' || chr(9) || 'two' || chr(9) || '3'
  ELSE event_type || chr(9) || CAST(event_id AS VARCHAR) || chr(9) || CAST(user_id AS VARCHAR) || chr(9) || '7' END"""


@check("b31_parse_page_views", """
SELECT event_type AS url, count(*) AS views, CAST(sum(event_id) AS BIGINT) AS time_now,
       CAST(sum(user_id) AS BIGINT) AS time_on_site, CAST(sum(7) AS BIGINT) AS time_on_read
FROM events WHERE event_id % 10 > 1 GROUP BY event_type
UNION ALL SELECT 'rejected', count(*), NULL, NULL, NULL FROM events WHERE event_id % 10 <= 1""")
def b31(spark, d):
    lines = samples.table(spark, d, "events").select(F.expr(LINE.replace("VARCHAR", "STRING")).alias("value"))
    rows, rejects = parse_page_views(lines)
    good = rows.groupBy("url").agg(
        F.count("*").alias("views"), F.sum("time_now").alias("time_now"),
        F.sum("time_on_site").alias("time_on_site"), F.sum("time_on_read").alias("time_on_read"))
    none = F.lit(None).cast("long")
    return good.unionByName(rejects.agg(F.count("*").alias("views")).select(
        F.lit("rejected").alias("url"), "views", none.alias("time_now"), none.alias("time_on_site"),
        none.alias("time_on_read")))


@check("b32_join_ids", with_sql(session_ctes(6), """
SELECT user_id, session_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM sc GROUP BY ALL"""))
def b32(spark, d):
    rows = samples.sessions(spark, d).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("l"))
    return rows.select(*KEY, X.join_ids(F.transform("l", lambda x: x["item_id"])).alias("ids"))
