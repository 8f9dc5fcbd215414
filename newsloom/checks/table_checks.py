"""Scans, sinks, joins, aggregates, encoders, set operations, catalogue upkeep."""

from pyspark.sql import functions as F

from newsloom.checks.base import CATALOG, CLICKS, check, session_ctes, truncated, with_sql
from newsloom.checks.scalar_checks import html_sql
from newsloom.functions.text import join_ids
from newsloom.operators import catalog as C, content as Z, encoders as E, features as Q, joins as J
from newsloom.operators import popularity as P, ranking as R, sampling as N, sessions as S
from newsloom.operators.metrics import recommendable_items
from newsloom.schema import KEY, MS_HOUR
from newsloom.session import fresh_path
from newsloom.sources import articles as A, bundles as B, clicks as K, logs as L, samples, sessions as W

# ---- A: scans and sinks ---------------------------------------------------


@check("a1_json_click_scan", with_sql([CLICKS], """
SELECT user_id, count(*) AS clicks, CAST(sum(article_id) AS BIGINT) AS article_sum,
       min(ts_ms // 1000) AS first_sec FROM clicks GROUP BY user_id"""))
def a1(spark, d):
    path = fresh_path(spark, "clicks-json")
    samples.clicks(spark, d).select(
        F.col("user_id").alias("userId"), F.floor(F.col("ts_ms") / 1000).alias("time"),
        F.concat(F.lit("http://news.example/"), F.col("article_id")).alias("canonicalUrl"),
        F.col("active_time_secs").cast("long").alias("activeTime"), F.col("event_type").alias("os"),
    ).write.json(path)
    rows = K.read_clicks_json(spark, [path]).filter(F.col("_corrupt_record").isNull())
    return rows.groupBy(F.col("userId").alias("user_id")).agg(
        F.count("*").alias("clicks"),
        F.sum(F.substring_index("canonicalUrl", "/", -1).cast("long")).alias("article_sum"),
        F.min("time").alias("first_sec"))


@check("a2_click_log_range", with_sql([CLICKS], """
SELECT event_id, event_type || '/' || CAST(article_id AS VARCHAR) AS full_url, ts_ms // 1000 AS "time"
FROM clicks WHERE event_type = 'click' AND user_id <> '7'
  AND ts_ms >= epoch_ms(TIMESTAMP '2024-01-05') AND ts_ms < epoch_ms(TIMESTAMP '2024-01-21')"""))
def a2(spark, d):
    path = fresh_path(spark, "click-log")
    secs = F.floor(F.col("ts_ms") / 1000)
    (samples.clicks(spark, d).select(
        "event_id", F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd HH:mm:ss").alias("dt"),
        F.date_format(F.timestamp_seconds(secs), "yyyy-MM").alias("month"),
        F.when(F.col("user_id") == "7", "-1").otherwise(F.col("user_id")).alias("guid"),
        F.col("event_type").alias("domain"), F.concat(F.lit("/"), F.col("article_id")).alias("path"))
     .write.partitionBy("month").parquet(path))
    return K.read_click_log(spark, path, "2024-01-05", "2024-01-20", "click", "month").select(
        "event_id", "full_url", "time")


@check("a3_incremental_read", """
SELECT 'rows' AS kind, count(*) AS n, max(epoch_us(o_orderdate)) AS mark FROM orders
WHERE o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'
UNION ALL
SELECT 'empty', 0, epoch_us(TIMESTAMP '2199-01-01')""")
def a3(spark, d):
    orders = samples.table(spark, d, "orders").select(
        "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))

    def read(mark, end):
        at = spark.range(1).select(F.unix_micros(F.lit(mark).cast("timestamp")).alias("mark"))
        rows, new = C.read_incremental(orders, "us", at, F.unix_micros(F.lit(end).cast("timestamp")))
        return rows.agg(F.count("*").alias("n")).withColumn("mark", new.scalar())
    return (read("1995-01-01", "1996-06-30").withColumn("kind", F.lit("rows"))
            .unionByName(read("2199-01-01", "2199-01-02").withColumn("kind", F.lit("empty"))))


@check("a4_csv_sessions", with_sql(session_ctes(6), """
SELECT session_id, CAST(min(user_id) AS BIGINT) AS user_id, min(session_start) AS session_start, min(session_size) AS session_size,
       string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts_ms, item_id) AS items,
       string_agg(CAST(ts_ms AS VARCHAR), ',' ORDER BY ts_ms, item_id) AS times
FROM sc GROUP BY session_id"""))
def a4(spark, d):
    path = fresh_path(spark, "clicks-csv")
    code = F.lit(1)
    samples.sessions(spark, d).select(
        F.col("user_id").cast("long"), "session_id", "session_start", "session_size",
        F.col("item_id").alias("click_article_id"), F.col("ts_ms").alias("click_timestamp"),
        *[code.alias(c) for c in K.CSV_LISTS[2:]]).write.option("header", True).csv(path)
    rows = K.sessions_from_csv(K.read_clicks_csv(spark, path))
    return rows.select("session_id", "user_id", "session_start", "session_size",
                       join_ids("click_article_id").alias("items"), join_ids("click_timestamp").alias("times"))


@check("a5_article_json_scan", """
SELECT CAST(doc_id AS VARCHAR) AS id, lang AS category0, source AS site, 'author ' || lang AS author_1st,
       '2017-01-01T00:00:00.000Z' AS publishtime, 1483228800000 AS created_at_ts,
       md5('title ' || CAST(doc_id AS VARCHAR) || ' | teaser | ' || source || '. ' || lang || ' | '
           || replace(replace(text, '"', ''), chr(173), '') || ' end') AS text_hash,
       'x,y' AS concepts
FROM documents WHERE doc_id % 10 <> 0""")
def a5(spark, d):
    path = fresh_path(spark, "articles-json")

    def field(name, value):
        return F.struct(F.lit(name).alias("field"), value.alias("value"))
    listed = lambda *c: F.to_json(F.array(*c))
    docs = samples.table(spark, d, "documents")
    article = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("title "), F.col("doc_id")).alias("title"),
        F.array(field("og-site-name", listed("source")), field("author", listed(F.concat(F.lit("author "), F.col("lang")), F.lit("other"))),
                field("createtime", F.lit("2017-01-01T00:00:00.000Z")), field("teaser", F.lit("teaser")),
                field("heading", listed("source", "lang", "source")), field("body", listed("text", F.lit("end"))),
                field("kw-concept", listed(F.lit("x"), F.lit("y"))), field("category0", F.col("lang"))).alias("fields"))
    body = F.when(F.col("doc_id") % 10 == 0, "null").otherwise(F.to_json(article))
    docs.select(body.alias("value")).write.text(path)
    catalog = A.clean_articles(A.parse_articles(spark.read.text(path)), order=["url"])
    return catalog.select("id", "category0", "site", "author_1st", "publishtime", "created_at_ts",
                          F.md5(F.col("text_highlights").cast("binary")).alias("text_hash"), "concepts")


@check("a6_a7_session_hours", with_sql(session_ctes(6), """
SELECT user_id, session_id, session_hour, pos, item_id FROM sc WHERE session_hour <= 300"""))
def a7(spark, d):
    path = fresh_path(spark, "sessions")
    W.write_sessions(samples.sessions(spark, d).select(*KEY, "session_hour", "pos", "item_id"), path)
    return W.read_session_hours(spark, path, 300)


@check("a8_session_examples_sink", with_sql(session_ctes(24) + [truncated()], """
SELECT session_hour, count(DISTINCT (user_id, session_id)) AS sessions, count(*) AS clicks, CAST(sum(item_id) AS BIGINT) AS item_sum
FROM tr GROUP BY session_hour"""))
def a8(spark, d):
    path = fresh_path(spark, "examples")
    W.write_examples(S.session_lists(samples.sessions(spark, d, 24), ["item_id", "ts_ms", "event_type"]), path)
    rows = spark.read.parquet(path)
    return rows.groupBy("session_hour").agg(
        F.count("*").alias("sessions"), F.sum(F.size("item_id").cast("long")).alias("clicks"),
        F.sum(F.aggregate("item_id", F.lit(0).cast("long"), lambda s, x: s + x)).alias("item_sum"))


@check("a9_append_catalog", """
SELECT lang, count(*) AS n, count(source) AS with_source FROM (
  SELECT lang, source FROM documents WHERE doc_id < 300
  UNION ALL SELECT lang, NULL FROM documents WHERE doc_id >= 300) GROUP BY lang""")
def a9(spark, d):
    docs = samples.table(spark, d, "documents").select("doc_id", "lang", "source")
    both = C.append_catalog(docs.filter("doc_id < 300"), docs.filter("doc_id >= 300").drop("source"))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("source").alias("with_source"))


@check("a10_retain_hours", with_sql(session_ctes(6), """
SELECT user_id, session_id, session_hour, pos FROM sc
WHERE session_hour > (SELECT max(session_hour) FROM sc) - 336"""))
def a10(spark, d):
    return W.retain_hours(samples.sessions(spark, d), 336).select(*KEY, "session_hour", "pos")


@check("a13_last_hours_sessions", with_sql(session_ctes(6) + [truncated()], """
SELECT user_id, session_id, session_hour, string_agg('article-' || lpad(CAST(item_id AS VARCHAR), 3, '0'), ',' ORDER BY pos) AS items
FROM tr WHERE session_hour > (SELECT max(session_hour) FROM sc) - 168 GROUP BY ALL"""))
def a13(spark, d):
    clicks = samples.clicks(spark, d).withColumn(
        "name", F.concat(F.lit("article-"), F.lpad(F.col("article_id").cast("string"), 3, "0")))
    encoder = E.fit_full_encoder(clicks, "name")
    flat = samples.sessions(spark, d)
    named = flat.withColumn("name", F.concat(F.lit("article-"), F.lpad(F.col("item_id").cast("string"), 3, "0")))
    coded = J.encode(named, "name", encoder, 0, "code").withColumn("item_id", F.col("code")).drop("name", "code")
    return W.last_hours_sessions(coded, encoder, 168).select(
        *KEY, "session_hour", F.array_join("items", ",").alias("items"))


@check("a14_f6_catalog_bundle", with_sql([CLICKS, CATALOG], """
SELECT 'catalog' AS tab, count(*) AS n, CAST(sum(article_id) AS BIGINT) AS id_sum FROM catalog
UNION ALL SELECT 'embeddings', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings"""))
def a14(spark, d):
    path = fresh_path(spark, "bundle")
    catalog, emb = samples.catalog(spark, d), samples.embeddings(spark, d)
    B.write_catalog_bundle(path, 20190101, catalog=catalog.filter("article_id < 10"), embeddings=emb.limit(0))
    B.write_catalog_bundle(path, 20190301, catalog=catalog, embeddings=emb)
    stored = B.read_catalog_bundle(spark, path, ["catalog", "embeddings"])
    out = [t.agg(F.count("*").alias("n"), F.sum("article_id").cast("long").alias("id_sum")).withColumn("tab", F.lit(n))
           for n, t in stored.items()]
    return out[0].unionByName(out[1])


# ---- C: joins -------------------------------------------------------------

@check("c1_attach_article", """
SELECT l_orderkey, l_linenumber, p_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_size < 20 GROUP BY ALL""")
def c1(spark, d):
    parts = samples.table(spark, d, "part").filter("p_size < 20").select("p_partkey", F.col("p_partkey").alias("l_partkey"))
    lines = samples.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.attach_article(lines, parts, "l_partkey").groupBy("l_orderkey", "l_linenumber", "p_partkey").agg(
        F.count("*").alias("n"))


@check("c1_salted_lookup", """
SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
LEFT JOIN part ON p_partkey = l_partkey AND p_size < 30 GROUP BY p_brand""")
def c1_salted(spark, d):
    parts = samples.table(spark, d, "part").filter("p_size < 30").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = samples.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = J.lookup_join(lines, parts, "l_partkey")
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


ENC = """enc AS (
  SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) + 1 AS INTEGER) AS code FROM (
    SELECT CAST(article_id AS VARCHAR) AS value, count(*) AS n FROM clicks GROUP BY 1 HAVING count(*) >= {0}))"""


@check("c2_encode", with_sql([CLICKS, ENC.format(100)], """
SELECT event_id, coalesce(code, 1) AS code FROM clicks LEFT JOIN enc ON value = CAST(article_id AS VARCHAR)"""))
def c2(spark, d):
    clicks = samples.clicks(spark, d).withColumn("article", F.col("article_id").cast("string"))
    return J.encode(clicks, "article", E.fit_encoder(clicks, "article_id", 100), out="code").select("event_id", "code")


@check("c3_decode", with_sql([CLICKS, ENC.format(100)], """
SELECT c_custkey, value FROM customer LEFT JOIN (
  SELECT * FROM enc UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNF>', 1) e ON e.code = CAST(c_custkey % 200 AS INTEGER)"""))
def c3(spark, d):
    encoder = E.fit_encoder(samples.clicks(spark, d), "article_id", 100)
    codes = samples.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 200).cast("int").alias("code_in"))
    return J.decode(codes, "code_in", encoder, "value").select("c_custkey", "value")


@check("c4_attach_metadata", with_sql([CLICKS, CATALOG], """
SELECT event_id, article_id, category_id, created_at_ts FROM clicks LEFT JOIN (
  SELECT * FROM catalog WHERE article_id > 10) USING (article_id)"""))
def c4(spark, d):
    cat = samples.catalog(spark, d).filter("article_id > 10")
    return J.attach_metadata(samples.clicks(spark, d), cat, ["category_id", "created_at_ts"]).select(
        "event_id", "article_id", "category_id", "created_at_ts")


@check("c7_g3_known_articles", """
SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents""")
def c7(spark, d):
    docs = samples.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    known = samples.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    fresh = J.drop_known(docs, known).withColumn("fresh", F.lit(True))
    return J.split_known(docs, known).join(fresh, "id", "left").select(
        "id", (F.col("known") & F.col("fresh").isNull()).alias("known"))


@check("c12_recent_clicks", with_sql([CLICKS], """
SELECT r.ref_ts, count(*) AS clicks, min(c.ts_ms) AS oldest, max(c.ts_ms) AS newest
FROM (SELECT DISTINCT ts_ms // 10800000 * 10800000 + 1234567 AS ref_ts FROM clicks) r
JOIN clicks c ON c.ts_ms >= r.ref_ts - 5 * 3600000 AND c.ts_ms < r.ref_ts GROUP BY r.ref_ts"""))
def c12(spark, d):
    clicks = samples.clicks(spark, d)
    step = 3 * MS_HOUR
    refs = clicks.select((F.floor(F.col("ts_ms") / step) * step + 1234567).alias("ref_ts")).distinct()
    return P.recent_clicks(clicks, refs, 5).groupBy("ref_ts").agg(
        F.count("*").alias("clicks"), F.min("ts_ms").alias("oldest"), F.max("ts_ms").alias("newest"))


# ---- D: aggregates --------------------------------------------------------

@check("d1_value_counts", with_sql([CLICKS], """
SELECT CAST(article_id AS VARCHAR) AS value, count(*) AS "count" FROM clicks GROUP BY 1"""))
def d1(spark, d):
    return E.value_counts(samples.clicks(spark, d), "article_id")


@check("d2_fit_encoder", with_sql([CLICKS, ENC.format(100)], """
SELECT value, code FROM enc UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNF>', 1"""))
def d2(spark, d):
    return E.fit_encoder(samples.clicks(spark, d), "article_id", 100)


@check("d3_fit_full_encoder", """
SELECT p_name AS value, CAST(row_number() OVER (ORDER BY p_name) AS INTEGER) AS code FROM (SELECT DISTINCT p_name FROM part)
UNION ALL SELECT '<PAD>', 0""")
def d3(spark, d):
    return E.fit_full_encoder(samples.table(spark, d, "part"), "p_name")


WORDS = r"string_split(regexp_replace(lower(text), '[^\p{L} ]', '', 'g'), ' ')"


@check("d4_fit_list_encoder", f"""
SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS code FROM (
  SELECT value, count(*) AS n FROM (SELECT unnest({WORDS}) AS value FROM documents) GROUP BY value HAVING count(*) >= 100)
UNION ALL SELECT '<PAD>', 0""")
def d4(spark, d):
    words = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L} ]", ""), " ")
    return E.fit_list_encoder(samples.table(spark, d, "documents").select(words.alias("words")), "words", 100)


@check("d5_describe", """
SELECT count(*) AS "count", round(avg(l_extendedprice), 6) AS mean, round(stddev(l_extendedprice), 6) AS std,
       min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
       round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem""")
def d5(spark, d):
    out = Q.describe_col(samples.table(spark, d, "lineitem"), "l_extendedprice", (0.1, 0.5, 0.9))
    return out.select("count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q10", "q50", "q90")])


@check("d6_audit", """
SELECT 'l_orderkey' AS "column", count(*) AS "rows", count(*) - count(l_orderkey) AS nulls, count(DISTINCT l_orderkey) AS "distinct" FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_suppkey', count(*), count(*) - count(l_suppkey), count(DISTINCT l_suppkey) FROM lineitem""")
def d6(spark, d):
    return Q.audit(samples.table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag", "l_suppkey"])


@check("d7_time_origin", with_sql([CLICKS], "SELECT min(ts_ms) AS origin_ms FROM clicks"))
def d7(spark, d):
    return S.time_origin(samples.clicks(spark, d))


GINI = """(sum((2 * i - n - 1) * (c + 0.0000001)) / (max(n) * sum(c + 0.0000001)))"""


@check("d8_hourly_stats", with_sql(session_ctes(6), f"""
SELECT a.session_hour, s.session_count, clicks, round(clicks / CAST(s.session_count AS DOUBLE), 6) AS clicks_by_session,
       unique_articles, round(clicks / CAST(unique_articles AS DOUBLE), 6) AS clicks_by_article,
       round(1.0 / unique_articles, 6) AS norm_pop_mean, round(med / clicks, 6) AS norm_pop_median,
       round(gini_index, 6) AS gini_index
FROM (SELECT session_hour, CAST(sum(c) AS BIGINT) AS clicks, count(*) AS unique_articles, median(c) AS med, {GINI} AS gini_index
      FROM (SELECT *, row_number() OVER (PARTITION BY session_hour ORDER BY c, item_id) AS i,
                   count(*) OVER (PARTITION BY session_hour) AS n
            FROM (SELECT session_hour, item_id, count(*) AS c FROM sc GROUP BY ALL))
      GROUP BY session_hour) a
JOIN (SELECT session_hour, count(*) AS session_count FROM sc WHERE pos = 1 GROUP BY 1) s USING (session_hour)"""))
def d8(spark, d):
    stats = P.hourly_stats(samples.sessions(spark, d))
    exact = ["session_hour", "session_count", "clicks", "unique_articles"]
    return stats.select(*exact, *[F.round(c, 6).alias(c) for c in stats.columns if c not in exact])


@check("d9_gini", f"""
SELECT l_shipmonth, round({GINI}, 6) AS gini FROM (
  SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, l_extendedprice AS c,
         row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m') ORDER BY l_extendedprice) AS i,
         count(*) OVER (PARTITION BY strftime(l_shipdate, '%Y-%m')) AS n FROM lineitem) GROUP BY l_shipmonth""")
def d9(spark, d):
    lines = samples.table(spark, d, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    return P.gini(lines, "l_extendedprice", ["l_shipmonth"]).select("l_shipmonth", F.round("gini", 6).alias("gini"))


@check("d10_d11_support", with_sql(session_ctes(6), """
SELECT item_id, count(*) AS support, count(*) AS clicks FROM sc GROUP BY item_id"""))
def d10(spark, d):
    flat = samples.sessions(spark, d)
    return P.support(flat).join(P.clicks_by_article(flat), "item_id")


@check("d14_first_click", with_sql(session_ctes(6), """
SELECT item_id, min(ts_ms) AS first_ts, min(session_hour) AS first_step FROM sc GROUP BY item_id"""))
def d14(spark, d):
    return P.first_click(samples.sessions(spark, d))


@check("d16_class_weights", """
SELECT lang, count(*) AS "count", round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM documents GROUP BY lang""")
def d16(spark, d):
    return Z.class_weights(samples.table(spark, d, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@check("d17_inverse_freq_weight", """
SELECT source, count(*) AS "count", round(10.0 / count(*), 6) AS weight FROM documents GROUP BY source""")
def d17(spark, d):
    return Z.inverse_freq_weight(samples.table(spark, d, "documents"), "source").withColumn("weight", F.round("weight", 6))


@check("d21_fold_counters", with_sql(session_ctes(6), """
SELECT session_hour, count(*) AS clicks, count(DISTINCT item_id) AS unique_items, count(DISTINCT (user_id, session_id)) AS sessions
FROM sc GROUP BY session_hour"""))
def d21(spark, d):
    return P.fold_counters(samples.sessions(spark, d))


# ---- E6, F, G -------------------------------------------------------------

@check("e6_click_buffer", with_sql([CLICKS], """
SELECT state_step, event_id, buffer_pos FROM (
  SELECT r.state_step, c.event_id, row_number() OVER (PARTITION BY r.state_step ORDER BY c.ts_ms DESC, c.event_id DESC) AS buffer_pos
  FROM (SELECT DISTINCT ts_ms // 86400000 AS state_step, ts_ms // 86400000 * 86400000 AS ref_ts FROM clicks) r
  JOIN clicks c ON c.ts_ms >= r.ref_ts - 24 * 3600000 AND c.ts_ms < r.ref_ts) WHERE buffer_pos <= 100"""))
def e6(spark, d):
    clicks = samples.clicks(spark, d)
    day = F.floor(F.col("ts_ms") / 86_400_000)
    refs = clicks.select(day.alias("state_step")).distinct().withColumn("ref_ts", F.col("state_step") * 86_400_000)
    return P.click_buffer(clicks, refs, 24, 100).select("state_step", "event_id", F.col("buffer_pos").cast("long"))


@check("f2_top_n", """
SELECT l_suppkey, l_partkey, qty, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS rank FROM (
    SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)) WHERE rank <= 5""")
def f2(spark, d):
    sums = samples.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return R.top_n(sums, ["l_suppkey"], "qty", 5, tie="l_partkey").withColumn("rank", F.col("rank").cast("long"))


@check("f3_rank_candidates", """
SELECT l_orderkey AS user_id, l_partkey AS item_id, row_number() OVER (
  PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, l_partkey) AS rank
FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS score FROM lineitem GROUP BY ALL)""")
def f3(spark, d):
    rows = samples.table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.max("l_quantity").alias("score"))
    return R.rank_candidates(rows, click=["user_id"]).select("user_id", "item_id", F.col("rank").cast("long"))


@check("f4_most_common", with_sql([CLICKS], """
SELECT article_id, count(*) AS "count" FROM clicks GROUP BY article_id ORDER BY 2 DESC, 1 LIMIT 20"""))
def f4(spark, d):
    return R.most_common(samples.clicks(spark, d), "article_id", 20)


@check("f5_latest_slice", with_sql([CLICKS, CATALOG], """
SELECT article_id, row_number() OVER (ORDER BY created_at_ts, article_id) AS new_id FROM (
  SELECT * FROM catalog ORDER BY created_at_ts DESC, article_id DESC LIMIT 60)"""))
def f5(spark, d):
    return C.latest_slice(samples.catalog(spark, d), 60).select("article_id", F.col("new_id").cast("long"))


@check("f_global_rank", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders""")
def f_rank(spark, d):
    ranked = R.global_rank(samples.table(spark, d, "orders"), [("o_totalprice", False), ("o_orderkey", True)])
    return ranked.select("o_orderkey", F.col("rn").cast("long"))


@check("g1_recommendable_items", """
SELECT item_id FROM (SELECT l_partkey AS item_id FROM lineitem WHERE l_quantity > 49
  UNION SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT p_partkey FROM part WHERE p_size = 2)""")
def g1(spark, d):
    part = samples.table(spark, d, "part").withColumnRenamed("p_partkey", "item_id")
    lines = samples.table(spark, d, "lineitem").filter("l_quantity > 49").withColumnRenamed("l_partkey", "item_id")
    return recommendable_items(lines, part.filter("p_size = 1"), part.filter("p_size = 2"))


@check("g2_negative_pool", with_sql([CLICKS], """
SELECT state_step, item_id, copy FROM (
  SELECT *, row_number() OVER (PARTITION BY state_step ORDER BY h, copy) AS r FROM (
    SELECT ts_ms // 86400000 AS state_step, article_id AS item_id,
           CASE WHEN event_type = 'click' THEN 'b:' ELSE 'r:' END || CAST(event_id AS VARCHAR) AS copy,
           md5('42|' || CAST(ts_ms // 86400000 AS VARCHAR) || '|' ||
               CASE WHEN event_type = 'click' THEN 'b:' ELSE 'r:' END || CAST(event_id AS VARCHAR)) AS h FROM clicks))
WHERE r <= 100"""))
def g2(spark, d):
    rows = samples.clicks(spark, d).select(
        F.floor(F.col("ts_ms") / 86_400_000).alias("state_step"), F.col("article_id").alias("item_id"),
        F.col("event_id").alias("copy_id"), "event_type")
    pool = N.negative_pool(rows.filter("event_type = 'click'"), rows.filter("event_type <> 'click'"), 100)
    return pool.select("state_step", "item_id", "copy")


# ---- M: catalogue upkeep --------------------------------------------------

@check("m1_extend_encoder", """
WITH old AS (SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS code FROM (
    SELECT DISTINCT p_brand FROM part WHERE p_size < 3) UNION ALL SELECT '<PAD>', 0)
SELECT * FROM old UNION ALL
SELECT value, CAST((SELECT max(code) FROM old) + row_number() OVER (ORDER BY value) AS INTEGER) FROM (
  SELECT DISTINCT p_type AS value FROM part WHERE p_type NOT IN (SELECT value FROM old))""")
def m1(spark, d):
    part = samples.table(spark, d, "part")
    old = E.fit_full_encoder(part.filter("p_size < 3"), "p_brand")
    return E.extend_encoder(old, part.select(F.col("p_type").alias("value")))


@check("m2_encode_known", """
WITH enc AS (SELECT p_type AS value, CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS code FROM (
    SELECT DISTINCT p_type FROM part WHERE p_size < 10)),
lists AS (SELECT p_partkey, p_type, unnest([p_type, p_brand, p_type]) AS v, generate_subscripts([p_type, p_brand, p_type], 1) AS i FROM part)
SELECT p_partkey, coalesce(max(e2.code), 0) AS type_code, string_agg(CAST(coalesce(e.code, 0) AS VARCHAR), ',' ORDER BY i) AS codes
FROM lists LEFT JOIN enc e ON e.value = v LEFT JOIN enc e2 ON e2.value = p_type GROUP BY p_partkey""")
def m2(spark, d):
    part = samples.table(spark, d, "part")
    encoder = E.fit_full_encoder(part.filter("p_size < 10"), "p_type")
    single = E.encode_known(part, "p_type", encoder).select("p_partkey", F.col("p_type_code").alias("type_code"))
    lists = E.encode_known_list(part.withColumn("l", F.array("p_type", "p_brand", "p_type")), "p_partkey", "l", encoder)
    return single.join(lists, "p_partkey").select("p_partkey", "type_code", join_ids("l_codes").alias("codes"))


@check("m3_encode_dims_again", with_sql([CLICKS], """
, counts AS (SELECT article_id, count(*) AS n FROM clicks WHERE ts_ms >= 1705000000000 GROUP BY 1),
enc AS (SELECT article_id, CAST(row_number() OVER (ORDER BY n DESC, CAST(article_id AS VARCHAR)) + 1 AS INTEGER) AS code FROM (
  SELECT article_id, count(*) AS n FROM clicks WHERE ts_ms < 1705000000000 GROUP BY 1 HAVING count(*) >= 20))
SELECT event_id, coalesce(CASE WHEN n >= 40 THEN code END, 1) AS code FROM clicks
LEFT JOIN counts USING (article_id) LEFT JOIN enc USING (article_id) WHERE ts_ms >= 1705000000000"""))
def m3(spark, d):
    clicks = samples.clicks(spark, d)
    stored = E.fit_encoder(clicks.filter("ts_ms < 1705000000000"), "article_id", 20).withColumn("feature", F.lit("article_id"))
    batch = clicks.filter("ts_ms >= 1705000000000")
    return E.encode_dims_again(batch, stored, ["article_id"], 40).select("event_id", F.col("article_id_code").alias("code"))


@check("m4_merge_catalog", """
SELECT article_id, label FROM (
  SELECT vec_id AS article_id, label, 0 AS part FROM embeddings WHERE vec_id < 300
  UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id = 0 OR vec_id >= 250)
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY part) = 1""")
def m4(spark, d):
    emb = samples.table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), "label")
    new = emb.filter("article_id = 0 or article_id >= 250").withColumn("label", F.col("label") + 100)
    return C.merge_catalog(emb.filter("article_id < 300"), new)


@check("m5_prepare_articles", """
SELECT page_id AS id, md5('T' || CAST(page_id AS VARCHAR) || '|teaser|' || {html}) AS text_hash, 'a,b' AS keywords,
       1546300800 + page_id AS created_at_ts, page_id % 7 AS category0
FROM pages WHERE page_id % 11 <> 0 AND page_id >= 20""".replace("{html}", html_sql("html", False)))
def m5(spark, d):
    pages = samples.table(spark, d, "pages")
    raw = pages.select(
        F.col("page_id").alias("newsId"), F.col("html").alias("content"),
        F.timestamp_seconds(F.lit(1546300800) + F.col("page_id")).alias("publishDate"), F.lit("teaser").alias("sapo"),
        F.lit("portal").alias("sourceNews"), F.lit("a;b").alias("tags"),
        F.concat(F.lit("T"), F.col("page_id")).alias("title"), "url", (F.col("page_id") % 7).alias("catId"),
        F.when(F.col("page_id") % 11 == 0, 1).otherwise(0).alias("is_deleted"))
    known = pages.filter("page_id < 20").select(F.col("page_id").alias("id"))
    return C.prepare_articles(raw, known, "portal").select(
        "id", F.md5(F.col("text_highlights").cast("binary")).alias("text_hash"), "keywords", "created_at_ts", "category0")
