"""Streaming jobs run over the sample events and compared with batch definitions."""

from pyspark.sql import functions as F

from newsloom.checks.base import CLICKS, check, session_ctes, with_sql
from newsloom.checks.metric_checks import rounded
from newsloom.checks.recommender_checks import COOC, FLAT6, PAIRS, RULES
from newsloom.operators import rules as U, sessions as S
from newsloom.schema import KEY
from newsloom.session import fresh_path
from newsloom.sources import samples
from newsloom.streaming import jobs as J

MARK = "(SELECT max(epoch_us(ts)) FROM events) - 600000000"  # watermark: newest event minus 10 minutes


def click_stream(spark, d):
    """The events table as a file stream."""
    schema = samples.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").cast("string").alias("user_id"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("article_id"))


def collect_stream(spark, stream, name):
    path = J.run_available(stream, fresh_path(spark, name), fresh_path(spark, f"{name}-state"))
    return spark.read.parquet(path)


@check("l1_stream_sessions", with_sql(session_ctes(6), f"""
SELECT s.user_id, s.session_id, s.session_size, string_agg(CAST(s.item_id AS VARCHAR), ',' ORDER BY s.pos) AS items
FROM sc s JOIN (SELECT user_id, min(q.ts_ms) AS session_start, max(epoch_us(e.ts)) AS last_us FROM seq q JOIN events e USING (event_id)
                GROUP BY q.user_id, session_seq) l ON l.user_id = s.user_id AND l.session_start = s.session_start
WHERE last_us + 6 * 3600000000 <= {MARK} GROUP BY ALL""".replace("SELECT user_id, min(q", "SELECT q.user_id, min(q")))
def l1(spark, d):
    rows = collect_stream(spark, J.stream_sessions(click_stream(spark, d), "6 hours"), "sessions")
    items = F.transform("clicks", lambda c: c["article_id"].cast("string"))
    return rows.select(*KEY, "session_size", F.array_join(items, ",").alias("items"))


@check("l2_stream_popularity", with_sql([CLICKS], f"""
SELECT (us // 300000000 - i + 12) * 300000 AS ref_ts, article_id AS item_id, count(*) AS clicks
FROM (SELECT epoch_us(e.ts) AS us, article_id FROM clicks JOIN events e USING (event_id)), range(0, 12) r(i)
WHERE (us // 300000000 - i + 12) * 300000000 <= {MARK} GROUP BY ALL"""))
def l2(spark, d):
    return collect_stream(spark, J.stream_popularity(click_stream(spark, d)), "popularity")


@check("l3_stream_hourly_stats", with_sql([CLICKS], f"""
SELECT hour_ms, CAST(sum(c) AS BIGINT) AS clicks, count(*) AS unique_articles, round(sum(c) / count(*), 6) AS clicks_by_article,
       round(1.0 / count(*), 6) AS norm_pop_mean, round(median(c) / sum(c), 6) AS norm_pop_median
FROM (SELECT ts_ms // 3600000 * 3600000 AS hour_ms, article_id, count(*) AS c FROM clicks GROUP BY ALL)
WHERE (hour_ms + 3600000) * 1000 <= {MARK} GROUP BY hour_ms"""))
def l3(spark, d):
    return rounded(collect_stream(spark, J.stream_hourly_stats(click_stream(spark, d)), "stats"))


PARTS = 3


def feed_sessions(spark, d, job):
    """Run a session-stream job once per part, each part added to the source folder before."""
    nested = S.nest_sessions(samples.sessions(spark, d).select(
        *KEY, "session_hour", "session_size", "session_start", "pos", "ts_ms", "event_id",
        F.col("item_id").alias("article_id")))
    nested = nested.select(*KEY, "session_hour", "session_start", "session_size", F.transform(
        "clicks", lambda c: F.struct(c["ts_ms"].alias("ts_ms"), c["event_id"].alias("event_id"),
                                     c["article_id"].alias("article_id"))).alias("clicks"))
    source, out, state = (fresh_path(spark, n) for n in ("feed", "tables", "feed-state"))
    for part in range(PARTS):
        # the last part takes every later hour
        nested.filter(F.least(F.floor(F.col("session_hour") / 240), F.lit(PARTS - 1)) == part).drop("session_hour").write.mode("append").parquet(source)
        stream = spark.readStream.schema(nested.drop("session_hour").schema).parquet(source)
        job(stream, out, state)
    return out


@check("l4_maintain_rules", with_sql(FLAT6 + [PAIRS, RULES, COOC], """
SELECT antecedent, consequent, round(score, 6) AS score, pairs, n FROM rules
JOIN cooc ON item_a = antecedent AND item_b = consequent"""))
def l4(spark, d):
    out = feed_sessions(spark, d, lambda stream, out, state: J.maintain_rules(stream, out, state, every=2))
    rules = J.read_changes(spark, f"{out}/rules", J.RULE, every=2)
    cooc = J.read_changes(spark, f"{out}/cooccurrence", J.PAIR, every=2)
    both = rules.join(cooc, (F.col("item_a") == F.col("antecedent")) & (F.col("item_b") == F.col("consequent")))
    return both.select("antecedent", "consequent", F.round("score", 6).alias("score"), "pairs", "n")


@check("l5_stream_last_n", with_sql([CLICKS], """
SELECT article_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts_ms DESC, event_id DESC) AS event_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY ts_ms DESC, event_id DESC) AS r FROM clicks) WHERE r <= 10 GROUP BY article_id"""))
def l5(spark, d):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string"))
    lists = last_lists(spark, d, 10).groupBy("key").agg(F.array_join(ids, ",").alias("event_ids"))
    return lists.withColumnRenamed("key", "article_id")


def last_lists(spark, d, n, key="article_id"):
    path = fresh_path(spark, "last-n")
    J.run_batches(J.stream_last_n(click_stream(spark, d), n, "60 days", key),
                  lambda batch, i: J.write_delta(batch, path, i), fresh_path(spark, "last-n-state"), "update")
    return J.last_n(spark.read.parquet(path), n)


@check("l5_stream_last_n_global", with_sql([CLICKS], """
SELECT event_id, ts_ms, rank FROM (
  SELECT event_id, ts_ms, row_number() OVER (ORDER BY ts_ms DESC, event_id DESC) AS rank FROM clicks) WHERE rank <= 100"""))
def l5_global(spark, d):
    """The newest 100 clicks of all: one list for every article, kept in salted states."""
    return last_lists(spark, d, 100, None).select("event_id", "ts_ms", F.col("rank").cast("long").alias("rank"))


@check("l6_stream_recommend", with_sql(FLAT6 + [PAIRS, RULES], """
SELECT event_id, user_id, article_id, consequent, rank FROM clicks JOIN (
  SELECT antecedent, consequent, row_number() OVER (PARTITION BY antecedent ORDER BY round(score, 9) DESC, consequent) AS rank FROM rules)
  ON antecedent = article_id WHERE rank <= 3"""))
def l6(spark, d):
    from newsloom.session import materialize
    packed = materialize(J.packed_rules(U.train_rules(samples.sessions(spark, d)), 3), "packed-rules")
    live = collect_stream(spark, J.stream_recommend(click_stream(spark, d), packed), "live")
    return live.withColumn("rank", F.col("rank").cast("long"))


#: Sessions by feed part, and what the parts before each later part show of them.
PARTED = """parts AS (SELECT *, least(CAST(session_hour // 240 AS INTEGER), 2) AS part FROM tr),
later AS (SELECT unnest([1, 2]) AS part),
pr AS (SELECT a.part, a.item_id AS antecedent, b.item_id AS consequent, sum(1.0 / CAST(b.pos - a.pos AS DOUBLE)) AS s
  FROM parts a JOIN parts b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos > a.pos AND b.pos - a.pos <= 10 GROUP BY ALL)"""


@check("l6_live_lists", with_sql(FLAT6, f"""
, {PARTED},
cat AS (SELECT vec_id AS article_id, CAST(label AS INTEGER) AS category_id FROM embeddings WHERE label <> 0),
rl AS (SELECT p.part, antecedent, consequent, row_number() OVER (PARTITION BY p.part, antecedent ORDER BY round(sum(s), 9) DESC, consequent) AS rank
  FROM later p JOIN pr ON pr.part < p.part WHERE antecedent IN (SELECT article_id FROM cat) AND consequent IN (SELECT article_id FROM cat)
  GROUP BY p.part, antecedent, consequent),
pop AS (SELECT p.part, item_id, row_number() OVER (PARTITION BY p.part ORDER BY count(*) DESC, item_id) AS rank
  FROM later p JOIN parts x ON x.part < p.part WHERE item_id IN (SELECT article_id FROM cat) GROUP BY p.part, item_id)
SELECT user_id, session_id, pos, c.item_id AS article_id, fallback, rank, rec_item, category_id FROM (
  SELECT c.part, c.user_id, c.session_id, c.pos, c.item_id, false AS fallback, r.rank, r.consequent AS rec_item
  FROM parts c JOIN rl r ON r.part = c.part AND r.antecedent = c.item_id WHERE r.rank <= 3
  UNION ALL SELECT c.part, c.user_id, c.session_id, c.pos, c.item_id, true, p.rank, p.item_id FROM parts c JOIN pop p ON p.part = c.part
  WHERE p.rank <= 3 AND NOT EXISTS (SELECT 1 FROM rl WHERE rl.part = c.part AND rl.antecedent = c.item_id)) c
JOIN cat ON cat.article_id = rec_item"""))
def l6_live(spark, d):
    """Clicks of each part get lists from the rules of the earlier parts, which change between batches."""
    catalog = samples.table(spark, d, "embeddings").filter("label <> 0").select(
        F.col("vec_id").alias("article_id"), F.col("label").cast("int").alias("category_id"))
    lists = fresh_path(spark, "live-lists")

    def job(stream, out, state):
        clicks = J.flatten_sessions(stream).select(*KEY, "pos", F.col("item_id").alias("article_id"))
        J.live_lists(clicks, out, lists, f"{state}-live", catalog, 3, ["category_id"])
        J.maintain_rules(stream, out, state)
    feed_sessions(spark, d, job)
    rows = spark.read.parquet(lists).drop("batch")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("pos", "rank")})


@check("l7_stream_evaluate", with_sql(FLAT6, f"""
, {PARTED},
co AS (SELECT a.part, a.item_id AS a, b.item_id AS b, count(*) AS n FROM parts a JOIN parts b
  ON a.user_id = b.user_id AND a.session_id = b.session_id AND a.pos <> b.pos GROUP BY ALL),
sup AS (SELECT p.part, item_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY p.part) AS total, count(*) OVER (PARTITION BY p.part) AS items
  FROM later p JOIN parts x ON x.part < p.part GROUP BY p.part, item_id),
cs AS (SELECT p.part, a, b, sum(n) AS n FROM later p JOIN co ON co.part < p.part GROUP BY p.part, a, b),
lists AS (
  SELECT 'sr' AS recommender, p.part, antecedent AS item, consequent AS rec, row_number() OVER (PARTITION BY p.part, antecedent ORDER BY round(sum(s), 9) DESC, consequent) AS rank
  FROM later p JOIN pr ON pr.part < p.part GROUP BY p.part, antecedent, consequent
  UNION ALL SELECT 'coocurrent', part, a, b, row_number() OVER (PARTITION BY part, a ORDER BY n DESC, b) FROM cs
  UNION ALL SELECT 'item_knn', part, a, b, row_number() OVER (PARTITION BY part, a ORDER BY round(score, 9) DESC, b) FROM (
    SELECT cs.part, a, b, cs.n / (power(y.n + 20.0, 0.75) * power(x.n + 20.0, 0.25)) AS score
    FROM cs JOIN sup x ON x.part = cs.part AND x.item_id = a JOIN sup y ON y.part = cs.part AND y.item_id = b)),
lb AS (SELECT * FROM (SELECT part, user_id, session_id, pos, item_id, lead(item_id) OVER (PARTITION BY user_id, session_id ORDER BY pos) AS label FROM parts)
  WHERE label IS NOT NULL AND part > 0),
shown AS (
  SELECT recommender, lb.part, user_id, session_id, pos, label, rec, rank FROM lb JOIN lists l ON l.part = lb.part AND l.item = lb.item_id WHERE rank <= 5
  UNION ALL SELECT 'popular', lb.part, user_id, session_id, pos, label, rec, rank FROM lb JOIN (
    SELECT part, item_id AS rec, row_number() OVER (PARTITION BY part ORDER BY n DESC, item_id) AS rank FROM sup) p ON p.part = lb.part WHERE rank <= 5),
names AS (SELECT unnest(['sr', 'coocurrent', 'item_knn', 'popular']) AS recommender),
totals AS (SELECT recommender, part, count(*) AS clicks FROM lb, names GROUP BY ALL)
SELECT t.part AS batch, t.recommender, t.clicks, round(sum(CASE WHEN rec = label THEN 1.0 ELSE 0 END) / t.clicks, 6) AS hitrate,
  round(sum(CASE WHEN rec = label THEN 1.0 / rank ELSE 0 END) / t.clicks, 6) AS mrr,
  round(sum(CASE WHEN rec = label THEN 1.0 / log2(rank + 1) ELSE 0 END) / t.clicks, 6) AS ndcg,
  round(avg(-log2(CAST(n AS DOUBLE) / total)), 6) AS novelty, round(CAST(count(DISTINCT rec) AS DOUBLE) / any_value(items), 6) AS coverage
FROM totals t JOIN shown s ON s.part = t.part AND s.recommender = t.recommender JOIN sup ON sup.part = t.part AND sup.item_id = rec
GROUP BY t.part, t.recommender, t.clicks"""))
def l7(spark, d):
    out = feed_sessions(spark, d, lambda stream, out, state: J.stream_evaluate(stream, out, state, every=2))
    return rounded(spark.read.parquet(f"{out}/metrics"))
