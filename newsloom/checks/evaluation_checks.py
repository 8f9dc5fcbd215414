"""Folds, sampling, features, rolling evaluation, logs, cold start."""

from pyspark.sql import Window, functions as F

from newsloom.checks.base import CATALOG, CLICKS, EMB, check, fold_ctes, session_ctes, truncated, with_sql
from newsloom.checks.metric_checks import rounded
from newsloom.checks.recommender_checks import FLAT6, knn_ctes
from newsloom.functions.text import join_ids
from newsloom.operators import content as Z, features as Q, learned as X, metrics as M, popularity as P
from newsloom.operators import ranking as K, recommenders as R, rules as U, sampling as N, sessions as S
from newsloom.plans import evaluation as V
from newsloom.schema import CLICK, KEY
from newsloom.session import materialize
from newsloom.sources import logs as L, samples

FOLD_K, NEG, BUFFER_H = 24, 50, 24

EVAL = FLAT6 + fold_ctes(FOLD_K) + [
    "test AS (SELECT * FROM tagged WHERE state_step IS NOT NULL AND pos <= 20)",
    """lab AS (SELECT * FROM (SELECT *, lead(item_id) OVER (PARTITION BY user_id, session_id ORDER BY pos) AS label FROM test)
  WHERE label IS NOT NULL)""",
    "refs AS (SELECT state_step, min(ts_ms) AS ref_ts FROM test GROUP BY 1)",
    f"""buffer AS (SELECT * FROM (
  SELECT r.state_step, c.event_id, c.ts_ms, c.article_id AS item_id, row_number() OVER (
    PARTITION BY r.state_step ORDER BY c.ts_ms DESC, c.event_id DESC) AS buffer_pos
  FROM refs r JOIN clicks c ON c.ts_ms >= r.ref_ts - {BUFFER_H} * 3600000 AND c.ts_ms < r.ref_ts) WHERE buffer_pos <= 20000)""",
    """pop AS (SELECT state_step, item_id, n AS clicks, greatest(n / (sum(n) OVER (PARTITION BY state_step) + 1), 0.001) AS norm_pop
  FROM (SELECT state_step, item_id, count(*) AS n FROM buffer GROUP BY ALL))""",
    f"""pool AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY state_step ORDER BY md5('42|' || CAST(state_step AS VARCHAR) || '|' || copy), copy) AS r
  FROM (SELECT state_step, item_id, 'b:' || CAST(event_id AS VARCHAR) AS copy FROM test
        UNION ALL SELECT state_step, item_id, 'r:' || CAST(event_id AS VARCHAR) FROM buffer)) WHERE r <= {20 * NEG})""",
    f"""neg AS (SELECT * FROM (
  SELECT user_id, session_id, pos, state_step, item_id, row_number() OVER (PARTITION BY user_id, session_id, pos ORDER BY h, item_id) AS neg_pos
  FROM (SELECT t.user_id, t.session_id, t.pos, t.state_step, p.item_id,
               min(md5('42|' || t.user_id || '|' || CAST(t.session_id AS VARCHAR) || '|' || CAST(t.pos AS VARCHAR) || '|' || p.copy)) AS h
        FROM test t JOIN pool p USING (state_step)
        WHERE NOT EXISTS (SELECT 1 FROM test o WHERE o.user_id = t.user_id AND o.session_id = t.session_id AND o.item_id = p.item_id)
        GROUP BY ALL)) WHERE neg_pos <= {NEG})""",
    """cand AS (
  SELECT user_id, session_id, pos, item_id AS active_item, label AS item_id, label, 1 AS is_label, state_step, ts_ms FROM lab
  UNION ALL SELECT l.user_id, l.session_id, l.pos, l.item_id, n.item_id, l.label, 0, l.state_step, l.ts_ms
  FROM lab l JOIN neg n USING (user_id, session_id, pos))"""]

PAIRS_T = """pairs AS (
  SELECT a.step, a.user_id, a.session_id, a.item_id AS antecedent, b.item_id AS consequent, b.pos - a.pos AS distance
  FROM tagged a JOIN tagged b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos > a.pos
  WHERE b.pos <= 20)"""
SCORES = [PAIRS_T,
          """rule_d AS (SELECT step, antecedent, consequent, sum(1.0 / CAST(distance AS DOUBLE)) AS score FROM pairs
  WHERE distance <= 10 GROUP BY ALL)""",
          """cooc_d AS (SELECT step, item_a, item_b, count(*) AS n FROM (
  SELECT step, antecedent AS item_a, consequent AS item_b FROM pairs UNION ALL SELECT step, consequent, antecedent FROM pairs) GROUP BY ALL)""",
          "supp_d AS (SELECT step, item_id, count(*) AS n FROM tagged WHERE pos <= 20 GROUP BY ALL)",
          """s_sr AS (SELECT user_id, session_id, pos, state_step, item_id, sum(score) AS score
  FROM cand JOIN rule_d ON antecedent = active_item AND consequent = item_id AND step < state_step GROUP BY ALL)""",
          """s_co AS (SELECT user_id, session_id, pos, state_step, active_item, item_id, CAST(sum(n) AS DOUBLE) AS score
  FROM cand JOIN cooc_d ON item_a = active_item AND item_b = item_id AND step < state_step GROUP BY ALL)""",
          """supp_at AS (SELECT t.state_step, s.item_id, sum(s.n) AS support FROM refs t JOIN supp_d s ON s.step < t.state_step GROUP BY ALL)""",
          """s_knn AS (SELECT c.user_id, c.session_id, c.pos, c.state_step, c.item_id,
         c.score / (pow(b.support + 20, 0.75) * pow(a.support + 20, 0.25)) AS score
  FROM s_co c JOIN supp_at a ON a.state_step = c.state_step AND a.item_id = c.active_item
  JOIN supp_at b ON b.state_step = c.state_step AND b.item_id = c.item_id)""",
          """s_pop AS (SELECT user_id, session_id, pos, state_step, item_id, CAST(clicks AS DOUBLE) AS score
  FROM cand JOIN pop USING (state_step, item_id))""", EMB,
          """s_cb AS (SELECT user_id, session_id, pos, state_step, item_id, list_cosine_similarity(x.embedding, y.embedding) AS score
  FROM cand JOIN emb x ON x.article_id = active_item JOIN emb y ON y.article_id = item_id)"""]
SKNN = [*knn_ctes(3000, FOLD_K)[-2:],
        """votes AS (
  SELECT e.user_id, e.session_id, e.pos, b.user_id AS nu, b.session_id AS ns, b.size,
         sum(1.0 / CAST(e.pos - p.pos + 1 AS DOUBLE)) / (sqrt(e.pos) * sqrt(b.size)) AS similarity
  FROM lab e JOIN test p ON p.user_id = e.user_id AND p.session_id = e.session_id AND p.pos <= e.pos
  JOIN bufitems b ON b.state_step = e.state_step AND b.item_id = p.item_id
  GROUP BY e.user_id, e.session_id, e.pos, b.user_id, b.session_id, b.size)""",
        """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id, pos
      ORDER BY round(similarity, 9) DESC, ns DESC, nu DESC) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id, pos ORDER BY ns DESC, nu DESC) AS newest FROM votes)
  WHERE newest <= 1000 AND round(similarity, 9) > 0 AND round(similarity, 9) < 1) WHERE best <= 500)""",
        """s_sknn AS (SELECT c.user_id, c.session_id, c.pos, c.state_step, c.item_id, sum(similarity) AS score
  FROM cand c JOIN near USING (user_id, session_id, pos)
  JOIN (SELECT state_step, user_id AS nu, session_id AS ns, item_id FROM bufitems) i
    ON i.nu = near.nu AND i.ns = near.ns AND i.state_step = c.state_step AND i.item_id = c.item_id GROUP BY ALL)"""]
NAMES = {"pop_recent": "s_pop", "coocurrent": "s_co", "item_knn": "s_knn", "sr": "s_sr", "v-sknn": "s_sknn", "cb": "s_cb"}


def ranked(names, top):
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS recommender, user_id, session_id, pos, state_step, item_id, score FROM {NAMES[n]}" for n in names)
    return f"""lists AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY recommender, user_id, session_id, pos ORDER BY round(score, 9) DESC, item_id) AS rank FROM ({parts})) WHERE rank <= {top})"""


def who(names):
    return "who AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS recommender)"


HITS = """SELECT recommender, CAST(state_step AS BIGINT) AS state_step, count(*) AS clicks, round(avg(hit), 6) AS hitrate, round(avg(rr), 6) AS mrr FROM (
  SELECT w.recommender, l.state_step, l.user_id, l.session_id, l.pos, max(CASE WHEN p.item_id = label THEN 1.0 ELSE 0 END) AS hit,
         max(CASE WHEN p.item_id = label THEN 1.0 / rank ELSE 0 END) AS rr
  FROM lab l CROSS JOIN who w LEFT JOIN lists p ON p.recommender = w.recommender AND p.user_id = l.user_id
    AND p.session_id = l.session_id AND p.pos = l.pos GROUP BY ALL) GROUP BY ALL"""


def build(spark, d, keep=materialize, n=NEG, **kw):
    return V.EvaluationInput(samples.sessions(spark, d), samples.clicks(spark, d), FOLD_K, n, BUFFER_H, keep=keep, **kw)


@check("flagship_rules_evaluation", with_sql(EVAL[:-4] + SCORES[:2], """
SELECT CAST(state_step AS BIGINT) AS state_step, count(*) AS clicks,
       round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS hitrate, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
FROM lab LEFT JOIN (
  SELECT ss, antecedent, consequent, row_number() OVER (PARTITION BY ss, antecedent ORDER BY round(score, 9) DESC, consequent) AS rank
  FROM (SELECT state_step AS ss, antecedent, consequent, sum(score) AS score FROM refs JOIN rule_d ON step < state_step GROUP BY ALL)) r
  ON r.ss = state_step AND antecedent = item_id AND consequent = label AND rank <= 5
GROUP BY state_step"""))
def flagship(spark, d):
    return rounded(V.rules_hit_rate(samples.sessions(spark, d), FOLD_K, 5))


@check("k7_temporal_folds", with_sql(FLAT6 + fold_ctes(5), """
SELECT session_hour, chunk, is_test, CASE WHEN is_test THEN chunk - 1 END AS fold FROM folds"""))
def k7(spark, d):
    return V.temporal_folds(samples.sessions(spark, d), 5)


@check("k5_sample_negatives", with_sql(EVAL, "SELECT user_id, session_id, pos, item_id, neg_pos FROM neg"))
def k5(spark, d):
    return build(spark, d).negatives.select(
        *CLICK, "item_id", (F.col("neg_pos") + 1).cast("long").alias("neg_pos"))


@check("k6_g4_candidates", with_sql(EVAL, "SELECT user_id, session_id, pos, active_item, item_id, is_label FROM cand"))
def k6(spark, d):
    return build(spark, d).candidates.select(*CLICK, "active_item", "item_id", "is_label")


@check("c15_attach_negatives", with_sql(EVAL, """
SELECT user_id, session_id, pos, max(label) AS label, string_agg(CAST(n.item_id AS VARCHAR), ',' ORDER BY n.item_id) AS negative_items
FROM lab JOIN neg n USING (user_id, session_id, pos) WHERE n.item_id % 2 = 0 GROUP BY ALL"""))
def c15(spark, d):
    inp = build(spark, d)
    out = N.attach_negatives(inp.labels, inp.negatives.filter("item_id % 2 = 0"))
    return out.select(*CLICK, F.col("label_next_item").alias("label"), join_ids("negative_items").alias("negative_items"))


@check("k8_evaluate_fold", with_sql(EVAL + SCORES[:4] + SCORES[4:6] + [ranked(["coocurrent", "sr"], 10), who(["coocurrent", "sr"])], HITS))
def k8(spark, d):
    inp = build(spark, d)
    scored = {"coocurrent": R.score_cooccurrence(R.cooccurrence_state(inp.tagged), inp.probes),
              "sr": R.score_rules(R.rules_state(inp.tagged), inp.probes)}
    return rounded(V.evaluate_fold(inp, scored))


BATCH = 2
BATCHED = FLAT6 + fold_ctes(FOLD_K)[:1] + [f"""tagged AS (
  SELECT * REPLACE (CASE WHEN is_test THEN chunk * 1048576 + batch ELSE chunk * 1048576 + 1048575 END AS step,
                    CASE WHEN is_test THEN chunk * 1048576 + batch END AS state_step)
  FROM (SELECT s.*, chunk, is_test, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS state_step, batch FROM sc s JOIN folds USING (session_hour)
        JOIN (SELECT user_id, session_id, (row_number() OVER (PARTITION BY session_hour ORDER BY session_id, user_id) - 1) // {BATCH} AS batch
              FROM sc WHERE pos = 1) USING (user_id, session_id)))""",
                                           "test AS (SELECT * FROM tagged WHERE state_step IS NOT NULL AND pos <= 20)"]


@check("k8_prequential_batches", with_sql(BATCHED + [x for x in EVAL if x.startswith("lab AS")] + SCORES[:2], """
SELECT CAST(state_step AS BIGINT) AS state_step, count(*) AS clicks, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS hitrate
FROM lab LEFT JOIN (
  SELECT ss, antecedent, consequent, row_number() OVER (PARTITION BY ss, antecedent ORDER BY round(score, 9) DESC, consequent) AS rank
  FROM (SELECT state_step AS ss, antecedent, consequent, sum(score) AS score
        FROM (SELECT DISTINCT state_step FROM test) JOIN rule_d ON step < state_step GROUP BY ALL)) r
  ON r.ss = state_step AND antecedent = item_id AND consequent = label AND rank <= 5 GROUP BY state_step"""))
def k8_batches(spark, d):
    return rounded(V.rules_hit_rate(samples.sessions(spark, d), FOLD_K, 5, batch_sessions=BATCH).drop("mrr"))


@check("k9_run_evaluation", with_sql(EVAL + SCORES + SKNN + [ranked(NAMES, 10), who(NAMES), """
rows_ AS (SELECT p.recommender, p.state_step, p.user_id, p.session_id, p.pos, p.rank, p.item_id, l.label,
       coalesce(q.norm_pop, 0.001) AS norm_pop, CASE WHEN rank < 10 THEN 1 / log2(rank + 1) END AS disc
  FROM lists p JOIN lab l USING (user_id, session_id, pos) LEFT JOIN pop q ON q.state_step = p.state_step AND q.item_id = p.item_id)""",
    """hits AS (SELECT w.recommender, l.state_step, l.user_id, l.session_id, l.pos,
       max(CASE WHEN p.item_id = l.label THEN 1.0 ELSE 0 END) AS hit, max(CASE WHEN p.item_id = l.label THEN 1.0 / rank ELSE 0 END) AS rr,
       sum(-log2(norm_pop) * disc) / sum(disc) AS esi_r
  FROM lab l CROSS JOIN who w LEFT JOIN rows_ p ON p.recommender = w.recommender AND p.user_id = l.user_id
    AND p.session_id = l.session_id AND p.pos = l.pos GROUP BY ALL)""",
    """prs AS (SELECT a.recommender, a.state_step, a.user_id, a.session_id, a.pos, (1 - list_cosine_similarity(x.embedding, y.embedding)) / 2 AS dist
  FROM rows_ a JOIN rows_ b ON a.recommender = b.recommender AND a.user_id = b.user_id AND a.session_id = b.session_id AND a.pos = b.pos AND a.rank < b.rank
  JOIN emb x ON x.article_id = a.item_id JOIN emb y ON y.article_id = b.item_id)"""], """
SELECT recommender, metric, count(value) AS steps, round(avg(value), 6) AS mean FROM (
  SELECT recommender, state_step, 'hitrate' AS metric, avg(hit) AS value FROM hits GROUP BY ALL
  UNION ALL SELECT recommender, state_step, 'mrr', avg(rr) FROM hits GROUP BY ALL
  UNION ALL SELECT recommender, state_step, 'esi_r', avg(esi_r) FROM hits GROUP BY ALL
  UNION ALL SELECT recommender, state_step, 'novelty', avg(-log2(norm_pop)) FROM rows_ GROUP BY ALL
  UNION ALL SELECT recommender, state_step, 'ild_avg', avg(v) FROM (
      SELECT recommender, state_step, user_id, session_id, pos, avg(dist) AS v FROM prs GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT w.recommender, s.state_step, 'item_coverage', count(DISTINCT r.item_id) / max(n) FROM who w CROSS JOIN (
      SELECT state_step, CAST(count(*) AS DOUBLE) AS n FROM (SELECT state_step, item_id FROM test UNION SELECT state_step, item_id FROM buffer)
      GROUP BY ALL) s LEFT JOIN rows_ r ON r.recommender = w.recommender AND r.state_step = s.state_step GROUP BY ALL) GROUP BY ALL"""))
def k9(spark, d):
    long = V.run_evaluation(samples.sessions(spark, d), samples.clicks(spark, d), samples.embeddings(spark, d),
                            FOLD_K, 10, NEG, BUFFER_H)
    kept = long.filter(F.col("metric").isin("hitrate", "mrr", "esi_r", "novelty", "ild_avg", "item_coverage"))
    return rounded(M.summarize_metrics(kept).select("recommender", "metric", "steps", "mean"))


@check("k10_d15_cold_start", with_sql(EVAL + SCORES[:6] + [ranked(["coocurrent", "sr"], 10)], """
, first_rec AS (SELECT recommender, item_id, min(t.session_hour) AS h FROM lists p JOIN (
    SELECT user_id, session_id, min(session_hour) AS session_hour FROM test GROUP BY ALL) t USING (user_id, session_id) GROUP BY ALL),
steps AS (SELECT recommender, h - first_step AS s FROM first_rec JOIN (
    SELECT item_id, min(session_hour) AS first_step FROM sc GROUP BY 1) USING (item_id) WHERE h >= first_step)
SELECT recommender, min(s) AS min, max(s) AS max, count(*) AS "count", round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std,
       round(quantile_cont(s, 0.01), 6) AS p01, round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.25), 6) AS p25,
       round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.9), 6) AS p90,
       round(quantile_cont(s, 0.99), 6) AS p99 FROM steps GROUP BY recommender"""))
def k10(spark, d):
    inp = build(spark, d)
    scored = {"coocurrent": R.score_cooccurrence(R.cooccurrence_state(inp.tagged), inp.probes),
              "sr": R.score_rules(R.rules_state(inp.tagged), inp.probes)}
    hours = inp.test.select(*KEY, "session_hour").distinct()
    lists = V.ranked_lists(scored, 10).join(hours, KEY)
    return rounded(V.cold_start_stats(V.cold_start(lists, samples.sessions(spark, d))))


@check("h13_evaluate_external", with_sql(EVAL + SCORES[:6], """
, train AS (SELECT DISTINCT item_id FROM tagged WHERE step < 3),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, session_id) AS n FROM (
    SELECT user_id, session_id, pos, item_id FROM test WHERE item_id IN (SELECT item_id FROM train))) WHERE n >= 2),
l2 AS (SELECT * FROM (SELECT user_id, session_id, pos, lead(item_id) OVER (PARTITION BY user_id, session_id ORDER BY pos) AS label FROM kept)
  WHERE label IS NOT NULL AND (user_id, session_id, pos) IN (SELECT (user_id, session_id, pos) FROM neg)),
allowed AS (SELECT n.user_id, n.session_id, n.pos, n.item_id FROM neg n JOIN l2 USING (user_id, session_id, pos)
  UNION SELECT user_id, session_id, pos, label FROM l2),
ext AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id, pos ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM s_co JOIN allowed USING (user_id, session_id, pos, item_id))
SELECT count(*) AS clicks, round(avg(hit), 6) AS hitrate, round(avg(rr), 6) AS mrr, round(avg(g), 6) AS ndcg FROM (
  SELECT l2.user_id, l2.session_id, l2.pos, max(CASE WHEN item_id = label THEN 1.0 ELSE 0 END) AS hit,
         max(CASE WHEN item_id = label THEN 1.0 / rank ELSE 0 END) AS rr, max(CASE WHEN item_id = label THEN 1 / log2(rank + 1) ELSE 0 END) AS g
  FROM l2 LEFT JOIN ext ON ext.user_id = l2.user_id AND ext.session_id = l2.session_id AND ext.pos = l2.pos AND rank <= 10 GROUP BY ALL)"""))
def h13(spark, d):
    inp = build(spark, d)
    preds = R.score_cooccurrence(R.cooccurrence_state(inp.tagged), inp.probes)
    return rounded(V.evaluate_external(preds, inp.test, inp.tagged.filter("step < 3"), inp.negatives, 10))


@check("k1_click_features", with_sql(session_ctes(24) + [CATALOG], """
SELECT user_id, session_id, pos, item_id, ts_ms, round(sin(a), 6) AS local_hour_sin, round(cos(a), 6) AS local_hour_cos,
       round((wd + 1 - 3.5) / 7, 6) AS weekday, round((least(elapsed_ms, 3600000.0) - 789935.7) / 1371436.0, 6) AS user_elapsed_ms_since_last_click,
       round((least(trunc(active_time_secs / coalesce(text_length, 728)), 10.0) - 1.854) / 1.474, 6) AS active_time_secs_by_word
FROM (SELECT s.*, c.text_length, isodow(t) - 1 AS wd, (hour(t) + minute(t) / 60.0 + 0.000001) / 24.0 * 2 * pi() AS a
      FROM (SELECT *, to_timestamp(ts_ms // 1000) AT TIME ZONE 'Europe/Oslo' AS t FROM sc) s LEFT JOIN catalog c ON c.article_id = item_id)"""))
def k1(spark, d):
    out = Q.click_features(samples.sessions(spark, d, 24), samples.catalog(spark, d))
    return rounded(out)


CONTEXT_CODE = """code_{0} AS (SELECT v, code FROM (SELECT {0} AS v, row_number() OVER (ORDER BY count(*) DESC, {0}) + 1 AS code
  FROM ctx WHERE {0} IS NOT NULL GROUP BY {0} HAVING count(*) >= 5) WHERE code < {1})"""


@check("k1_context_features", with_sql(session_ctes(24) + ["""ctx AS (
  SELECT s.*, n_name AS country, n_regionkey AS region FROM sc s
  LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id LEFT JOIN nation ON n_nationkey = c_nationkey)""",
    CONTEXT_CODE.format("event_type", 1000), CONTEXT_CODE.format("country", 12), CONTEXT_CODE.format("region", 1000)], """
SELECT user_id, session_id, pos, item_id, ts_ms, coalesce(a.code, 1) AS event_type_code, coalesce(b.code, 1) AS country_code,
       coalesce(c.code, 1) AS region_code
FROM ctx LEFT JOIN code_event_type a ON a.v = event_type LEFT JOIN code_country b ON b.v = country LEFT JOIN code_region c ON c.v = region"""))
def k1_context(spark, d):
    """Codes of kind, country and region of each click; ten countries have a code of their own."""
    nations = samples.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"))
    places = samples.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").cast("string").alias("user_id"), "country", "region")
    clicks = samples.sessions(spark, d, 24).join(places, "user_id", "left")
    cfg = Q.FeatureConfig(context={"device": {"event_type": None}, "location": {"country": 12, "region": None}},
                          off=("time", "elapsed", "reading"))
    out = Q.click_features(clicks, samples.catalog(spark, d), cfg, Q.fit_context(clicks, cfg, 5))
    return out.withColumns({c: F.col(c).cast("long") for c in cfg.columns()})


NORM = """((z - zlo + 1e-24) / greatest(zhi - zlo, 2e-24)) * 2 - 1"""


@check("k2_recency", with_sql(EVAL + [CATALOG, """
vals AS (SELECT b.state_step, ln(1 + greatest((mx - created_at_ts) / 86400000.0, 0)) / ln(1.3) AS x
  FROM buffer b JOIN catalog ON article_id = item_id JOIN (SELECT state_step, max(ts_ms) AS mx FROM lab GROUP BY 1) USING (state_step)
  WHERE buffer_pos <= 200),
st AS (SELECT state_step, avg(x) AS m, sqrt(var_pop(x) + 1e-24) AS s, min(x) AS lo, max(x) AS hi FROM (
  SELECT * FROM vals UNION ALL
  SELECT l.state_step, ln(1 + greatest((ts_ms - created_at_ts) / 86400000.0, 0)) / ln(1.3) FROM lab l JOIN catalog ON article_id = item_id
  WHERE l.state_step NOT IN (SELECT state_step FROM vals)) GROUP BY 1)"""], f"""
SELECT user_id, session_id, pos, item_id, round({NORM}, 6) AS recency FROM (
  SELECT l.user_id, l.session_id, l.pos, l.item_id, (ln(1 + greatest((ts_ms - created_at_ts) / 86400000.0, 0)) / ln(1.3) - m) / s AS z,
         (lo - m) / s AS zlo, (hi - m) / s AS zhi FROM lab l JOIN catalog ON article_id = item_id JOIN st USING (state_step))"""))
def k2(spark, d):
    inp = build(spark, d)
    items = inp.labels.select(*CLICK, "state_step", "item_id", "ts_ms")
    out = Q.recency(items, inp.buffer, samples.catalog(spark, d), 200)
    return out.select(*CLICK, "item_id", F.round("recency", 6).alias("recency"))


@check("k3_novelty", with_sql(EVAL + ["""
vals AS (SELECT b.state_step, -log2(norm_pop) AS x FROM buffer b JOIN pop USING (state_step, item_id) WHERE buffer_pos <= 200),
st AS (SELECT state_step, avg(x) AS m, sqrt(var_pop(x) + 1e-24) AS s, min(x) AS lo, max(x) AS hi FROM (
  SELECT * FROM vals UNION ALL
  SELECT l.state_step, -log2(coalesce(norm_pop, 0.001)) FROM lab l LEFT JOIN pop USING (state_step, item_id)
  WHERE l.state_step NOT IN (SELECT state_step FROM vals)) GROUP BY 1)"""], f"""
SELECT user_id, session_id, pos, item_id, round({NORM}, 6) AS novelty FROM (
  SELECT l.user_id, l.session_id, l.pos, l.item_id, (-log2(coalesce(norm_pop, 0.001)) - m) / s AS z, (lo - m) / s AS zlo, (hi - m) / s AS zhi
  FROM lab l JOIN st USING (state_step) LEFT JOIN pop USING (state_step, item_id))"""))
def k3(spark, d):
    inp = build(spark, d)
    items = inp.labels.select(*CLICK, "state_step", "item_id")
    out = Q.novelty(items, inp.popularity, inp.buffer, 200)
    return out.select(*CLICK, "item_id", F.round("novelty", 6).alias("novelty"))


@check("a12_recommendations_log", with_sql(EVAL + SCORES[:6] + [ranked(["coocurrent"], 5)], """
, prob AS (SELECT *, score / sum(score) OVER (PARTITION BY user_id, session_id, pos) AS p FROM lists),
per AS (SELECT p.state_step, p.user_id, p.session_id, p.pos, max(l.label) AS label, string_agg(CAST(p.item_id AS VARCHAR), ',' ORDER BY rank) AS ids,
    string_agg(CAST(CAST(round(p * 1e7) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS probs
  FROM prob p JOIN lab l USING (user_id, session_id, pos) GROUP BY ALL)
SELECT CAST(state_step AS BIGINT) AS eval_hour_id, user_id, CAST(session_id AS VARCHAR) AS session_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY pos) AS next_click_labels,
       string_agg(ids, '|' ORDER BY pos) AS predicted_item_ids, string_agg(probs, '|' ORDER BY pos) AS predicted_item_probs
FROM per GROUP BY ALL"""))
def a12(spark, d):
    inp = build(spark, d)
    scored = R.score_cooccurrence(R.cooccurrence_state(inp.tagged), inp.probes)
    lists = K.rank_candidates(scored, 5)
    share = F.sum("score").over(Window.partitionBy(*CLICK))
    preds = P.with_norm_pop(lists.withColumn("prob", F.col("score") / share), inp.popularity)
    log = L.recommendations_log(preds, inp.labels.withColumn("label", F.col("label_next_item")))
    ids = F.array_join(F.transform("predicted_item_ids", lambda a: join_ids(a)), "|")
    probs = F.array_join(F.transform("predicted_item_probs", lambda a: join_ids(
        F.transform(a, lambda x: F.round(x * 1e7).cast("long")))), "|")
    return log.select("eval_hour_id", "user_id", "session_id", join_ids("next_click_labels").alias("next_click_labels"),
                      ids.alias("predicted_item_ids"), probs.alias("predicted_item_probs"))


@check("a12_negatives_log", with_sql(EVAL, """
SELECT user_id, CAST(session_id AS VARCHAR) AS session_id, string_agg(ids, '|' ORDER BY pos) AS negative_items FROM (
  SELECT user_id, session_id, pos, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY neg_pos) AS ids FROM neg GROUP BY ALL) GROUP BY ALL"""))
def a12_negatives(spark, d):
    log = L.negatives_log(build(spark, d).negatives)
    return log.withColumn("negative_items", F.array_join(F.transform("negative_items", lambda a: join_ids(a)), "|"))


@check("k4_encode_context")
def k4(spark, d):
    codes = samples.clicks(spark, d).select(
        "event_id", (F.col("article_id") % 7).alias("device"), (F.col("article_id") % 90).alias("city"))
    return Q.encode_context(codes, {"device": 7, "city": 90})


@check("k11_sweep")
def k11(spark, d):
    return V.sweep(samples.sessions(spark, d), samples.clicks(spark, d), 72,
                   {"sr": {"max_dist": [5, 10], "rule_decay": ["div", "quadratic"]},
                    "item_knn": {"knn_lambda": [20.0], "knn_alpha": [0.5, 0.75]}})


@check("h10_learned_ranker")
def h10(spark, d):
    inp = build(spark, d, n=20)
    probes = inp.candidates.join(inp.labels.select(*CLICK, "ts_ms"), CLICK)
    scores = {"content": R.score_content(samples.embeddings(spark, d), inp.probes),
              "rule": R.score_rules(R.rules_state(inp.tagged), inp.probes),
              "cooc": R.score_cooccurrence(R.cooccurrence_state(inp.tagged), inp.probes),
              "popularity": R.score_popular(inp.popularity, inp.probes)}
    features = materialize(X.ranker_features(probes, scores, inp.popularity, samples.catalog(spark, d)), "features")
    cut = 15
    model = X.train_ranker(features.filter(F.col("state_step") < cut))
    return K.rank_candidates(X.score_ranker(model, features.filter(F.col("state_step") >= cut)), 10).select(
        *CLICK, "item_id", "is_label", "score", "rank")
