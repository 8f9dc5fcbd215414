"""Metrics over top-10 co-occurrence lists of every session click."""

from pyspark.sql import functions as F

from newsloom.checks.base import CATALOG, CLICKS, EMB, check, session_ctes, with_sql
from newsloom.checks.recommender_checks import COOC, FLAT6, PAIRS
from newsloom.operators import metrics as M, popularity as P, recommenders as R, rules as U, sessions as S
from newsloom.schema import CLICK, KEY
from newsloom.sources import samples

N = 10
CTES = FLAT6 + [EMB, CATALOG, PAIRS, COOC, """pops AS (
  SELECT item_id, greatest(c / (sum(c) OVER () + 1), 0.001) AS norm_pop FROM (
    SELECT article_id AS item_id, count(*) AS c FROM clicks GROUP BY 1))""", """lists AS (
  SELECT t.user_id, t.session_id, t.pos, r.item_b AS item_id, r.rank, p.norm_pop FROM tr t
  JOIN (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY n DESC, item_b) AS rank FROM cooc) r ON r.item_a = t.item_id
  JOIN pops p ON p.item_id = r.item_b WHERE rank <= 10)""", """labels_ AS (
  SELECT * FROM (SELECT user_id, session_id, pos, lead(item_id) OVER (PARTITION BY user_id, session_id ORDER BY pos) AS label FROM tr)
  WHERE label IS NOT NULL)""", """rows_ AS (
  SELECT lb.*, l.item_id, l.rank, l.norm_pop, l.item_id = lb.label AS is_hit,
         CASE WHEN l.item_id = lb.label THEN 1.0 ELSE 0.02 END AS rel,
         CASE WHEN rank < 10 THEN 1 / log2(rank + 1) END AS disc
  FROM labels_ lb LEFT JOIN lists l USING (user_id, session_id, pos))""", """per_click AS (
  SELECT user_id, session_id, pos, max(CASE WHEN is_hit THEN 1.0 ELSE 0 END) AS hit,
         max(CASE WHEN is_hit THEN 1.0 / rank ELSE 0 END) AS rr, max(CASE WHEN is_hit THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg,
         sum(-log2(norm_pop) * disc) / sum(disc) AS esi_r, sum(-log2(norm_pop) * disc * rel) / sum(disc) AS esi_rr
  FROM rows_ GROUP BY ALL)""", """prs AS (
  SELECT lb.user_id, lb.session_id, lb.pos, a.rank AS ri, b.rank AS rj, a.item_id AS ii, b.item_id AS ij, lb.label,
         (1 - list_cosine_similarity(x.embedding, y.embedding)) / 2 AS dist,
         CASE WHEN ca.category_id = cb.category_id THEN 0.0 ELSE 1.0 END AS cdist,
         CASE WHEN a.item_id = label THEN 1.0 ELSE 0.02 END AS rel_i, CASE WHEN b.item_id = label THEN 1.0 ELSE 0.02 END AS rel_j
  FROM labels_ lb JOIN lists a USING (user_id, session_id, pos) JOIN lists b USING (user_id, session_id, pos)
  JOIN emb x ON x.article_id = a.item_id JOIN emb y ON y.article_id = b.item_id
  LEFT JOIN catalog ca ON ca.article_id = a.item_id LEFT JOIN catalog cb ON cb.article_id = b.item_id
  WHERE a.rank <> b.rank)""", """places AS (
  SELECT user_id, session_id, pos, ri, 1 / log2(ri + 1) AS disc, max(rel_i) AS rel,
         avg(dist) FILTER (rj > ri) AS mean_after,
         sum(dist / log2(greatest(0, rj - ri - 1) + 2)) / sum(1 / log2(greatest(0, rj - ri - 1) + 2)) AS inner_all,
         sum(cdist / log2(greatest(0, rj - ri - 1) + 2)) / sum(1 / log2(greatest(0, rj - ri - 1) + 2)) AS inner_cat,
         sum(dist * rel_j / log2(rj - ri + 1)) FILTER (rj > ri) / sum(rel_j / log2(rj - ri + 1)) FILTER (rj > ri) AS inner_rel
  FROM prs GROUP BY ALL)""", """spread AS (
  SELECT user_id, session_id, pos,
         sum(mean_after * disc) FILTER (mean_after IS NOT NULL) / sum(disc) FILTER (mean_after IS NOT NULL) AS eild_r_v2,
         sum(inner_all * disc) / sum(disc) AS eild_r, sum(inner_cat * disc) / sum(disc) AS category_eild,
         sum(inner_rel * disc * rel) FILTER (inner_rel IS NOT NULL) / sum(disc) FILTER (inner_rel IS NOT NULL) AS eild_rr,
         sum(mean_after * disc * rel) FILTER (mean_after IS NOT NULL) / sum(disc) FILTER (mean_after IS NOT NULL) AS eild_rr_v2
  FROM places WHERE ri < 10 GROUP BY ALL)""", """ild AS (
  SELECT user_id, session_id, pos, avg(dist) AS ild_avg, median(dist) AS ild_median, min(dist) AS ild_min
  FROM prs WHERE rj > ri GROUP BY ALL)"""]


def sql(select):
    return with_sql(CTES, select)


def inputs(spark, d):
    """Lists, labels and the popularity of the recommended items."""
    clicks = samples.clicks(spark, d).withColumnRenamed("article_id", "item_id")
    flat = samples.sessions(spark, d)
    cut = S.truncate_sessions(flat)
    lists = R.recommend_cooccurrence(U.cooccurrence(flat), cut, N).select(
        *CLICK, F.col("rec_item").alias("item_id"), "rank")
    preds = P.with_norm_pop(lists, P.recent_popularity(clicks, by=()), by=())
    labels = S.shift_labels(flat).select(*CLICK, F.col("label_next_item").alias("label"))
    return preds, labels


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def simple(name, column, fn):
    @check(name, sql(f"SELECT round(avg({column[0]}), 6) AS {column[1]} FROM per_click"))
    def run(spark, d):
        preds, labels = inputs(spark, d)
        return rounded(fn(preds, labels, N))
    return run


simple("j1_hit_rate", ("hit", "hitrate"), M.hit_rate)
simple("j2_mrr", ("rr", "mrr"), M.mrr)
simple("j3_ndcg", ("ndcg", "ndcg"), M.ndcg)
simple("j7_esi_r", ("esi_r", "esi_r"), M.esi_r)
simple("j8_esi_rr", ("esi_rr", "esi_rr"), M.esi_rr)


@check("j4_hit_rate_by_position", sql("""
SELECT pos, round(avg(hit), 6) AS hitrate, round(avg(norm_pop), 6) AS label_norm_pop, count(*) AS clicks
FROM per_click JOIN labels_ USING (user_id, session_id, pos) JOIN pops ON item_id = label GROUP BY pos"""))
def j4(spark, d):
    preds, labels = inputs(spark, d)
    clicks = samples.clicks(spark, d).withColumnRenamed("article_id", "item_id")
    pop = P.recent_popularity(clicks, by=()).select(F.col("item_id").alias("label"), F.col("norm_pop").alias("label_norm_pop"))
    out = M.hit_rate_by_position(preds, labels.join(pop, "label"), N)
    return rounded(out.withColumn("pos", F.col("pos").cast("long")))


@check("j5_popularity_bias", sql("SELECT round(avg(norm_pop), 6) AS pop_bias FROM rows_ WHERE rank IS NOT NULL"))
def j5(spark, d):
    return rounded(M.popularity_bias(*inputs(spark, d), N))


@check("j6_novelty", sql("SELECT round(avg(-log2(norm_pop)), 6) AS novelty FROM rows_ WHERE rank IS NOT NULL"))
def j6(spark, d):
    return rounded(M.novelty(*inputs(spark, d), N))


@check("j9_item_coverage", sql("""
SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM (
  SELECT item_id FROM tr UNION SELECT label FROM labels_ UNION SELECT article_id FROM clicks)), 6) AS item_coverage
FROM rows_ WHERE rank <= 3"""))
def j9(spark, d):
    preds, labels = inputs(spark, d)
    buffer = samples.clicks(spark, d).select(F.col("article_id").alias("item_id"))
    return rounded(M.item_coverage(preds, labels, S.truncate_sessions(samples.sessions(spark, d)), buffer, 3))


def spread(name, metric, table, fn):
    @check(name, sql(f"SELECT round(avg({metric}), 6) AS {metric} FROM {table}"))
    def run(spark, d):
        preds, labels = inputs(spark, d)
        return rounded(fn(preds, labels, samples.embeddings(spark, d), N))
    return run


spread("j10_ild_avg", "ild_avg", "ild", M.ild_avg)
spread("j11_ild_median", "ild_median", "ild", M.ild_median)
spread("j12_ild_min", "ild_min", "ild", M.ild_min)
spread("j13_eild_r_v2", "eild_r_v2", "spread", M.eild_r_v2)
spread("j14_eild_r", "eild_r", "spread", M.eild_r)
spread("j15_eild_rr", "eild_rr", "spread", M.eild_rr)
spread("j16_eild_rr_v2", "eild_rr_v2", "spread", M.eild_rr_v2)


@check("j17_category_eild", sql("SELECT round(avg(category_eild), 6) AS category_eild FROM spread"))
def j17(spark, d):
    preds, labels = inputs(spark, d)
    return rounded(M.category_eild(preds, labels, samples.catalog(spark, d), N))


METRIC_ROWS = [("hitrate", "avg(hit)", "per_click"), ("mrr", "avg(rr)", "per_click"), ("ndcg", "avg(ndcg)", "per_click"),
               ("esi_r", "avg(esi_r)", "per_click"), ("esi_rr", "avg(esi_rr)", "per_click"),
               ("clicks", "CAST(count(*) AS DOUBLE)", "per_click"),
               ("pop_bias", "avg(norm_pop)", "rows_ WHERE rank IS NOT NULL"),
               ("novelty", "avg(-log2(norm_pop))", "rows_ WHERE rank IS NOT NULL"),
               *[(m, f"avg({m})", "ild") for m in ("ild_avg", "ild_median", "ild_min")],
               *[(m, f"avg({m})", "spread") for m in ("eild_r_v2", "eild_r", "eild_rr", "eild_rr_v2", "category_eild")],
               ("item_coverage", """(SELECT count(DISTINCT item_id) FROM rows_ WHERE rank <= 10) / CAST((SELECT count(*) FROM (
  SELECT item_id FROM tr UNION SELECT label FROM labels_)) AS DOUBLE)""", "(SELECT 1)")]


@check("j18_evaluate", sql(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, round({e}, 6) AS value FROM {t}" for m, e, t in METRIC_ROWS)))
def j18(spark, d):
    preds, labels = inputs(spark, d)
    cut = S.truncate_sessions(samples.sessions(spark, d))
    return rounded(M.evaluate(preds, labels, samples.embeddings(spark, d), N, clicked=cut, buffer=cut,
                              catalog=samples.catalog(spark, d), stage=True))


@check("a11_metrics_table", """
SELECT "index", hour, day, count(*) AS n, round(avg(v), 6) AS value FROM (
  SELECT o_orderkey % 20 AS "index", CAST((o_orderkey % 20 + 1) * 5 % 24 AS INTEGER) AS hour,
         CAST((o_orderkey % 20 + 1) * 5 // 24 AS INTEGER) AS day, o_totalprice AS v FROM orders) GROUP BY ALL""")
def a11(spark, d):
    rows = samples.table(spark, d, "orders").select((F.col("o_orderkey") % 20).alias("index"), F.col("o_totalprice").alias("v"))
    return M.metrics_table(rows, 5).groupBy("index", "hour", "day").agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("value"))


@check("d20_summarize_metrics", """
SELECT o_orderstatus AS recommender, o_orderpriority AS metric, count(*) AS steps, round(avg(o_totalprice), 6) AS mean,
       min(o_totalprice) AS min, round(median(o_totalprice), 6) AS median, max(o_totalprice) AS max FROM orders GROUP BY ALL""")
def d20(spark, d):
    rows = samples.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("recommender"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"))
    return rounded(M.summarize_metrics(rows))


@check("i8_classification_metrics", """
SELECT round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0 END), 6) AS accuracy,
       round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END), 6) AS precision,
       round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS recall
FROM labels""")
def i8(spark, d):
    rows = samples.table(spark, d, "labels").withColumn("guess", 1 - F.col("toxic"))
    return rounded(M.classification_metrics(rows, "quality", "guess"))
