"""Pair tables, state, recommenders over the whole history."""

from pyspark.sql import functions as F

from newsloom.checks.base import BASKETS, CATALOG, CLICKS, EMB, check, fold_ctes, session_ctes, truncated, with_sql
from newsloom.operators import joins as J, learned as M, popularity as P, ranking as K, recommenders as R, rules as U
from newsloom.operators import sampling as N, sessions as S, state as T
from newsloom.plans import evaluation as V
from newsloom.functions.numeric import decay, rank_discount
from newsloom.schema import CLICK, KEY
from newsloom.sources import samples

PAIRS = """pairs AS (
  SELECT a.user_id, a.session_id, a.item_id AS antecedent, b.item_id AS consequent, b.pos - a.pos AS distance
  FROM tr a JOIN tr b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos > a.pos)"""
COOC = """cooc AS (
  SELECT item_a, item_b, count(*) AS n FROM (
    SELECT antecedent AS item_a, consequent AS item_b FROM pairs
    UNION ALL SELECT consequent, antecedent FROM pairs) GROUP BY ALL)"""
RULES = """rules AS (
  SELECT antecedent, consequent, sum(1.0 / CAST(distance AS DOUBLE)) AS score, count(*) AS pairs
  FROM pairs WHERE distance <= 10 GROUP BY ALL)"""
FLAT6 = session_ctes(6) + [truncated()]
FLAT24 = session_ctes(24) + [truncated()]
BASK = BASKETS + [truncated("baskets")]


def flat(spark, d, hours=6):
    return samples.sessions(spark, d, hours)


@check("c9_session_pairs", with_sql(FLAT6 + [PAIRS, COOC], """
SELECT user_id, session_id, antecedent AS item_a, consequent AS item_b FROM pairs
UNION ALL SELECT user_id, session_id, consequent, antecedent FROM pairs"""))
def c9(spark, d):
    return U.session_pairs(flat(spark, d)).select(*KEY, "item_a", "item_b")


@check("c10_ordered_pairs", with_sql(FLAT24 + [PAIRS], """
SELECT user_id, session_id, antecedent, consequent, distance FROM pairs WHERE distance <= 10"""))
def c10(spark, d):
    return U.ordered_pairs(flat(spark, d, 24)).withColumn("distance", F.col("distance").cast("long"))


@check("d13_cooccurrence", with_sql(FLAT24 + [PAIRS, COOC], "SELECT * FROM cooc"))
def d13(spark, d):
    return U.cooccurrence(flat(spark, d, 24))


@check("d13_cooccurrence_baskets", with_sql(BASK + [PAIRS, COOC], "SELECT * FROM cooc"))
def d13_baskets(spark, d):
    return U.cooccurrence(samples.baskets(spark, d))


@check("d12_recent_popularity", with_sql([CLICKS], """
SELECT item_id, clicks, round(greatest(clicks / (sum(clicks) OVER () + 1), 1.0 / 1000), 6) AS norm_pop
FROM (SELECT article_id AS item_id, count(*) AS clicks FROM clicks
      WHERE ts_ms >= epoch_ms(TIMESTAMP '2024-01-20') - 48 * 3600000 AND ts_ms < epoch_ms(TIMESTAMP '2024-01-20') GROUP BY 1)"""))
def d12(spark, d):
    refs = spark.range(1).select(F.lit(0).alias("state_step"), F.lit(1705708800000).alias("ref_ts"))
    clicks = samples.clicks(spark, d).withColumnRenamed("article_id", "item_id")
    return P.recent_popularity(P.click_buffer(clicks, refs, 48)).select(
        "item_id", "clicks", F.round("norm_pop", 6).alias("norm_pop"))


@check("e7_rank_discount", with_sql(FLAT6, "SELECT user_id, session_id, pos, round(1 / log2(pos + 1), 6) AS discount FROM tr"))
def e7(spark, d):
    return S.truncate_sessions(flat(spark, d)).select(*CLICK, F.round(rank_discount("pos"), 6).alias("discount"))


@check("e8_state_at", with_sql(FLAT6 + fold_ctes(96), """
SELECT t.state_step, s.item_id, count(*) AS support
FROM (SELECT DISTINCT CAST(state_step AS BIGINT) AS state_step FROM tagged WHERE state_step IS NOT NULL) t
JOIN tagged s ON s.step < t.state_step AND s.pos <= 20 GROUP BY ALL"""))
def e8(spark, d):
    tagged = V.tag_steps(flat(spark, d), 96)
    state = T.cumulative_state(P.support(S.truncate_sessions(tagged), ["step"]), ["item_id"], ["support"])
    steps = tagged.filter("state_step is not null").select("state_step").distinct()
    return T.state_at(state, steps, ["item_id"], ["support"])


@check("h1_recommend_popular", with_sql([CLICKS], """
SELECT event_type AS state_step, article_id AS item_id, n AS clicks, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, article_id) AS rank FROM (
    SELECT event_type, article_id, count(*) AS n FROM clicks GROUP BY ALL)) WHERE rank <= 10"""))
def h1(spark, d):
    buffer = samples.clicks(spark, d).select(F.col("event_type").alias("state_step"), F.col("article_id").alias("item_id"))
    return R.recommend_popular(P.recent_popularity(buffer), 10).select(
        "state_step", "item_id", "clicks", F.col("rank").cast("long"))


@check("h2_recommend_cooccurrence", with_sql(FLAT6 + [PAIRS, COOC], """
SELECT t.user_id, t.session_id, t.pos, t.item_id, item_b AS rec_item, n, rank FROM tr t JOIN (
  SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY n DESC, item_b) AS rank FROM cooc) r ON r.item_a = t.item_id
WHERE rank <= 5"""))
def h2(spark, d):
    sessions = flat(spark, d)
    return R.recommend_cooccurrence(U.cooccurrence(sessions), S.truncate_sessions(sessions), 5).withColumn(
        "rank", F.col("rank").cast("long"))


KNN = """knn AS (
  SELECT item_a, item_b, round(n / (pow(sb.support + 20, 0.75) * pow(sa.support + 20, 0.25)), 9) AS score
  FROM cooc JOIN supp sa ON sa.item_id = item_a JOIN supp sb ON sb.item_id = item_b)"""
SUPP = "supp AS (SELECT item_id, count(*) AS support FROM tr GROUP BY item_id)"


@check("h3_recommend_item_knn", with_sql(BASK + [PAIRS, COOC, SUPP, KNN], """
SELECT t.user_id, t.session_id, t.pos, t.item_id, item_b AS rec_item, round(score, 6) AS score, rank FROM tr t JOIN (
  SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY score DESC, item_b) AS rank FROM knn) r ON r.item_a = t.item_id
WHERE rank <= 3"""))
def h3(spark, d):
    rows = samples.baskets(spark, d)
    cut = S.truncate_sessions(rows)
    out = R.recommend_item_knn(U.cooccurrence(rows), P.support(cut), cut, 3)
    return out.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@check("h4_train_rules", with_sql(FLAT24 + [PAIRS, RULES], """
SELECT antecedent, consequent, round(score, 6) AS score, pairs FROM rules"""))
def h4(spark, d):
    return U.train_rules(flat(spark, d, 24)).withColumn("score", F.round("score", 6))


@check("h4_recommend_rules", with_sql(FLAT6 + [PAIRS, RULES], """
SELECT t.user_id, t.session_id, t.pos, t.item_id, consequent AS rec_item, round(score, 6) AS score, rank FROM tr t JOIN (
  SELECT antecedent, consequent, score, row_number() OVER (PARTITION BY antecedent ORDER BY round(score, 9) DESC, consequent) AS rank
  FROM rules) r ON r.antecedent = t.item_id WHERE rank <= 5"""))
def h4_rec(spark, d):
    sessions = flat(spark, d)
    out = R.recommend_rules(U.train_rules(sessions), S.truncate_sessions(sessions), 5)
    return out.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@check("h4d_decay_family", with_sql(FLAT24 + [PAIRS], """
SELECT distance, count(*) AS n, 1.0::DOUBLE AS same, round(1.0 / distance, 6) AS div,
       round(CASE WHEN distance <= 100 THEN 1 - 0.1 * distance ELSE 0 END, 6)::DOUBLE AS linear,
       round(1.0 / (distance * distance), 6) AS quadratic, round(1.0 / log10(distance + 1.7), 6) AS log
FROM pairs GROUP BY distance"""))
def h4d(spark, d):
    counts = U.ordered_pairs(flat(spark, d, 24), 19).groupBy(F.col("distance").cast("long").alias("distance")).agg(
        F.count("*").alias("n"))
    return counts.select("distance", "n", *[F.round(decay(x, "distance"), 6).alias(x)
                                            for x in ("same", "div", "linear", "quadratic", "log")])


@check("h5_expand_rules", with_sql(BASK + [PAIRS, RULES], """
, nexts AS (SELECT antecedent, list(consequent ORDER BY round(score, 9) DESC, consequent) AS next FROM rules GROUP BY antecedent),
walk AS (
  SELECT antecedent AS item_id, list_slice(next, 1, 100) AS items, 0 AS place FROM nexts
  UNION ALL
  SELECT w.item_id, list_slice(list_concat(w.items, list_slice(list_filter(coalesce(n.next, []),
         lambda x: NOT list_contains(w.items, x)), 1, 10)), 1, 100), w.place + 1
  FROM walk w LEFT JOIN nexts n ON n.antecedent = w.items[w.place + 1]
  WHERE len(w.items) < 100 AND len(w.items) > w.place)
SELECT item_id, unnest(items) AS consequent, generate_subscripts(items, 1) AS rank
FROM (SELECT item_id, arg_max(items, place) AS items FROM walk GROUP BY item_id)""").replace("WITH ", "WITH RECURSIVE ", 1))
def h5(spark, d):
    rows = samples.baskets(spark, d)
    rules = U.train_rules(rows)
    out = U.expand_rules(rules, rows.select("item_id").distinct(), k=100, per_item=10)
    return out.withColumn("rank", F.col("rank").cast("long"))


KNN_SQL = """
SELECT user_id, session_id, pos, item_id, round(sum(similarity), 6) AS score FROM (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, session_id, pos
        ORDER BY round(similarity, 9) DESC, ns DESC, nu DESC) AS best FROM (
      SELECT *, {sim} AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, session_id, pos ORDER BY {first}ns DESC, nu DESC) AS newest FROM (
          SELECT e.user_id, e.session_id, e.pos, b.user_id AS nu, b.session_id AS ns, b.size,
                 count(*) AS hits, sum(1.0 / CAST(e.pos - p.pos + 1 AS DOUBLE)) AS weight
          FROM test e JOIN test p ON p.user_id = e.user_id AND p.session_id = e.session_id AND p.pos <= e.pos
          JOIN bufitems b ON b.state_step = e.state_step AND b.item_id = p.item_id
          GROUP BY ALL))
      WHERE newest <= {sample})
    WHERE round(similarity, 9) > 0 AND round(similarity, 9) < 1)
  WHERE best <= {k_nn})
JOIN (SELECT user_id AS nu, session_id AS ns, item_id FROM bufitems) USING (nu, ns)
GROUP BY ALL"""


def knn_ctes(size, k):
    return FLAT6 + fold_ctes(k) + ["test AS (SELECT * FROM tagged WHERE state_step IS NOT NULL AND pos <= 20)", f"""buf AS (
  SELECT * FROM (SELECT t.state_step, s.user_id, s.session_id,
      row_number() OVER (PARTITION BY t.state_step ORDER BY s.session_id DESC, s.user_id DESC) AS r
    FROM (SELECT DISTINCT state_step FROM test) t JOIN tagged s ON s.step < t.state_step AND s.pos = 1) WHERE r <= {size})""",
                                   """bufitems AS (
  SELECT buf.state_step, buf.user_id, buf.session_id, t.item_id,
         count(*) OVER (PARTITION BY buf.state_step, buf.user_id, buf.session_id) AS size
  FROM buf JOIN tr t USING (user_id, session_id))"""]


@check("h6_session_knn", with_sql(knn_ctes(3000, 360), KNN_SQL.format(
    sim="weight / (sqrt(pos) * sqrt(size))", sample=1000, k_nn=500, first="")))
def h6(spark, d):
    tagged = V.tag_steps(flat(spark, d), 360)
    active = S.truncate_sessions(tagged.filter("state_step is not null"))
    return R.score_session_knn(tagged, active).withColumn("score", F.round("score", 6))


@check("h6_session_knn_jaccard", with_sql(knn_ctes(3000, 360), KNN_SQL.format(
    sim="hits / CAST(pos + size - hits AS DOUBLE)", sample=1000, k_nn=500, first="")))
def h6_jaccard(spark, d):
    tagged = V.tag_steps(flat(spark, d), 360)
    active = S.truncate_sessions(tagged.filter("state_step is not null"))
    return R.score_session_knn(tagged, active, sim="jaccard", decay="same").withColumn(
        "score", F.round("score", 6))


@check("h6_session_knn_random", with_sql(knn_ctes(3000, 360), KNN_SQL.format(
    sim="weight / (sqrt(pos) * sqrt(size))", sample=100, k_nn=500, first="md5('42:' || ns || ':' || nu), ")))
def h6_random(spark, d):
    """Neighbours from 100 sessions drawn by a seeded hash; drawing them is the operator."""
    tagged = V.tag_steps(flat(spark, d), 360)
    active = S.truncate_sessions(tagged.filter("state_step is not null"))
    return R.score_session_knn(tagged, active, sample=100, sampling="random").withColumn("score", F.round("score", 6))


@check("c11_candidate_sessions", with_sql(knn_ctes(3000, 360), """
SELECT user_id, session_id, pos, ns AS nbr_session, hits FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, session_id, pos ORDER BY ns DESC, nu DESC) AS newest FROM (
    SELECT e.user_id, e.session_id, e.pos, b.user_id AS nu, b.session_id AS ns, count(*) AS hits
    FROM test e JOIN test p ON p.user_id = e.user_id AND p.session_id = e.session_id AND p.pos <= e.pos
    JOIN bufitems b ON b.state_step = e.state_step AND b.item_id = p.item_id GROUP BY ALL)) WHERE newest <= 1000"""))
def c11(spark, d):
    tagged = V.tag_steps(flat(spark, d), 360)
    active = S.truncate_sessions(tagged.filter("state_step is not null"))
    buffered = R.buffer_items(tagged, R.session_buffer(tagged, active.select("state_step").distinct()))
    return R.candidate_sessions(active, buffered).select(
        *CLICK, "nbr_session", F.size("hits").cast("long").alias("hits"))


@check("c13_h7_content", with_sql(FLAT6 + [EMB], """
SELECT user_id, session_id, pos, item_id, rec_item, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, session_id, pos ORDER BY round(score, 9) DESC, rec_item) AS rank FROM (
    SELECT a.user_id, a.session_id, a.pos, a.item_id, c.item_id AS rec_item, list_cosine_similarity(x.embedding, y.embedding) AS score
    FROM tr a JOIN tr c ON c.user_id = a.user_id AND c.session_id = a.session_id AND c.pos <> a.pos
    JOIN emb x ON x.article_id = a.item_id JOIN emb y ON y.article_id = c.item_id))"""))
def c13(spark, d):
    cut = S.truncate_sessions(flat(spark, d))
    others = cut.select(*KEY, F.col("pos").alias("_p"), F.col("item_id").alias("rec_item"))
    probes = (cut.join(others, KEY).filter("pos <> _p")
              .select(*CLICK, F.col("item_id").alias("active_item"), F.col("rec_item").alias("item_id")))
    ranked = K.rank_candidates(R.score_content(samples.embeddings(spark, d), probes))
    return ranked.select(*CLICK, F.col("active_item").alias("item_id"), F.col("item_id").alias("rec_item"),
                         F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@check("h8_item2vec")
def h8(spark, d):
    rows = S.truncate_sessions(samples.baskets(spark, d))
    sentences = S.session_lists(rows.withColumn("session_hour", F.lit(0)), ["item_id"]).withColumnRenamed("item_id", "items")
    vectors = M.train_item2vec(sentences, size=16)
    candidates = rows.select(*CLICK, (F.col("item_id") % 50 + 1).alias("item_id")).distinct()
    return M.recommend_item2vec(rows, candidates, vectors)


@check("h9_fallback", with_sql(BASK + [PAIRS, RULES], """
, best AS (SELECT * FROM (SELECT antecedent, consequent, row_number() OVER (
    PARTITION BY antecedent ORDER BY round(score, 9) DESC, consequent) AS rank FROM rules WHERE antecedent <= 1500) WHERE rank <= 20),
pop AS (SELECT l_partkey AS item, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS item_id, b.antecedent IS NULL AS fallback, rank, rec_item FROM part
LEFT JOIN (SELECT DISTINCT antecedent FROM best) b ON b.antecedent = p_partkey
JOIN (SELECT antecedent AS k, rank, consequent AS rec_item FROM best
      UNION ALL SELECT -1, rank, item FROM pop WHERE rank <= 20) l
  ON l.k = CASE WHEN b.antecedent IS NULL THEN -1 ELSE p_partkey END"""))
def h9(spark, d):
    rules = U.train_rules(samples.baskets(spark, d)).filter("antecedent <= 1500")
    primary = U.top_rules(rules, 20).select(
        F.col("antecedent").alias("item_id"), F.col("consequent").alias("rec_item"), F.col("rank").cast("long").alias("rank"))
    counts = samples.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"))
    top = K.top_n(counts.withColumn("g", F.lit(0)), ["g"], "n", 20)
    popular = top.select(F.col("item_id").alias("rec_item"), F.col("rank").cast("long").alias("rank"))
    parts = samples.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    return R.with_fallback(primary, popular, parts, 20)


@check("h11_softmax", """
SELECT l_orderkey AS user_id, l_partkey AS item_id, round(exp((s - m) / 5.0) / sum(exp((s - m) / 5.0)) OVER (PARTITION BY l_orderkey), 6) AS prob
FROM (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS m FROM (
  SELECT l_orderkey, l_partkey, max(l_quantity) AS s FROM lineitem GROUP BY ALL))""")
def h11(spark, d):
    rows = samples.table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.max("l_quantity").alias("score"))
    return R.softmax_scores(rows, 5.0, ["user_id"]).select("user_id", "item_id", F.round("prob", 6).alias("prob"))


@check("h12_rerank_novelty", """
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(prob + 0.1 * -log2(norm_pop), 9) DESC, item_id) AS rank
FROM (SELECT l_orderkey AS user_id, l_partkey AS item_id, max(l_quantity) / 50.0 AS prob, greatest(max(p.n) / 60000.0, 0.001) AS norm_pop
      FROM lineitem JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) p USING (l_partkey) GROUP BY ALL)""")
def h12(spark, d):
    lines = samples.table(spark, d, "lineitem")
    pop = lines.groupBy("l_partkey").agg(F.greatest(F.count("*") / F.lit(60000.0), F.lit(0.001)).alias("norm_pop"))
    rows = lines.groupBy("l_orderkey", "l_partkey").agg((F.max("l_quantity") / 50.0).alias("prob")).join(pop, "l_partkey")
    rows = rows.select(F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "prob", "norm_pop")
    return R.rerank_novelty(rows, 0.1, ["user_id"]).select("user_id", "item_id", F.col("rank").cast("long"))


@check("c5_top_valid", """
SELECT user_id, item_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT l_orderkey AS user_id, l_partkey AS item_id, max(l_quantity) AS score FROM lineitem GROUP BY ALL)
  WHERE (user_id, item_id) IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N')) WHERE rank <= 2""")
def c5(spark, d):
    lines = samples.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "l_quantity", "l_returnflag")
    scored = lines.groupBy("user_id", "item_id").agg(F.max("l_quantity").alias("score"))
    return K.top_valid(scored, lines.filter("l_returnflag <> 'N'"), 2, ["user_id"]).select(
        "user_id", "item_id", F.col("rank").cast("long"))


@check("c5_pad_lists", """
SELECT l_orderkey AS user_id, array_to_string(list_transform(list_resize(list(l_partkey ORDER BY rank), 4, NULL),
   lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS items
FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_quantity) DESC, l_partkey) AS rank
      FROM lineitem GROUP BY l_orderkey, l_partkey) WHERE rank <= 4 GROUP BY l_orderkey""")
def c5_pad(spark, d):
    lines = samples.table(spark, d, "lineitem")
    scored = lines.groupBy(F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(
        F.max("l_quantity").alias("score"))
    lists = K.pad_lists(K.rank_candidates(scored, 4, ["user_id"]), 4, ["user_id"])
    return lists.select("user_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",", "-").alias("items"))


@check("c6_exclude_items", """
SELECT l_orderkey AS user_id, l_partkey AS item_id, count(*) AS n FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY ALL""")
def c6(spark, d):
    lines = samples.table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"))
    seen = samples.table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("item_id"))
    return K.exclude_items(lines, seen)


@check("c8_exclude_session_items", with_sql(FLAT6, """
SELECT DISTINCT user_id, session_id, cand AS item_id FROM (SELECT user_id, session_id, (item_id * 7) % 100 + 1 AS cand FROM tr) c
WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.user_id = c.user_id AND t.session_id = c.session_id AND t.item_id = c.cand)"""))
def c8(spark, d):
    cut = S.truncate_sessions(flat(spark, d))
    cands = cut.select(*KEY, ((F.col("item_id") * 7) % 100 + 1).alias("item_id")).distinct()
    return N.exclude_session_items(cands, cut)
