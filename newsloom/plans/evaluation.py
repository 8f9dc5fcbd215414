"""Rolling evaluation: folds by hour, prediction with earlier state only."""

import itertools

from pyspark.sql import Window, functions as F

from newsloom.operators import metrics as M
from newsloom.operators import recommenders as R
from newsloom.operators.joins import lookup_join
from newsloom.operators.popularity import click_buffer, recent_popularity, with_norm_pop
from newsloom.operators.ranking import global_rank, rank_candidates, top_n as top_n_rows
from newsloom.operators.state import cumulative_state, visible_rows
from newsloom.operators.sampling import attach_negatives, build_candidates, sample_negatives
from newsloom.operators.sessions import (
    next_item_labels, restrict_to_train_items, shift_labels, truncate_sessions)
from newsloom.schema import CLICK, KEY
from newsloom.session import materialize

BATCHES = 1 << 20


def temporal_folds(hours, k):
    """Hour -> chunk of k consecutive hour files; the first hour of a later chunk is tested.

    ``fold`` is the chunk trained last before the test.  The table has one row per
    hour, so its rank window is as long as the log has hours.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy("session_hour")
    place = F.row_number().over(ordered) - 1
    return (hours.select("session_hour").distinct()
            .withColumn("_p", place)
            .withColumn("chunk", F.floor(F.col("_p") / k).cast("int"))
            .withColumn("is_test", (F.col("_p") % k == 0) & (F.col("chunk") > 0))
            .withColumn("fold", F.when(F.col("is_test"), F.col("chunk") - 1))
            .drop("_p"))


def session_batches(test, batch_sessions):
    """Micro-batch of each test session: ``batch_sessions`` at a time by session id.

    Positions come from a bucketed global rank, so a long hour is not one task.
    """
    sessions = test.filter(F.col("pos") == 1).select("session_hour", *KEY)
    ranked = global_rank(sessions, [("session_hour", True), ("session_id", True), ("user_id", True)], "_rn")
    start = ranked.groupBy("session_hour").agg(F.min("_rn").alias("_from"))
    return (lookup_join(ranked, start, "session_hour", "inner")
            .withColumn("batch", F.floor((F.col("_rn") - F.col("_from")) / batch_sessions))
            .select(*KEY, "batch"))


def tag_steps(flat, k, batch_sessions=None):
    """Add ``step`` (when a session enters the state) and ``state_step`` (test only).

    Frozen state: test sessions see the chunks before theirs.  With
    ``batch_sessions`` they also see the earlier batches of their hour; the same
    sessions belong to the next training chunk, so nothing is rolled back.
    """
    folds = temporal_folds(flat, k)
    # One row per hour of the log.
    tagged = flat.join(F.broadcast(folds), "session_hour")
    chunk = F.col("chunk").cast("long")
    if batch_sessions is None:
        return tagged.withColumn("step", chunk).withColumn(
            "state_step", F.when(F.col("is_test"), chunk))
    batches = session_batches(tagged.filter("is_test"), batch_sessions)
    tagged = tagged.join(batches, KEY, "left")
    return (tagged
            .withColumn("step", F.when(F.col("is_test"), chunk * BATCHES + F.col("batch"))
                        .otherwise(chunk * BATCHES + (BATCHES - 1)))
            .withColumn("state_step", F.when(F.col("is_test"), chunk * BATCHES + F.col("batch")))
            .drop("batch"))


def reference_times(test):
    """First click time of each state step: the point its buffer looks back from."""
    return test.groupBy("state_step").agg(F.min("ts_ms").alias("ref_ts"))


class EvaluationInput:
    """Tables one evaluation shares: tagged history, test clicks, candidates, buffer."""

    def __init__(self, flat, clicks, k, n_negatives=50, buffer_hours=1, buffer_size=20_000,
                 batch_sessions=None, seed=42, norm_clicks=1000, keep=lambda df, name: df):
        self.tagged = keep(tag_steps(keep(flat, "sessions"), k, batch_sessions), "tagged")
        self.test = truncate_sessions(self.tagged.filter(F.col("state_step").isNotNull()))
        self.labels = shift_labels(self.test)
        refs = reference_times(self.test)
        raw = clicks.select("event_id", "ts_ms", F.col("article_id").alias("item_id"))
        self.buffer = keep(click_buffer(raw, refs, buffer_hours, buffer_size,
                                        hourly_refs=batch_sessions is None), "buffer")
        self.norm_clicks = norm_clicks
        self.popularity = recent_popularity(self.buffer, norm_clicks)
        test_clicks = self.test.select(*CLICK, "item_id", "state_step", "event_id")
        self.negatives = keep(sample_negatives(
            test_clicks, self.buffer, n_negatives, seed, hourly_steps=batch_sessions is None), "negatives")
        self.candidates = keep(build_candidates(self.labels, self.negatives), "candidates")
        self.probes = self.candidates.select(*CLICK, "active_item", "item_id", "state_step")


def recommenders(inp, emb, knn_alpha=0.75, knn_lambda=20.0, buffer=3000, sample=1000, k_nn=500,
                 max_dist=10, rule_decay="div", session_decay="div", sim="cosine"):
    """Name -> scored candidates, with the reference settings as defaults."""
    cooc = R.cooccurrence_state(inp.tagged)
    supp = R.support_state(inp.tagged)
    rules = R.rules_state(inp.tagged, max_dist, rule_decay)
    return {
        "pop_recent": R.score_popular(inp.popularity, inp.probes),
        "coocurrent": R.score_cooccurrence(cooc, inp.probes),
        "item_knn": R.score_item_knn(cooc, supp, inp.probes, knn_lambda, knn_alpha),
        "sr": R.score_rules(rules, inp.probes),
        "sknn" if session_decay == "same" else "v-sknn": R.score_session_knn(
            inp.tagged, inp.labels, inp.probes, sim, session_decay, buffer, sample, k_nn),
        "cb": R.score_content(emb, inp.probes),
    }


def ranked_lists(scored, top_n):
    """Union of the recommenders' top lists: (recommender, CLICK, state_step, rank, ...)."""
    out = None
    for name, table in scored.items():
        lists = rank_candidates(table.select(*CLICK, "state_step", "item_id", "score"), top_n)
        lists = lists.withColumn("recommender", F.lit(name))
        out = lists if out is None else out.unionByName(lists)
    return out


def evaluate_lists(inp, lists, emb, top_n, names, catalog=None, rel_neg=0.02, stage=False):
    """Metrics per (recommender, state_step), long form."""
    preds = with_norm_pop(lists, inp.popularity, inp.norm_clicks)
    every = F.explode(F.array(*[F.lit(n) for n in names]))
    labels = inp.labels.select(*CLICK, "state_step", F.col("label_next_item").alias("label")).withColumn(
        "recommender", every)
    clicked = inp.test.select("state_step", "item_id").distinct().withColumn("recommender", every)
    buffer = inp.buffer.select("state_step", "item_id").distinct().withColumn("recommender", every)
    return M.evaluate(preds, labels, emb, top_n, ["recommender", "state_step"], clicked, buffer,
                      catalog, rel_neg, stage)


def run_evaluation(flat, clicks, emb, k=24, top_n=10, n_negatives=50, buffer_hours=1,
                   buffer_size=20_000, batch_sessions=None, seed=42, catalog=None,
                   only=None, stage=True, **settings):
    """All recommenders on all folds in one plan: (recommender, state_step, metric, value).

    The inputs that several recommenders read are written once to the shared
    folder (``stage``); a lost executor re-reads files instead of re-running them.
    """
    keep = materialize if stage else (lambda df, name: df)
    inp = EvaluationInput(flat, clicks, k, n_negatives, buffer_hours, buffer_size,
                          batch_sessions, seed, keep=keep)
    scored = recommenders(inp, emb, **settings)
    if only:
        scored = {name: scored[name] for name in only}
    return evaluate_lists(inp, ranked_lists(scored, top_n), emb, top_n, list(scored), catalog, stage=stage)


def evaluate_fold(inp, scored, top_n=10):
    """Hit rate and MRR per (recommender, state step) of prepared scores."""
    lists = ranked_lists(scored, top_n).withColumn("norm_pop", F.lit(1.0))
    labels = inp.labels.select(*CLICK, "state_step", F.col("label_next_item").alias("label")).withColumn(
        "recommender", F.explode(F.array(*[F.lit(n) for n in scored])))
    by = ["recommender", "state_step"]
    return (M.click_scores(lists, labels, top_n, by).groupBy(*by)
            .agg(F.count("*").alias("clicks"), F.avg("hit").alias("hitrate"), F.avg("rr").alias("mrr")))


def rules_hit_rate(flat, k=24, top_n=5, max_dist=10, decay="div", batch_sessions=None, stage=True):
    """Flagship: rules learned before each test hour, top-n next items, hit rate and MRR.

    The current items of a step are looked up once each; their n best rules are
    then joined to the clicks, so a hot article costs n rows per click.
    """
    tagged = tag_steps(flat, k, batch_sessions)
    labels = shift_labels(tagged.filter(F.col("state_step").isNotNull()))
    active = labels.select("state_step", F.col("item_id").alias("antecedent")).distinct()
    rules = cumulative_state(R.rules_state(tagged, max_dist, decay), ["antecedent", "consequent"], ["score"])
    found = visible_rows(rules, active, ["antecedent"], ["consequent", "score"])
    best = top_n_rows(found.withColumn("score", F.round("score", 9)),
                      ["state_step", "antecedent"], "score", top_n, tie="consequent")
    packed = best.groupBy("state_step", F.col("antecedent").alias("item_id")).agg(
        F.collect_list(F.struct("consequent", "rank")).alias("_l"))
    rows = lookup_join(labels.select(*CLICK, "state_step", "item_id", "label_next_item"), packed,
                       ["state_step", "item_id"])
    hits = F.filter(F.coalesce("_l", F.array().cast("array<struct<consequent:bigint,rank:int>>")),
                    lambda r: r["consequent"] == F.col("label_next_item"))
    rank = F.get(hits, 0)["rank"]
    return rows.withColumn("_rank", rank).groupBy("state_step").agg(
        F.count("*").alias("clicks"), F.avg(F.col("_rank").isNotNull().cast("double")).alias("hitrate"),
        F.avg(F.coalesce(1.0 / F.col("_rank"), F.lit(0.0))).alias("mrr"))


def cold_start(lists, flat, by=("recommender",), step="session_hour"):
    """Steps from an item's first click to its first recommendation, per recommender.

    ``lists`` carry the recommendation's ``step`` in the same unit as ``flat``.
    """
    by = list(by)
    clicked = flat.groupBy("item_id").agg(F.min(step).alias("first_step"))
    rec = lists.groupBy(*by, "item_id").agg(F.min(step).alias("rec_step"))
    both = lookup_join(rec, clicked, "item_id", "inner")
    return both.filter(F.col("rec_step") >= F.col("first_step")).withColumn(
        "steps", F.col("rec_step") - F.col("first_step"))


def cold_start_stats(steps, by=("recommender",)):
    q = [("p01", .01), ("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9), ("p99", .99)]
    counted = steps.groupBy(*by, "steps").agg(F.count("*").alias("f"))
    x, f = F.col("steps").cast("double"), F.col("f")
    mean = F.sum(x * f) / F.sum(f)
    return counted.groupBy(*by).agg(
        F.min("steps").alias("min"),
        *[F.expr(f"percentile(steps, {p}, f)").alias(name) for name, p in q],
        F.max("steps").alias("max"), mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(x * x * f) / F.sum(f) - mean * mean, F.lit(0.0))).alias("std"),
        F.sum("f").alias("count"))


def evaluate_external(preds, test, train, negatives, top_n, by=()):
    """Score lists made elsewhere on the logged positives and negatives.

    Only test items seen in training count, and only sessions with logged
    negatives; a list is cut to the click's candidates before it is ranked.
    """
    kept = restrict_to_train_items(test, train)
    labelled = next_item_labels(kept).filter(F.col("label_next_item").isNotNull())
    logged = attach_negatives(labelled, negatives)
    allowed = logged.select(*CLICK, F.explode(F.concat(
        "negative_items", F.array("label_next_item"))).alias("item_id")).distinct()
    lists = rank_candidates(preds.join(allowed, CLICK + ["item_id"], "left_semi"), top_n)
    labels = logged.select(*CLICK, F.col("label_next_item").alias("label"))
    return (M.click_scores(lists.withColumn("norm_pop", F.lit(1.0)), labels, top_n, by)
            .groupBy(*by).agg(F.count("*").alias("clicks"), F.avg("hit").alias("hitrate"),
                              F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg")))


def sweep(flat, clicks, k, grid, top_n=10, n_negatives=50, buffer_hours=24, seed=42):
    """Every setting of the grid on every fold; the settings ordered by mean MRR.

    ``grid``: {"sr": {"max_dist": [...], "rule_decay": [...]}, "item_knn": {"knn_lambda": [...],
    "knn_alpha": [...]}}.  Candidates are shared by all settings.
    """
    inp = EvaluationInput(flat, clicks, k, n_negatives, buffer_hours, seed=seed, keep=materialize)
    scored = {}
    for params in _settings(grid.get("sr", {})):
        state = R.rules_state(inp.tagged, params.get("max_dist", 10), params.get("rule_decay", "div"))
        scored[_label("sr", params)] = R.score_rules(state, inp.probes)
    if "item_knn" in grid:
        cooc = materialize(R.cooccurrence_state(inp.tagged), "cooccurrence")
        supp = materialize(R.support_state(inp.tagged), "support")
        for params in _settings(grid["item_knn"]):
            scored[_label("item_knn", params)] = R.score_item_knn(
                cooc, supp, inp.probes, params.get("knn_lambda", 20.0), params.get("knn_alpha", 0.75))
    per_fold = evaluate_fold(inp, scored, top_n)
    return (per_fold.groupBy("recommender")
            .agg(F.avg("hitrate").alias("hitrate"), F.avg("mrr").alias("mrr"))
            .orderBy(F.desc("mrr"), "recommender"))


def _settings(grid):
    if not grid:
        return []
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def _label(name, params):
    return name + "".join(f"|{k}={v}" for k, v in params.items())
