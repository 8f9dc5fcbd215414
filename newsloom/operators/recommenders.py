"""Next-click recommenders: state table -> scored candidates.

``probes`` are candidate rows (CLICK, current item ``active_item``, candidate
``item_id``, ``state_step``).  Scores come from keyed lookups, so the work is one
row per candidate however popular the current item is.  Without candidates, the
``*_lists`` forms cut the table to k rows per key first.
"""

from pyspark.sql import Window, functions as F

from newsloom.functions.numeric import decay as decay_of
from newsloom.functions.vectors import dot, l2_normalize
from newsloom.operators.joins import lookup_join
from newsloom.operators.ranking import rank_candidates, rank_rows, top_n
from newsloom.operators.rules import cooccurrence, train_rules
from newsloom.operators.popularity import support
from newsloom.operators.sessions import truncate_sessions
from newsloom.operators.state import asof_totals
from newsloom.schema import CLICK, KEY, MAX_SESSION_ITEMS


# ---- state tables: changes per step (one pass over the history each) --------

def cooccurrence_state(history):
    return cooccurrence(history, by=["step"])


def support_state(history):
    return support(truncate_sessions(history), by=["step"])


def rules_state(history, max_dist=10, decay="div"):
    return train_rules(history, max_dist, decay, by=["step"])


# ---- scoring of given candidates -----------------------------------------

def score_popular(popularity, probes):
    counts = popularity.select("state_step", "item_id", F.col("clicks").cast("double").alias("score"))
    return lookup_join(probes, counts, ["state_step", "item_id"], "inner")


def score_cooccurrence(state, probes):
    pairs = state.withColumnRenamed("item_a", "active_item").withColumnRenamed("item_b", "item_id")
    found = asof_totals(probes, pairs, ["active_item", "item_id"], ["n"])
    return found.withColumn("score", F.col("n").cast("double")).drop("n")


def knn_similarity(n, support_active, support_item, lam=20.0, alpha=0.75):
    return n / (F.pow(support_item + lam, F.lit(alpha)) * F.pow(support_active + lam, F.lit(1.0 - alpha)))


def score_item_knn(pair_state, item_support, probes, lam=20.0, alpha=0.75):
    pairs = pair_state.withColumnRenamed("item_a", "active_item").withColumnRenamed("item_b", "item_id")
    found = asof_totals(probes, pairs, ["active_item", "item_id"], ["n"])
    # an item is looked up once a step, whether it is the current one or a candidate
    items = probes.select("item_id", "state_step").union(probes.select("active_item", "state_step")).distinct()
    totals = asof_totals(items, item_support, ["item_id"], ["support"])
    found = lookup_join(found, totals, ["item_id", "state_step"], "inner")
    active = totals.withColumnsRenamed({"item_id": "active_item", "support": "active_support"})
    found = lookup_join(found, active, ["active_item", "state_step"], "inner")
    score = knn_similarity(F.col("n"), F.col("active_support"), F.col("support"), lam, alpha)
    return found.withColumn("score", score).drop("n", "support", "active_support")


def score_rules(state, probes):
    rules = state.withColumnRenamed("antecedent", "active_item").withColumnRenamed("consequent", "item_id")
    return asof_totals(probes, rules, ["active_item", "item_id"], ["score"])


def unit_vectors(emb, id_col="article_id", vec_col="embedding"):
    return emb.select(F.col(id_col).alias("item_id"), l2_normalize(vec_col).alias("unit"))


def pair_vectors(pairs, emb, a="active_item", b="item_id"):
    """Cosine per distinct (a, b): each pair of articles is computed once."""
    units = unit_vectors(emb)
    distinct = pairs.select(a, b).distinct()
    left = lookup_join(distinct, units.select(F.col("item_id").alias(a), F.col("unit").alias("_u")), a, "inner")
    both = lookup_join(left, units.select(F.col("item_id").alias(b), F.col("unit").alias("_v")), b, "inner")
    return both.select(a, b, dot("_u", "_v").alias("similarity"))


def score_content(emb, probes):
    sims = pair_vectors(probes, emb).withColumnRenamed("similarity", "score")
    return lookup_join(probes, sims, ["active_item", "item_id"], "inner")


# ---- session kNN ----------------------------------------------------------

def session_buffer(history, steps, size=3000):
    """The ``size`` newest sessions visible at each state step.

    No step can add more than ``size`` sessions, so each is cut first (a group
    limit); what is left is spread over the later state steps by a list of them,
    one entry per fold.
    """
    sessions = history.filter(F.col("pos") == 1).select(*KEY, "step")
    newest = [F.desc("session_id"), F.desc("user_id")]
    cut = rank_rows(sessions, ["step"], newest).filter(F.col("rank") <= size)
    later = steps.agg(F.sort_array(F.collect_set("state_step"))).scalar()
    seen = (cut.withColumn("_all", later)
            .select(*KEY, F.explode(F.filter("_all", lambda t: t > F.col("step"))).alias("state_step")))
    return (rank_rows(seen, ["state_step"], newest).filter(F.col("rank") <= size)
            .select("state_step", *KEY))


def buffer_items(history, buffer, max_len=MAX_SESSION_ITEMS):
    """Distinct items of the buffered sessions, each with the session's item count."""
    size = F.count("*").over(Window.partitionBy("state_step", "nbr_user", "nbr_session"))
    rows = truncate_sessions(history, max_len).select(*KEY, "item_id").distinct()
    return (rows.join(buffer, KEY)
            .select("state_step", F.col("user_id").alias("nbr_user"),
                    F.col("session_id").alias("nbr_session"), "item_id")
            .withColumn("nbr_size", size))


def sampling_order(sampling, seed=42):
    """Order in which candidate sessions are taken: the newest first, or by a seeded hash of the session.

    The hash order is the same for every click, so reruns agree and lists can be cut per item before they are joined.
    """
    newest = [F.desc("nbr_session"), F.desc("nbr_user")]
    if sampling == "recent":
        return newest
    if sampling == "random":
        return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("nbr_session").cast("string"), F.col("nbr_user")).cast("binary")), *newest]
    raise ValueError(f"unknown sampling: {sampling}")


def _take(rows, order, size):
    """The first ``size`` places of each click, where a row takes ``copies`` of them (the last one perhaps fewer)."""
    before = Window.partitionBy(*CLICK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(size) - F.coalesce(F.sum("copies").over(before), F.lit(0))
    return rows.withColumn("_left", left).filter(F.col("_left") > 0).withColumn(
        "copies", F.least("copies", "_left").cast("int")).drop("_left")


def candidate_sessions(active, buffered, sample=1000, sampling="recent", seed=42, multiplicity=False):
    """Buffered sessions that share an item with the click's prefix, in sampling order.

    A session counts once however many items it shares, or with ``multiplicity``
    once per shared item (``copies``).  At most ``sample`` are
    kept per click (0 or None: all); the limit is part of the method.  A kept session is among the
    first ``sample`` of every item it shares (all earlier ones with that item are
    candidates too), so each item's list is cut to that first, without loss.  The
    lists are one row per (step, item).  Matched positions are collected per (session,
    neighbour): at most the truncated session length.
    """
    order = sampling_order(sampling, seed)
    listed = buffered
    if sample:
        listed = rank_rows(buffered, ["state_step", "item_id"], order).filter(F.col("rank") <= sample)
    postings = (listed.groupBy("state_step", "item_id")
                .agg(F.collect_list(F.struct("nbr_user", "nbr_session", "nbr_size")).alias("_l")))
    prefix = active.select(*KEY, "pos", "item_id", "state_step", "session_size")
    shared = (lookup_join(prefix, postings, ["state_step", "item_id"], "inner")
              .select(*KEY, "pos", "state_step", "session_size", F.inline("_l"))
              .groupBy(*KEY, "state_step", "session_size", "nbr_user", "nbr_session", "nbr_size")
              .agg(F.sort_array(F.collect_list("pos")).alias("hits")))
    ends = F.filter(F.sequence(F.lit(1), F.col("session_size").cast("int")),
                    lambda p: p >= F.col("hits")[0])
    per_click = shared.withColumn("pos", F.explode(ends)).withColumn(
        "hits", F.filter("hits", lambda h: h <= F.col("pos")))
    per_click = per_click.withColumn("copies", F.size("hits") if multiplicity else F.lit(1))
    if not sample:
        return per_click
    if multiplicity:
        return _take(per_click, order, sample)
    return rank_rows(per_click, CLICK, order).filter(F.col("rank") <= sample).drop("rank")


def neighbour_sessions(candidates, sim="cosine", decay="div", k_nn=500):
    """Similarity of each click prefix to its candidates; best ``k_nn`` in (0, 1)."""
    weight = F.aggregate(
        F.transform("hits", lambda h: decay_of(decay, F.col("pos") - h + 1).cast("double")),
        F.lit(0.0), lambda s, x: s + x)
    a, b = F.col("pos").cast("double"), F.col("nbr_size").cast("double")
    if callable(sim):
        bottom = sim(a, b, F.size("hits"))
    elif sim == "cosine":
        bottom = F.sqrt(a) * F.sqrt(b)
    elif sim == "jaccard":
        bottom = a + b - F.size("hits")
    else:
        raise ValueError(f"unknown similarity: {sim}")
    scored = candidates.withColumn("similarity", weight / bottom)
    near = scored.filter((F.round("similarity", 9) > 0.0) & (F.round("similarity", 9) < 1.0))
    nearest = [F.desc(F.round("similarity", 9)), F.desc("nbr_session"), F.desc("nbr_user")]
    # each row takes a place at least: the cut by rows first is cheap and loses nothing
    best = Window.partitionBy(*CLICK).orderBy(*nearest)
    cut = near.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k_nn).drop("_r")
    return _take(cut, nearest, k_nn).select(*CLICK, "state_step", "nbr_user", "nbr_session", "similarity", "copies")


def score_session_knn(history, active, probes=None, sim="cosine", decay="div",
                      buffer=3000, sample=1000, k_nn=500, sampling="recent", seed=42, multiplicity=False):
    """Item score = sum of the similarities of the neighbour sessions holding it.

    The buffer is at most ``buffer`` sessions of at most 20 items per state step.
    """
    steps = active.select("state_step").distinct()
    buffered = buffer_items(history, session_buffer(history, steps, buffer))
    near = neighbour_sessions(candidate_sessions(active, buffered, sample, sampling, seed, multiplicity), sim, decay, k_nn)
    keys = ["state_step", "nbr_user", "nbr_session"]
    items = buffered.groupBy(*keys).agg(F.collect_list("item_id").alias("_items"))
    votes = lookup_join(near, items, keys, "inner").select(
        *CLICK, (F.col("similarity") * F.col("copies")).alias("similarity"), F.explode("_items").alias("item_id"))
    if probes is not None:
        votes = votes.join(probes.select(*CLICK, "item_id"), CLICK + ["item_id"], "left_semi")
    scores = votes.groupBy(*CLICK, "item_id").agg(F.sum("similarity").alias("score"))
    if probes is None:
        return scores
    return probes.join(scores, CLICK + ["item_id"])


# ---- top-k lists without candidates --------------------------------------

def recommend_popular(popularity, k):
    return top_n(popularity, ["state_step"], "clicks", k)


def recommend_cooccurrence(pairs, active, k):
    best = (top_n(pairs, ["item_a"], "n", k, tie="item_b")
            .select(F.col("item_a").alias("item_id"), F.col("item_b").alias("rec_item"), "n", "rank"))
    return lookup_join_many(active, best)


def recommend_item_knn(pairs, item_support, active, k, lam=20.0, alpha=0.75):
    """Best k items by similarity to each current item; its own support is joined last, so its pairs lie together for the ranks."""
    a = item_support.select(F.col("item_id").alias("item_a"), F.col("support").alias("_sa"))
    b = item_support.select(F.col("item_id").alias("item_b"), F.col("support").alias("_sb"))
    scored = lookup_join(lookup_join(pairs, b, "item_b", "inner"), a, "item_a", "inner")
    scored = scored.withColumn("score", F.round(
        knn_similarity(F.col("n"), F.col("_sa"), F.col("_sb"), lam, alpha), 9))
    best = (top_n(scored, ["item_a"], "score", k, tie="item_b")
            .select(F.col("item_a").alias("item_id"), F.col("item_b").alias("rec_item"), "score", "rank"))
    return lookup_join_many(active, best)


def recommend_rules(rules, active, k):
    scored = rules.withColumn("score", F.round("score", 9))
    best = (top_n(scored, ["antecedent"], "score", k, tie="consequent")
            .select(F.col("antecedent").alias("item_id"), F.col("consequent").alias("rec_item"),
                    "score", "rank"))
    return lookup_join_many(active, best)


def lookup_join_many(active, best):
    """Attach a ready top-k list: packed to one row per item, joined, unpacked.

    The join sees each item once, so a hot current item is a plain lookup.
    """
    cols = [c for c in best.columns if c != "item_id"]
    packed = best.groupBy("item_id").agg(F.collect_list(F.struct(*cols)).alias("_l"))
    joined = lookup_join(active.select(*CLICK, "item_id"), packed, "item_id", "inner")
    return joined.select(*CLICK, "item_id", F.inline("_l"))


def with_fallback(primary, popular, items, k=100):
    """Primary list where the article is known, else the popular list.

    ``popular`` is one list of at most k rows.
    """
    lists = primary.filter(F.col("rank") <= k).groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "rec_item"))).alias("_l"))
    default = popular.filter(F.col("rank") <= k).agg(
        F.sort_array(F.collect_list(F.struct("rank", "rec_item")))).scalar()
    joined = lookup_join(items, lists, "item_id")
    return (joined.withColumn("fallback", F.col("_l").isNull())
            .withColumn("_l", F.coalesce("_l", default))
            .select("item_id", "fallback", F.inline("_l")))


# ---- score post-processing ------------------------------------------------

def softmax_scores(scored, temperature=1.0, click=CLICK):
    """Softmax over each click's candidates (at most 1 + negatives of them)."""
    per_click = Window.partitionBy(*click)
    shifted = F.exp((F.col("score") - F.max("score").over(per_click)) / temperature)
    return (scored.withColumn("_e", shifted)
            .withColumn("prob", F.col("_e") / F.sum("_e").over(per_click)).drop("_e"))


def rerank_novelty(preds, weight, click=CLICK):
    """Rank by probability plus weighted novelty (-log2 of the popularity share)."""
    combined = F.col("prob") + weight * (-F.log2("norm_pop"))
    return rank_candidates(preds.withColumn("score", combined), click=click)
