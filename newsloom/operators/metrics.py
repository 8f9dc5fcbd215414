"""Accuracy, novelty, coverage and diversity of ranked lists.

``preds``: CLICK, rank, item_id, norm_pop (lists of distinct items, no pads).
``labels``: CLICK, label.  ``by`` adds grouping columns (fold, recommender) that
both tables carry.  Every metric is a mean over clicks with a label.
"""

from pyspark.sql import functions as F

from newsloom.functions.numeric import rank_discount
from newsloom.operators.joins import lookup_join
from newsloom.operators.recommenders import pair_vectors
from newsloom.schema import CLICK
from newsloom.session import materialize


def _cut(preds, n):
    return preds.filter(F.col("rank") <= n)


def click_scores(preds, labels, n, by=(), rel_neg=0.02):
    """One row per labelled click with its list-level scores.

    ESI leaves out list place n; lists without a place before n give null.
    """
    by = list(by)
    rows = labels.join(_cut(preds, n), by + CLICK, "left")
    hit = F.col("item_id") == F.col("label")
    disc = F.when(F.col("rank") < n, rank_discount("rank"))
    nov = -F.log2("norm_pop")
    rel = F.when(hit, F.lit(1.0)).otherwise(F.lit(float(rel_neg)))
    return rows.groupBy(*by, *CLICK).agg(
        F.max(F.when(hit, 1.0).otherwise(0.0)).alias("hit"),
        F.max(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"),
        F.max(F.when(hit, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg"),
        F.count("item_id").alias("listed"),
        F.sum("norm_pop").alias("pop_sum"),
        F.sum(nov).alias("nov_sum"),
        (F.sum(nov * disc) / F.sum(disc)).alias("esi_r"),
        (F.sum(nov * disc * rel) / F.sum(disc)).alias("esi_rr"))


def hit_rate(preds, labels, n, by=()):
    return click_scores(preds, labels, n, by).groupBy(*by).agg(F.avg("hit").alias("hitrate"))


def mrr(preds, labels, n, by=()):
    return click_scores(preds, labels, n, by).groupBy(*by).agg(F.avg("rr").alias("mrr"))


def ndcg(preds, labels, n, by=()):
    return click_scores(preds, labels, n, by).groupBy(*by).agg(F.avg("ndcg").alias("ndcg"))


def hit_rate_by_position(preds, labels, n, by=()):
    """Hit rate, mean label popularity and clicks per session position.

    ``labels`` also carry ``label_norm_pop``.
    """
    hits = _cut(preds, n).select(*by, *CLICK, F.col("item_id").alias("label"), F.lit(1.0).alias("hit"))
    return (labels.join(hits, [*by, *CLICK, "label"], "left")
            .groupBy(*by, "pos").agg(
                F.avg(F.coalesce("hit", F.lit(0.0))).alias("hitrate"),
                F.avg("label_norm_pop").alias("label_norm_pop"),
                F.count("*").alias("clicks")))


def _labelled(preds, labels, n, by):
    return _cut(preds, n).join(labels.select(*by, *CLICK), [*by, *CLICK], "left_semi")


def popularity_bias(preds, labels, n, by=()):
    return _labelled(preds, labels, n, by).groupBy(*by).agg(F.avg("norm_pop").alias("pop_bias"))


def novelty(preds, labels, n, by=()):
    return _labelled(preds, labels, n, by).groupBy(*by).agg(F.avg(-F.log2("norm_pop")).alias("novelty"))


def esi_r(preds, labels, n, by=()):
    return click_scores(preds, labels, n, by).groupBy(*by).agg(F.avg("esi_r").alias("esi_r"))


def esi_rr(preds, labels, n, by=(), rel_neg=0.02):
    return click_scores(preds, labels, n, by, rel_neg).groupBy(*by).agg(F.avg("esi_rr").alias("esi_rr"))


def recommendable_items(preds, clicked, buffer, by=()):
    """Clicked, recommended and recently clicked items without repeats."""
    cols = [*by, "item_id"]
    return (preds.select(*cols).union(clicked.select(*cols)).union(buffer.select(*cols)).distinct())


def item_coverage(preds, labels, clicked, buffer, n, by=()):
    """Distinct recommended items over distinct items that could be recommended.

    The denominator holds the initial buffer, the clicked items and the labels.
    """
    by = list(by)
    recommended = _labelled(preds, labels, n, by).select(*by, "item_id").distinct()
    cols = [*by, "item_id"]
    base = (clicked.select(*cols)
            .union(labels.select(*by, F.col("label").alias("item_id")))
            .union(buffer.select(*cols)).distinct())
    tagged = recommended.withColumn("r", F.lit(1)).withColumn("b", F.lit(0)).unionByName(
        base.withColumn("r", F.lit(0)).withColumn("b", F.lit(1)))
    return tagged.groupBy(*by).agg((F.sum("r") / F.sum("b")).alias("item_coverage"))


# ---- diversity ------------------------------------------------------------

def click_lists(preds, labels, n, by=(), emb=None, catalog=None):
    """Each labelled click's list cut at n as one array ``l``, with the label if it is listed; items without a vector are left out."""
    by = list(by)
    rows = _cut(preds, n).select(*by, *CLICK, "rank", "item_id")
    if emb is not None:
        rows = rows.join(emb.select(F.col("article_id").alias("item_id")), "item_id", "left_semi")
    if catalog is not None:
        rows = lookup_join(rows, catalog.select(F.col("article_id").alias("item_id"), F.col("category_id").alias("cat")), "item_id")
    else:
        rows = rows.withColumn("cat", F.lit(None).cast("int"))
    rows = rows.join(labels.select(*by, *CLICK, "label"), by + CLICK)
    lists = rows.groupBy(*by, *CLICK).agg(
        F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("rank", "item_id", "cat"))).alias("l"))
    listed = F.array_contains(F.transform("l", lambda x: x["item_id"]), F.col("label"))
    return lists.filter(F.size("l") > 1).withColumn("label", F.when(listed, F.col("label")))


LIST = ["_list", "_first", "copies"]


def same_lists(lists, by=()):
    """Clicks with equal lists as one row with their number: the columns of ``LIST`` stand for the click.

    A list's scores depend on its places and the label's alone, and a recommender that goes by the
    current item gives many clicks the same list: it is scored once, however many clicks have it.
    A list is named by two hashes, of itself and of one of its clicks.
    """
    equal = lists.groupBy(*by, "l", "label").agg(F.min(F.xxhash64(*CLICK)).alias("_first"), F.count("*").alias("copies"))
    return equal.withColumn("_list", F.xxhash64("l", "label"))


def weighted_pairs(preds, labels, n, by=(), rel_neg=0.02, emb=None, catalog=None):
    """Pairs of each labelled click's list cut at n, with the weight of their distance in each score."""
    return list_pairs(click_lists(preds, labels, n, by, emb, catalog), n, [*by, *CLICK], rel_neg)


def list_pairs(lists, n, keys, rel_neg=0.02):
    """Pairs of each list with the weight of their distance in each score.

    A list is one row, and its pairs come from its own array: at most n(n-1)/2.
    Every score but median and minimum is a weighted sum of the pair distances,
    and the weights depend on places and label only.  Outer weights run over list
    places before n; inner weights fall with the distance of j behind i, and all
    places before i weigh 1.
    """
    # each step's arrays are columns of the next, computed once
    place = F.transform("l", lambda x: F.struct(
        x["rank"].alias("r"), x["item_id"].alias("item"), x["cat"].alias("cat"),
        F.when(x["rank"] < n, rank_discount(x["rank"])).alias("disc"),
        F.when(x["item_id"] == F.col("label"), 1.0).otherwise(float(rel_neg)).alias("rel")))
    lists = lists.select(*keys, F.explode(F.array(place)).alias("p"))

    def near(i, j):
        return 1.0 / F.log2(j["r"] - i["r"] + 1)

    def inner(pick):
        return F.transform("p", lambda x, a: F.aggregate(
            F.filter("p", lambda y: y["r"] > x["r"]), F.lit(0.0), lambda total, y: total + pick(x, y)))

    def discounts(upto):
        return F.aggregate(F.slice("p", 1, upto), F.lit(0.0), lambda total, x: total + F.coalesce(x["disc"], F.lit(0.0)))
    lists = lists.select(*keys, "p", F.inline(F.array(F.struct(
        inner(near).alias("w"), inner(lambda x, y: near(x, y) * y["rel"]).alias("v"),
        discounts(F.size("p")).alias("all_"), discounts(F.size("p") - 1).alias("some")))))
    pairs = lists.select(*keys, "p", "w", "v", "all_", "some", F.posexplode("p").alias("a", "i"))
    pairs = pairs.select("*", F.explode(F.transform(F.filter("p", lambda y: y["r"] > F.col("i.r")), lambda y: y)).alias("j"))
    place_of = F.col("a") + 1
    behind = F.array_position(F.transform("p", lambda y: y["r"]), F.col("j.r"))
    pairs = pairs.withColumn("b", behind.cast("int"))
    disc_i, disc_j = F.coalesce("i.disc", F.lit(0.0)), F.coalesce("j.disc", F.lit(0.0))
    w = near(F.col("i"), F.col("j"))
    # all places before a place weigh 1 each
    total_i, total_j = F.element_at("w", place_of) + F.col("a"), F.element_at("w", F.col("b")) + F.col("b") - 1
    after = F.size("p") - place_of
    return pairs.select(
        *keys, F.col("i.item").alias("item_i"), F.col("j.item").alias("item_j"),
        F.when(F.col("i.cat") == F.col("j.cat"), 0.0).otherwise(1.0).alias("cat_dist"),
        (disc_i / after / F.col("some")).alias("k_mean"),
        ((disc_i * w / total_i + disc_j / total_j) / F.col("all_")).alias("k_all"),
        (disc_i * F.col("i.rel") * w * F.col("j.rel") / F.element_at("v", place_of) / F.col("some")).alias("k_rel"),
        (disc_i * F.col("i.rel") / after / F.col("some")).alias("k_mean_rel"))


def item_pairs(lists):
    """The pairs of articles in the lists, without places and weights."""
    firsts = lists.select("l").distinct().select("l", F.explode("l").alias("i"))
    return firsts.select(F.col("i.item_id").alias("item_i"), F.explode(F.transform(
        F.filter("l", lambda y: y["rank"] > F.col("i.rank")), lambda y: y["item_id"])).alias("item_j"))


def pair_distances(pairs, emb, asked=None):
    """Attach (1 - cosine) / 2; each unordered pair of articles is computed once.

    ``asked``: the pairs of articles, where they are had with less work than ``pairs``.
    """
    def ordered(df):
        return df.withColumn("_a", F.least("item_i", "item_j")).withColumn("_b", F.greatest("item_i", "item_j"))
    keyed = ordered(pairs)
    sims = pair_vectors(keyed if asked is None else ordered(asked), emb, "_a", "_b")
    dist = sims.select("_a", "_b", ((1 - F.col("similarity")) / 2).alias("dist"))
    return lookup_join(keyed, dist, ["_a", "_b"], "inner").drop("_a", "_b")


def click_diversity(pairs, by=(), click=CLICK):
    """One row per labelled click with every intra-list diversity score."""
    scores = pairs.groupBy(*by, *click).agg(
        F.avg("dist").alias("ild_avg"), F.min("dist").alias("ild_min"),
        F.sort_array(F.collect_list("dist")).alias("_d"),  # at most n(n-1)/2 values
        F.sum(F.col("dist") * F.col("k_mean")).alias("eild_r_v2"),
        F.sum(F.col("dist") * F.col("k_all")).alias("eild_r"),
        F.sum(F.col("dist") * F.col("k_rel")).alias("eild_rr"),
        F.sum(F.col("dist") * F.col("k_mean_rel")).alias("eild_rr_v2"),
        F.sum(F.col("cat_dist") * F.col("k_all")).alias("category_eild"))
    m = F.size("_d")
    lower, upper = (F.get("_d", F.floor(x).cast("int")) for x in ((m - 1) / 2, m / 2))
    return scores.withColumn("ild_median", (lower + upper) / 2).drop("_d")


DIVERSITY = ["ild_avg", "ild_median", "ild_min", "eild_r_v2", "eild_r", "eild_rr",
             "eild_rr_v2", "category_eild"]


def list_means(lists, n, emb, metrics, by=(), rel_neg=0.02):
    """Mean of the diversity scores over clicks; equal lists are scored once.

    Without vectors the distance is that of the categories.
    """
    lists = same_lists(lists, by)
    pairs = list_pairs(lists, n, [*by, *LIST], rel_neg)
    pairs = pairs.withColumn("dist", F.col("cat_dist")) if emb is None else pair_distances(pairs, emb, item_pairs(lists))
    scores = click_diversity(pairs, by, LIST)
    return scores.groupBy(*by).agg(*[
        (F.sum(F.col(m) * F.col("copies")) / F.sum(F.when(F.col(m).isNotNull(), F.col("copies")))).alias(m) for m in metrics])


def diversity(preds, labels, emb, n, by=(), catalog=None, rel_neg=0.02):
    """Mean of every diversity score per group; the category score is null without a catalogue."""
    means = list_means(click_lists(preds, labels, n, by, emb, catalog), n, emb, DIVERSITY, by, rel_neg)
    return means if catalog is not None else means.withColumn("category_eild", F.lit(None).cast("double"))


def _one(metric):
    def single(preds, labels, emb, n, by=(), rel_neg=0.02):
        return list_means(click_lists(preds, labels, n, by, emb), n, emb, [metric], by, rel_neg)
    single.__name__ = metric
    single.__doc__ = f"Mean {metric} of the lists cut at n."
    return single


ild_avg, ild_median, ild_min = _one("ild_avg"), _one("ild_median"), _one("ild_min")
eild_r_v2, eild_r = _one("eild_r_v2"), _one("eild_r")
eild_rr, eild_rr_v2 = _one("eild_rr"), _one("eild_rr_v2")


def category_eild(preds, labels, catalog, n, by=()):
    """EILD-R with a 0/1 category distance (no vectors needed)."""
    return list_means(click_lists(preds, labels, n, by, catalog=catalog), n, None, ["category_eild"], by)


ACCURACY = {"hitrate": "hit", "mrr": "rr", "ndcg": "ndcg", "esi_r": "esi_r", "esi_rr": "esi_rr"}


def evaluate(preds, labels, emb, n, by=(), clicked=None, buffer=None, catalog=None, rel_neg=0.02,
             stage=False):
    """All metrics per group, long form (by..., metric, value).

    Several aggregates read the lists; ``stage`` writes them once to the shared
    folder instead of computing them for each.
    """
    by = list(by)
    if stage:
        preds, labels = materialize(preds, "preds"), materialize(labels, "labels")
    scores = click_scores(preds, labels, n, by, rel_neg)
    wide = scores.groupBy(*by).agg(
        *[F.avg(c).alias(m) for m, c in ACCURACY.items()],
        (F.sum("pop_sum") / F.sum("listed")).alias("pop_bias"),
        (F.sum("nov_sum") / F.sum("listed")).alias("novelty"),
        F.count("*").cast("double").alias("clicks"))
    spread = diversity(preds, labels, emb, n, by, catalog, rel_neg)
    parts = [(wide, [*ACCURACY, "pop_bias", "novelty", "clicks"]), (spread, DIVERSITY)]
    if clicked is not None:
        parts.append((item_coverage(preds, labels, clicked, buffer, n, by), ["item_coverage"]))
    out = None
    for table, names in parts:
        long = table.unpivot(by, names, "metric", "value") if by else table.select(
            F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))
        out = long if out is None else out.unionByName(long)
    return out


# ---- classification -------------------------------------------------------

def classification_metrics(preds, label="label", prediction="prediction", positive=1):
    """Accuracy, precision and recall in one aggregate."""
    hit, said, true = (F.col(label) == F.col(prediction), F.col(prediction) == positive, F.col(label) == positive)
    both = F.sum((said & true).cast("long"))
    return preds.agg(
        F.avg(hit.cast("double")).alias("accuracy"),
        F.try_divide(both, F.sum(said.cast("long"))).alias("precision"),
        F.try_divide(both, F.sum(true.cast("long"))).alias("recall"))


# ---- logged metrics -------------------------------------------------------

def metrics_table(df, k):
    """Evaluation log with the hour of day and day of each evaluation step."""
    end = (F.col("index") + 1) * k
    return df.withColumn("hour", (end % 24).cast("int")).withColumn("day", F.floor(end / 24).cast("int"))


def summarize_metrics(metrics, by=("recommender", "metric")):
    """Mean and spread of each logged metric."""
    return metrics.groupBy(*by).agg(
        F.count("value").alias("steps"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.expr("percentile(value, 0.5)").alias("median"),
        F.max("value").alias("max"))
