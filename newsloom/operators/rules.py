"""Item pairs within sessions: co-occurrence, sequential rules, rule expansion."""

from pyspark.sql import Window, functions as F

from newsloom.functions.numeric import decay as decay_of
from newsloom.operators.joins import lookup_join
from newsloom.operators.ranking import top_n
from newsloom.operators.sessions import truncate_sessions
from newsloom.schema import KEY, MAX_SESSION_ITEMS
from newsloom.session import materialize


def ordered_pairs(flat, max_dist=10, max_len=MAX_SESSION_ITEMS, carry=()):
    """(antecedent, consequent, distance) for clicks up to ``max_dist`` apart.

    The followers of a click come from ``lead`` over one window on the session, so
    there is no self-join; a click gives at most ``max_dist`` rows.
    """
    ordered = Window.partitionBy(*KEY).orderBy("pos")
    followers = F.array(*[
        F.struct(F.lead("item_id", d).over(ordered).alias("consequent"), F.lit(d).alias("distance"))
        for d in range(1, max_dist + 1)])
    cut = truncate_sessions(flat, max_len)
    return (cut.select(*KEY, *carry, F.col("item_id").alias("antecedent"), followers.alias("_f"))
            .withColumn("_f", F.filter("_f", lambda x: x["consequent"].isNotNull()))
            .select(*KEY, *carry, "antecedent", F.inline("_f")))


def session_pairs(flat, max_len=MAX_SESSION_ITEMS, carry=()):
    """All ordered pairs of different clicks in a session of at most ``max_len``."""
    later = ordered_pairs(flat, max_len - 1, max_len, carry).select(
        *KEY, *carry, F.col("antecedent").alias("item_a"), F.col("consequent").alias("item_b"))
    both = F.array(F.struct(F.col("item_a"), F.col("item_b")),
                   F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))
    return later.select(*KEY, *carry, F.inline(both))


def cooccurrence(flat, by=(), max_len=MAX_SESSION_ITEMS):
    """Sessions that hold both items, symmetric.

    Pairs are counted once in (smaller, larger) order and mirrored after the
    aggregation, which halves the shuffle.
    """
    pairs = ordered_pairs(flat, max_len - 1, max_len, carry=by).select(
        *by, F.least("antecedent", "consequent").alias("_lo"),
        F.greatest("antecedent", "consequent").alias("_hi"))
    counts = pairs.groupBy(*by, "_lo", "_hi").agg(F.count("*").alias("n"))
    mirrored = F.array(F.struct(F.col("_lo").alias("item_a"), F.col("_hi").alias("item_b")),
                       F.struct(F.col("_hi").alias("item_a"), F.col("_lo").alias("item_b")))
    return counts.select(*by, "n", F.inline(mirrored))


def train_rules(flat, max_dist=10, decay="div", by=(), max_len=MAX_SESSION_ITEMS, clip=False):
    """Sequential rules: score(past -> later) = sum of decay(distance).

    Distances are counted before the decay is applied, so the shuffle carries
    integers and the score does not depend on the order of addition.
    """
    pairs = ordered_pairs(flat, max_dist, max_len, carry=by)
    counts = pairs.groupBy(*by, "antecedent", "consequent", "distance").agg(F.count("*").alias("n"))
    scored = counts.withColumn("score", F.col("n") * decay_of(decay, F.col("distance"), clip))
    return scored.groupBy(*by, "antecedent", "consequent").agg(
        F.sum("score").alias("score"), F.sum("n").alias("pairs"))


def top_rules(rules, k):
    """Best k consequents per antecedent (a group holds at most one row per article)."""
    ranked = rules.withColumn("_s", F.round("score", 9))
    return (top_n(ranked, ["antecedent"], "_s", k, tie="consequent")
            .select("antecedent", "consequent", "score", "rank"))


def expand_rules(rules, items, k=100, per_item=10, max_depth=None):
    """Lists of k consequents per item, filled from the rules of listed items.

    When an item has fewer than k direct consequents, the list is walked in order
    and up to ``per_item`` unseen consequents of each listed item are appended,
    until k are found or the list ends.

    A round looks up the next list places of all open lists by one join and folds the finds
    into the lists in list order.  It takes as many places as must be walked to fill the list
    (each gives at most ``per_item``), or as many as were walked before if that is more: at
    most twice the places that are needed, in some seven rounds for a list that hardly grows.
    Full lists leave the rounds, and a list whose places are all walked is done.
    ``max_depth`` bounds the places walked.
    A table row holds k + per_item consequents: at most k of them can be in the
    list already, so the first unseen ones are always among them.
    """
    need = k + per_item
    ordered = (top_rules(rules, need).groupBy("antecedent")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "consequent"))).alias("_l"))
               .select("antecedent", F.transform("_l", lambda x: x["consequent"]).alias("next")))
    ordered = materialize(ordered, "rule-lists")
    lists = (items.select(F.col("item_id")).distinct()
             .join(ordered, F.col("item_id") == F.col("antecedent"))
             .select("item_id", F.slice("next", 1, k).alias("items"), F.lit(0).alias("walked")))
    limit = k if max_depth is None else min(k, max_depth)
    unfinished = (F.size("items") < k) & (F.size("items") > F.col("walked")) & (F.col("walked") < limit)
    lists = materialize(lists.withColumn("open", unfinished), "rule-walk")
    finished = []
    while lists.filter("open").limit(1).count():
        finished.append(lists.filter("NOT open"))
        lists = materialize(_next_places(lists.filter("open"), ordered, k, per_item, limit)
                            .withColumn("open", unfinished), "rule-walk")
    for part in finished:
        lists = lists.unionByName(part)
    return lists.select("item_id", F.posexplode("items").alias("_p", "consequent")).select(
        "item_id", (F.col("_p") + 1).alias("rank"), "consequent")


def _next_places(lists, ordered, k, per_item, limit):
    """Lists after the walk over the next places that they had not walked yet."""
    needed = F.ceil((k - F.size("items")) / per_item).cast("int")
    upto = F.least(F.size("items"), F.lit(limit), F.col("walked") + F.greatest(needed, F.col("walked")))
    lists = lists.withColumn("_upto", upto)
    places = F.slice("items", F.col("walked") + 1, F.col("_upto") - F.col("walked"))
    heads = lists.select("item_id", F.posexplode(places).alias("_p", "_head"))
    found = (lookup_join(heads, ordered.withColumnRenamed("antecedent", "_head"), "_head", "inner")
             .groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("_p", "next"))).alias("_found")))

    def append(so_far, step):
        fresh = F.slice(F.array_except(step["next"], so_far), 1, per_item)
        return F.when(F.size(so_far) < k, F.slice(F.concat(so_far, fresh), 1, k)).otherwise(so_far)

    grown = lookup_join(lists, found, "item_id")
    return grown.select("item_id", F.aggregate(F.coalesce("_found", F.array()), F.col("items"), append).alias("items"),
                        F.col("_upto").alias("walked"))
