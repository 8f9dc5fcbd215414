"""Every metric against a direct Python definition on random lists."""

import math
import random
import statistics

import pytest

from newsloom.operators import metrics as M

N = 5


def disc(i):
    return 1 / math.log2(i + 2)


def cos_dist(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return (1 - dot / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))) / 2


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    vec = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(1, 21)}
    cat = {i: i % 3 for i in vec}
    pop = {i: rng.uniform(0.001, 0.2) for i in vec}
    lists = {s: rng.sample(sorted(vec), N) for s in range(30)}
    label = {s: rng.choice(lists[s]) if rng.random() < .5 else rng.randint(1, 20) for s in lists}
    preds = spark.createDataFrame([(f"u{s}", s, 1, r + 1, x, pop[x]) for s, items in lists.items() for r, x in enumerate(items)],
                                  "user_id string, session_id long, pos int, rank int, item_id long, norm_pop double")
    labels = spark.createDataFrame([(f"u{s}", s, 1, x) for s, x in label.items()], "user_id string, session_id long, pos int, label long")
    emb = spark.createDataFrame([(i, v) for i, v in vec.items()], "article_id long, embedding array<double>")
    cats = spark.createDataFrame([(i, c) for i, c in cat.items()], "article_id long, category_id int")
    return dict(vec=vec, cat=cat, pop=pop, lists=lists, label=label, preds=preds, labels=labels, emb=emb, cats=cats)


def brute(d, rel_neg=0.02):
    out = {m: [] for m in ("hitrate", "mrr", "ndcg", "esi_r", "esi_rr", *M.DIVERSITY)}
    for s, items in d["lists"].items():
        lab = d["label"][s]
        rank = items.index(lab) + 1 if lab in items else None
        out["hitrate"].append(float(rank is not None))
        out["mrr"].append(1 / rank if rank else 0)
        out["ndcg"].append(1 / math.log2(rank + 1) if rank else 0)
        rel = [1.0 if x == lab else rel_neg for x in items]
        nov = [-math.log2(d["pop"][x]) for x in items]
        places = range(N - 1)
        total = sum(disc(i) for i in places)
        out["esi_r"].append(sum(nov[i] * disc(i) for i in places) / total)
        out["esi_rr"].append(sum(nov[i] * disc(i) * rel[i] for i in places) / total)
        dist = [[cos_dist(d["vec"][a], d["vec"][b]) for b in items] for a in items]
        pairs = [dist[i][j] for i in range(N) for j in range(i + 1, N)]
        out["ild_avg"].append(statistics.mean(pairs))
        out["ild_median"].append(statistics.median(pairs))
        out["ild_min"].append(min(pairs))
        after = {i: statistics.mean(dist[i][i + 1:]) for i in places}
        out["eild_r_v2"].append(sum(after[i] * disc(i) for i in places) / total)
        out["eild_rr_v2"].append(sum(after[i] * disc(i) * rel[i] for i in places) / total)

        def near(i, table):
            js = [j for j in range(N) if j != i]
            w = {j: disc(max(0, j - i - 1)) for j in js}
            return sum(table(i, j) * w[j] for j in js) / sum(w.values())
        out["eild_r"].append(sum(near(i, lambda a, b: dist[a][b]) * disc(i) for i in places) / total)
        cat = [d["cat"][x] for x in items]
        out["category_eild"].append(sum(near(i, lambda a, b: float(cat[a] != cat[b])) * disc(i) for i in places) / total)

        def relevant(i):
            w = {j: disc(j - i - 1) * rel[j] for j in range(i + 1, N)}
            return sum(dist[i][j] * w[j] for j in w) / sum(w.values())
        out["eild_rr"].append(sum(relevant(i) * disc(i) * rel[i] for i in places) / total)
    return {m: statistics.mean(v) for m, v in out.items()}


def test_all_metrics(data):
    got = {r.metric: r.value for r in M.evaluate(data["preds"], data["labels"], data["emb"], N, catalog=data["cats"]).collect()}
    for name, value in brute(data).items():
        assert got[name] == pytest.approx(value, abs=1e-9), name


def test_known_list(spark):
    preds = spark.createDataFrame([("u", 1, 1, r + 1, x, .1) for r, x in enumerate([5, 3, 9])],
                                  "user_id string, session_id long, pos int, rank int, item_id long, norm_pop double")
    labels = spark.createDataFrame([("u", 1, 1, 3)], "user_id string, session_id long, pos int, label long")
    row = M.click_scores(preds, labels, 3).first()
    assert (row.hit, row.rr, round(row.ndcg, 9)) == (1, .5, round(1 / math.log2(3), 9))


def test_empty_list_counts_as_miss_and_top1_has_no_esi(spark):
    preds = spark.createDataFrame([("u", 1, 1, 1, 3, .1)], "user_id string, session_id long, pos int, rank int, item_id long, norm_pop double")
    labels = spark.createDataFrame([("u", 1, 1, 3), ("v", 2, 1, 3)], "user_id string, session_id long, pos int, label long")
    assert M.hit_rate(preds, labels, 1).first().hitrate == .5
    assert M.esi_r(preds, labels, 1).first().esi_r is None


def test_equal_lists_are_scored_once(data, spark):
    """Clicks with one list and label place share a row; means still count every click."""
    from pyspark.sql import functions as F
    again = F.explode(F.sequence(F.lit(0), F.col("session_id") % 3))
    more = [df.withColumn("k", again).withColumn("session_id", F.col("session_id") + 100 * F.col("k")).drop("k") for df in (data["preds"], data["labels"])]
    lists = M.click_lists(*more, N, emb=data["emb"], catalog=data["cats"])
    same = M.same_lists(lists)
    assert lists.count() == 60 and same.count() == 30 and same.select(M.LIST[:2]).distinct().count() == 30
    alone = M.click_diversity(M.pair_distances(M.weighted_pairs(*more, N, emb=data["emb"], catalog=data["cats"]), data["emb"]))
    want = alone.agg(*[F.avg(m).alias(m) for m in M.DIVERSITY]).first()
    got = M.diversity(*more, data["emb"], N, catalog=data["cats"]).first()
    for m in M.DIVERSITY:
        assert got[m] == pytest.approx(want[m], abs=1e-9), m
