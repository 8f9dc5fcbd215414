"""Rules, kNN, expansion and sampling against small Python definitions."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from newsloom.operators import joins, ranking, recommenders as R, rules as U, sampling, state


def flat(spark, sessions, step=0):
    rows = []
    for i, items in enumerate(sessions):
        for p, item in enumerate(items):
            rows.append((f"u{i}", i, p + 1, len(items), item, 1000 * i + p, 1000 * i, step if isinstance(step, int) else step[i]))
    return spark.createDataFrame(rows, "user_id string, session_id long, pos int, session_size int, item_id long,"
                                       "ts_ms long, session_start long, step long")


def random_sessions(n, items, seed):
    rng = random.Random(seed)
    # item 1 sits in a third of the sessions
    out = []
    for _ in range(n):
        s = rng.sample(range(2, items), rng.randint(2, 8))
        out.append(s[:3] + [1] + s[3:] if rng.random() < 0.34 else s)
    return out


def test_rule_scores_of_one_session(spark):
    got = {(r.antecedent, r.consequent): r.score for r in U.train_rules(flat(spark, [[1, 2, 3, 4]])).collect()}
    assert got == {(1, 2): 1, (1, 3): .5, (1, 4): 1 / 3, (2, 3): 1, (2, 4): .5, (3, 4): 1}


def test_rule_distance_limit(spark):
    got = {(r.antecedent, r.consequent) for r in U.train_rules(flat(spark, [list(range(1, 13))])).collect()}
    assert (1, 11) in got and (1, 12) not in got


def test_cooccurrence_is_symmetric_and_matches_counts(spark):
    sessions = random_sessions(60, 15, 1)
    want = Counter((a, b) for s in sessions for a in s for b in s if a != b)
    got = {(r.item_a, r.item_b): r.n for r in U.cooccurrence(flat(spark, sessions)).collect()}
    assert got == want
    same = {(r.antecedent, r.consequent): r.score for r in U.train_rules(flat(spark, sessions), 19, "same").collect()}
    for (a, b), n in want.items():
        assert same.get((a, b), 0) + same.get((b, a), 0) == n


def brute_expand(rules, item, k, per_item):
    def order(i):
        return [c for c, s in sorted(rules.get(i, {}).items(), key=lambda x: (-round(x[1], 9), x[0]))]
    out, at = order(item)[:k], 0
    while len(out) < k and at < len(out):
        out += [c for c in order(out[at]) if c not in out][:per_item]
        at += 1
    return out[:k]


def test_expand_rules(spark):
    sessions = [random.Random(i).sample(range(1, 40), 3) for i in range(45)]
    table = U.train_rules(flat(spark, sessions))
    rules = defaultdict(dict)
    for r in table.collect():
        rules[r.antecedent][r.consequent] = r.score
    items = spark.createDataFrame([(i,) for i in range(1, 40)], "item_id long")
    got = defaultdict(dict)
    for r in U.expand_rules(table, items, k=12, per_item=3).collect():
        got[r.item_id][r.rank] = r.consequent
    for i in range(1, 40):
        want = brute_expand(rules, i, 12, 3)
        assert [got[i][r] for r in sorted(got[i])] == want


def test_expand_rules_walks_needed_places(spark, monkeypatch):
    """A round looks up the places that can fill a list, not all of its places; short lists end in few rounds."""
    ring = [(i, (i + j) % 40, 1.0 / j) for i in range(40) for j in range(1, 9)]  # 8 consequents each
    ring += [(100 + i, 100 + (i + j) % 5, 1.0 / j) for i in range(5) for j in range(1, 5)]  # a closed group of 5
    table = spark.createDataFrame(ring, "antecedent long, consequent long, score double")
    rules = defaultdict(dict)
    for a, c, score in ring:
        rules[a][c] = score
    heads, join = [], U.lookup_join

    def counted(left, right, on, how="left"):
        if on == "_head":
            heads.append(left.count())
        return join(left, right, on, how)
    monkeypatch.setattr(U, "lookup_join", counted)
    items = spark.createDataFrame([(a,) for a in rules], "item_id long")
    got = defaultdict(dict)
    for r in U.expand_rules(table, items, k=12, per_item=3).collect():
        got[r.item_id][r.rank] = r.consequent
    for a in rules:
        assert [got[a][r] for r in sorted(got[a])] == brute_expand(rules, a, 12, 3)
    assert heads[0] == 40 * 2 + 5 * 3 and len(heads) <= 5


def brute_knn(history, prefix, sample, k_nn):
    cands = []
    for sid in sorted(history, reverse=True):
        if set(history[sid]) & set(prefix):
            cands.append(sid)
    near = []
    for sid in cands[:sample]:
        b = set(history[sid])
        w = sum(1 / (i + 1) for i, x in enumerate(reversed(prefix)) if x in b)
        sim = w / (math.sqrt(len(prefix)) * math.sqrt(len(b)))
        if 0 < round(sim, 9) < 1:
            near.append((sid, sim))
    near.sort(key=lambda x: (-round(x[1], 9), -x[0]))
    scores = defaultdict(float)
    for sid, sim in near[:k_nn]:
        for x in set(history[sid]):
            scores[x] += sim
    return scores


def test_session_knn(spark):
    sessions = random_sessions(50, 18, 5)
    steps = [0] * 40 + [1] * 10
    df = flat(spark, sessions, steps).withColumn("state_step", F.col("step"))
    active = df.filter("step = 1")
    got = defaultdict(dict)
    for r in R.score_session_knn(df, active, buffer=30, sample=12, k_nn=7).collect():
        got[(r.session_id, r.pos)][r.item_id] = r.score
    history = {i: sessions[i] for i in range(10, 40)}  # the 30 newest before the step
    for sid in range(40, 50):
        for pos in range(1, len(sessions[sid]) + 1):
            want = brute_knn(history, sessions[sid][:pos], 12, 7)
            mine = got.get((sid, pos), {})
            assert set(mine) == set(want)
            assert all(abs(mine[x] - want[x]) < 1e-9 for x in want)


def test_identical_session_is_no_neighbour(spark):
    df = flat(spark, [[1], [1], [1, 2]], [0, 1, 0]).withColumn("state_step", F.col("step"))
    got = R.score_session_knn(df, df.filter("step = 1"), sim="cosine", decay="same").collect()
    assert {r.item_id for r in got} == {1, 2}  # only session 2 votes
    assert all(abs(r.score - 1 / math.sqrt(2)) < 1e-9 for r in got)


def test_state_never_shows_the_future(spark):
    deltas = spark.createDataFrame([(1, 0, 5), (1, 3, 2), (2, 2, 1), (None, 0, 9)], "item_id long, step long, n long")
    probes = spark.createDataFrame([(i, t) for i in (1, 2, 3, None) for t in range(5)], "item_id long, state_step long")
    want = {(1, 1): 5, (1, 2): 5, (1, 3): 5, (1, 4): 7, (2, 3): 1, (2, 4): 1}
    got = state.asof_totals(probes, deltas, ["item_id"], ["n"]).collect()
    assert {(r.item_id, r.state_step): r.n for r in got} == want and len(got) == len(want)
    table = state.cumulative_state(deltas, ["item_id"], ["n"])
    seen = state.visible_rows(table, probes, ["item_id"], ["n"]).collect()
    assert {(r.item_id, r.state_step): r.n for r in seen} == want and len(seen) == len(want)


def test_asof_totals_keep_repeated_probes_and_clashing_names(spark):
    rng = random.Random(4)
    deltas = [(rng.randrange(4), rng.randrange(4), t, rng.randrange(9), rng.random()) for t in range(12) for _ in range(3)]
    probes = [(rng.randrange(4), rng.randrange(4), rng.randrange(14), rng.randrange(3), "x") for _ in range(300)]
    a = spark.createDataFrame(deltas, "a long, b long, step long, n long, w double")
    a = a.groupBy("a", "b", "step").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    p = spark.createDataFrame(probes, "a int, b int, state_step long, pos int, step string")
    got = state.asof_totals(p, a, ["a", "b"], ["n", "w"])
    assert got.columns == ["a", "b", "state_step", "pos", "step", "n", "w"]
    want = Counter()
    for x in probes:
        seen = [(n, w) for i, j, t, n, w in deltas if (i, j) == x[:2] and t < x[2]]
        if seen:
            want[x + (sum(n for n, _ in seen), round(sum(w for _, w in seen), 9))] += 1
    assert Counter((r.a, r.b, r.state_step, r.pos, r.step, r.n, round(r.w, 9)) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_item_knn_scores_as_of_each_step(spark):
    sessions = random_sessions(40, 12, 9)
    df = flat(spark, sessions, [i // 10 for i in range(40)])
    probes = df.select("user_id", "session_id", "pos", F.col("item_id").alias("active_item"), ((F.col("item_id") + 1) % 12).alias("item_id"),
                       (F.col("session_id") % 4).cast("long").alias("state_step"))
    got = {(r.session_id, r.pos): r for r in R.score_item_knn(R.cooccurrence_state(df), R.support_state(df), probes).collect()}
    for sid, items in enumerate(sessions):
        past = [set(s) for i, s in enumerate(sessions) if i // 10 < sid % 4]
        for pos, item in enumerate(items, 1):
            other = (item + 1) % 12
            n = sum(item in s and other in s for s in past)
            assert ((sid, pos) in got) == bool(n)
            if n:
                sup = [sum(x in s for s in past) for x in (item, other)]
                assert abs(got[(sid, pos)].score - n / ((sup[1] + 20) ** .75 * (sup[0] + 20) ** .25)) < 1e-9


def test_lookup_join_keeps_every_row(spark):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.lookup_join(left, right, "k").select("k", "id", "v").collect()
    want = [(1 if i % 3 == 0 else i, i) for i in range(300)]
    assert sorted((r.k, r.id) for r in got) == sorted(want)
    assert all(r.v == (2 * r.k if r.k < 50 else None) for r in got)


def test_global_rank_is_dense_and_total(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("c"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    got = ranking.global_rank(df, [("c", False), ("v", True)], buckets=16).collect()
    want = {v: i + 1 for i, (c, v) in enumerate(sorted(((r.c, r.v) for r in got), key=lambda x: (-x[0], x[1])))}
    assert {r.v: r.rn for r in got} == want


def test_negatives_are_stable_distinct_and_outside_the_session(spark):
    sessions = random_sessions(30, 60, 11)
    df = flat(spark, sessions).withColumn("state_step", F.lit(0)).withColumn(
        "event_id", F.col("session_id") * 100 + F.col("pos"))
    buffer = df.select("state_step", "item_id", (F.col("event_id") + 100000).alias("event_id"))

    def run(parts):
        out = sampling.sample_negatives(df.repartition(parts), buffer.repartition(parts), n=5).collect()
        return sorted((r.session_id, r.pos, r.neg_pos, r.item_id) for r in out)
    one = run(1)
    assert one == run(7)
    per_click = defaultdict(list)
    for sid, pos, _, item in one:
        assert item not in sessions[sid]
        per_click[(sid, pos)].append(item)
    assert all(len(v) == len(set(v)) == 5 for v in per_click.values())
    assert len(per_click) == sum(map(len, sessions))


def brute_sample(history, prefix, sample, multiplicity, first):
    """Sampled candidate sessions of a prefix, with their places."""
    cand = {s: sum(x in items for x in prefix) for s, items in history.items() if set(items) & set(prefix)}
    out, left = {}, sample
    for s in sorted(cand, key=first):
        take = min(cand[s] if multiplicity else 1, left)
        if take:
            out[s] = take
        left -= take
    return out


def test_candidate_sampling(spark):
    import hashlib
    sessions = random_sessions(60, 14, 21)
    df = flat(spark, sessions, [i // 40 for i in range(60)]).withColumn("state_step", F.col("step"))
    history = {i: s for i, s in enumerate(sessions) if i < 40}
    buffered = R.buffer_items(df, R.session_buffer(df, df.filter("step = 1").select("state_step").distinct(), 100))
    firsts = {"recent": lambda s: -s, "random": lambda s: hashlib.md5(f"7:{s}:u{s}".encode()).hexdigest()}
    for sampling, first in firsts.items():
        for multiplicity in (False, True):
            got = defaultdict(dict)
            for r in R.candidate_sessions(df.filter("step = 1"), buffered, 9, sampling, 7, multiplicity).collect():
                got[(r.session_id, r.pos)][r.nbr_session] = r.copies
            for sid in range(40, 60):
                for pos in range(1, len(sessions[sid]) + 1):
                    assert got[(sid, pos)] == brute_sample(history, sessions[sid][:pos], 9, multiplicity, first)


def test_multiplicity_votes(spark):
    df = flat(spark, [[1, 2, 3], [1, 5], [1, 2, 9]], [0, 0, 1]).withColumn("state_step", F.col("step"))
    got = {(r.pos, r.item_id): r.score for r in R.score_session_knn(df, df.filter("step = 1"), decay="same", multiplicity=True).collect()}
    # at place 2 session 0 shares two items and votes twice
    assert abs(got[(2, 3)] - 2 * 2 / math.sqrt(6)) < 1e-9 and abs(got[(2, 5)] - 1 / 2) < 1e-9


def test_item2vec_finds_planted_neighbours(spark):
    """Items of one of ten topics appear together; nearest vectors are of the same topic, with several tasks."""
    from newsloom.operators import learned
    rng = random.Random(6)
    rows = []
    for _ in range(30_000):
        topic = rng.randrange(10)
        rows.append(([topic * 10 + x for x in rng.sample(range(10), 5)],))
    items = spark.createDataFrame(rows, "items array<long>")
    from newsloom.operators.content import skipgram_partitions
    assert skipgram_partitions(items, "items") > 1
    vectors = {r.item_id: r.vector for r in learned.train_item2vec(items, size=16).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    near = [max((i for i in vectors if i != k), key=lambda i: cos(vectors[k], vectors[i])) for k in vectors]
    assert sum(n // 10 == k // 10 for k, n in zip(vectors, near)) >= 0.9 * len(vectors)
