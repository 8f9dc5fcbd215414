"""Steps whose cost must follow the rows: spread hashing, looked-up words, broadcast vectors, texts split once."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import content as Z, recommenders as R, rules as U, sampling as N
from newsloom.session import fresh_path, materialize, task_count
from newsloom.sources import samples


def brute_negatives(user, session, pos, own, copies, n, seed=42):
    pool = sorted(copies, key=lambda c: (hashlib.md5(f"{seed}|1|{c[1]}".encode()).hexdigest(), c[1]))[:20 * n]
    keyed = sorted((hashlib.md5(f"{seed}|{user}|{session}|{pos}|{c}".encode()).hexdigest(), i) for i, c in pool if i not in own)
    return list(dict.fromkeys(i for _, i in keyed))[:n]


def test_negatives_are_hashed_in_many_tasks(spark):
    clicks = [(f"u{s}", s, pos, (s + pos) % 9, 1, 10 * s + pos) for s in range(30) for pos in (1, 2)]
    recent = [(1, k % 13, 1000 + k) for k in range(100)]
    rows = spark.createDataFrame(clicks, "user_id string, session_id long, pos long, item_id long, state_step long, event_id long")
    buffer = spark.createDataFrame(recent, "state_step long, item_id long, event_id long")
    out = N.sample_negatives(rows, buffer, 3, hourly_steps=True)
    assert out.rdd.getNumPartitions() >= task_count(spark)
    copies = [(c[3], f"b:{c[5]}") for c in clicks] + [(i, f"r:{e}") for _, i, e in recent]
    got = {}
    for r in out.collect():
        got.setdefault((r.user_id, r.session_id, r.pos), {})[r.neg_pos] = r.item_id
    for u, s, pos, *_ in clicks:
        own = {c[3] for c in clicks if c[1] == s}
        assert [got[u, s, pos][k] for k in sorted(got[u, s, pos])] == brute_negatives(u, s, pos, own, copies, 3)


def test_tokens_of_repeated_and_null_ids(spark):
    """Each row keeps its own codes in order; repeated ids failed before."""
    rows = [(1, ["a", "b", "a", "x"]), (1, ["b", "a"]), (None, ["a"]), (2, []), (3, None)]
    texts = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "value string, code int")
    got = [(r.doc_id, r.codes, r.text_length) for r in Z.encode_tokens(texts, vocab, "doc_id").collect()]
    want = [(1, [2, 3, 2, 1], 4), (1, [3, 2], 2), (None, [2], 1), (2, [], 0), (3, None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_vectors_are_broadcast_and_texts_split_once(spark):
    texts = [(k, ["w%d" % ((k * 7 + j) % 5) for j in range(3)] + ["rare%d" % k]) for k in range(8)] + [(9, ["none"])]
    tokens = spark.createDataFrame(texts, "doc_id long, tokens array<string>")
    weights = Z.tfidf(tokens, "doc_id", max_df=1.0)
    assert all("term-counts" in f for f in weights.inputFiles())
    words = {f"w{j}": [float(j), 1.0] for j in range(5)} | {f"rare{k}": [9.0, 9.0] for k in range(8)}
    vectors = spark.createDataFrame(list(words.items()), "word string, vector array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = Z.weighted_doc_vectors(tokens, weights, vectors, [0.5, 0.5], "doc_id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [term" in plan and "hashpartitioning(term" not in plan
        got = {r.doc_id: r.embedding for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sums = {}
    for r in weights.collect():
        s = sums.setdefault(r.doc_id, [0.0, 0.0, 0.0])
        for d in (0, 1):
            s[d] += r.weight * words[r.term][d]
        s[2] += r.weight
    for k, _ in texts:
        want = [x / sums[k][2] for x in sums[k][:2]] if k in sums else [0.5, 0.5]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want))


def test_skipgram_tasks_end_at_the_cores(spark, monkeypatch):
    monkeypatch.setattr(Z, "SKIPGRAM_TOKENS", 4)
    few, many = (spark.createDataFrame([(["a", "b"],)] * n, "tokens array<string>") for n in (4, 400))
    assert Z.skipgram_partitions(few, "tokens") == 3
    assert Z.skipgram_partitions(many, "tokens") == spark.sparkContext.defaultParallelism


def test_compressed_tables_are_not_broadcast(spark):
    """1,500,000 rows of repeated keys: some MB of files, some 50 MB of rows."""
    samples.tune(spark)
    keys = spark.range(1_500_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string").alias("user_id"), F.pmod(F.hash("id"), F.lit(7)).alias("pos"))
    left, right = materialize(keys, "left"), materialize(keys, "right")
    plan = left.join(right, ["user_id", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lsa_follows_the_dense_svd(spark, monkeypatch):
    """Similarities of texts against numpy; a null text, an empty one, one term order and a text beyond a block."""
    monkeypatch.setattr(Z, "GRAM_BLOCK", 40)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = {i: [rng.choice(words) for _ in range(rng.randrange(1, 60))] for i in range(120)}
    texts |= {200: None, 201: [], 202: [w for w in words for _ in range(3)]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>")
    got = {r.doc_id: np.array(r.embedding) for r in Z.lsa_embeddings(frame, "doc_id", k=5).collect()}
    assert set(got) == set(texts)
    grams = {i: Counter(" ".join(t[p:p + n]) for n in (1, 2, 3) for p in range(len(t) - n + 1)) for i, t in ((i, t or []) for i, t in texts.items())}
    df = Counter(g for c in grams.values() for g in c)
    terms = [g for g in df if 2 <= df[g] <= 0.4 * len(texts)]
    rows = np.array([[grams[i][g] * (np.log((1 + len(texts)) / (1 + df[g])) + 1) for g in terms] for i in texts])
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    u, s, _ = np.linalg.svd(norm(rows), full_matrices=False)
    want, mine = norm((u * s)[:, :5]), np.array([got[i] for i in texts])
    filled = [n for n, i in enumerate(texts) if texts[i]]
    # a text far from all five components magnifies the SVD's tolerance
    assert np.allclose((mine @ mine.T)[np.ix_(filled, filled)], (want @ want.T)[np.ix_(filled, filled)], atol=1e-3)


def lines_folder(spark):
    """Order lines with repeated parts and a repeated row: (order, part, supplier, line, day)."""
    rows = [(1, 10, 1, 1, 3), (1, 11, 1, 2, 1), (1, 10, 2, 3, 2), (1, 12, 1, 4, 3), (2, 11, 1, 1, 5), (2, 10, 1, 2, 4), (2, 10, 1, 2, 4),
            (3, 13, 1, 1, 1), (4, 12, 1, 1, 1), (4, 13, 1, 2, 2), (4, 11, 1, 3, 3)]
    folder = fresh_path(spark, "lines")
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, day int")
    df.withColumn("l_shipdate", F.expr("timestamp_seconds(day * 86400)")).drop("day").write.parquet(f"{folder}/lineitem.parquet")
    return folder


BASKETS = {1: [11, 10, 12], 2: [10, 11], 3: [13], 4: [12, 13, 11]}


def test_baskets_are_shuffled_once(spark):
    rows = samples.baskets(spark, lines_folder(spark)).select("session_id", "pos", "item_id", "session_size")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {}
    for r in sorted(rows.collect()):
        got.setdefault(r.session_id, []).append(r.item_id)
        assert r.session_size == len(BASKETS[r.session_id])
    assert got == BASKETS


def test_pairs_of_baskets_need_no_second_deal(spark):
    """One shuffle of the lines and one of the pairs, in parts that adaptive execution keeps small."""
    pairs = U.cooccurrence(samples.baskets(spark, lines_folder(spark)))
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    want = Counter((a, b) for items in BASKETS.values() for a in items for b in items if a != b)
    assert {(r.item_a, r.item_b): r.n for r in pairs.collect()} == want


def test_item_knn_ranks_where_its_pairs_lie(spark):
    """The current item's support is joined last: the ranks need no shuffle of their own."""
    pairs = spark.createDataFrame([(1, 2, 3), (2, 1, 3), (1, 3, 1), (3, 1, 1)], "item_a long, item_b long, n long")
    support = spark.createDataFrame([(1, 4), (2, 3), (3, 1)], "item_id long, support long")
    active = spark.createDataFrame([("u", 1, 1, 1), ("u", 1, 2, 3)], "user_id string, session_id long, pos int, item_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = R.recommend_item_knn(pairs, support, active, 1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(item_a") == 2  # the pairs and the supports
        assert {(r.item_id, r.rec_item, r["rank"]) for r in out.collect()} == {(1, 2, 1), (3, 1, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_negatives_of_null_items_and_more_pools_than_kept(spark, monkeypatch):
    """A pool is decoded once a task, hashed in Arrow batches; missing items are never drawn."""
    clicks = [(f"u{s}", s, pos, None if s == 3 else (s + pos) % 5, s % 4, 10 * s + pos) for s in range(12) for pos in (1, 2)]
    rows = spark.createDataFrame(clicks, "user_id string, session_id long, pos long, item_id long, state_step long, event_id long")
    buffer = spark.createDataFrame([(k % 4, k % 7, 500 + k // 2) for k in range(40)], "state_step long, item_id long, event_id long")
    monkeypatch.setattr(N, "KEPT_POOLS", 1)
    out = N.sample_negatives(rows, buffer, 3, hourly_steps=True)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(out.select("session_id", "pos", "neg_pos", "item_id").collect()):
        got.setdefault((r.session_id, r.pos), []).append(r.item_id)
    for _, s, pos, _, step, _ in clicks:
        own = {c[3] for c in clicks if c[1] == s}
        copies = [(c[3], f"b:{c[5]}") for c in clicks if c[4] == step] + [(k % 7, f"r:{500 + k // 2}") for k in range(40) if k % 4 == step]
        keyed = sorted((hashlib.md5(f"42|u{s}|{s}|{pos}|{c}".encode()).hexdigest(), i) for i, c in copies if i is not None and i not in own)
        assert got[s, pos] == list(dict.fromkeys(i for _, i in keyed))[:3]
