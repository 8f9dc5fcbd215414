"""Parts of a skip-gram fit: a task each, superseded copies are deleted, means are taken in blocks."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import content as Z, learned as M, skipgram as G
from newsloom.session import shared_dir


def test_each_part_has_its_own_task(spark):
    """Parts were hashed to the tasks before, so several shared one."""
    rows = [([f"w{k % 7}", f"w{k % 5}"],) for k in range(200)]
    tokens = spark.createDataFrame(rows, "tokens array<string>")
    out = Z.word_vectors(spark, tokens=tokens, size=4, partitions=6)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "part" in plan and ", 6" in plan and "avg(" not in plan
    dealt = spark.range(60).select((F.col("id") % 6).cast("int").alias("part")).repartitionById(6, F.col("part"))
    sizes = dealt.groupBy(F.spark_partition_id()).agg(F.countDistinct("part").alias("n")).collect()
    assert len(sizes) == 6 and all(r.n == 1 for r in sizes)
    assert {r.word for r in out.collect()} == {f"w{k}" for k in range(7)}


def test_superseded_copies_are_deleted(spark):
    """Each iteration's copies of all vectors stayed on disk before."""
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("trained-*"))
    sessions = spark.createDataFrame([([k % 9, (k + 1) % 9, (k + 2) % 9],) for k in range(100)], "items array<long>")
    vectors = M.train_item2vec(sessions, size=4, iterations=4, partitions=2)
    assert len(set(folder.glob("trained-*")) - before) == 1
    assert {r.item_id for r in vectors.collect()} == set(range(9))


def test_means_of_copies():
    copies = pa.table({"part": pa.array([0, 1, 1], pa.int32()), "id": pa.array([5, 9, 5], pa.int64()), "word": ["a", None, "a"],
                       "vector": pa.array([[1.0, 2.0], [7.0, 8.0], [3.0, 6.0]], pa.list_(pa.float32()))})
    assert G._mean_of_copies(2)(copies)["vector"].to_pylist() == [[2.0, 4.0], [7.0, 8.0], [2.0, 4.0]]
    assert G._mean_of_words(2)(copies.filter(pa.array([True, False, True]))).to_pylist() == [{"word": "a", "vector": [2.0, 4.0]}]


@pytest.mark.parametrize("groups", (1, 4))
def test_a_step_adds_the_gradients_of_its_start(groups, monkeypatch):
    """Against one pair at a time: the words around a centre learn its path from the vectors at the step's start."""
    monkeypatch.setattr(G, "STEP_GROUPS", groups)
    rng = np.random.default_rng(4)
    tokens, sentence = rng.integers(0, 9, 30), np.repeat([0, 1, 2], 10)
    paths, codes = G.tree_paths(np.arange(9), G.huffman_runs([(1, 4), (2, 3), (5, 2)]))
    _, back = np.unique(paths, return_inverse=True)
    paths = np.where(paths >= 0, back.reshape(paths.shape) - (paths < 0).any(), -1).astype(np.int32)
    inputs, nodes = rng.normal(size=(9, 3)).astype(np.float32), rng.normal(size=(9, 3)).astype(np.float32)
    nodes[-1] = 0
    reach = np.random.default_rng(1).integers(1, 3, 30)
    moves, turns = np.zeros((9, 3)), np.zeros((9, 3))
    met, crossed = np.zeros(9), np.zeros(9)
    for c in range(30):
        for p in paths[tokens[c]]:
            crossed[p] += p >= 0
        for o in range(max(0, c - reach[c]), min(30, c + reach[c] + 1)):
            if o != c and sentence[o] == sentence[c]:
                met[tokens[o]] += 1
                for p, code in zip(paths[tokens[c]], codes[tokens[c]]):
                    score = inputs[tokens[o]] @ nodes[p] if p >= 0 else 9
                    if abs(score) < 6:
                        slope = (1 - code - 1 / (1 + np.exp(-score))) * 0.1
                        moves[tokens[o]] += slope * nodes[p]
                        turns[p] += slope * inputs[tokens[o]]
    want = [t + s * np.minimum(1, G.STEP_REPEATS / np.maximum(n, 1))[:, None] for t, s, n in ((inputs, moves, met), (nodes, turns, crossed))]
    G.train_part(tokens, sentence, inputs, nodes, paths, codes, 2, np.random.default_rng(1), [0.1, 0.1, 0.1])
    assert np.allclose(inputs, want[0], atol=1e-5) and np.allclose(nodes, want[1], atol=1e-5)
