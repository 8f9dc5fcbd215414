"""Skip-gram fit without the vocabulary on the driver."""

import heapq
import math
import random

import numpy as np

from newsloom.operators import content as Z, skipgram as G


def test_huffman_runs_make_an_optimal_prefix_code():
    rng = random.Random(3)
    for words in (1, 2, 3, 7, 40, 300):
        counts = sorted(rng.choice([1, 1, 1, 2, 3, rng.randrange(1, 90)]) for _ in range(words))
        histogram = [(c, counts.count(c)) for c in sorted(set(counts))]
        paths, codes = G.tree_paths(np.arange(words), G.huffman_runs(histogram))
        depth = (paths >= 0).sum(axis=1)
        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert sum(d * c for d, c in zip(depth, counts)) == cost
        ways = {tuple(zip(p[:d][::-1], c[:d][::-1])) for p, c, d in zip(paths, codes, depth)}
        assert len(ways) == words and math.isclose(sum(2.0 ** -d for d in depth), 1.0)


def test_word_vectors_of_no_words(spark):
    for rows in ([], [([],), (None,)]):
        assert Z.word_vectors(spark, tokens=spark.createDataFrame(rows, "tokens array<string>"), size=4).collect() == []


def test_word_vectors_find_planted_topics(spark):
    """Null texts and null words, words below the count, texts longer than a sentence, several parts."""
    rng = random.Random(6)
    text = lambda n: [f"{t}{rng.randrange(10)}" for t in [rng.choice("abcde")] for _ in range(n)]
    rows = [(text(8) + [None],) for _ in range(15_000)] + [(text(2500),), (None,), (["rare"],)]
    tokens = spark.createDataFrame(rows, "tokens array<string>")
    vectors = {r.word: np.array(r.vector) for r in Z.word_vectors(spark, tokens=tokens, size=8, min_count=2, partitions=3).collect()}
    assert set(vectors) == {f"{t}{i}" for t in "abcde" for i in range(10)}
    unit = {w: v / np.linalg.norm(v) for w, v in vectors.items()}
    near = {w: max((x for x in unit if x != w), key=lambda x: unit[w] @ unit[x]) for w in unit}
    assert sum(w[0] == x[0] for w, x in near.items()) >= 45


def test_skipgram_parts_have_a_largest_size(spark, monkeypatch):
    monkeypatch.setattr(Z, "SKIPGRAM_PART", 10)
    many = spark.createDataFrame([(["a", "b"],)] * 400, "tokens array<string>")
    assert Z.skipgram_partitions(many, "tokens") == 80
