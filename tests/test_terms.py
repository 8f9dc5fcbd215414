"""TF-IDF and document vectors from rows of counts: no row per word is shuffled, and a write leaves no shuffle files."""

import glob
import math
import os
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from newsloom.operators import content as Z
from newsloom.session import materialize

ROWS = [(1, ["a", "b", "a"]), (1, ["a", "c"]), (None, ["a", "d"]), (None, ["d", "d"]), (2, None), (3, ["b", None, "c"]),
        (2, ["c", "b"]), (7, ["a"]), (8, [])]


def brute_tfidf():
    docs = {}
    for k, words in ROWS:
        docs.setdefault(k, Counter()).update(words or [])
    df = Counter(w for c in docs.values() for w in c)
    out = {}
    for k, c in docs.items():
        w = {t: x * (math.log((1 + len(ROWS)) / (1 + df[t])) + 1) for t, x in c.items() if t is not None}
        out |= {(k, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    return out


def test_weights_need_no_shuffle(spark):
    """Repeated and null ids count together, null texts count as texts; the weights were shuffled by id before."""
    tokens = spark.createDataFrame(ROWS, "doc_id long, tokens array<string>")
    weights = Z.tfidf(tokens, "doc_id", max_df=0.9, min_df=1)
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    got, want = {(r.doc_id, r.term): r.weight for r in weights.collect()}, brute_tfidf()
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_document_vectors_shuffle_sums(spark, monkeypatch):
    """A word's several vectors all count, a null vector does not (it ended the query before); no vector is joined to the rows of words."""
    monkeypatch.setattr(Z, "GRAM_BLOCK", 2)
    monkeypatch.setattr(Z, "BATCH_ROWS", 1)
    tokens = spark.createDataFrame(ROWS, "doc_id long, tokens array<string>")
    counted = Z.term_counts(tokens, "doc_id")
    assert {(r.word, r["count"]) for r in Z.word_counts(counted).collect()} == {
        (r.word, r["count"]) for r in Z.word_counts(tokens).collect()}
    table = [("a", [1.0, 0.0]), ("a", [3.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("zz", [9.0, 9.0])]
    vectors = spark.createDataFrame(table, "word string, vector array<double>")
    out = Z.weighted_doc_vectors(tokens, Z.tfidf(tokens, "doc_id", max_df=0.9, min_df=1, counted=counted), vectors, [0.5, 0.5], "doc_id")
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    want, sums = {}, {}
    for (k, t), w in brute_tfidf().items():
        for word, v in table:
            if word == t and k is not None and v is not None:
                total = sums.setdefault(k, [0.0, np.zeros(2)])
                total[0] += w
                total[1] = total[1] + w * np.array(v)
    want = [(k, (sums[k][1] / sums[k][0] if k in sums else np.full(2, 0.5)).round(9).tolist()) for k, _ in ROWS]
    assert sorted(((r.doc_id, np.round(r.embedding, 9).tolist()) for r in out.collect()), key=str) == sorted(want, key=str)


def test_a_write_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage before."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for f in glob.glob(os.path.join(d, "**", "shuffle_*"), recursive=True)}
    before = files()
    out = materialize(spark.range(10_000).repartition(5).groupBy("id").count(), "counted")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 10_000


def test_ngram_counts_take_bounded_memory():
    """A task held some 300 MB of n-grams for a million tokens at once before."""
    rng = np.random.default_rng(1)
    lists = pa.array(list(rng.integers(0, 50_000, (2000, 500))), pa.list_(pa.int64()))
    tracemalloc.start()
    for out in Z._gram_counts(3)([pa.RecordBatch.from_arrays([lists], ["hashes"])]):
        assert len(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
