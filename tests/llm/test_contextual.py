"""Personal data, the conversation trie and whitening against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import personal, prefix_trie, queries, whitening

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def counts(found):
    """A multiset: rows that repeat are told apart from single ones."""
    out = defaultdict(int)
    for row in found:
        out[row] += 1
    return dict(out)


# ---- personal data

def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in text.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if fits(kind, m[0]))


def listed(spans):
    return ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in spans)


def test_op11(spark, folder, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op11_personal_data"](spark, folder).collect()}
    assert len(got) == len(docs)
    for doc, text, _ in docs:
        want, r = base_spans(text), got[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(listed(want).split(",")) <= set(r.spans.split(",")) or not want


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 2.@+-()%_3é\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(40)) for _ in range(100)]
    texts += ["a@b.c_d@e.f", "x" * 50_000, "1" * 50_000, "+1" + " " * 50_000 + "5", "a@" * 500 + "b.c", "0" * 3000 + ".1.1.1", None, "",
              "😀 4111 1111 1111 1111 😀 +49 (030) 123-4567", "word " * 1_000_000 + "a@b.example 10.0.0.1"]
    texts += ["mail me a@b.example"] * 2
    found = personal.scan(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "at c@d.example")] * 2, "doc_id long, text string"))
    got = found.select("doc_id", personal._listed(personal.KINDS).alias("spans")).collect()
    assert [r.spans for r in got if r.doc_id is None] == ["email:3:14"] * 2
    assert {r.doc_id: r.spans for r in got if r.doc_id is not None} == {k: listed(base_spans(t)) for k, t in enumerate(texts)}


def test_many_matches_in_one_text(spark):
    """Places of tens of thousands of candidates and addresses in one text."""
    text = " ".join(f"w{k:06d}" for k in range(30_000)) + " " + " ".join(f"n{k}@b.example" for k in range(2_500))
    row = personal.base_mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(m.start, m.end) for m in row.email] == [m.span() for m in re.finditer(KINDS["email"], text)]
    assert [(m.start, m.end) for m in row.candidate] == [(8 * k, 8 * k + 7) for k in range(30_000)]


def test_patterns_find_unseen_identifiers(spark):
    texts = [f"Hello all. You can reach my phone at +1 (555) {200 + k}-{1000 + k * 7} any time. Item {k} has the order 20{k:02d}{k * 37:04d} in stock."
             for k in range(40)]
    texts += [f"user-id: bob{k}@mail{k}.example and more" for k in range(8)]
    new = ["You can reach my phone at 555 0199 4321 when you like. The build number is 20240101 today.", "Their user-id: kim4711 and no more."]
    plain = ["You can reach my phone at noon. The year 123456 was fine.", "The order 20240101 in stock."]
    found = personal.scan(spark.createDataFrame([(k, t) for k, t in enumerate(texts + new + plain)], "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in found.select("doc_id", personal._listed(personal.KINDS, "found").alias("spans")).collect()}
    assert spans[48] == f"found_phone:26:{26 + len('555 0199 4321')}"
    assert spans[49] == "found_email:15:22"
    assert not spans[50] and not spans[51]
    assert all(spans[k] == listed(base_spans(t)) for k, t in enumerate(texts))


def test_bootstrapping_reaches_second_patterns(spark):
    """Instances found by one pattern make another one confident, whose seeds alone are too few a share."""
    rows = [(k, 0, 1, "phone", f"p{k}", ["call _"]) for k in range(30)]
    rows += [(100 + k, 0, 1, None, f"q{k}", ["call _"]) for k in range(6)]
    rows += [(200 + k, 0, 1, "phone", f"p{k}", ["dial _"]) for k in range(6)] + [(300 + k, 0, 1, None, f"q{k}", ["dial _"]) for k in range(6)]
    rows += [(400, 0, 1, None, "new", ["dial _"])]
    rows += [(500 + k, 0, 1, "phone", f"p{k}", ["the _"]) for k in range(9)] + [(600 + k, 0, 1, None, f"n{k}", ["the _"]) for k in range(9)]
    table = spark.createDataFrame(rows, "key long, start int, end int, kind string, value string, patterns array<string>")
    first = {r.pattern for r in personal.bootstrapped(table, rounds=1, confident=0.75).collect()}
    last = {r.pattern for r in personal.bootstrapped(table, rounds=3, confident=0.75).collect()}
    assert first == {"call _"} and last == {"call _", "dial _"}


# ---- the trie

def brute_trie(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}
    full = {}
    for c in own:
        cut = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:cut] + own[c][cut:]
    tops, kids = {}, defaultdict(set)

    def of(node):
        return tops.setdefault(node, {"members": [], "ends": []})

    ids = {(): 0}  # prefixes by number: long ones are not copied
    last = {}
    for c in sorted(full):
        at = 0
        of(0)["members"].append(c)
        for turn in full[c]:
            key = (at, turn)
            nxt = ids.setdefault(key, len(ids))
            kids[at].add(nxt)
            last[nxt] = (at, turn)
            at = nxt
            of(at)["members"].append(c)
        of(at)["ends"].append(c)
    depth, out = {0: 0}, {}
    for node in sorted(tops):
        if node:
            depth[node] = depth[last[node][0]] + 1
    for node in sorted(tops, reverse=True):
        m = tops[node]["members"]
        own_saved = (len(m) - 1) * len(last[node][1][1].encode()) if node else 0
        out[node] = (m[0], depth[node], tops[last[node][0]]["members"][0] if node else None, len(m), len(kids[node]),
                     sum(out[k][5] for k in kids[node]) or 1, own_saved + sum(out[k][6] for k in kids[node]),
                     hashlib.sha256(",".join(map(str, tops[node]["ends"])).encode()).hexdigest())
    return counts(out.values())


def test_op12(spark, folder):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{folder}/conversations.parquet'").fetchall()
    got = queries.QUERIES["op12_prefix_trie"](spark, folder)
    assert dict(got.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in got.columns}
    assert counts(map(tuple, got.collect())) == brute_trie(rows)


@pytest.mark.parametrize("shard, block", [(1, 1), (3, 2), (2048, 256)])
def test_trie_of_any_cut(spark, shard, block):
    rng = random.Random(shard)
    rows = [(c, t, rng.choice(["u", None]), rng.choice(["a", None, "bé", ""])) for c in rng.sample(range(90), 60) for t in range(rng.choice([1, 2, 5, 30]))]
    rows += [(7, 1000, "u", "same")] * 40 + [(None, 1, "u", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(table, shard=shard, block=block).collect()
    assert counts(map(tuple, got)) == brute_trie(rows)


# ---- whitening

def test_op13(spark, folder):
    rows = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall()
    rows = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 64 and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.array([np.floor(64 * v) + 1_000_000 for _, v in rows]).astype(np.int64)
    n, total = len(x), x.sum(axis=0)
    away = x - total / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = queries.QUERIES["op13_whitening"](spark, folder).collect()
    assert len(got) == n * 32 and {r.component for r in got} == set(range(1, 33)) and {r.n for r in got} == {n}
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, total)) for row in x]
    assert counts((r.vec_id, r.deviation) for r in got if r.component == 1) == counts((i, d if d < 2 ** 63 else None) for (i, _), d in zip(rows, deviation))
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 for r in got)
    assert {r.identity_error for r in got}.pop() < 1e-8
    want = away @ vectors[:, :32] / np.sqrt(values[:32])
    by_id = {}
    for r in got:
        if r.vec_id is not None and r.vec_id not in (9003, 9004):
            by_id.setdefault(r.vec_id, np.zeros(32))[r.component - 1] = r.whitened
    mine = np.array([by_id[i] for i, _ in rows if i in by_id])
    want = want[[i in by_id for i, _ in rows]]
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-8


@pytest.mark.parametrize("name, a", [
    ("tall", np.random.default_rng(1).standard_normal((200, 64))), ("wide", np.random.default_rng(2).standard_normal((30, 64))),
    ("dependent", np.hstack([np.random.default_rng(3).standard_normal((100, 5))] * 3)), ("equal", np.eye(20)),
    ("pairs", np.diag([1.0, 1, 1, 2, 2, 3])), ("constant", np.ones((10, 4))), ("graded", np.diag(10.0 ** -np.arange(12))),
    ("repeated", np.kron(np.eye(8), np.random.default_rng(4).standard_normal((8, 8)))), ("one", np.random.default_rng(5).standard_normal((50, 1))),
    ("rotated", np.linalg.qr(np.random.default_rng(6).standard_normal((30, 30)))[0] @ np.diag([1.0] * 10 + [1 + 1e-10] * 10 + [2.0] * 10))])
def test_spectrum(name, a):
    values, vectors = whitening.spectrum(np.linalg.qr(a, mode="r"), 10 ** 9)
    s = np.linalg.svd(a, compute_uv=False)
    s = np.concatenate([s, np.zeros(max(0, a.shape[1] - len(s)))])
    assert np.abs(np.sqrt(values) - s).max() < 1e-14 * s[0] * len(s)
    k = vectors.shape[1]
    assert k == np.linalg.matrix_rank(a)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
    assert np.abs(a.T @ a @ vectors - vectors * values[:k]).max() < 1e-13 * s[0] ** 2 * len(s)


def test_dqds_keeps_small_values_exact():
    """Relative accuracy of a graded bidiagonal matrix, against 60-digit arithmetic in closed form for 2 x 2."""
    got = whitening.dqds([1.0, 1e-30], [1e-8])
    assert got[1] == pytest.approx(1e-30 / (1 + 1e-8), rel=1e-14)


def test_whitening_cases(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
    assert make([("a", [1.0, 2.0])]).collect() == []
    assert make([("a", [1.0, 2.0])] * 4).collect() == []
    got = make([("a", [0.0, 5.0]), ("b", [2.0, 5.0]), (None, [1.0, 5.0]), ("c", None), ("d", [1.0])]).collect()
    assert sorted((r.vec_id or "", round(abs(r.whitened), 9), r.component) for r in got) == [("", 0.0, 1), ("a", 1.224744871, 1), ("b", 1.224744871, 1)]
    huge = make([("a", [1e300, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 3.0])]).collect()
    assert {r.deviation for r in huge} == {None} and np.isfinite([r.whitened for r in huge]).all()
    wide = spark.range(300).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.hash(F.col("id"), k) / 1e9).alias("embedding"))
    out = whitening.whiten(wide.repartition(40), components=None)
    assert out.count() == 1800 and out.first().identity_error < 1e-9
