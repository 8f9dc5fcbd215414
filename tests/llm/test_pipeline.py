"""The pipeline's stages one after another, each held against its own input."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipeline
from newsloom.llm import line_dedup, simhash
from newsloom.llm.bpe import vocabulary
from newsloom.llm.common import staged


@pytest.fixture(scope="module")
def tables(spark, folder):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, columns = {"documents": docs.collect()}, docs.columns
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), f"test-{name}")
        out[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    return out


def test_quality_keeps_rows_whole(tables):
    before = Counter(tables["documents"])
    after = Counter(tables["quality_rules"])
    assert after and not after - before
    for row in (before - after):
        assert row not in after
    assert all(len((r["text"] or "").split()) >= 10 for r in after)


def test_line_dedup_drops_only_lines(tables):
    before = {r["doc_id"]: r for r in tables["quality_rules"]}
    assert {r["doc_id"] for r in tables["line_dedup"]} == set(before)
    met = defaultdict(set)
    for d, r in before.items():
        for line in r["text"].split("\n"):
            met[line].add(d)
    for r in tables["line_dedup"]:
        old, new = before[r["doc_id"]]["text"].split("\n"), r["text"].split("\n")
        left = iter(old)
        assert all(x in left for x in new) or r["text"] == ""
        gone = Counter(old) - Counter(new)
        assert all(len(x.split()) >= line_dedup.LEAST for x in gone)
        if r["text"] == before[r["doc_id"]]["text"]:
            assert r == before[r["doc_id"]]


def test_recurring_templates(spark):
    docs = spark.createDataFrame(
        [(k, f"text number {k} here it goes\nPosted by user{k} on 2024-01-0{k % 9} at noon\nown line of document {chr(97 + k)} only") for k in range(8)]
        + [(20, None), (21, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert got[20] is None and got[21] == ""
    assert sum("Posted by" in (t or "") for t in got.values()) == 1 and "Posted by" in got[0]


def test_exact_repeats_and_hidden_templates(spark):
    """A line repeated in two documents goes from the second; two templates of one leaf with a field of names do not hide each other."""
    names = [f"{a}{b}" for a in ("al", "be", "co", "du", "el") for b in ("na", "ro", "mi")]
    rows = [(k, f"we thank our guest {name} for the visit\nwe thank our member {name} for all help\nown words of {name * 3} here") for k, name in enumerate(names)]
    rows += [(50, "this very line stands twice\nshort a b"), (51, "x\nthis  very line stands twice \nshort a b")]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == rows[15][1] and got[51] == "x\nshort a b"
    for part in ("our guest", "our member"):
        assert [d for d in sorted(got) if part in got[d]] == [0]


def test_short_and_numeric_lines_stay(spark):
    """Four-word lines that differ in the last word, and rows of numbers, are no template; equal ones go."""
    ends = ["here", "there", "early", "late", "twice", "once", "poor", "rich"]
    rows = [(k, f"he was born {end}\n{k} {k + 7} 3{k} 4\n1 2 3 4") for k, end in enumerate(ends)]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: t if k == 0 else t.rsplit("\n", 1)[0] for k, t in rows}


def test_one_of_each_group(tables):
    """A document goes only for one kept of the same group; close fingerprints never stay together."""
    rows = tables["line_dedup"]
    kept = {r["doc_id"] for r in tables["near_dedup"]}
    assert kept <= {r["doc_id"] for r in rows}
    prints = {r["doc_id"]: np.array(simhash.fingerprint((r["text"] or "").encode().lower().split(), 5, 64, 4), np.uint64) for r in rows}
    differ = lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum())
    for d in prints:
        if d not in kept:
            assert any(differ(d, o) <= 40 for o in prints if o != d)
    # within the guarantee of the structured masks no two kept documents are left
    ids = sorted(kept)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if differ(a, b) <= 19]


def test_mix_and_codes(tables):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    source = {r["doc_id"]: r["source"] for r in tables["near_dedup"]}
    words = {r["doc_id"]: (r["text"] or "").split() for r in tables["near_dedup"]}
    taken = Counter()
    for r in tables["mix_sources"]:
        assert r["source"] == source[r["doc_id"]]
        new = r["text"].split()
        taken[r["doc_id"]] += len(new)
        left = iter(words[r["doc_id"]])
        assert all(x in left for x in new)
    assert all(n <= 2 * len(words[d]) for d, n in taken.items())
    whole = 1.5 * sum(map(len, words.values()))
    # every source's target is cut to whole words: less than one word a source is lost, none is gained
    assert 0 <= whole - sum(taken.values()) < len({source[d] for d in words if words[d]})
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in tables["mix_sources"])
    assert want == Counter((r["doc_id"], tuple(r["ids"])) for r in tables["bpe"])


def test_one_of_each_brute_force(spark):
    """Groups are those of exact five-word Jaccard >= 0.8, near and far from it, with short texts, chains and blank texts."""
    rng = np.random.default_rng(5)
    texts = []
    for base in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.choice([4, 12, 60, 300, 300, 600]))]
        texts.append(" ".join(words))
        for changes in rng.integers(1, 20, 4):
            other = list(words)
            for k in rng.integers(0, len(words), min(changes, 1 + len(words) // 36)):
                other[k] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(other))
            if changes % 3 == 0:
                words = other
    texts += ["", " \n", None, texts[0], texts[7].upper()]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string")
    got = Counter(r.doc_id for r in simhash.one_of_each(docs).collect())
    want = Counter({find(k) for k in range(len(texts))})
    assert got == want + Counter([None])
    assert 40 < len(want) < len(texts) - 20


def test_near_dedup_links_fingerprints(spark):
    """Texts of one fingerprint but unlike shingle sets are one group, also through a third text; null and repeated ids as before."""
    loop = "one two three four five " * 400
    words = [f"w{k}" for k in range(60)]
    texts = [(1, loop + " ".join(words[:12])), (2, loop + " ".join(words[20:32])), (3, " ".join(words)), (3, " ".join(words)),
             (4, " ".join(words[:59])), (None, loop), (5, loop + " ".join(words[40:52])), (6, "unlike the others in every way and short")]
    rows = [r for r in texts if r[0] in (1, 2, 5)]
    prints = np.array([simhash.fingerprint(t.encode().split(), 4, 64, 1) for _, t in rows], np.uint64)
    assert all(np.bitwise_count(prints[:1] ^ prints) <= 4)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(r.doc_id for r in simhash.one_of_each(docs).collect()) == Counter([1, 2, 3, 5, 6, None])
    assert Counter(r.doc_id for r in pipeline.near_dedup(spark, docs, None).collect()) == Counter([1, 3, 6, None])
