"""Every query against brute force on a small folder with edge cases, and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from newsloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(spark, name, folder):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_op1(spark, folder, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op1_mix_sources", folder)}
    size = {d: len(words(t)) for d, t, _ in docs}
    per, source = Counter(), {d: s for d, _, s in docs}
    for d, s in source.items():
        per[s] += size[d]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(per.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if rate * weight[s] > 2 * per[s]]
        for s in full or list(open_):
            target[s] = 2 * per[s] if full else rate * weight[s]
            open_.discard(s)
            left -= target[s]
    assert set(got) == set(size)
    taken = Counter()
    for d, r in got.items():
        assert (r["size"], r["source_size"]) == (size[d], per[source[d]])
        assert r["target"] == pytest.approx(target[source[d]])
        assert 0 <= r["taken"] <= 2 * size[d]
        taken[source[d]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 1


def test_op2(spark, folder):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = {r["page_id"]: r for r in rows(spark, "op2_url_filter", folder)}
    pages = duckdb.sql(f"select page_id, url from '{folder}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
            host, slash, tail = rest.partition("/")
            host, path = host.translate(LOWER), slash + tail
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")


def test_url_evidence_reaches_pages_without_rule(spark):
    """Unlabelled pages follow their host's labels, or the labelled branch beside them that they are like."""
    from newsloom.llm import url_filter
    rules = (("block", "pills.com", "/de/"), ("allow", "good.com", "/fr/"), ("block", "both.com", "/bad/"), ("allow", "both.com", "/fine/"))
    want = {}
    for k in range(40):
        want |= {f"http://pills.com/de/page/{k}": "block", f"http://pills.com/xx/long/way/to/{k}": "block", f"http://pills.com/u{k}": "block",
                 f"http://good.com/fr/page/{k}": "allow", f"http://good.com/xx/{k}": "allow", f"http://bare.com/de/{k}": "allow",
                 f"http://both.com/bad/a/b/{k}": "block", f"http://both.com/fine/{k}": "allow", f"http://both.com/more/a/b/{k}": "block",
                 f"http://both.com/else/{k}": "allow", f"http://both.com/odd/a/b/c/d/{k}": "allow"}
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(want)], "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert {u: rows[k].verdict for k, u in enumerate(want)} == want
    # a template without labels has its parent's purity
    bare = next(rows[k] for k, u in enumerate(want) if "odd" in u)
    host = (40 + 4 * 0.5) / (80 + 4)
    assert bare.purity == pytest.approx((0 + 4 * host) / (0 + 4))


def test_op3(spark, folder, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r["doc_id"]: r for r in rows(spark, "op3_bpe", folder)}
    for d, text, _ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[d]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_op4(spark, folder, docs):
    first, lists = {}, {d: words(t) for d, t, _ in docs}
    gone = defaultdict(set)
    for d, w in lists.items():
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i:i + 20]), (d, i)) != (d, i):
                gone[d].update(range(i, i + 20))
    got = {r["doc_id"]: r for r in rows(spark, "op4_substring_dedup", folder)}
    assert any(gone.values())
    for d, w in lists.items():
        r = got[d]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone[d]))
        assert r["kept_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone[d]))


def test_op6(spark, folder, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op6_quality_rules", folder)}
    for d, text, _ in docs:
        w = words(text)
        met = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        inside = {i + k for i in range(len(w) - 4) if met[tuple(w[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[d]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and r["kept"])


def test_op7(spark, folder, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in rows(spark, "op7_secret_scan", folder)}
    for d, text, _ in docs:
        text = text or ""
        found = [[(m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6],
                 [(m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
                 [(m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]]
        spans = sorted((a, k, z) for k, f in enumerate(found) for a, z in f)
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in spans)
        r = got[d]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(f) for f in found]
        assert r["base_sha256"] == sha(line)
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_random_strings_of_one_kind(spark, folder):
    """Random base32, lower-case, upper-case and [a-z0-9] strings are found; long words and rules of dashes are not."""
    import random
    import string

    from newsloom.llm import secrets
    rng = random.Random(3)
    kinds = [string.ascii_uppercase + "234567", string.ascii_lowercase, string.ascii_uppercase, string.ascii_lowercase + string.digits]
    secret = ["".join(rng.choices(k, k=n)) for k in kinds for n in (24, 32, 40) for _ in range(5)]
    prose = [w for t, in duckdb.sql(f"select text from '{folder}/documents.parquet' where text is not null").fetchall() for w in
             re.findall(r"\b[a-z]{5,12}\b", t)]
    words = ["".join(prose[7 * k:7 * k + 4]) for k in range(200)]
    plain = [w for w in words + [w.upper() for w in words] if len(w) >= 20] + ["-" * 40, "ab" * 20]
    lines = [(100_000 + k, f"here is {x} now") for k, x in enumerate(secret + plain)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(lines, "doc_id long, text string"))
    got = {r.doc_id: [s.text for s in r.random] for r in secrets.scan(docs).filter("doc_id >= 100000").collect()}
    missed = [x for k, x in enumerate(secret) if got[100_000 + k] != [x]]
    false = [x for k, x in enumerate(plain) if got[100_000 + len(secret) + k]]
    assert len(missed) <= 1, missed  # the filter for order may take one string in 10,000 for a pattern
    assert len(false) <= 0.02 * len(plain), false


def test_op8(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{folder}/documents.parquet'")
    twin = con.sql(queries.ORACLES["op8_exact_dedup"])
    want = sorted(map(str, (dict(zip(twin.columns, r)) for r in twin.fetchall())))
    got = rows(spark, "op8_exact_dedup", folder)
    assert sorted(str({c: r[c] for c in twin.columns}) for r in got) == want


def test_op9(spark, folder, docs):
    lists = {d: [*words((t or "").translate(LOWER)), None] for d, t, _ in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in lists}
    count = Counter(w for d, x in lists.items() if not held[d] for w in x)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in rows(spark, "op9_lattice_lm", folder)}
    for d, x in lists.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(x), sum(w in count for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), rel=1e-9)
        assert r["score"] <= 0 and math.isfinite(r["score"])


def test_op10(spark, folder, docs):
    prints = {}
    for d, text, _ in docs:
        w = words((text or "").translate(LOWER))
        grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op10_simhash", folder)}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in ids}


# ---- null ids, repeated rows, clashing names, very long texts

ODD = [(None, "aa one two"), (None, "aa one two"), (5, "bb"), (5, "bb"), (None, "cc " * 30), (7, "cc " * 30), (7, "cc " * 30), (8, None), (8, None),
       (9, "word" + " word" * 30 + " and an end a@b.example 10.0.0.1 password=hunter2hunter2"), (10, "")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with null ids, rows repeated whole, and ids that share texts."""
    out = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(d, t, "en", "s" if d != 9 else None, len(t or "")) for d, t in ODD],
                          "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_bpe", "op4_substring_dedup", "op6_quality_rules", "op7_secret_scan",
                                  "op9_lattice_lm", "op10_simhash", "op11_personal_data"])
def test_null_ids_and_repeated_rows(spark, odd, name):
    """Every row gets its row; rows repeated whole get equal ones, but for the mix, where copies differ by passes."""
    got = rows(spark, name, odd)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ODD)
    if name != "op1_mix_sources":
        for doc in (5, 7, 8):
            assert len({tuple(sorted(r.items(), key=str)) for r in got if r["doc_id"] == doc}) == 1


def test_op4_null_ids_and_repeated_rows(spark, odd):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in rows(spark, "op4_substring_dedup", odd))
    # within the first text every window but the first is a repeat; the null id comes first, and a repeated row is no copy of itself
    assert got == Counter([(None, 3, 0)] * 2 + [(5, 1, 0)] * 2 + [(None, 30, 29)] + [(7, 30, 30)] * 2 + [(8, 0, 0)] * 2 + [(9, 37, 30), (10, 0, 0)])


def test_op8_null_ids_and_repeated_rows(spark, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    want = Counter(con.execute(queries.ORACLES["op8_exact_dedup"]).fetchall())
    got = rows(spark, "op8_exact_dedup", odd)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len({t or "" for _, t in ODD})


def test_a_million_words(spark, tmp_path):
    """One text of a million words, whole: its own repeats are removed."""
    half = " ".join(f"w{k % 499_979}" for k in range(999_960)) + " a@b.example"
    docs = [(1, half), (2, "short text")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in rows(spark, "op4_substring_dedup", str(tmp_path))}
    assert (got[1]["n_words"], got[1]["n_removed"]) == (999_961, 999_960 - 499_979)


def test_clashing_names(spark):
    from newsloom.llm.line_dedup import drop_lines
    from newsloom.llm.mixing import mixed_documents
    from newsloom.llm.quality_rules import keep_good
    from newsloom.llm.simhash import one_of_each
    names = ["_size", "_rank", "_whole", "_words", "_spans", "_id", "_source", "_n", "_nth", "_passes", "gone", "_gone", "_known", "_doc", "_key",
             "_text", "doc", "key", "row", "n", "rule", "kept", "label"]
    texts = [f"this is document number {k} with some words of its own {k * 7} and an end here" for k in range(12)]
    data = [(k, t, "s", len(t), *[-7 - k] * len(names)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    for made in (mixed_documents(docs), drop_lines(docs), one_of_each(docs), keep_good(docs, labels)):
        assert made.columns == docs.columns
        for r in made.collect():
            assert {r[n] for n in names} == {-7 - r.doc_id}


def test_lattice_sums_all_segmentations():
    """The forward recursion against the sum over every way to cut a word into pieces, bytes for letters that are no piece."""
    import random
    from newsloom.llm import lattice_lm
    path = lattice_lm.vocabulary()
    model = lattice_lm.pieces_of(path)
    rng = random.Random(1)
    scores = [rng.uniform(-6, -1) for _ in range(model.get_piece_size())]
    plain, raw = {}, {}
    for i, s in enumerate(scores):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            raw[int(text[3:5], 16)] = s
        elif not model.is_control(i) and not model.is_unknown(i):
            plain[text] = s

    def cuts(text):
        if not text:
            return [0.0]
        found = [plain[text[:k]] + rest for k in range(1, len(text) + 1) if text[:k] in plain for rest in cuts(text[k:])]
        if text[0] not in plain:
            found += [sum(raw[b] for b in text[0].encode()) + rest for rest in cuts(text[1:])]
        return found
    held = lattice_lm.Lattice(path, scores)
    for word in ("a", "the", "tokens", "stream", "Übung", "x\U0001f600y", "antedate"):
        assert held.score(word) == pytest.approx(math.log10(sum(10 ** x for x in cuts("▁" + word))), abs=1e-9)


def test_sketch_blocks_follow_windows(spark):
    """A wider sketch makes no more blocks; the filter holds every repeated window, at any width of cells and filter, and few others."""
    from newsloom.llm import substring_dedup as sub
    from newsloom.llm.common import ship
    ship(spark)
    rng = np.random.default_rng(3)
    common = " ".join(f"c{k}" for k in range(200))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 1500)) + (f" {common}" if k % 3 == 0 else "") for k in range(60)]
    batch = pa.record_batch([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    counts = [sum(b.num_rows for b in sub.sketch_batches(20, fine, low)([batch])) for fine, low in ((24, 8), (34, 8), (40, 13), (42, 15))]
    assert max(counts) <= 1 << sub.PARTS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    one = np.concatenate([w[0] for w in sub.windows([batch], 20)])
    values, times = np.unique(one, return_counts=True)
    for fine, low, bits in ((24, 8, 16), (34, 8, 18), (40, 13, 20)):
        held = sub.repeated_cells(docs, 20, fine, low, bits)
        hit = np.ones(len(values), bool)
        for spot in sub._spots(values >> np.uint64(64 - fine), fine, bits):
            hit &= (held[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
        assert hit[times > 1].all() and (times > 1).sum() == 181
        assert hit[times == 1].mean() < (0.05 if fine == 24 else 0.01)
