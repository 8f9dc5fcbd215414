"""Substring dedup (4): a sketch screens the windows, those estimated repeated are grouped exactly.

A window is ``size`` consecutive words of one document. Every task hashes its windows to some 128 cells a word of the input and
notes the cells it hit once and more often. It hands them on in ``PARTS`` blocks, however many cells there are, and each block is merged
by itself. A merged block is a Bloom filter of the cells hit twice or more, two bits a cell inside the block. A repeated window has
both bits, so none is lost; few others have them. The filters are the only table that all tasks read. Their size follows the input up
to a bound (``max_cells``); beyond it they fill up, more windows pass, and the exact step does more work.

The second pass hands on the windows with both bits, one per task and window, in bundles by hash range. Each range is sorted
by (window, doc_id, start); all but the earliest are repeats. A window's identity is a 96-bit hash of its word sequence.
Repeats return in bundles by document and the words they cover are dropped; windows are judged on the input.

Null and empty texts have no words. Fewer words than a window are all kept. Rows with a null doc_id come before all others. Rows
repeated with id and text are the same document and get the same result; rows that share only the id come in the order of
their texts' checksums. An empty table gives no row.
"""

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from newsloom.llm.common import ship, table

SIZE = 20
#: Bits of all filters, at most: 64 MB.
MAX_CELLS = 1 << 29
#: Blocks of the sketch, as a power of two: what a task hands on grows with its windows only.
PARTS = 10
#: Windows a task holds before it hands them on.
FLUSH = 2_000_000
#: Bytes of text that one group of documents holds, about.
GROUP_BYTES = 8 << 20
U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NULL_ID = -2 ** 63


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@functools.lru_cache(maxsize=8)
def _powers(base, n):
    up = np.full(n + 1, base, U64)
    up[0] = 1
    down = np.full(n, pow(base, -1, 2 ** 64), U64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x):
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(words, starts, size):
    """Two 64-bit hashes of the windows at ``starts``; ``words`` are word hashes."""
    out = []
    for base in BASES:
        up, down = _powers(base, 1 << max(10, len(words).bit_length()))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(words * up[:len(words)])])
        out.append(_mixed((total[starts + size] - total[starts]) * down[starts]))
    return out


def windows(batches, size, flush=FLUSH):
    """Bundles of windows of a task: two hashes, doc_id, checksum of the text, start."""
    known, held, count = WordHashes(), [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            ids = part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            flat, lengths, tags = [], [], []
            for text in part.column("text").to_pylist():
                raw = (text or "").encode()
                words = raw.split()
                flat.append(np.fromiter(map(known.__getitem__, words), U64, len(words)))
                lengths.append(len(words))
                tags.append(zlib.crc32(raw))
            lengths = np.array(lengths)
            fits = np.maximum(lengths - size + 1, 0)
            if not fits.sum():
                continue
            begins = np.cumsum(lengths) - lengths
            at = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
            one, two = window_hashes(np.concatenate(flat), np.repeat(begins, fits) + at, size)
            held.append((one, two, np.repeat(ids, fits), np.repeat(np.array(tags, np.uint32), fits), at.astype(np.uint32)))
            count += len(at)
            if count >= flush:
                yield [np.concatenate(x) for x in zip(*held)]
                held, count = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _spots(cells, fine, bits):
    """The two filter bits of each cell, both in the block of its highest bits."""
    block, mixed, inside = cells >> U64(fine - PARTS), _mixed(cells), bits - PARTS
    return [((block << U64(inside)) + (x & U64((1 << inside) - 1))).astype(np.int64) for x in (mixed, mixed >> U64(32))]


def gaps_of(places):
    """Rising places of a block as bytes: each gap in 255s and a rest below 255."""
    gaps = np.diff(places, prepend=0)
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    return out.tobytes()


def places_of(blob):
    """The places of ``gaps_of``: up to each rest, the bytes add up to one."""
    raw = np.frombuffer(blob, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def sketch_batches(size, fine, low):
    """mapInArrow function: a task's sketch in blocks, the cells hit once and those hit more often.

    The highest bits of a block's cells are handed on as gaps, their ``low`` last bits as they are.
    """
    kind = np.uint8 if low <= 8 else np.uint16

    def run(batches):
        for one, *_ in windows(batches, size):
            cells, times = np.unique(one >> U64(64 - fine), return_counts=True)
            inside = (cells & U64((1 << (fine - PARTS)) - 1)).astype(np.int64)
            blocks = (cells >> U64(fine - PARTS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            names, parts = [], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                again, own = times[a:b] > 1, inside[a:b]
                names.append(int(blocks[a]))
                parts.append([x for c in (own[~again], own[again]) for x in (gaps_of(c >> low), (c & ((1 << low) - 1)).astype(kind).tobytes())])
            for k in range(0, len(names), 256):
                yield pa.record_batch([pa.array(names[k:k + 256], pa.int64()),
                                       *[pa.array(list(x), pa.binary()) for x in zip(*parts[k:k + 256])]],
                                      names=["block", "hit", "hit_low", "more", "more_low"])
    return run


def _merge(fine, low, bits):
    kind = np.uint8 if low <= 8 else np.uint16

    def cells_of(t, name):
        return [(places_of(a) << low) + np.frombuffer(b, kind) for a, b in zip(t.column(name).to_pylist(), t.column(f"{name}_low").to_pylist())]

    def run(t: pa.Table) -> pa.Table:
        block, width = t.column("block")[0].as_py(), 1 << (bits - PARTS)
        once = cells_of(t, "hit")
        more = np.unique(np.concatenate(cells_of(t, "more")))
        cells = np.sort(np.concatenate([*once, more]))  # a task names each cell once
        again = np.concatenate([cells[1:][cells[1:] == cells[:-1]], more]) + (block << (fine - PARTS))
        held = np.zeros(width, np.uint8)
        for spot in _spots(again.astype(U64), fine, bits):
            held[spot - block * width] = 1
        packed = zstandard.compress(np.packbits(held, bitorder="little").tobytes(), 1)
        return pa.table({"block": t.column("block")[:1], "bits": pa.array([packed], pa.binary())})
    return run


def repeated_cells(docs, size, fine, low, bits):
    """The filters of all blocks as one array of bits: cells hit at least twice. Its size is bounded by ``bits``."""
    found = docs.mapInArrow(sketch_batches(size, fine, low), "block long, hit binary, hit_low binary, more binary, more_low binary")
    found = found.groupBy("block").applyInArrow(_merge(fine, low, bits), "block long, bits binary")
    out, width = np.zeros((1 << bits) // 8, np.uint8), (1 << (bits - PARTS)) // 8
    for row in found.toLocalIterator(prefetchPartitions=True):
        out[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(zstandard.decompress(bytes(row["bits"])), np.uint8)
    return out


def _bundles(keys, columns):
    """Rows of the same key as bytes, one bundle a key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])) if len(keys) else []
    columns = [c[order] for c in columns]
    return [int(keys[a]) for a, _ in spans], [[zstandard.compress(c[a:b].tobytes(), 1) for a, b in spans] for c in columns]


def _group_of(ids, groups):
    return (_mixed(ids.astype(np.int64).view(U64)) % U64(groups)).astype(np.int64)


def _earliest(one, two, ids, tags, at):
    """Order by window and place, and which rows in that order are not the earliest of their window."""
    order = np.lexsort((at, tags, ids, two, one))
    a, b = one[order], two[order]
    again = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])]) if len(a) else np.zeros(0, bool)
    # the same row may be there twice, when the table repeats a row: equal places are no earlier start
    i, g, p = ids[order], tags[order], at[order]
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(a)))) if len(a) else np.zeros(0, np.int64)
    same = (i == i[first]) & (g == g[first]) & (p == p[first])
    return order, again, again & ~same


def candidate_batches(size, fine, bits, sketch, ranges, groups):
    """mapInArrow function: windows estimated repeated, by hash range; and repeats found inside the task, by document group."""
    def run(batches):
        held = sketch.value
        for bundle in windows(batches, size):
            keep = np.ones(len(bundle[0]), bool)
            for spot in _spots(bundle[0] >> U64(64 - fine), fine, bits):
                keep &= (held[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
            one, two, ids, tags, at = (x[keep] for x in bundle)
            two = (two >> U64(32)).astype(np.uint32)
            order, again, repeat = _earliest(one, two, ids, tags, at)
            for kind, chosen in ((0, order[~again]), (1, order[repeat])):
                key = (one[chosen] >> U64(40)).astype(np.int64) * ranges >> 24 if kind == 0 else _group_of(ids[chosen], groups)
                cols = [one[chosen], two[chosen]] if kind == 0 else []
                names, blobs = _bundles(key, [*cols, ids[chosen], tags[chosen], at[chosen]])
                blobs = blobs if kind == 0 else [[None] * len(names)] * 2 + blobs
                if names:
                    yield pa.record_batch([pa.array([kind] * len(names), pa.int32()), pa.array(names, pa.int64()),
                                           *[pa.array(b, pa.binary()) for b in blobs]],
                                          names=["kind", "key", "one", "two", "ids", "tags", "at"])
    return run


def _unpack(t, name, kind):
    return np.concatenate([np.frombuffer(zstandard.decompress(x), kind) for x in t.column(name).to_pylist()] or [np.zeros(0, kind)])


def exact_group(groups):
    """applyInArrow function over a hash range: the repeats, by document group. Repeats found inside a task pass through."""
    def run(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return t.select(["key", "ids", "tags", "at"]).rename_columns(["group", "ids", "tags", "at"])
        one, two = _unpack(t, "one", U64), _unpack(t, "two", np.uint32)
        ids, tags, at = _unpack(t, "ids", np.int64), _unpack(t, "tags", np.uint32), _unpack(t, "at", np.uint32)
        order, _, repeat = _earliest(one, two, ids, tags, at)
        chosen = order[repeat]
        chosen = chosen[np.lexsort((at[chosen], tags[chosen], ids[chosen]))]
        names, blobs = _bundles(_group_of(ids[chosen], groups), [ids[chosen], tags[chosen], at[chosen]])
        return pa.table([pa.array(names, pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]],
                        names=["group", "ids", "tags", "at"])
    return run


def clean_group(size):
    """Cogroup function over documents and repeats of a group: the words that stay."""
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        ids, tags, at = _unpack(repeats, "ids", np.int64), _unpack(repeats, "tags", np.uint32), _unpack(repeats, "at", np.uint32)
        order = np.lexsort((tags, ids))
        ids, tags, at = ids[order], tags[order], at[order]
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(tags.astype(np.int64)) != 0)) + 1
        spans = {(int(ids[a]), int(tags[a])): at[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)])} if len(ids) else {}
        total, removed, kept = [], [], []
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            raw = (text or "").encode()
            words = raw.split()
            starts = spans.get((NULL_ID if doc is None else doc, zlib.crc32(raw)))
            total.append(len(words))
            gone = 0
            if starts is not None:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts.astype(np.int64) + size, -1)
                stays = np.cumsum(edges[:-1]) == 0
                gone = int(len(words) - stays.sum())
                words = [words[k] for k in np.flatnonzero(stays).tolist()]
            removed.append(gone)
            kept.append(b" ".join(words).decode())
        return pa.table([docs.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def digest_group(size):
    clean = clean_group(size)

    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        out = clean(docs, repeats)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in out.column("kept").to_pylist()]
        return out.drop_columns("kept").append_column("kept_sha256", pa.array(digests, pa.string()))
    return run


def dedup(docs, size=SIZE, max_cells=MAX_CELLS, digest=False):
    """doc_id, n_words, n_removed and the kept words (or their SHA-256) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    expected = volume // 6 + 1  # words, about: sets the sketch's width only
    bits = min(max(16, (2 * expected - 1).bit_length()), max_cells.bit_length() - 1)
    fine = min(max(24, (128 * expected - 1).bit_length()), 42)
    low = 8 if fine <= 35 else min(fine - 27, 16)
    groups = max(256, volume // GROUP_BYTES)
    ranges = max(256, expected >> 20)
    sketch = spark.sparkContext.broadcast(repeated_cells(docs, size, fine, low, bits))
    found = docs.mapInArrow(candidate_batches(size, fine, bits, sketch, ranges, groups),
                            "kind int, key long, one binary, two binary, ids binary, tags binary, at binary")
    # both kinds in one shuffle: nothing is written beside it
    repeats = found.groupBy("kind", "key").applyInArrow(exact_group(groups), "group long, ids binary, tags binary, at binary")
    texts = docs.mapInArrow(grouped_batches(groups), "group long, doc_id long, text string")
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string")
    clean = digest_group(size) if digest else clean_group(size)
    return texts.groupBy("group").cogroup(repeats.groupBy("group")).applyInArrow(clean, schema)


def grouped_batches(groups):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(_group_of(ids, groups)), batch.column("doc_id"), batch.column("text")],
                                  names=["group", "doc_id", "text"])
    return run


def op4_substring_dedup(spark, folder):
    ship(spark)
    return dedup(table(spark, folder, "documents"), digest=True)
