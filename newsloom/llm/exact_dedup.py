"""Exact dedup (8): binary-fuse filters per snapshot screen a batch, positives are compared byte by byte.

A snapshot is immutable, so its filter is built once: three cells per digest, 8-bit fingerprints, no
deletions. The filter is sharded by digest, each shard is built and probed in one task and none is sent
to the driver. A digest that the filter rejects is surely new; a positive is joined to the exact bucket
of its SHA-256 and its text is compared with the bucket's. Copies inside the snapshot and inside the
batch are grouped on their own side first.

Null text counts as empty, and empty texts equal each other. A null doc_id is never the largest while
another id is there. Rows repeated with the same id and text count one by one in group_size, and one of
them is kept. An empty table gives no row. Other columns of the input are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.common import bounded, ship, staged, table, text_of

#: Digests of one filter shard, about.
SHARD_KEYS = 50_000
U64 = np.uint64


def _mix(keys, seed):
    x = keys + U64((0x9E3779B97F4A7C15 * (seed + 1)) % 2 ** 64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _cells(keys, seed, segment, count):
    """Three cells per key, in three neighbouring segments, and the 8-bit fingerprint."""
    h = _mix(keys, seed)
    first = (h >> U64(32)) * U64(count) >> U64(32)
    cells = [((first + U64(i)) * U64(segment) + (_mix(h, i) & U64(segment - 1))).astype(np.int64) for i in range(3)]
    return cells, (h & U64(255)).astype(np.uint8)


def fuse_build(keys):
    """Bytes of a binary-fuse filter over distinct uint64 ``keys``: seed, segment length, segments, cells."""
    keys = np.unique(np.asarray(keys, dtype=U64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for seed in range(1000):
        count = max(1, -(-int(n * factor * (1 + seed / 50)) // segment))
        cells, marks = _cells(keys, seed, segment, count)
        size = (count + 2) * segment
        left, degree, mixed = np.ones(n, bool), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for c in cells:
            np.add.at(degree, c, 1)
            np.bitwise_xor.at(mixed, c, np.arange(n))
        rounds = []
        while True:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            owner, at = np.unique(mixed[alone], return_index=True)
            rounds.append((owner, alone[at]))
            left[owner] = False
            for c in cells:
                np.add.at(degree, c[owner], -1)
                np.bitwise_xor.at(mixed, c[owner], owner)
        if not left.any():
            out = np.zeros(size, np.uint8)
            for owner, cell in reversed(rounds):  # no two keys of a round share the cell that either owns
                value = marks[owner]
                for c in cells:
                    value = value ^ out[c[owner]]
                out[cell] ^= value
            return np.array([seed, segment, count], np.int64).tobytes() + out.tobytes()
    raise ValueError("no seed lets the filter be built")


def fuse_probe(blob, keys):
    """Which of ``keys`` the filter may hold; never False for a key it was built from."""
    seed, segment, count = (int(x) for x in np.frombuffer(blob[:24], np.int64))
    held = np.frombuffer(blob[24:], np.uint8)
    cells, marks = _cells(np.asarray(keys, dtype=U64), seed, segment, count)
    return held[cells[0]] ^ held[cells[1]] ^ held[cells[2]] == marks


def _keys(t):
    return t.column("probe").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


def _build(t: pa.Table) -> pa.Table:
    return pa.table({"shard": t.column("shard")[:1], "filter": pa.array([fuse_build(_keys(t))], pa.binary())})


def _screen(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        hit = np.zeros(0, bool)
    elif not right.num_rows:
        hit = np.zeros(left.num_rows, bool)
    else:
        hit = fuse_probe(right.column("filter")[0].as_py(), _keys(left))
    return pa.table({"sha": left.column("sha"), "hit": pa.array(hit, pa.bool_())})


def digests(docs):
    """One row per (doc_id, text): SHA-256, and how often the row occurs."""
    return docs.select("doc_id", F.sha2(text_of(docs), 256).alias("sha"))


def snapshot_filters(groups, shards):
    """The filter shards of a snapshot's digest groups."""
    return _sharded(groups, shards).groupBy("shard").applyInArrow(_build, "shard long, filter binary")


def _sharded(groups, shards):
    key = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    probe = F.conv(F.substring("sha", 17, 15), 16, 10).cast("long")
    return groups.select(F.pmod(key, F.lit(shards)).alias("shard"), "sha", probe.alias("probe"))


def screen(groups, filters, shards):
    """Digests of a batch with ``hit``: False is surely not in the snapshot."""
    return _sharded(groups, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(
        _screen, "sha string, hit boolean")


def dedup(snapshot, batch):
    """Class of every row of a snapshot and a batch (doc_id, text).

    Returns doc_id, keep_id, group_size, kept, text_sha256; the row with the largest id of equal texts stays.
    """
    sides = digests(snapshot).withColumn("side", F.lit(0)).union(digests(batch).withColumn("side", F.lit(1)))
    rows = staged(sides.groupBy("side", "sha", "doc_id").agg(F.count(F.lit(1)).alias("n")), "dedup-rows")
    groups = staged(rows.groupBy("side", "sha").agg(F.max("doc_id").alias("top"), F.sum("n").alias("size")), "dedup-groups")
    old, new = groups.filter("side = 0"), groups.filter("side = 1")
    shards = max(1, -(-old.count() // SHARD_KEYS))
    positives = screen(new, snapshot_filters(old, shards), shards).filter("hit").select("sha")
    buckets = old.select("sha", F.col("top").alias("old_top"), F.col("size").alias("old_size"))
    pairs = staged(positives.join(buckets, "sha").join(
        new.select("sha", F.col("top").alias("new_top"), F.col("size").alias("new_size")), "sha"), "dedup-pairs")
    same = _same_bytes(pairs, snapshot, batch)
    classes = _classes(groups, same)
    out = rows.join(classes, ["side", "sha"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    # one id may be the largest on both sides: its row in the snapshot stays
    kept = kept & ((F.col("side") == 0) | ~F.col("tied"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def _same_bytes(pairs, snapshot, batch):
    """The positives whose text equals the text of their bucket."""
    wanted = bounded(pairs)

    def texts(docs, top, name):
        found = docs.select(F.col("doc_id").alias("_id"), text_of(docs).alias(name))
        found = found.withColumn("_sha", F.sha2(name, 256))
        on = found["_id"].eqNullSafe(wanted[top]) & (found["_sha"] == wanted["sha"])
        return found.join(wanted, on).groupBy("sha").agg(F.first(name).alias(name))
    met = texts(snapshot, "old_top", "old_text").join(texts(batch, "new_top", "new_text"), "sha")
    return pairs.join(met.filter("old_text = new_text").select("sha"), "sha")


def _classes(groups, same):
    met = same.select("sha", F.greatest("old_top", "new_top").alias("m_top"), (F.col("old_size") + F.col("new_size")).alias("m_size"),
                      F.coalesce(F.col("old_top").eqNullSafe(F.col("new_top")), F.lit(False)).alias("m_tied"))
    return groups.join(met, "sha", "left").select(
        "side", "sha", F.when(F.col("m_size").isNull(), F.col("top")).otherwise(F.col("m_top")).alias("keep_id"),
        F.coalesce("m_size", "size").alias("group_size"), F.coalesce("m_tied", F.lit(False)).alias("tied"))


def op8_exact_dedup(spark, folder):
    """All documents: half of the ids, by checksum, are the snapshot, the others the incoming batch."""
    ship(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(True))
    return dedup(docs.filter(held), docs.filter(~held))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
