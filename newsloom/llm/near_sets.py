"""Exact Jaccard near-dedup of shingle sets, for the pipeline: prefix filter, exact verification, connected groups.

Two sets of a similarity of at least 4/5 share at least 4/5 of the larger one. So if all sets list their shingles in one
common order, the first n - ceil(4n/5) + 1 of each have one in common: every such pair meets in a bucket, without exception.
The order puts shingles last that are common in a sample of documents; it decides how large buckets get, never which pairs are found.

Every prefix entry carries its place and the set's size. Where two sets first meet, at most what is left after those places can be
common too; pairs for which that is too little, or whose sizes differ too much, are never made. Each set also has a parity
signature, two bits or more a shingle: signatures that differ in d bits belong to sets that differ in d shingles at least, so most
other pairs go before any text moves. Neither screen loses a pair.

Equal sets are one node. In a first pass the nodes of a bucket are held against its smallest one, and what is verified is joined to
components; buckets within one component are done, so a large group of near copies does not yield all its pairs. In the
second pass the pairs of a bucket that lie in different components are screened and verified; a bucket is split by size, since only
sets of like size can be similar. Links are verified pairs only.

Fewer words than a shingle are one shingle; null or blank texts have the empty set and are equal to each other.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from newsloom.llm.common import bounded, staged
from newsloom.llm.simhash import components, shingle_hashes

SAMPLE = 4000
COMMON = 100_000


def shingle_set(text, size):
    """Sorted different shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    return np.unique(shingle_hashes(words, size)) if words else np.zeros(0, np.uint64)


def similar(a, b):
    """Whether two sorted sets have a Jaccard similarity of at least 4/5."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _hash_batches(size):
    def run(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.record_batch([pa.array(shingle_set(text, size).view(np.int64))], names=["hash"])
    return run


def common_shingles(docs, size):
    """Hashes that recur in a sample of documents, the commonest last."""
    rate = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rate)) == 0)
    met = some.select("text").mapInArrow(_hash_batches(size), "hash long").groupBy("hash").count().filter("count > 2")
    top = met.orderBy(F.desc("count"), "hash").limit(COMMON).select("hash").toArrow()
    return top.column("hash").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def signature(h):
    """Parity of the shingles in each of at least 2n cells, as bytes."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    cells = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_be_similar(n, m, one, other):
    """False only where the signatures show that sets of n and m shingles differ in more than a ninth of n + m."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):  # the cell of a shingle in fewer cells is its low bits; parities add up
        a = np.packbits(np.bitwise_xor.reduce(np.unpackbits(a).reshape(-1, 8 * len(b)), axis=0))
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n + m


def set_batches(size, common):
    """mapInArrow function: doc_id, key, size and signature of every text's set, and its prefix in the common order."""
    by_hash = np.argsort(common)
    known = common[by_hash]

    def rank(h):
        if not len(known):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, by_hash[at] + 1, 0)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                keys, sizes, prefixes, signs = [], [], [], []
                for text in part.column("text").to_pylist():
                    h = shingle_set(text, size)
                    n = len(h)
                    first = h[np.lexsort((h, rank(h)))][:n - -(-4 * n // 5) + 1]
                    keys.append(xxhash.xxh64_intdigest(h.tobytes()))
                    sizes.append(n)
                    prefixes.append(first.view(np.int64))
                    signs.append(signature(h))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                                       pa.array(prefixes, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                                      names=["doc_id", "key", "n", "prefix", "sign"])
    return run


def shared_batches(batches):
    """mapInArrow function over rows of longs sorted by bucket: the rows whose bucket has another row."""
    last, shared = None, False  # the last row waits for its successor
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if last is not None:
            rows = np.concatenate([last, rows])
        same = rows[1:, 0] == rows[:-1, 0]
        take = np.concatenate([[shared], same]) | np.concatenate([same, [False]])
        last, shared = rows[-1:], bool(take[-1])
        out = rows[:-1][take[:-1]]
        if len(out):
            yield pa.record_batch([pa.array(c) for c in out.T], names=batch.schema.names)
    if last is not None and shared:
        yield pa.record_batch([pa.array(c) for c in last.T], names=["bucket", "doc_id", "n", "place"])


def _screen_batches(batches):
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
        one, other = batch.column("one"), batch.column("other")
        keep = [may_be_similar(int(n[k]), int(m[k]), one[k].as_py(), other[k].as_py()) for k in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def screened(pairs, signs):
    """The pairs (a, b) whose signatures do not show them to be unlike; written."""
    one = signs.select(F.col("node").alias("a"), "n", F.col("sign").alias("one"))
    other = signs.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sign").alias("other"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "n", "m", "one", "other")
    return staged(both.mapInArrow(_screen_batches, "a long, b long").distinct(), "near-pairs")


def _verify_batches(size):
    def run(batches):
        last, held = None, None
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                a, b, one, other = (part.column(c).to_pylist() for c in ("a", "b", "one", "other"))
                keep = []
                for k in range(len(a)):
                    if one[k] != last or held is None:  # rows of one pair side follow each other after the join
                        last, held = one[k], shingle_set(one[k], size)
                    keep.append(similar(held, shingle_set(other[k], size)))
                keep = np.array(keep, bool)
                yield pa.record_batch([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])
    return run


def verified(pairs, signs, docs, size):
    """The pairs (a, b) of doc_ids whose texts are similar; written."""
    pairs = screened(staged(pairs.distinct(), "near-met"), signs)
    text = docs.select(F.col("doc_id").alias("id"), "text")
    other = text.join(bounded(pairs), F.col("id") == F.col("b")).select("a", "b", F.col("text").alias("other"))
    one = text.join(bounded(pairs.select(F.col("a").alias("a_")).distinct()), F.col("id") == F.col("a_")).select("a_", F.col("text").alias("one"))
    both = other.join(one, F.col("a") == F.col("a_")).select("a", "b", "one", "other")
    return staged(both.mapInArrow(_verify_batches(size), "a long, b long").distinct(), "near-links")


def fits(x, y):
    """Whether sets that first meet in these prefix entries can be similar: by size, and by what is left after the places."""
    left = F.least(x["n"] - x["place"], y["n"] - y["place"])
    return (5 * x["n"] >= 4 * y["n"]) & (5 * y["n"] >= 4 * x["n"]) & (9 * left >= 4 * (x["n"] + y["n"]))


def set_groups(docs, size=5, known=None):
    """doc_id and component_id (its smallest doc_id) of every document, by links of a similarity of 4/5 or more.

    ``known`` holds further links (a, b) of doc_ids, found by another method; they connect documents just like verified ones.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(docs.mapInArrow(set_batches(size, common_shingles(docs, size)),
                                  "doc_id long, key long, n long, prefix array<long>, sign binary"), "near-sets")
    nodes = staged(sets.groupBy("key", "n").agg(F.min("doc_id").alias("node")), "near-nodes")
    first = sets.join(nodes.withColumnRenamed("node", "doc_id"), ["key", "n", "doc_id"])
    signs = first.select(F.col("doc_id").alias("node"), "n", "sign")
    rows = first.select(F.posexplode("prefix").alias("place", "bucket"), "doc_id", "n")
    rows = rows.select("bucket", "doc_id", "n", F.col("place").cast("long").alias("place"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    rows = staged(rows.mapInArrow(shared_batches, "bucket long, doc_id long, n long, place long"), "near-shared")

    def side(name):
        return {c: F.col(f"{name}.{c}" if name else c) for c in ("doc_id", "n", "place")}
    least = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "n", "place")).alias("least"))
    star = rows.join(least, "bucket").filter((F.col("doc_id") != F.col("least.doc_id")) & fits(side(""), side("least")))
    links = verified(star.select(F.col("least.doc_id").alias("a"), F.col("doc_id").alias("b")), signs, docs, size)
    if known is not None:
        node = sets.select("doc_id", "key", "n").join(nodes, ["key", "n"]).select("doc_id", "node")
        one, other = (node.select(F.col("doc_id").alias(c), F.col("node").alias(f"{c}_")) for c in "ab")
        known = known.join(one, "a").join(other, "b").filter("a_ != b_").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
        links = staged(links.union(known).distinct(), "near-known")
    roots = components(links)
    rows = rows.join(roots, rows["doc_id"] == roots["node"], "left").select("bucket", "doc_id", "n", "place", F.coalesce("root", "doc_id").alias("root"))
    open_ = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("bucket")
    # sizes by powers of 5/4: similar sets lie in the same band or in neighbours
    rows = staged(rows.join(open_, "bucket").withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1.25))).cast("int")), "near-open")
    up = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    x, y = rows.alias("x"), up.alias("y")
    own = F.floor(F.log(F.greatest(F.col("y.n"), F.lit(1))) / F.log(F.lit(1.25))).cast("int")
    one_way = (F.col("x.band") != own) | (F.col("x.doc_id") < F.col("y.doc_id"))  # pairs of one band are made once
    across = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.band") == F.col("y.band")) & one_way
                    & (F.col("x.root") != F.col("y.root")) & fits(side("x"), side("y")))
    more = verified(across.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")), signs, docs, size)
    roots = components(links.union(more).distinct())
    nodes = nodes.join(roots, "node", "left").select("key", "n", F.coalesce("root", "node").alias("component_id"))
    return sets.select("doc_id", "key", "n").join(nodes, ["key", "n"]).select("doc_id", "component_id")
