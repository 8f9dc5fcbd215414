"""SimHash near-dedup (10): covering locality-sensitive hashing, then connected groups.

A fingerprint consists of ``pieces`` independent words of ``bits`` bits. A piece gets 2^(radius+1) - 1 structured masks:
every bit position has a random (radius+1)-bit label, and mask v keeps the positions whose label has odd
overlap with v. Whatever ``radius`` positions differ, some non-zero v is orthogonal to all their labels, so the pair
agrees on that mask: every pair within the radius of a piece meets in a table, without exception. With several pieces, every pair
within pieces * (radius + 1) - 1 bits in all meets, and most pairs a little beyond.

Equal fingerprints are one node. In a table's bucket, nodes are linked by walking out from one node to those
close to it that no walk has reached yet, so a bucket yields a spanning forest, never all its pairs. A bucket of more than
``chunk`` nodes is cut into chunks whose pairs of chunks are compared in different tasks. Links join to
components by alternating star contraction; every round is a written table.

Null or blank texts have the fingerprint zero and are linked like any other. A doc_id that is null names no component; such a
row gets its fingerprint's component. Repeated rows are equal nodes and each gets its row. An empty table gives no row.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from newsloom.llm.common import ship, staged, table, unused

SEED = 42
CHUNK = 4096


def shingle_hashes(words, size):
    """XXH64 of every run of ``size`` words joined by one blank; fewer words are one run."""
    text, n = b" ".join(words), max(1, len(words) - size + 1)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(text[a:b - 1], SEED) for a, b in zip(begins, ends[size - 1:].tolist())], np.uint64, n)


def fingerprint(words, size, bits, pieces):
    """The fingerprint's pieces as unsigned integers; zero without words."""
    if not words:
        return [0] * pieces
    hashes = shingle_hashes(words, size)
    width = bits * pieces
    salts = [hashes] + [(hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2 ** 64)) for k in range(1, -(-width // 64))]
    for k in range(1, len(salts)):
        x = salts[k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        salts[k] = x ^ (x >> np.uint64(29))
    votes = np.zeros(64 * len(salts), np.int64)
    for k, h in enumerate(salts):
        for part in np.array_split(h, -(-len(h) // 8192)):
            votes[64 * k:64 * k + 64] += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    ones = (2 * votes[:width] > len(hashes)).reshape(pieces, bits)
    return [int("".join("1" if b else "0" for b in row), 2) for row in ones]


def fingerprint_batches(size, bits, pieces):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                prints = [fingerprint((t or "").encode().lower().split(), size, bits, pieces) for t in part.column("text").to_pylist()]
                signed = np.array(prints, dtype=np.uint64).astype(np.int64).reshape(-1, pieces)
                yield pa.record_batch([part.column("doc_id"), *[pa.array(signed[:, k]) for k in range(pieces)]],
                                      names=["doc_id", *[f"f{k}" for k in range(pieces)]])
    return run


def fingerprints(docs, size=4, bits=64, pieces=1):
    """doc_id and the pieces f0, f1, ... of every document's fingerprint."""
    schema = "doc_id long, " + ", ".join(f"f{k} long" for k in range(pieces))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        fingerprint_batches(size, bits, pieces), schema)


def covering_masks(bits, radius, seed=SEED):
    """2^(radius+1) - 1 masks such that any ``radius`` positions are all left out by one of them."""
    labels = np.random.default_rng(seed).integers(1, 2 ** (radius + 1), bits)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        odd = [bin(int(x) & v).count("1") % 2 for x in labels]
        masks.append(sum(o << i for i, o in enumerate(odd)))
    return masks


def _signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def _distance(one, many):
    # the count of a signed number is that of its absolute value
    return np.bitwise_count((one ^ many).view(np.uint64)).sum(axis=1)


def forest(ids, prints, most, start=None):
    """Spanning forest of the graph that links prints within ``most`` bits: pairs of ids.

    With ``start``, only links between the first ``start`` rows and the others are looked for.
    """
    left = np.arange(len(ids))
    found = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _distance(prints[at], prints[left]) <= most
            if start is not None:
                near &= (left < start) != (at < start)
            for other in left[near].tolist():
                found.append((ids[at], ids[other]))
                queue.append(other)
            left = left[~near]
    return found


def _runs(keys):
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def shared_batches(batches):
    """mapInArrow function over rows sorted by bucket: the rows whose bucket has another row."""
    last, sent = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "doc_id"))
        if last is not None:  # the last row waits for its successor
            bucket, ids = np.concatenate([[last[0]], bucket]), np.concatenate([[last[1]], ids])
        same = np.concatenate([[False], bucket[1:] == bucket[:-1]])
        take = same | np.concatenate([same[1:], [False]])
        if last is not None and sent:
            take[0] = False
        out, last = take.copy(), (bucket[-1], ids[-1])
        sent = bool(out[-1])
        if out.any():
            yield pa.record_batch([pa.array(bucket[out]), pa.array(ids[out])], names=["bucket", "doc_id"])


def link_batches(pieces, most, chunk):
    """mapInArrow function over rows sorted by bucket: links of a bucket, or its rows by chunk if it is too large."""
    names = [f"f{k}" for k in range(pieces)]

    def table_of(links, late):
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        n, m = len(links), len(late[0])
        none = np.zeros(n, np.int64)
        return pa.record_batch(
            [pa.array(np.concatenate([a, late[0]])), pa.array(np.concatenate([b, late[1]])),
             pa.array(np.concatenate([none - 1, late[2]])), pa.array(np.concatenate([none, late[3]])),
             *[pa.array(np.concatenate([none, late[4][:, k]])) for k in range(pieces)]],
            names=["a", "b", "part", "parts", *names]) if n + m else None

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "doc_id", *names)]
            now = np.stack(cols, axis=1) if len(cols[0]) else np.zeros((0, 2 + pieces), np.int64)
            rest = now if rest is None else np.concatenate([rest, now])
            if not len(rest):
                continue
            begins, ends = _runs(rest[:, 0])
            done, rest = rest[:begins[-1]], rest[begins[-1]:]
            out = finish(done)
            if out is not None:
                yield out
        if rest is not None and len(rest):
            out = finish(rest)
            if out is not None:
                yield out

    def finish(rows):
        links, late = [], []
        if len(rows):
            begins, ends = _runs(rows[:, 0])
            sizes = ends - begins
            two = begins[sizes == 2]  # most shared buckets hold two nodes
            near = _distance(rows[two, 2:], rows[two + 1, 2:]) <= most
            links += list(zip(rows[two[near], 1].tolist(), rows[two[near] + 1, 1].tolist()))
            for a, b in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist()):
                if b - a <= chunk:
                    links += forest(rows[a:b, 1].tolist(), rows[a:b, 2:], most)
                else:
                    parts = -(-(b - a) // chunk)
                    late.append(np.column_stack([rows[a:b, :2], np.arange(b - a) % parts, np.full(b - a, parts), rows[a:b, 2:]]))
        late = np.concatenate(late) if late else np.zeros((0, 4 + pieces), np.int64)
        return table_of(links, (late[:, 0], late[:, 1], late[:, 2], late[:, 3], late[:, 4:]))

    return run


def _chunk_pair(pieces, most):
    names = [f"f{k}" for k in range(pieces)]

    def run(t: pa.Table) -> pa.Table:
        own, x, y = (t.column(c).to_numpy() for c in ("part", "x", "y"))
        order = np.argsort(own != x[0], kind="stable")
        ids = t.column("b").to_numpy()[order]
        prints = np.stack([t.column(c).to_numpy() for c in names], axis=1)[order]
        found = forest(ids.tolist(), prints, most, None if x[0] == y[0] else int((own == x[0]).sum()))
        a, b = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": a, "b": b})
    return run


def links(nodes, bits=64, pieces=1, radius=4, most=4, chunk=CHUNK):
    """Links (a, b) between doc_ids of different fingerprints that keep every connection within ``most`` bits."""
    names = [f"f{k}" for k in range(pieces)]
    keys = [F.xxhash64(F.lit(k * 1000 + t), F.col(f"f{k}").bitwiseAND(F.lit(_signed(m))))
            for k in range(pieces) for t, m in enumerate(covering_masks(bits, radius, SEED + k))]
    rows = nodes.select("doc_id", *names, F.explode(F.array(*keys)).alias("bucket"))
    if pieces > 1:  # wide fingerprints: let only those nodes carry theirs that share a bucket
        slim = rows.select("bucket", "doc_id").repartition("bucket").sortWithinPartitions("bucket")
        slim = staged(slim.mapInArrow(shared_batches, "bucket long, doc_id long"), "simhash-shared")
        rows = slim.join(nodes.select("doc_id", *names), "doc_id")
    rows = rows.select("bucket", "doc_id", *names).repartition("bucket").sortWithinPartitions("bucket")
    schema = "a long, b long, part long, parts long, " + ", ".join(f"{n} long" for n in names)
    found = staged(rows.mapInArrow(link_batches(pieces, most, chunk), schema), "simhash-links")
    # rows of a large bucket: a is the bucket, b the node; each chunk meets every other chunk once
    late = found.filter("part >= 0").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    late = late.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    pairs = late.groupBy("a", "x", "y").applyInArrow(_chunk_pair(pieces, most), "a long, b long")
    both = found.filter("part < 0").select("a", "b").union(pairs)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges):
    """Smallest reachable node of every node that has a link: (node, root). Edges are (a, b) with a < b.

    Large-star and small-star steps in turn; a hot node's neighbours are joined, not gathered in one task.
    """
    now, before = staged(edges.select("a", "b"), "star"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # every larger neighbour moves to the smallest node around
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b")
        large = staged(large.distinct(), "star")
        # every node and its smaller neighbours move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = staged(small.filter("a < b").distinct(), "star")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state


def near_groups(docs, size=4, bits=64, pieces=1, radius=4, most=4, chunk=CHUNK):
    """doc_id, f0.. and component_id of every document; links are fingerprints at ``most`` or fewer differing bits."""
    names = [f"f{k}" for k in range(pieces)]
    prints = staged(fingerprints(docs, size, bits, pieces), "simhash-prints")
    nodes = staged(prints.groupBy(*names).agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    roots = components(links(nodes.filter("doc_id IS NOT NULL"), bits, pieces, radius, most, chunk))
    nodes = nodes.join(roots, nodes["doc_id"] == roots["node"], "left").select(
        *[F.col(n).alias(f"_{n}") for n in names], F.coalesce("root", "doc_id").alias("component_id"))
    on = [prints[n] == nodes[f"_{n}"] for n in names]
    return prints.join(nodes, on).select("doc_id", *names, "component_id")


def near_links(docs, size=4, bits=64, pieces=1, radius=4, most=4, chunk=CHUNK):
    """Links (a, b) between doc_ids that join every two documents of fingerprints at ``most`` or fewer differing bits."""
    names = [f"f{k}" for k in range(pieces)]
    prints = staged(fingerprints(docs.filter("doc_id IS NOT NULL"), size, bits, pieces), "simhash-prints")
    nodes = staged(prints.groupBy(*names).agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    equal = prints.join(nodes.withColumnRenamed("doc_id", "a"), names).filter("a < doc_id").select("a", F.col("doc_id").alias("b"))
    return equal.union(links(nodes, bits, pieces, radius, most, chunk))


def one_of_each(docs, size=5, most=None):
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Documents are linked at a Jaccard similarity of their five-word shingles of 0.8 or more, exactly (``near_sets``): masks that
    cover the bits such pairs differ in would be too many or too narrow to part documents. With ``most``, fingerprints at that many
    differing bits or fewer are links too, as in ``near_groups``, and the exact join only looks for what they have not connected.
    Null ids stay; of rows that repeat the id that stays, one is kept.
    """
    from newsloom.llm.near_sets import set_groups  # it builds on this module

    own = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    groups = set_groups(own, size, None if most is None else near_links(own, radius=most, most=most))
    name, = unused(docs, "gone")
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
    alone = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return alone.unionByName(kept.filter("doc_id IS NULL"))


def op10_simhash(spark, folder):
    ship(spark)
    groups = near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
