"""Conversation prefix trie (12): vertical bitmaps, intersected depth first in shards, merged by prefix.

Turns are numbered within their conversation from one global sort, so a conversation may hold any share of all rows. A shard is up to
``shard`` consecutive conversations times ``block`` positions. In it an index maps (position, turn) to a bitset of conversations. From
the bitsets of equal prefixes at the block's start, a depth-first walk intersects a node's bitset with the postings of its
members' next turns: each intersection is a child, its popcount the shard's members, those that end there the shard's end list. A
prefix is known by 128 bits that all shards agree on: the exclusive or of its (position, turn) hashes.

Nodes of all shards are merged by prefix in sorted streams. End lists come in the order of conversation ids, so their SHA-256
is updated list by list and never held. Sums over subtrees: the nodes with one smallest member are a path; paths form a
tree whose sums double their reach in every round (the parent 2^k steps up), then run backwards along each path block by block.

Null roles and texts are empty. Null turns come first; turns of one number are ordered by role, then by a hash of the text. Repeated
rows are turns of their own. Rows with a null conv_id belong to no conversation and are left out. % is never negative. A
table without conversations gives no row. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import ship, staged, table

SHARD = 2048
BLOCK = 256
FAMILY = 5
HEADS = 9


def _partitions(spark, rows):
    """Range partitions of some 200 000 rows, at least as many as a shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 200_000)


def numbered(talks):
    """conv_id, pos (from 0), two turn hashes and the text's bytes; written. Holds whatever one conversation's share is."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = talks.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, F.lit(7), role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"))
    # equal rows may be many: their place in the input parts them, and which of them comes first is all one
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    count = rows.count()
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("h1"), F.col("h2"), F.col("tie")]
    rows = rows.repartitionByRange(_partitions(talks.sparkSession, count), *order).sortWithinPartitions(*order)
    rows = staged(rows.select("conv_id", "h1", "h2", "bytes", F.monotonically_increasing_id().alias("seq")), "trie-turns")
    # one row per conversation and partition: where its turns begin there, and how many earlier partitions hold
    spans = rows.groupBy("conv_id", F.shiftright("seq", 33).alias("part")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("turns"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("base", F.coalesce(F.sum("turns").over(before), F.lit(0)) - F.col("first")).select(
        F.col("conv_id").alias("conv"), F.col("part").alias("part_"), "base")
    rows = rows.join(spans, (rows["conv_id"] == spans["conv"]) & (F.shiftright("seq", 33) == spans["part_"]))
    return staged(rows.select("conv_id", (F.col("seq") + F.col("base")).alias("pos"), "h1", "h2", "bytes"), "trie-numbered")


def conversations(turns, shard, family, heads):
    """conv_id, own (turns), cut (h), lead (turns taken from the first of the family), size (rebuilt) and shard; written."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long")
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    firsts = sizes.select(F.col("conv_id").alias("first"), F.col("own").alias("has"))
    out = sizes.withColumn("first", first).join(firsts, "first", "left").withColumn("cut", cut)
    out = out.withColumn("lead", F.least("cut", F.coalesce("has", F.lit(0))))
    out = out.withColumn("size", F.col("lead") + F.greatest(F.col("own") - F.col("cut"), F.lit(0)))
    spark = turns.sparkSession
    out = out.repartitionByRange(_partitions(spark, turns.count()), "conv_id").sortWithinPartitions("conv_id")
    at = F.monotonically_increasing_id()  # 2^33 of a partition: shards are runs of ids
    return staged(out.select("conv_id", "cut", "lead", "size", F.floor(at / shard).cast("long").alias("shard")), "trie-conversations")


def rebuilt(turns, talks, family, heads):
    """shard, conv_id, pos, z1, z2, bytes, last of the rebuilt conversations."""
    borrowed = turns.filter((F.pmod("conv_id", F.lit(family)) == 0) & (F.col("pos") < heads - 1)).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(family - 1)), lambda k: F.col("conv_id") + k)).alias("conv_id"),
        "pos", "h1", "h2", "bytes", F.lit(True).alias("lent"))
    rows = borrowed.unionByName(turns.withColumn("lent", F.lit(False))).join(talks, "conv_id")
    rows = rows.filter(F.when(F.col("lent"), F.col("pos") < F.col("cut")).otherwise(F.col("pos") >= F.col("cut")))
    pos = F.when(F.col("lent"), F.col("pos")).otherwise(F.col("pos") - F.col("cut") + F.col("lead"))
    rows = rows.withColumn("pos", pos)
    return rows.select("shard", "conv_id", "pos", F.xxhash64("pos", "h1", "h2").alias("z1"), F.xxhash64("h2", "pos", "h1").alias("z2"),
                       "bytes", (F.col("pos") == F.col("size") - 1).alias("last"), F.col("size").alias("_size"))


NODE = "x1 long, x2 long, p1 long, p2 long, depth long, shard long, conv_id long, members long, bytes long, ends binary"


def walk(block):
    """applyInArrow function over a shard: its nodes, from the prefixes at its start."""
    def run(t: pa.Table) -> pa.Table:
        conv, pos, z1, z2, size = (t.column(c).to_numpy() for c in ("conv_id", "pos", "z1", "z2", "bytes"))
        last = t.column("last").to_numpy(zero_copy_only=False)
        ids, member = np.unique(conv, return_inverse=True)
        order = np.lexsort((pos, member))
        start = int(t.column("part")[0].as_py()) * block
        where = np.full((len(ids), block + 1), -1, np.int32)  # of a conversation and position: its turn's posting; column 0: the prefix
        posting, bits, turn_of = {}, [], []
        ended = [False] * len(ids)
        column = pos - start + 1
        for r in order.tolist():
            m, c = int(member[r]), int(column[r])
            key = (c, z1[r], z2[r])
            k = posting.get(key)
            if k is None:
                k = posting[key] = len(bits)
                bits.append(0)
                turn_of.append(r)
            bits[k] |= 1 << m
            where[m, c] = k
            if last[r]:
                ended[m] = True
        if start == 0:
            starts = [((1 << len(ids)) - 1, 0, 0)]
        else:
            starts = [(bits[k], int(z1[r]), int(z2[r])) for k, r in enumerate(turn_of) if column[r] == 0]
        if start == 0:
            where[:, 0] = 0  # all have the empty prefix
        stop = (where >= 0).sum(axis=1).tolist()  # first column without a turn
        out = []

        def node(held, depth, column, x, p, size):
            first = (held & -held).bit_length() - 1
            ends, rest = [], held
            while rest:
                m = (rest & -rest).bit_length() - 1
                rest &= rest - 1
                if stop[m] == column + 1 and ended[m]:
                    ends.append(int(ids[m]))
            out.append((*x, *p, depth, int(ids[first]), held.bit_count(), size, np.array(ends, "<i8").tobytes() if ends else None))

        stack = [(held, 0, (a, b)) for held, a, b in starts]
        if start == 0:
            node(starts[0][0], 0, 0, (0, 0), (0, 0), 0)
        while stack:
            held, at, x = stack.pop()
            if at == block:
                continue
            rest = held
            while rest:
                m = (rest & -rest).bit_length() - 1
                k = int(where[m, at + 1])
                if k < 0:
                    rest &= rest - 1
                    continue
                child = held & bits[k]
                rest &= ~bits[k]
                r = turn_of[k]
                y = (x[0] ^ int(z1[r]), x[1] ^ int(z2[r]))
                node(child, start + at + 1, at + 1, y, x, int(size[r]))
                stack.append((child, at + 1, y))
        cols = list(zip(*out)) if out else [[]] * 9
        longs = [pa.array(c, pa.int64()) for c in cols[:8]]
        shard = pa.array([t.column("shard")[0].as_py()] * len(out), pa.int64())
        return pa.table([*longs[:5], shard, *longs[5:], pa.array(cols[8], pa.binary())],
                        names=["x1", "x2", "p1", "p2", "depth", "shard", "conv_id", "members", "bytes", "ends"])
    return run


def merged_batches(batches):
    """mapInArrow function over nodes sorted by prefix and shard: one row per prefix; the digest of its ends grows list by list."""
    held, ends = None, None

    def closed():
        return (*held, (ends or hashlib.sha256()).hexdigest())

    names = ["x1", "x2", "p1", "p2", "depth", "bytes", "conv_id", "members", "ends_sha256"]

    def batch_of(rows):
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], pa.string())], names=names)

    for batch in batches:
        out = []
        for x1, x2, p1, p2, depth, conv, members, size, some in zip(*(batch.column(c).to_pylist() for c in (
                "x1", "x2", "p1", "p2", "depth", "conv_id", "members", "bytes", "ends"))):
            if held is None or held[0] != x1 or held[1] != x2:
                if held is not None:
                    out.append(closed())
                held, ends = [x1, x2, p1, p2, depth, size, conv, 0], None
            held[6] = min(held[6], conv)
            held[7] += members
            if some:
                listed = ",".join(map(str, np.frombuffer(some, "<i8").tolist())).encode()
                if ends is None:
                    ends = hashlib.sha256(listed)
                else:
                    ends.update(b"," + listed)
        if out:
            yield batch_of(out)
    if held is not None:
        yield batch_of([closed()])


def nodes(talks, shard=SHARD, block=BLOCK, family=FAMILY, heads=HEADS):
    """x1, x2 (prefix), p1, p2 (its parent), depth, bytes, conv_id (smallest member), members and ends_sha256 of every node; written."""
    turns = numbered(talks)
    convs = conversations(turns, shard, family, heads)
    rows = rebuilt(turns, convs, family, heads).withColumn("part", F.floor(F.col("pos") / block).cast("long"))
    zero = F.lit(0).cast("long")
    none = convs.filter("size = 0").select("shard", "conv_id", (zero - 1).alias("pos"), zero.alias("z1"), zero.alias("z2"), zero.alias("bytes"),
                                           F.lit(True).alias("last"), F.col("size").alias("_size"), zero.alias("part"))
    # prefixes at the later blocks' starts
    long = rows.filter(F.col("_size") > block).groupBy("shard", "conv_id", "_size", "part").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
    upto = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = long.select("shard", "conv_id", (F.col("part") * block - 1).alias("pos"), F.bit_xor("z1").over(upto).alias("z1"),
                         F.bit_xor("z2").over(upto).alias("z2"), zero.alias("bytes"), F.lit(False).alias("last"), "_size", "part").filter("part > 0")
    rows = rows.unionByName(none).unionByName(starts).drop("_size")
    local = rows.groupBy("shard", "part").applyInArrow(walk(block), NODE)
    local = local.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "shard")
    schema = "x1 long, x2 long, p1 long, p2 long, depth long, bytes long, conv_id long, members long, ends_sha256 string"
    return staged(local.mapInArrow(merged_batches, schema), "trie-nodes")


def path_totals(paths):
    """conv_id, parent, at (depth of the parent node) and the path's two weights summed over it and all paths below it; written."""
    reach = staged(paths.select("conv_id", F.col("parent").alias("up"), "saved", "leaves"), "trie-reach")
    while True:
        below = reach.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("saved_"), F.sum("leaves").alias("leaves_"))
        ups = reach.select(F.col("conv_id").alias("up"), F.col("up").alias("up_"))
        some = reach.filter("up IS NOT NULL").limit(1).count()
        if not some:
            break
        reach = reach.join(below, "conv_id", "left").join(ups, "up", "left").select(
            "conv_id", F.col("up_").alias("up"), (F.col("saved") + F.coalesce("saved_", F.lit(0))).alias("saved"),
            (F.col("leaves") + F.coalesce("leaves_", F.lit(0))).alias("leaves"))
        reach = staged(reach, "trie-reach")
    return staged(paths.select("conv_id", "parent", "at").join(reach.select("conv_id", "saved", "leaves"), "conv_id"), "trie-totals")


def trie(talks, shard=SHARD, block=BLOCK, family=FAMILY, heads=HEADS):
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    found = nodes(talks, shard, block, family, heads)
    children = found.filter("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_"), F.lit(True).alias("there"))
    rows = found.join(children, ["x1", "x2"], "left").join(parents, ["p1", "p2"], "left")
    rows = staged(rows.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
                              F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                              ((F.col("members") - 1) * F.col("bytes")).alias("saved"),
                              F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "ends_sha256"), "trie-rows")
    top = F.min(F.struct("depth", F.col("parent_conv_id").alias("parent")))
    paths = rows.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), top.alias("top")).select(
        "conv_id", "saved", "leaves", F.col("top.parent").alias("parent"), (F.col("top.depth") - 1).alias("at"))
    totals = path_totals(paths)
    joined = totals.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum("saved").alias("saved_"), F.sum("leaves").alias("leaves_"))
    rows = rows.join(joined, ["conv_id", "depth"], "left").withColumn("saved", F.col("saved") + F.coalesce("saved_", F.lit(0))).withColumn(
        "leaves", F.col("leaves") + F.coalesce("leaves_", F.lit(0))).withColumn("part", F.floor(F.col("depth") / block).cast("long"))
    # from each node to its path's end: the rest of its block, then the later blocks
    inside = W.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    after = rows.groupBy("conv_id", "part").agg(F.sum("saved").alias("a"), F.sum("leaves").alias("b")).select(
        "conv_id", "part", F.coalesce(F.sum("a").over(later), F.lit(0)).alias("a"), F.coalesce(F.sum("b").over(later), F.lit(0)).alias("b"))
    rows = rows.withColumn("saved", F.sum("saved").over(inside)).withColumn("leaves", F.sum("leaves").over(inside)).join(after, ["conv_id", "part"])
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("b")).alias("n_leaves"),
                       (F.col("saved") + F.col("a")).alias("saved_tokens"), "ends_sha256")


def op12_prefix_trie(spark, folder):
    ship(spark)
    return trie(table(spark, folder, "conversations"))
