"""Mixing sources to target weights (1): multinomial draws per output shard over permuted token blocks.

A source's documents form one stream of words, cut into blocks of ``block`` words; the last may be shorter. The words a source may
give are its target: its weight's share of all, at most ``cap`` times its size, the excess shared again by weight. An output
shard is ``shard`` consecutive slots. Every slot draws a source, so the counts of a shard are multinomial; draws beyond what
a source owes go to the sources that are short, so the totals are exact. The j-th draw of a source maps to a block by a
pseudorandom permutation of its blocks, a new pass starting when all are used, and slots join blocks by that index.
A source's last slot is cut to the words still owed: sources meet their targets to the word, and no word is taken more
often than ``cap`` times, rounded up. The seed fixes every draw.

Streams and permutations are ordered by a hash, and places in them come from running totals over buckets of the hash range, so a
source with most of the rows is never in one task. One row per source goes to one task: the sources of a mix are few.

Null and blank texts have no words: they are listed with zero words taken and appear in no slot. A null source is a source, ordered
last. Rows repeated in every column are separate documents of the stream. An empty table gives no row. Sources without
words have target zero.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import bucket_count, running, staged, table, word_count, word_list

BLOCK = 256
SHARD = 1024
#: Cells of the table that turns a uniform draw into a source.
CELLS = 1 << 16
WEIGHTS = (3, 1, 2)


def sizes_of(docs):
    """doc_id, source and words of every document."""
    return docs.select("doc_id", "source", F.coalesce(word_count(F.col("text")), F.lit(0)).cast("long").alias("size"))


def targets(sizes, weights=WEIGHTS, share=1.5, cap=2.0):
    """source, source_size, weight and target of every source, weights repeating in the order of the sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # the sources that reach their cap are those with the least cap per weight: go up until one stays below
    every = W.partitionBy()
    rank = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(W.unboundedPreceding, -1)
    onward = rank.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.least(F.sum("source_size").over(every) * share, F.sum("most").over(every))
    rate = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("rate", rate)
    open_rate = F.max(F.when(F.col("most") / F.col("weight") > F.col("rate"), F.col("rate"))).over(every)
    per = per.withColumn("open", open_rate)
    target = F.when(F.col("open").isNull(), F.col("most")).otherwise(F.least("most", F.col("open") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _uniform(seed, *cols):
    return F.xxhash64(F.lit(seed), *cols)


def plan(sizes, per, block=BLOCK, shard=SHARD, seed=17):
    """Which words of which document each slot holds.

    ``sizes`` (doc_id, source, size) and ``per`` (targets) must be written tables. Returns two frames: the placed
    documents (doc_id, source, size, start) and the slices (source, start, shard, slot, pass, first, last): words
    first..last-1 of the document at ``start`` of its source's stream.
    """
    spark = sizes.sparkSession
    full = sizes.filter("size > 0").withColumn("h", _uniform(seed, "source", "doc_id", "size"))
    count, words = full.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    order = ["h", "doc_id", "size"]
    placed = staged(running(full, ["source"], order, "size", bucket_count(count), "start").drop("h"), "mix-placed")
    b = F.lit(block)
    pieces = placed.select("source", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
    pieces = pieces.withColumn("a", F.greatest(F.col("start"), F.col("block") * b) - F.col("block") * b)
    pieces = pieces.withColumn("z", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.col("block") * b)

    # the permutation: blocks by hash, with their place and the words before them in a pass
    blocks = pieces.groupBy("source", "block").agg(F.sum(F.col("z") - F.col("a")).alias("words"))
    blocks = blocks.withColumn("h", _uniform(seed + 1, "source", "block")).withColumn("one", F.lit(1))
    buckets = bucket_count(words // block)
    blocks = running(blocks, ["source"], ["h", "block"], ["one", "words"], buckets, ["place", "before"])
    blocks = staged(blocks.drop("h", "one"), "mix-blocks")
    owed = per.withColumn("owed", F.floor("target").cast("long")).filter("owed > 0")
    owed = owed.select(F.col("source").alias("o_source"), "owed", (F.col("owed") / F.col("source_size")).cast("long").alias("passes"),
                       (F.col("owed") % F.col("source_size")).alias("left"), "source_size")
    number = blocks.groupBy("source").agg(F.max("place").alias("last")).withColumnRenamed("source", "n_source")
    owed = owed.join(number, F.col("o_source").eqNullSafe(F.col("n_source"))).drop("n_source")
    uses = blocks.join(owed, blocks["source"].eqNullSafe(owed["o_source"]))
    uses = uses.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    take = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(
        F.greatest(F.lit(0), F.least(F.col("words"), F.col("left") - F.col("before"))))
    uses = uses.withColumn("take", take).filter("take > 0")
    uses = staged(uses.select("source", "block", "pass", "take", (F.col("pass") * (F.col("last") + 1) + F.col("place")).alias("draw")), "mix-uses")

    slots = staged(_draws(spark, uses, per, shard, seed), "mix-slots")
    held = slots.join(uses, slots["source"].eqNullSafe(uses["source"]) & (slots["draw"] == uses["draw"])).select(
        uses["source"], "shard", "slot", "block", "pass", "take")
    on = held["source"].eqNullSafe(pieces["source"]) & (held["block"] == pieces["block"])
    cut = held.join(pieces, on).withColumn("end", F.least("z", "take")).filter("a < end")
    shift = F.col("start") - pieces["block"] * b
    slices = cut.select(pieces["source"], "start", "shard", "slot", "pass",
                        (F.col("a") - shift).alias("first"), (F.col("end") - shift).alias("last"))
    return placed, slices


def _draws(spark, uses, per, shard, seed):
    """One row per slot: shard, slot, source, and which draw of its source it is."""
    quota = staged(uses.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), "mix-quota")
    total = quota.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    line = W.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("quota").over(line.rowsBetween(W.unboundedPreceding, 0))
    ranged = quota.select("source", "quota", (upto - F.col("quota")).alias("low"), upto.alias("high"))
    cell = lambda c: F.floor(F.col(c) * F.lit(CELLS) / F.lit(max(total, 1))).cast("long")
    # CELLS rows whatever the input: a bounded table
    cells = ranged.select("source", cell("low").alias("a"), cell("high").alias("z")).filter("a < z")
    cells = cells.select(F.col("source").alias("drawn"), F.explode(F.sequence("a", F.col("z") - 1)).alias("cell"))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard).alias("shard"),
                                      F.pmod(_uniform(seed + 2, "id"), F.lit(CELLS)).alias("cell"))
    slots = slots.join(F.broadcast(cells), "cell").withColumnRenamed("drawn", "source").drop("cell")
    slots = slots.withColumn("h", F.col("slot") * F.lit(2 ** 62 // max(total, 1))).withColumn("one", F.lit(1))
    buckets = bucket_count(total)
    slots = staged(running(slots, ["source"], ["h", "slot"], "one", buckets, "draw"), "mix-drawn")
    # a source that was drawn too often hands its last draws to those that were drawn too rarely
    got = slots.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    state = quota.join(got.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")), "left")
    state = state.select(F.col("source").alias("q_source"), "quota", F.coalesce("got", F.lit(0)).alias("got"))
    slots = slots.join(state, slots["source"].eqNullSafe(state["q_source"]))
    kept = slots.filter("draw < quota").select("shard", "slot", "source", "draw")
    spare = slots.filter("draw >= quota").select("shard", "slot", "h", "one")
    spare = running(spare, [], ["h", "slot"], "one", buckets, "gap")
    short = state.withColumn("lack", F.greatest(F.lit(0), F.col("quota") - F.col("got")))
    upto = F.sum("lack").over(W.orderBy(F.col("q_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    short = short.withColumn("from", upto - F.col("lack")).filter("lack > 0")
    short = short.select(F.col("q_source").alias("source"), "from", "got", F.explode(
        F.sequence("from", F.col("from") + F.col("lack") - 1)).alias("gap"))
    filled = spare.join(short, "gap").select("shard", "slot", "source", (F.col("got") + F.col("gap") - F.col("from")).alias("draw"))
    return kept.unionByName(filled)


def mix(docs, weights=WEIGHTS, share=1.5, cap=2.0, block=BLOCK, shard=SHARD, seed=17):
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    sizes = staged(sizes_of(docs), "mix-sizes")
    per = staged(targets(sizes, weights, share, cap), "mix-targets")
    placed, slices = plan(sizes, per, block, shard, seed)
    taken = slices.groupBy("source", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    taken = taken.withColumnRenamed("source", "t_source").withColumnRenamed("start", "t_start")
    full = placed.join(taken, placed["source"].eqNullSafe(taken["t_source"]) & (placed["start"] == taken["t_start"]), "left")
    full = full.select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    rows = full.union(sizes.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long")))
    per = per.withColumnRenamed("source", "p_source")
    return rows.join(per, rows["source"].eqNullSafe(per["p_source"])).select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs, weights=WEIGHTS, share=1.5, cap=2.0, block=BLOCK, shard=SHARD, seed=17):
    """The mix as documents: one row for each pass over a document, with the words that the pass takes.

    A pass that takes the whole document keeps its text as it is; otherwise the words taken are joined by one blank.
    Columns are those of ``docs``; n_chars, if there, follows the new text.
    """
    sizes = staged(sizes_of(docs), "mix-sizes")
    per = staged(targets(sizes, weights, share, cap), "mix-targets")
    placed, slices = plan(sizes, per, block, shard, seed)
    spans = slices.groupBy("source", "start", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_spans"))  # blocks of one document
    placed = placed.withColumnRenamed("source", "p_source").withColumnRenamed("start", "p_start")
    spans = spans.join(placed, spans["source"].eqNullSafe(placed["p_source"]) & (spans["start"] == placed["p_start"]))
    spans = spans.groupBy("doc_id", "p_source", "size", "p_start").agg(F.collect_list("_spans").alias("_passes"))
    nth = W.partitionBy("doc_id", "p_source", "size").orderBy("p_start")
    # rows that repeat id, source and size are told apart by their rank
    spans = spans.withColumn("_nth", F.row_number().over(nth)).select(
        F.col("doc_id").alias("_id"), F.col("p_source").alias("_source"), F.col("size").alias("_n"), "_nth", "_passes")
    # the user's columns go along in one struct: no name of theirs meets one of ours
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"),
                       F.coalesce(word_count(F.col("text")), F.lit(0)).cast("long").alias("_size"))
    own = W.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))
    rows = rows.withColumn("_rank", F.row_number().over(own))
    on = (rows["doc_id"].eqNullSafe(spans["_id"]) & rows["source"].eqNullSafe(spans["_source"])
          & (rows["_size"] == spans["_n"]) & (rows["_rank"] == spans["_nth"]))
    out = rows.join(spans, on).withColumn("_spans", F.explode("_passes"))
    words = word_list(F.col("text"))
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"]) == F.col("_size")
    cut = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(
        F.col("_words"), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), " ")
    out = out.withColumn("_whole", whole).withColumn("_words", F.when(~F.col("_whole"), words))
    out = out.withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(cut))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op1_mix_sources(spark, folder):
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")
