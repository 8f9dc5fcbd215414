"""LM scoring (9): the probability of a text summed over all segmentations into subword pieces.

The pieces come from a public vocabulary. Their unigram scores are estimated from the training documents: the words
are counted, each distinct word is segmented once by the vocabulary's own rule, and its pieces count as often as the word.
A word's score is the log of the sum over every path of its lattice, by a forward recursion in log space; letters without a
piece take a path of byte pieces. A text's score is the sum over its words and one end token.

Every distinct word is scored once. The ``head`` most frequent words (at most 64 bytes each, so the table has a
bound) are sent to all tasks and summed there; the others are counted per document and joined with the table of words.
Frequent words never reach that join, so no key of it is hot.

Null, empty and blank texts have the end token only. A null doc_id belongs to the training documents. Repeated rows are
separate documents. An empty table gives no row; without training documents N is 0 and pieces are equally likely.
"""

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from newsloom.llm.common import ship, staged, table

HEAD = 1 << 18
HEAD_BYTES = 64
#: Distinct words a task counts before it hands them on.
FLUSH_WORDS = 300_000
#: Texts turned to Python objects at a time.
ROWS = 64


def _parts(batches, rows=ROWS):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def words_of(text):
    """Words of a text as bytes, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def count_batches(batches):
    """mapInArrow function: (train, text) -> word, uses in training documents, uses in all."""
    seen, trained = Counter(), Counter()

    def flush():
        words = list(seen)
        out = pa.record_batch([pa.array(words, pa.binary()), pa.array([trained[w] for w in words], pa.int64()),
                               pa.array([seen[w] for w in words], pa.int64())], names=["word", "c", "n"])
        seen.clear()
        trained.clear()
        return out

    for part in _parts(batches):
        for train, text in zip(part.column("train").to_pylist(), part.column("text").to_pylist()):
            words = words_of(text)
            seen.update(words)
            if train:
                trained.update(words)
        if len(seen) >= FLUSH_WORDS:
            yield flush()
    if seen:
        yield flush()


@functools.lru_cache(maxsize=1)
def pieces_of(path):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_batches(path):
    """mapInArrow function: (word, c) -> piece id, how often it is used."""
    def run(batches):
        model = pieces_of(path)
        total = np.zeros(model.get_piece_size(), np.int64)
        for part in _parts(batches, 4096):
            words = [w.decode() for w in part.column("word").to_pylist()]
            ids = model.encode(words, num_threads=1)
            uses = np.repeat(part.column("c").to_numpy(), list(map(len, ids)))
            flat = np.fromiter((i for x in ids for i in x), np.int64, len(uses))
            np.add.at(total, flat, uses)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["piece", "n"])
    return run


class Lattice:
    """Sum over all segmentations of a word, given log10 scores of the pieces."""

    def __init__(self, path, scores):
        import ahocorasick
        model = pieces_of(path)
        self.find, self.bytes, self.single = ahocorasick.Automaton(), [0.0] * 256, set()
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(text[3:5], 16)] = scores[i] * math.log(10)
            elif not model.is_control(i) and not model.is_unknown(i):
                self.find.add_word(text, (len(text), scores[i] * math.log(10)))
                if len(text) == 1:
                    self.single.add(text)
        self.find.make_automaton()

    def score(self, word):
        """log10 of the word's marginal probability."""
        text = "▁" + word
        n, none = len(text), -math.inf
        arcs = [[] for _ in range(n + 1)]
        for end, (size, s) in self.find.iter(text):
            arcs[end + 1].append((end + 1 - size, s))
        alpha = [0.0] + [none] * n
        for end in range(1, n + 1):
            letter = text[end - 1]
            paths = [alpha[begin] + s for begin, s in arcs[end]]
            if letter not in self.single:
                paths.append(alpha[end - 1] + sum(self.bytes[b] for b in letter.encode()))
            most = max(paths)
            alpha[end] = most + math.log(sum(math.exp(p - most) for p in paths)) if len(paths) > 1 else most
        return alpha[n] / math.log(10)


@functools.lru_cache(maxsize=1)
def lattice(path, scores):
    return Lattice(path, scores.value)


def lattice_batches(path, scores):
    def run(batches):
        model = lattice(path, scores)
        for part in _parts(batches, 4096):
            out = [model.score(w.decode()) for w in part.column("word").to_pylist()]
            yield pa.record_batch([*[part.column(c) for c in ("word", "c", "n")], pa.array(out, pa.float64())],
                                  names=["word", "c", "n", "lp"])
    return run


def train(docs, path):
    """Word table (word, c, n, lp) and (N, V, training documents, log10 of the end token). ``docs``: train, text."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(count_batches, "word binary, c long, n long")
    words = staged(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")
    ends = docs.filter("train").count()
    n, v = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    used = words.filter("c > 0").select("word", "c").mapInArrow(piece_batches(path), "piece long, n long")
    size = pieces_of(path).get_piece_size()
    counts = np.zeros(size)
    for row in used.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most one row per piece of the vocabulary
        counts[row["piece"]] = row["n"]
    total = counts.sum() + ends + size + 1
    scores = spark.sparkContext.broadcast(np.log10((counts + 1) / total).tolist())
    scored = staged(words.mapInArrow(lattice_batches(path, scores), "word binary, c long, n long, lp double"), "lm-scored")
    return scored, (n + ends, v + (ends > 0), ends, math.log10((ends + 1) / total))


def score_batches(head, facts):
    """mapInArrow function: sums over a document's head words, and its other words with their counts."""
    def run(batches):
        place, c, lp = head.value
        n, v, ends, end_lp = facts
        base = np.log10((c + 1) / (n + v + 1))
        end_base = math.log10((ends + 1) / (n + v + 1))
        get, key = place.get, TaskContext.get().partitionId() << 33
        for part in _parts(batches):
            cols = {k: [] for k in ("key", "n_tokens", "n_known", "base", "score", "rest", "times")}
            for text in part.column("text").to_pylist():
                words = words_of(text)
                at = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
                inside = at[at >= 0]
                rest = Counter(words[k] for k in np.flatnonzero(at < 0).tolist())
                cols["key"].append(key)
                cols["n_tokens"].append(len(words) + 1)
                cols["n_known"].append(int((c[inside] > 0).sum()) + (ends > 0))
                cols["base"].append(float(base[inside].sum()) + end_base)
                cols["score"].append(float(lp[inside].sum()) + end_lp)
                cols["rest"].append(list(rest))
                cols["times"].append(list(rest.values()))
                key += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.record_batch([part.column("doc_id"), part.column("train"),
                                   *[pa.array(x, t) for x, t in zip(cols.values(), kinds)]],
                                  names=["doc_id", "train", *cols])
    return run


SCORED = ("doc_id long, train boolean, key long, n_tokens long, n_known long, base double, score double, "
          "rest array<binary>, times array<long>")


def score(docs, path, head=HEAD):
    """Score all documents (doc_id, text, train) with the model learned from those marked ``train``."""
    spark = docs.sparkSession
    words, facts = train(docs.select("train", "text"), path)
    n, v = facts[:2]
    top = words.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(head)
    top = top.select("word", "c", "lp").toArrow()  # at most ``head`` words of HEAD_BYTES bytes
    place = {w: k for k, w in enumerate(top.column("word").to_pylist())}
    known = spark.sparkContext.broadcast((place, top.column("c").to_numpy(), top.column("lp").to_numpy()))
    first = staged(docs.select("doc_id", "train", "text").mapInArrow(score_batches(known, facts), SCORED), "lm-first")
    rest = first.filter(F.size("rest") > 0).select("key", F.explode(F.arrays_zip("rest", "times")).alias("w"))
    rest = rest.select("key", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    sums = rest.join(words, "word").groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * base).alias("more_base"), F.sum(F.col("times") * F.col("lp")).alias("more_score"))
    out = first.drop("rest", "times").join(sums, "key", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"))


def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op9_lattice_lm(spark, folder):
    ship(spark)
    docs = table(spark, folder, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held).alias("train")), vocabulary())
