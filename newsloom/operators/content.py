"""Content representation: vocabulary, TF-IDF, vectors, PCA, LSA, checks."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import ElementwiseProduct, Normalizer, PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.functions.text import tokenize
from newsloom.operators.encoders import _reserved
from newsloom.operators.joins import lookup_join
from newsloom.operators.ranking import global_rank
from newsloom.operators.skipgram import numbered, train_skipgram
from newsloom.schema import UNKNOWN_TOKEN
from newsloom.session import materialize


def tokenize_articles(articles, id_col, text_col, lower_first=False, max_words=None, lower=False):
    text = F.lower(text_col) if lower else F.col(text_col)
    return articles.select(id_col, tokenize(text, lower_first, max_words).alias("tokens"))


def word_counts(tokens, col="tokens"):
    """(word, count) of token lists, or of texts that are counted already (``term_counts``)."""
    if isinstance(tokens, Counted):
        return tokens.totals.select(F.col("term").alias("word"), F.col("cf").alias("count"))
    return (tokens.select(F.explode(col).alias("word")).groupBy("word")
            .agg(F.count("*").alias("count")))


def top_words(tokens, n):
    """The n most frequent words (ties by word)."""
    return word_counts(tokens).orderBy(F.desc("count"), "word").limit(n)


def build_vocab(tokens, vectors, top_n=100_000):
    """Codes of frequent words that have a vector: 0 pad, 1 unknown, then by frequency."""
    known = top_words(tokens, top_n).join(
        vectors.select("word"), "word", "left_semi").withColumnRenamed("word", "value")
    numbered = global_rank(known, [("count", False), ("value", True)]).select(
        "value", (F.col("rn") + 1).cast("int").alias("code"))
    reserved, _ = _reserved(tokens.sparkSession, True, False)
    unknown = tokens.sparkSession.createDataFrame([(UNKNOWN_TOKEN, 1)], "value string, code int")
    # at most top_n rows and two
    return F.broadcast(reserved.unionByName(unknown).unionByName(numbered))


def encode_tokens(articles, vocab, id_col, col="tokens", unknown=1):
    """Token list -> code list (unknown words get code 1) with the text length.

    Every token looks its code up and goes back to its row by place, so the work of a text
    grows with its tokens (a map of its words would be searched from the start for each).
    """
    key, place = "_row", "_place"
    rows = articles.select(id_col, F.col(col).alias("_t"), F.monotonically_increasing_id().alias(key))
    words = rows.select(id_col, key, F.size("_t").alias("text_length"), F.posexplode_outer("_t").alias(place, "value"))
    coded = lookup_join(words, vocab.select("value", "code"), "value")
    found = F.when(F.col(place).isNotNull(), F.struct(F.col(place), F.coalesce("code", F.lit(unknown)).alias("code")))
    lists = coded.groupBy(key, id_col, "text_length").agg(F.sort_array(F.collect_list(found)).alias("_l"))
    codes = F.when(F.col("text_length") >= 0, F.transform("_l", lambda x: x["code"]))
    return lists.select(id_col, codes.alias("codes"), "text_length")


def token_coverage(encoded, unknown=1):
    """Mean, median and largest text length and the share of known tokens."""
    known = F.size(F.filter("codes", lambda c: c != unknown))
    per_length = encoded.withColumn("_k", known).groupBy("text_length").agg(
        F.count("*").alias("f"), F.sum("_k").alias("k"))
    total = F.sum(F.col("text_length") * F.col("f"))
    return per_length.agg(
        (total / F.sum("f")).alias("mean_length"),
        F.expr("percentile(text_length, 0.5, f)").alias("median_length"),
        F.max("text_length").alias("max_length"),
        (F.sum("k") / total * 100).alias("percent_known"))


def ngram_tokens(tokens, low=1, high=1, col="tokens"):
    """Token lists with all n-grams of low..high tokens, joined by blanks."""
    def grams(n):
        if n == 1:
            return F.col(col)
        starts = F.sequence(F.lit(1), F.greatest(F.size(col) - (n - 1), F.lit(1)))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(col, i, n), " "))
        return F.when(F.size(col) >= n, joined).otherwise(F.array().cast("array<string>"))
    return tokens.withColumn(col, F.concat(*[grams(n) for n in range(low, high + 1)]))


#: Words repeat over the texts of a file: a dictionary larger than the default of 1 MB holds them.
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20)}


class Counted(NamedTuple):
    """Written counts of texts: (id, terms, times, texts), one row of lists per id, and (term, df, cf)."""

    lists: DataFrame
    totals: DataFrame


def term_counts(tokens, id_col, col="tokens"):
    """The distinct tokens of each id, and of all (``Counted``): texts are split once.

    A text is counted where it is read, so no row per word is shuffled.  Only ids that occur again are counted
    together: their own rows stay without terms, so that ``texts`` adds up to the rows of ``tokens``.
    """
    lists = F.coalesce(F.col(col), F.array().cast("array<string>")).alias("tokens")
    kind = tokens.schema[id_col].dataType.simpleString()
    counted = tokens.select(id_col, lists).mapInArrow(
        _term_lists(id_col), f"`{id_col}` {kind}, terms array<string>, times array<int>, texts int")
    counted = materialize(counted, "term-counts", **DICTIONARY)
    again = counted.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(id_col).alias("_again"))
    again = materialize(again, "repeated-ids")
    if again.isEmpty():
        return Counted(counted, materialize(_term_totals(counted), "terms"))
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    rows = counted.join(again, same, "left_semi")
    each = (rows.select(id_col, F.explode(F.arrays_zip("terms", "times")).alias("_t")).groupBy(id_col, F.col("_t.terms").alias("term"))
            .agg(F.sum("_t.times").cast("int").alias("n")))
    merged = each.groupBy(id_col).agg(F.collect_list(F.struct("term", "n")).alias("_l")).select(
        id_col, F.col("_l.term").alias("terms"), F.col("_l.n").alias("times"), F.lit(0).alias("texts"))
    emptied = rows.select(id_col, F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("times"), "texts")
    counted = materialize(counted.join(again, same, "left_anti").unionByName(emptied).unionByName(merged), "term-counts", **DICTIONARY)
    return Counted(counted, materialize(_term_totals(counted), "terms"))


def tfidf(tokens, id_col, max_df=0.4, min_df=2, max_terms=50_000, ngrams=1, col="tokens", counted=None):
    """(id, term, weight): raw counts x smooth idf, unit rows.

    ``counted``: ``term_counts`` of the tokens, if they are written already.  The vocabulary has at most ``max_terms``
    rows and is broadcast; weights and length of a text follow from its row of counts, without a shuffle.
    """
    if counted is None:
        counted = term_counts(ngram_tokens(tokens, 1, ngrams, col) if ngrams > 1 else tokens, id_col, col)
    counted, totals = counted
    n_docs = counted.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    terms = totals.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    vocab = (_most_frequent(terms, max_terms, "term").filter(F.col("term").isNotNull())
             .select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf")).toPandas())
    shared = counted.sparkSession.sparkContext.broadcast((vocab["term"].tolist(), vocab["idf"].to_numpy(float)))
    kind = counted.schema[id_col].dataType.simpleString()
    return counted.select(id_col, "terms", "times").mapInArrow(
        _term_weights(shared, id_col), f"`{id_col}` {kind}, term string, weight double")


def _most_frequent(terms, n, tie):
    """The ``n`` rows of ``terms`` of the largest cf (ties by ``tie``)."""
    # The least count is known first (one row per distinct count): else each task sends its n best.
    least = taken = 0
    for r in terms.groupBy("cf").agg(F.count("*").alias("n")).orderBy(F.desc("cf")).collect():
        least, taken = r.cf, taken + r.n
        if taken >= n:
            break
    return terms.filter(F.col("cf") >= least).orderBy(F.desc("cf"), tie).limit(n)


def _term_totals(counted):
    """(term, df, cf): lists that hold a term, and its occurrences."""
    parts = counted.select("terms", "times").mapInArrow(_term_sums, "term string, df long, cf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _term_sums(batches):
    for batch in batches:
        lists, times = batch.column("terms"), batch.column("times")
        for start, stop, _ in _list_blocks(lists):
            coded = lists.slice(start, stop - start).flatten().dictionary_encode(null_encoding="encode")
            code, n = coded.indices.to_numpy(), times.slice(start, stop - start).flatten().to_numpy()
            df = np.bincount(code, minlength=len(coded.dictionary))
            cf = np.bincount(code, n, len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df, pa.int64()), pa.array(cf)], ["term", "df", "cf"])


def _term_lists(id_col):
    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            for start, stop, row in _list_blocks(lists):
                coded = lists.slice(start, stop - start).flatten().dictionary_encode(null_encoding="encode")
                width = max(1, len(coded.dictionary))
                key, times = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(stop - start + 1) * width), pa.int32())
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % width)))
                times = pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(start, stop - start), terms, times, pa.array(np.ones(stop - start), pa.int32())],
                                                 [id_col, "terms", "times", "texts"])
    return run


#: Rows of a batch that a task hands back to the JVM.
BATCH_ROWS = 1 << 16


def _term_weights(shared, id_col):
    def run(batches):
        names, idf = shared.value
        names = pa.array(names, pa.string())
        for batch in batches:
            lists, times = batch.column("terms"), batch.column("times")
            for start, stop, row in _list_blocks(lists):
                place = pc.index_in(lists.slice(start, stop - start).flatten(), value_set=names, skip_nulls=True)
                known = place.is_valid().to_numpy(zero_copy_only=False)
                place, row = place.drop_null().to_numpy(), row[known]
                weight = times.slice(start, stop - start).flatten().to_numpy()[known] * idf[place]
                weight /= np.sqrt(np.bincount(row, weight * weight, stop - start))[row]
                for at in range(0, len(row), BATCH_ROWS):
                    to = slice(at, at + BATCH_ROWS)
                    ids, terms = batch.column(id_col).take(pa.array(start + row[to])), names.take(pa.array(place[to]))
                    yield pa.RecordBatch.from_arrays([ids, terms, pa.array(weight[to])], [id_col, "term", "weight"])
    return run


def weighted_doc_vectors(docs, weights, vectors, unknown_vector, id_col):
    """Weighted mean word vector per document; documents without a known word get the unknown vector.

    ``weights`` have the terms of a vocabulary (at most ``tfidf``'s ``max_terms``): their vectors alone are
    broadcast, and a row carries its term's number, never a vector.  A document's rows lie together in ``weights``
    (two passes read them), so a shuffle row is one sum per document and run of its rows.
    """
    spark = weights.sparkSession
    terms = F.broadcast(weights.select("term").distinct())
    used = vectors.select(F.col("word").alias("term"), F.col("vector").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    used = materialize(used.join(terms, "term", "left_semi"), "term-vectors").toArrow()
    filler = F.array(*[F.lit(float(x)) for x in unknown_vector])
    if not len(used):
        return docs.select(id_col, filler.alias("embedding"))
    # A word may have several vectors: all of them count.
    coded = used["term"].combine_chunks().dictionary_encode()
    code, each = coded.indices.to_numpy(), used["v"].combine_chunks().flatten().to_numpy().reshape(len(used), -1)
    sums = np.zeros((len(coded.dictionary), each.shape[1]))
    np.add.at(sums, code, each)
    shared = spark.sparkContext.broadcast((sums, np.bincount(code)))
    places = spark.createDataFrame(pa.table({"term": coded.dictionary, "place": pa.array(np.arange(len(sums)), pa.int32())}))
    known = lookup_join(weights.select(id_col, "term", "weight"), F.broadcast(places), "term", "inner")
    kind = weights.schema[id_col].dataType.simpleString()
    parts = known.select(id_col, "place", "weight").mapInArrow(_vector_sums(shared, id_col), f"`{id_col}` {kind}, mass double, sums array<double>")
    total = parts.groupBy(id_col).agg(F.sum("mass").alias("mass"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(sums.shape[1])])
    means = total.filter("mass > 0").select(id_col, F.array(*[F.col(f"s{i}") / F.col("mass") for i in range(sums.shape[1])]).alias("embedding"))
    return (docs.select(id_col).join(means, id_col, "left")
            .withColumn("embedding", F.coalesce("embedding", filler)))


def _vector_sums(shared, id_col):
    """Per run of rows of one id: its weight and the weighted sum of its terms' vectors."""
    def run(batches):
        sums, times = shared.value
        for batch in batches:
            if len(batch):
                runs = pc.run_end_encode(batch.column(id_col))
                starts = np.concatenate([[0], runs.run_ends.to_numpy()[:-1]])
                place, weight = batch.column("place").to_numpy(), batch.column("weight").to_numpy()
                total = np.add.reduceat(sums[place] * weight[:, None], starts, axis=0)
                flat = pa.array(total.ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, sums.shape[1]), pa.int32()), flat)
                mass = pa.array(np.add.reduceat(weight * times[place], starts))
                yield pa.RecordBatch.from_arrays([runs.values, mass, vectors], [id_col, "mass", "sums"])
    return run


def pca_embeddings(vecs, k=250, tile=1, id_col="article_id", col="embedding"):
    """Centred principal components of the (optionally repeated) vectors."""
    parts = F.concat(*[F.col(col)] * tile) if tile > 1 else F.col(col)
    raw = vecs.select(id_col, array_to_vector(parts.cast("array<double>")).alias("_v"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(raw).transform(raw)
    fitted = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return fitted.transform(centred).select(id_col, vector_to_array("_p").alias(col))


def lsa_embeddings(tokens, id_col, k=250, max_df=0.4, min_df=2, max_terms=50_000, ngrams=3, col="tokens"):
    """TF-IDF of 1..n-grams -> truncated SVD -> unit rows.

    Texts are split once and written as hashes of their tokens; an n-gram is the 64-bit hash of its tokens' hashes, so
    the counts and the rows are made of whole blocks of texts and the shuffle has numbers.  The terms are the
    ``max_terms`` most frequent ones (ties by hash).  The SVD runs on distributed sparse rows; the driver holds
    the terms' hashes and idf (at most ``max_terms`` numbers each) and the singular values.
    """
    spark = tokens.sparkSession
    hashed = F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda t: F.xxhash64(t))
    texts = materialize(tokens.select(F.col(id_col).cast("long").alias("index"), hashed.alias("hashes")), "lsa-tokens", **DICTIONARY)
    n_docs = texts.count()
    counted = texts.select("hashes").mapInArrow(_gram_counts(ngrams), "gram long, df long, cf long")
    terms = materialize(counted.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
                        .filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)), "lsa-terms")
    vocab = _most_frequent(terms, max_terms, "gram").select("gram", "df").toPandas().sort_values("gram")
    if not len(vocab):
        return texts.select(F.col("index").alias(id_col), F.array().cast("array<double>").alias("embedding"))
    idf = np.log((n_docs + 1) / (vocab["df"].to_numpy() + 1)) + 1
    shared = spark.sparkContext.broadcast((vocab["gram"].to_numpy(), idf))
    written = materialize(texts.mapInArrow(_weighted_rows(shared, ngrams), f"index long, vector {VectorUDT().sqlType().simpleString()}"), "lsa-rows")
    # The same files, read as the vectors that their columns are.
    rows = spark.read.schema(T.StructType([T.StructField("index", T.LongType()), T.StructField("vector", VectorUDT())])).parquet(*written.inputFiles())
    # The SVD reads its rows once per iteration: they are kept in memory.
    rows = MLUtils.convertVectorColumnsFromML(rows, "vector")
    matrix = IndexedRowMatrix(rows.persist(StorageLevel.MEMORY_AND_DISK))
    svd = matrix.computeSVD(min(k, int(matrix.numCols()) - 1), computeU=True)
    left = MLUtils.convertVectorColumnsToML(svd.U.rows.toDF(["index", "vector"]), "vector")
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(svd.s.toArray()), inputCol="vector",
                                outputCol="_s").transform(left)
    unit = Normalizer(p=2.0, inputCol="_s", outputCol="_n").transform(scaled)
    return unit.select(F.col("index").alias(id_col), vector_to_array("_n").alias("embedding"))


#: Tokens whose counts or n-grams are taken at once.
GRAM_BLOCK = 1 << 18


def _list_blocks(lists):
    """Blocks of whole lists (without nulls): first list, end, and per value its list's place in the block."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GRAM_BLOCK, "right")))
        yield start, stop, np.repeat(np.arange(stop - start), np.diff(ends[start:stop], prepend=before))
        start = stop


def _gram_blocks(batch, ngrams):
    """Blocks of a batch's texts: first text, end, and per n-gram its text's place in the block and its hash."""
    lists = batch.column("hashes")
    for start, stop, row in _list_blocks(lists):
        part = lists.slice(start, stop - start)
        h = part.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
        rows, grams, gram = [], [], np.zeros(len(h), np.uint64)
        for n in range(1, ngrams + 1):
            if len(h) < n:
                break
            # The multiplier and the shifts of SplitMix64 between the tokens: their order counts.
            gram = gram[:len(h) - n + 1] + h[n - 1:] + np.uint64(n)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                gram = (gram ^ (gram >> np.uint64(shift))) * np.uint64(factor)
            gram ^= gram >> np.uint64(31)
            whole = row[:len(gram)] == row[n - 1:]
            rows.append(row[:len(gram)][whole])
            grams.append(gram[whole].view(np.int64))
        yield (start, stop, np.concatenate(rows) if rows else row, np.concatenate(grams) if grams else h.view(np.int64))


def _row_counts(row, value):
    """Distinct (row, value) in order, and how often each occurs."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    del order
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], value[new], np.diff(new, append=len(row))


def _gram_counts(ngrams):
    """Per block: texts that hold an n-gram, and its occurrences."""
    def run(batches):
        for batch in batches:
            for _, _, row, gram in _gram_blocks(batch, ngrams):
                _, gram, times = _row_counts(row, gram)
                known, place, df = np.unique(gram, return_inverse=True, return_counts=True)
                cf = np.bincount(place, weights=times, minlength=len(known)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (known, df, cf)], ["gram", "df", "cf"])
    return run


def _weighted_rows(shared, ngrams):
    """Per text: the unit vector of its terms' counts x idf, as the columns of a sparse ML vector."""
    def run(batches):
        terms, idf = shared.value
        for batch in batches:
            for start, stop, row, gram in _gram_blocks(batch, ngrams):
                place = np.searchsorted(terms, gram).clip(0, len(terms) - 1)
                known = terms[place] == gram
                row, place, times = _row_counts(row[known], place[known])
                weight = times * idf[place]
                weight /= np.sqrt(np.bincount(row, weight * weight, stop - start))[row]
                ends = pa.array(np.searchsorted(row, np.arange(stop - start + 1)), pa.int32())
                n = stop - start
                vector = pa.StructArray.from_arrays([
                    pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(terms)), pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(weight, pa.float64()))], ["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([batch.column("index").slice(start, n), vector], ["index", "vector"])
    return run


def mean_vector(emb, col="embedding"):
    """Component means of all vectors as one array."""
    vec = array_to_vector(F.col(col).cast("array<double>"))
    return emb.agg(Summarizer.mean(vec).alias("m")).select(vector_to_array("m").alias(col))


def add_pad_embedding(emb, id_col="article_id", col="embedding", pad_id=0):
    """Prepend the pad row: the mean of all embeddings."""
    pad = mean_vector(emb, col).select(F.lit(pad_id).cast(emb.schema[id_col].dataType).alias(id_col), col)
    return pad.unionByName(emb.select(id_col, F.col(col).cast("array<double>").alias(col)))


def check_embeddings(catalog, emb, id_col="article_id", first=0):
    """Violations: ids with no vector, vectors with no article, gaps in the id range."""
    ids = catalog.select(F.col(id_col).alias("id")).distinct().withColumn("in_catalog", F.lit(True))
    vecs = emb.select(F.col(id_col).alias("id")).distinct().withColumn("in_embeddings", F.lit(True))
    both = ids.join(vecs, "id", "full")
    missing = both.select("id", F.when(F.col("in_embeddings").isNull(), "no_vector")
                          .when(F.col("in_catalog").isNull(), "no_article").alias("violation"))
    # An id starts a gap when its predecessor id is absent.
    previous = catalog.select((F.col(id_col) + 1).alias("id")).distinct()
    gaps = (ids.select("id").filter(F.col("id") > first).join(previous, "id", "left_anti")
            .select("id", F.lit("gap_before").alias("violation")))
    return missing.filter(F.col("violation").isNotNull()).unionByName(gaps)


#: Tokens that give a skip-gram fit another part, and the most that a part may have.
SKIPGRAM_TOKENS, SKIPGRAM_PART = 50_000, 1_000_000


def skipgram_partitions(sentences, col):
    """Parts of a skip-gram fit: they follow the tokens, up to the cores, beyond which a part only has a largest size.

    Each part is trained in one task, which writes every vector it met: more parts than
    needed would only write the same vectors again.
    """
    tokens = sentences.agg(F.sum(F.size(col))).first()[0] or 0
    cores = max(1, sentences.sparkSession.sparkContext.defaultParallelism)
    return max(min(1 + tokens // SKIPGRAM_TOKENS, cores), -(-tokens // SKIPGRAM_PART))


def word_vectors(spark, path=None, tokens=None, size=100, min_count=1, seed=10, partitions=None):
    """(word, vector): from a text file of vectors, or trained on token lists.

    Text format: word and numbers by blanks, with an optional 'count size' head line.
    """
    if path is not None:
        parts = F.split(F.trim("value"), " ")
        lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > 2)
        return lines.select(F.col("p")[0].alias("word"), F.expr(
            "transform(slice(p, 2, size(p) - 1), x -> cast(x as double))").alias("vector"))
    tokens = numbered(tokens, "tokens")
    parts = partitions or skipgram_partitions(tokens, "tokens")
    return train_skipgram(tokens, size, parts, min_count=min_count, seed=seed)


def class_weights(df, label):
    """Balanced weights n / (k * count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    totals = counts.agg(F.struct(F.sum("count").alias("n"), F.count("*").alias("k"))).scalar()
    return (counts.withColumn("_t", totals)
            .withColumn("weight", F.col("_t.n") / (F.col("_t.k") * F.col("count"))).drop("_t"))


def inverse_freq_weight(df, label, num=10.0):
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    return counts.withColumn("weight", F.lit(float(num)) / F.col("count"))


def assemble_features(df, cols):
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)
