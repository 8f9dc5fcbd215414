"""Line dedup (5): a log-template tree of fixed depth; repeats and lines of templates that recur across documents are dropped.

Word for word repeats (blanks aside) go from the second document on. For templates with wildcards a line's words are generalised
where they vary by nature: words with a digit and addresses become one wildcard. The tree has three levels: the number of words, the
``lead`` first generalised words, and in each leaf its templates. Leaves with fewer than ``min_docs`` lines are left at once. In
the others the words are counted by place: a line's template keeps those met ``min_docs`` times at their place and has wildcards
elsewhere, so a leaf gets as many templates as it has combinations of words. Since the words of a variable field may be frequent too,
every line also has the templates that leave out one more word beyond the lead. A template with wildcards counts only if at least
``similar`` of its words are constant, and ``beyond`` of those after the lead; so short lines and rows of numbers recur only as they
are. Templates met in ``min_docs`` or more documents are boilerplate.

Of each repeat or template the first line stays (smallest doc_id, then place), so no content is lost altogether. Lines of fewer than
``least`` words recur by chance and stay.

Null texts stay null, blank lines stay. Rows equal in id and text are one document and get the same result. A null doc_id comes
first. An empty table gives no row. Other columns pass through unchanged; n_chars, if there, follows a new text.
"""

from functools import reduce

from pyspark.sql import functions as F

from newsloom.llm.common import BLANK, bounded, staged, table, unused

WILD = "<*>"
#: Tried at the start of a word only: without the look-behind a word of n letters costs n tries of up to n letters.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?(?:[0-9@]|://)[^\x20\x09-\x0D]*"
MIN_DOCS = 6
LEAST = 4
LEAD = 3
SIMILAR = 0.7
BEYOND = 0.6
#: A leaf's key in a broadcast table takes some 50 bytes; more rows than these are joined by a shuffle.
LEAVES = 500_000


ODD = r"[\x09\x0B-\x0D]|\x20\x20"
FIELD = "[0-9@]|://"


def plain(line, odd):
    """The line with single blanks between words and none at the ends. ``odd``: whether its text has blanks other than single spaces."""
    return F.trim(F.when(odd & line.rlike(ODD), F.regexp_replace(line, BLANK + "+", " ")).otherwise(line))


def generalised(words, fields):
    """Plain words with wildcards for those that vary. ``fields``: whether their text has any."""
    return F.when(fields & words.rlike(FIELD), F.regexp_replace(words, VARIABLE, WILD)).otherwise(words)


def once(df, name, value):
    """``df`` with a column that later filters and expressions read and do not compute anew."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_lines(docs, least=LEAST, lead=LEAD):
    """One row per line of at least ``least`` words: doc, key, nth, number of words n, leaf, the raw line's hash, the line, and its text's flag ``fields``."""
    text = F.col("text")
    lines = docs.select(F.col("doc_id").alias("doc"), "text")
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    # once a text, not a line; every field has one of these letters
    for name, value in (("key", F.xxhash64("text")), ("odd", odd), ("fields", text.rlike("[0-9@/]"))):
        lines = once(lines, name, value)
    lines = lines.select("doc", "key", "odd", "fields", F.posexplode(F.split("text", "\n")).alias("nth", "as_is"))
    lines = once(lines, "line", plain(F.col("as_is"), F.col("odd"))).drop("as_is", "odd")
    lines = once(lines, "n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1).filter(F.col("n") >= least)
    start = once(lines, "start", F.substring_index("line", " ", lead))
    return start.select("doc", "key", "nth", "n", F.xxhash64("n", generalised(F.col("start"), F.col("fields"))).alias("leaf"),
                        F.xxhash64("line").alias("raw"), "line", "fields")


def line_templates(lines, min_docs=MIN_DOCS, lead=LEAD, similar=SIMILAR, beyond=BEYOND):
    """template, doc, key and nth: the line's template of frequent words, and those that leave out one of them. ``lines`` have an id."""
    words = lines.select("id", "n", "leaf", F.posexplode(F.split("flat", " ")).alias("place", "word")).filter(F.col("word") != WILD)
    words = words.select("id", "n", "place", F.xxhash64("leaf", "place", "word").alias("hash"))
    frequent = words.groupBy("hash").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") >= min_docs).select("hash")
    late = F.col("place") >= lead
    made = words.join(frequent, "hash").groupBy("id", "n").agg(
        F.bit_xor("hash").alias("bits"), F.count(F.lit(1)).alias("fixed"), F.count(F.when(late, F.col("hash"))).alias("ends"),
        F.collect_list(F.when(late, F.struct("place", "hash"))).alias("one"))  # as long as one line
    none = F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("hash"))
    made = made.withColumn("less", F.explode(F.concat(F.array(none), "one")))
    out = F.when(F.col("less.place") < 0, 0).otherwise(1)
    made = made.filter((F.col("fixed") - out >= similar * F.col("n")) & (F.col("ends") - out >= beyond * (F.col("n") - lead)))
    made = made.select("id", F.xxhash64("less.place", F.col("bits").bitwiseXOR(F.col("less.hash"))).alias("template"))
    return made.join(lines.select("id", "doc", "key", "nth"), "id").select("template", "doc", "key", "nth")


def repeated(lines, min_docs):
    """doc, key and nth of the lines whose template is met in ``min_docs`` documents, without the template's first line."""
    doc = F.coalesce("doc", F.lit(-1))
    first = F.min(F.struct("doc", "key", "nth")).alias("first")
    if min_docs == 2:  # the smallest and the largest tell, without a set of documents
        met = lines.groupBy("template").agg((F.min(doc) < F.max(doc)).alias("met"), first).filter("met")
    else:
        met = lines.groupBy("template").agg(F.count_distinct(doc).alias("docs"), first).filter(F.col("docs") >= min_docs)
    return lines.join(met, "template").filter(~F.struct("doc", "key", "nth").eqNullSafe(F.col("first"))).select("doc", "key", "nth")


def recurring(docs, min_docs=MIN_DOCS, least=LEAST, lead=LEAD, similar=SIMILAR, beyond=BEYOND):
    """doc, key and nth of the lines to drop; a line may be named twice."""
    lines = template_lines(docs, least, lead)
    hashes = staged(lines.select("doc", "key", "nth", "leaf", "raw"), "lines-hashes")
    exact = repeated(hashes.withColumnRenamed("raw", "template"), 2)
    hot = staged(hashes.groupBy("leaf").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= min_docs).select("leaf"), "lines-leaves")
    lines = lines.join(bounded(hot, LEAVES), "leaf").select(
        "doc", "key", "nth", "n", "leaf", generalised(F.col("line"), F.col("fields")).alias("flat"), F.monotonically_increasing_id().alias("id"))
    made = staged(line_templates(staged(lines, "lines-met"), min_docs, lead, similar, beyond), "lines-templates")
    return exact.union(repeated(made, min_docs))


def drop_lines(docs, **options):
    """``docs`` without the lines whose template recurs."""
    gone, doc, key, new = unused(docs, "gone", "doc", "key", "text")
    lines = recurring(docs, **options).groupBy("doc", "key").agg(F.sort_array(F.collect_set("nth")).alias(gone))
    lines = lines.withColumnsRenamed({"doc": doc, "key": key})
    rows = docs.join(lines, docs["doc_id"].eqNullSafe(lines[doc]) & (F.xxhash64(docs["text"]) == lines[key]), "left")
    kept = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(gone, i))
    rows = rows.withColumn(new, F.when(F.col(gone).isNull(), docs["text"]).otherwise(F.array_join(kept, "\n")))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(gone).isNull(), docs["n_chars"]).otherwise(F.length(new)).cast(kind)
    return rows.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


def op5_line_dedup(spark, folder):
    return drop_lines(table(spark, folder, "documents"))
