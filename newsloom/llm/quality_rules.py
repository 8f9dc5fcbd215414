"""Quality rules (6): decision lists grown and pruned from labelled statistics, as ordered conditional expressions.

Every document gets eight statistics. Labelled documents are cut into bins at quantiles of each statistic, and the counts of good and bad
documents by bin are all that learning reads. Sequential covering grows one rule at a time: thresholds are added to a conjunction as
long as the information gain grows; the rule is pruned from its end on labelled documents kept apart for that; documents that it
covers leave, and the next rule starts. A rule holds for bad documents and must be precise on the documents kept apart. The list
ends when no such rule is left. It is applied as one CASE expression in Spark: first rule that holds, else keep.

Learning may use a sample of at most ``sample`` labelled documents, the smallest by a hash of the id; everything else covers all rows.

Null text has no words. Documents failing the base rules are rejected before the list is asked. Labels whose value is null or whose document is
missing are left out; a label that is there twice counts twice. Without labels of both kinds the list is empty and only the base rules
judge. Repeated rows get equal results. An empty table gives no row. Other columns are ignored.
"""

import math

from pyspark.sql import functions as F

from newsloom.llm.common import BLANK, BLANKS, staged, table, word_list

SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test, as shares so that a document's length does not matter where it should not.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}
SAMPLE = 200_000
BINS = 16


def statistics(docs, extra=False):
    """doc_id and the base statistics of every text; with ``extra`` also those that only rules read."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select("doc_id", text.alias("text")).withColumn("w", word_list(F.col("text")))
    first = first.withColumn("n_words", F.size("w").cast("long"))
    windows = F.when(F.col("n_words") > 5, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")),
        lambda i: F.xxhash64(*[F.col("w")[i + k] for k in range(5)])))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^" + BLANK[1:]))
    out = first.withColumn("h", windows).withColumn("lines", lines)
    # sort (hash, place) pairs: equal hashes stand side by side; most texts repeat no window and skip this
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.arrays_zip(
        F.col("h").alias("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("i"))))
    out = out.withColumn("p", pairs)
    place = F.filter(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.when(
        ((k > 0) & (F.col("p")[F.greatest(k - 1, F.lit(0))]["h"] == F.col("p")[k]["h"]))
        | ((k < F.size("p") - 1) & (F.col("p")[F.least(k + 1, F.size("p") - 1)]["h"] == F.col("p")[k]["h"])), F.col("p")[k]["i"])),
        lambda x: x.isNotNull())
    out = out.withColumn("at", F.when(F.col("p").isNotNull(), F.sort_array(place)))
    # five words a window, less the overlap with the next one
    covered = F.aggregate(F.sequence(F.lit(1), F.size("at") - 1), F.lit(5).cast("long"),
                          lambda n, k: n + F.least(F.lit(5), F.col("at")[k] - F.col("at")[k - 1]))
    repeats = F.when(F.col("at").isNull(), F.lit(0)).when(F.size("at") < 2, F.lit(0)).otherwise(covered)
    count = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    cols = [F.col("n_words"), F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
            count(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeats.cast("long").alias("n_repeat_words")]
    if extra:
        cols += [F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
                 count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"), count("0123456789").cast("long").alias("n_digits")]
    return out.select("doc_id", *cols)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _gain(good, bad, all_good, all_bad):
    """Information gain of going from a rule's cover to a part of it, weighed by the bad documents kept."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (good + bad)) - math.log2(all_bad / (all_good + all_bad)))


def _value(good, bad):
    """Smoothed precision of a rule for bad documents."""
    return (bad + 1) / (good + bad + 2)


def learn(labelled, bins=BINS, most_rules=8, most_terms=3, precision=0.9, least=20):
    """Ordered rules, each a list of (feature, '<=' or '>', threshold), for documents with ``bad`` = true.

    ``labelled``: a written table with ``bad``, ``prune`` (kept apart) and the features.
    """
    names = list(FEATURES)
    probs = [k / bins for k in range(1, bins)]
    # exact enough: the error bound lets a cut lie at most a tenth of a bin off
    cuts = labelled.approxQuantile(names, probs, 0.1 / bins) if labelled.head(1) else []
    if not cuts or not all(cuts):
        return []
    cuts = {n: sorted(set(c)) for n, c in zip(names, cuts)}
    binned = labelled.select("bad", "prune", *[
        sum([F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]], F.lit(0)).alias(n) for n in names])
    binned = staged(binned, "rules-binned")
    rules, left = [], F.lit(True)

    def holds(rule):
        out = F.lit(True)
        for name, sign, k in rule:
            out = out & ((F.col(name) <= k) if sign == "<=" else (F.col(name) > k))
        return out

    while len(rules) < most_rules:
        rule, tried = [], None
        while len(rule) < most_terms:
            counts = _counts(binned.filter(left & holds(rule) & ~F.col("prune")), names)
            whole = [sum(x) for x in zip(*counts[names[0]].values())] if counts[names[0]] else [0, 0]
            if whole[1] < least or not whole[0]:
                break
            found = []
            for name in names:
                for k in range(len(cuts[name])):
                    low = [sum(v[i] for b, v in counts[name].items() if b <= k) for i in (0, 1)]
                    high = [whole[0] - low[0], whole[1] - low[1]]
                    found += [(_gain(*low, *whole), name, "<=", k), (_gain(*high, *whole), name, ">", k)]
            best = max(found, key=lambda x: (x[0], x[1], x[2], -x[3]))
            if best[0] <= 0:
                break
            rule = [*rule, best[1:]]
        if not rule:
            break
        # prune: the prefix that is most precise on the documents kept apart, the shorter one of equals
        tests = [F.sum(F.when(holds(rule[:k]) & (F.col("bad") == b), 1).otherwise(0)) for k in range(1, len(rule) + 1) for b in (False, True)]
        seen = binned.filter(left & F.col("prune")).agg(*tests).first()
        scores = [(_value(seen[2 * k] or 0, seen[2 * k + 1] or 0), -k) for k in range(len(rule))]
        tried = max(scores)
        rule = rule[:1 - tried[1]]
        if tried[0] < precision:
            break
        rules.append(rule)
        left = left & ~holds(rule)
    return [[(name, sign, cuts[name][k]) for name, sign, k in rule] for rule in rules]


def _counts(rows, names):
    """Good and bad documents by feature and bin."""
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names]))
    got = rows.select("bad", per.alias("f")).groupBy("f.name", "f.bin").agg(
        F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("good"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad")).collect()
    out = {n: {} for n in names}  # bins times features rows, whatever the input
    for r in got:
        out[r["name"]][r["bin"]] = (r["good"], r["bad"])
    return out


def verdict(rules):
    """The ordered list as one expression: the number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        test = F.lit(True)
        for name, sign, threshold in rules[k]:
            test = test & ((F.expr(FEATURES[name]) <= threshold) if sign == "<=" else (F.expr(FEATURES[name]) > threshold))
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def learned_rules(stats, labels, sample=SAMPLE):
    """The decision list for a written table of statistics and labels (doc_id, quality)."""
    labels = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stats.filter(~base_failed()).join(labels, "doc_id")
    rows = rows.select("bad", (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0).alias("prune"),
                       *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    return learn(staged(rows, "rules-labelled"))


def judge(stats, labels, sample=SAMPLE):
    """Add base_failed, rule and kept to a written table of statistics, learning from labels (doc_id, quality)."""
    rules = learned_rules(stats, labels, sample)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_good(docs, labels, sample=SAMPLE):
    """The documents that neither the base rules nor the learned list reject, with all their columns.

    The list is learned from the labelled documents and then applied where each document is read: no text is shuffled.
    """
    known = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("_known")).distinct()
    known = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_known"), "left_semi")
    rules = learned_rules(staged(statistics(known, extra=True), "rules-known"), labels, sample)
    # the whole row goes along in place of its id
    rows = statistics(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), extra=True)
    # behind a generator the filter is not pushed into the statistics, which would compute them once per mention
    rows = rows.select("doc_id", F.inline(F.array(F.struct(*rows.columns[1:]))))
    return rows.filter(~base_failed() & verdict(rules).isNull()).select("doc_id.*")


def op6_quality_rules(spark, folder):
    stats = staged(statistics(table(spark, folder, "documents"), extra=True), "rules-stats")
    judged, _ = judge(stats, table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
