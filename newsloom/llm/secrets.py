"""Secret scans (7): fixed patterns, and long strings that pass for random in a battery of tests.

Base patterns: credentials assigned to a name, access key ids, hexadecimal strings. Beside them every run of 20 or more letters of the
base64 alphabet is a candidate. Its encoding is inferred from its letters: the smallest of eight alphabets that holds them. Two tests give
the p value that is controlled, each by a bound that holds for prose whatever the length. The first weighs how likely the string is if
drawn at random from its encoding's alphabet against its neighbours' likelihood in the corpus (letters without case, counted in
all documents, candidates left out): prose reaches a ratio of r with a chance of 1/r at most, times eight for the
choice of the alphabet. The second is how unlikely the run's mix of digits, upper and lower case letters would be if one kind
filled it. The smaller of the two counts, times two.

Strings that are more orderly than random go first: chi-squared uniformity over the alphabet's quarters, runs above and below the
alphabet's middle, and serial correlation of neighbours join to ``p_random``.

Length-aware control: candidates are put in classes by length, and in each class the step-up procedure of Benjamini and Hochberg bounds the
share of false finds by ``rate``, over a histogram of p values (classes times cells rows, whatever the input). Long strings are judged
among long strings, so many short doubtful ones do not spend their budget.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap within a kind; a random string that overlaps a base span
is not listed again. Null and empty texts have no span. Repeated rows get equal results. An empty table gives no row. Other columns are ignored.
"""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import BLANK, staged, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: Alphabets in rank order, by inferred encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Cells of the histogram of p values: -log10 p in steps of 1/10, up to 30.
STEP, CELLS = 10, 300
#: Letters of the prose model, after folding case; weight of the single letter in a pair.
PROSE = "abcdefghijklmnopqrstuvwxyz0123456789+/"
WEIGHT = len(PROSE)


SPANS = "array<struct<start:int,end:int,text:string>>"


def _found(df, name, pattern, screen):
    """Add ``name``: the spans of ``pattern``; only texts that pass the cheaper ``screen`` are cut up.

    The pieces between matches and the matches alternate, so their lengths give the places.
    """
    df = df.withColumn("m", F.when(F.col("text").rlike(screen), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("g", F.when(F.size("m") > 0, F.split("text", pattern, -1)))
    none = F.array().cast(SPANS)

    def step(s, k):
        start = s["at"] + F.length(F.col("g")[k])
        end = start + F.length(F.col("m")[k])
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(F.struct(
            start.alias("start"), end.alias("end"), F.col("m")[k].alias("text")))).alias("found"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size("m") - 1), F.struct(F.lit(0).alias("at"), none.alias("found")), step,
                         lambda s: s["found"])
    return df.withColumn(name, F.when(F.size("m") > 0, walked).otherwise(none)).drop("m", "g")


def base_spans(docs):
    """doc_id and arrays assign, access, hex and candidate of (start, end, text)."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = _found(out, "assign", ASSIGN, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")
    # runs of an alphabet are maximal, so a bound on their length drops the failing ones as a later test would
    out = _found(out, "access", ACCESS.replace("+", "{16,}"), ACCESS.replace("+", "{16}"))
    out = _found(out, "hex", HEX.replace("+", "{24,}"), HEX.replace("+", "{24}"))
    out = _found(out, "candidate", CANDIDATE, CANDIDATE.replace(",", ""))
    long = F.filter("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6)
    return out.withColumn("assign", long).select("doc_id", *KINDS[:3], "candidate")


def prose_model(docs):
    """Logarithms of the chance of a letter after another in the corpus, at len(PROSE) * first + second.

    All texts count. Pairs lie within words, so words are counted first and each different one is cut up once.
    """
    text = F.translate(F.lower(F.regexp_replace("text", CANDIDATE, " ")), "-_", "+/")
    words = docs.select(F.explode(F.split(text, BLANK + "+")).alias("word")).groupBy("word").count()
    letters = words.select("count", F.split("word", "").alias("x"))
    pairs = letters.select("count", F.explode(F.arrays_zip(F.col("x").alias("a"), F.slice("x", 2, 1 << 30).alias("b"))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.sum("count").alias("count")).filter(
        F.col("a").isin(*PROSE) & F.col("b").isin(*PROSE)).collect()  # a row per pair of letters
    pairs = {(r["a"], r["b"]): r["count"] for r in counts}
    first = {a: sum(pairs.get((a, b), 0) for b in PROSE) for a in PROSE}
    second = {b: sum(pairs.get((a, b), 0) for a in PROSE) for b in PROSE}
    share = {b: (second[b] + 1) / (sum(second.values()) + len(PROSE)) for b in PROSE}
    return [math.log((pairs.get((a, b), 0) + WEIGHT * share[b]) / (first[a] + WEIGHT)) for a in PROSE for b in PROSE]


def _normal_tail(z):
    """Upper tail of the normal distribution, by the usual rational approximation (error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(spans, model):
    """Candidates outside base spans, with their inferred encoding and what the tests say. ``spans`` has a row key; ``model`` is the prose model."""
    def meets(c, name):
        return F.exists(name, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    free = F.filter("candidate", lambda c: ~(meets(c, "assign") | meets(c, "access") | meets(c, "hex")))
    rows = spans.select("key", F.explode(free).alias("c")).select("key", "c.start", "c.end", F.col("c.text").alias("text"))
    body = F.translate(F.regexp_replace("text", "=+$", ""), "-_", "+/")
    rows = rows.withColumn("body", body).filter(F.length("body") >= 16)
    one_case = ~(F.col("body").rlike("[a-f]") & F.col("body").rlike("[A-F]"))
    encoding = F.when(F.col("body").rlike("^[0-9a-fA-F]+$") & one_case, "hex").when(
        F.col("body").rlike("^[a-z]+$"), "lower").when(F.col("body").rlike("^[A-Z]+$"), "upper").when(
        F.col("body").rlike("^[A-Z2-7]+$"), "base32").when(F.col("body").rlike("^[a-z0-9]+$"), "lower36").when(
        F.col("body").rlike("^[A-Z0-9]+$"), "upper36").when(F.col("body").rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    rows = rows.withColumn("encoding", encoding)
    alphabet = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    rows = rows.withColumn("alphabet", alphabet[F.col("encoding")])
    rows = rows.withColumn("plain", F.when(F.col("encoding") == "hex", F.lower("body")).otherwise(F.col("body")))
    letters = F.regexp_extract_all("plain", F.lit("."), F.lit(0))
    rows = rows.withColumn("v", F.transform(letters, lambda x: (F.position(x, F.col("alphabet")) - 1).cast("double")))
    return _battery(rows, model)


def _battery(rows, model):
    size = F.length("alphabet").cast("double")
    n = F.size("v").cast("double")
    rows = rows.withColumn("k", size).withColumn("n", n)
    # chi-squared over the quarters of the alphabet, three degrees of freedom, as a normal value (Wilson and Hilferty)
    def quarter(q):
        return F.size(F.filter("v", lambda x: F.floor(x * 4 / F.col("k")) == q)).cast("double")
    share = [(F.ceil(F.col("k") * (q + 1) / 4) - F.ceil(F.col("k") * q / 4)) / F.col("k") for q in range(4)]
    chi = sum([(o - F.col("n") * s) * (o - F.col("n") * s) / (F.col("n") * s) for o, s in zip(map(quarter, range(4)), share)], F.lit(0.0))
    rows = rows.withColumn("chi", chi)
    rows = rows.withColumn("z_chi", (F.pow(F.col("chi") / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5)
    # runs above and below the middle of the alphabet
    high = F.transform("v", lambda x: F.when(x >= F.col("k") / 2, 1).otherwise(0))
    rows = rows.withColumn("high", high)
    steps = F.sequence(F.lit(1), F.size("v") - 1)
    up = F.aggregate("high", F.lit(0), lambda s, x: s + x).cast("double")
    runs = F.aggregate(steps, F.lit(1), lambda s, i: s + F.when(F.col("high")[i] != F.col("high")[i - 1], 1).otherwise(0)).cast("double")
    rows = rows.withColumn("up", up).withColumn("runs", runs)
    down = F.col("n") - F.col("up")
    mean = 2 * F.col("up") * down / F.col("n") + 1
    spread = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    rows = rows.withColumn("z_runs", F.when(spread > 0, F.abs(F.col("runs") - mean) / F.sqrt(spread)).otherwise(F.sqrt("n")))
    # serial correlation of neighbours
    avg = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    rows = rows.withColumn("avg", avg)
    var = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("avg")) * (x - F.col("avg")))
    cov = F.aggregate(steps, F.lit(0.0), lambda s, i: s + (F.col("v")[i] - F.col("avg")) * (F.col("v")[i - 1] - F.col("avg")))
    rows = rows.withColumn("z_serial", F.when(var > 0, F.abs(cov / var) * F.sqrt("n")).otherwise(F.sqrt("n")))
    # a random string shows none of the three; their worst value, thrice tested
    worst = F.greatest("z_chi", "z_runs", "z_serial")
    rows = rows.withColumn("p_random", F.least(F.lit(1.0), 3 * _normal_tail(worst)))
    # evidence against prose, whose letters are of one kind: changes of kind between neighbours, where a word changes about
    # once in eight; each change and each place is a Bernoulli trial, tail by Chernoff's bound
    letters = F.regexp_extract_all("body", F.lit("."), F.lit(0))
    sort = F.transform(letters, lambda x: F.when(x.rlike("[0-9]"), 0).when(x.rlike("[a-z]"), 1).when(x.rlike("[A-Z]"), 2).otherwise(3))
    rows = rows.withColumn("sort", sort)
    changes = F.aggregate(steps, F.lit(0), lambda s, i: s + F.when(F.col("sort")[i] != F.col("sort")[i - 1], 1).otherwise(0)).cast("double")
    rate, base = changes / (F.col("n") - 1), 1 / 8
    bound = (F.col("n") - 1) * (rate * F.log(rate / base) + (1 - rate) * F.log((1 - rate) / (1 - base)))
    bound = F.when(rate <= base, 0.0).when(rate >= 1, (F.col("n") - 1) * F.log(F.lit(1 / base))).otherwise(bound)
    rows = rows.withColumn("mixed", F.coalesce(bound, F.lit(0.0)))
    # the ratio of the chances under the alphabet and under prose: its mean is 1 in prose, so Markov's inequality bounds its tail
    folded = F.regexp_extract_all(F.lower("body"), F.lit("."), F.lit(0))
    rows = rows.withColumn("at", F.transform(folded, lambda x: F.position(x, F.lit(PROSE)) - 1))
    chance = F.array(*map(F.lit, model))
    prose = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.get(chance, F.col("at")[i - 1] * len(PROSE) + F.col("at")[i]))
    rows = rows.withColumn("ratio", -prose - (F.col("n") - 1) * F.log("k") - math.log(len(ALPHABETS)))
    strength = F.greatest(F.greatest("mixed", "ratio") - math.log(2), F.lit(0.0)) / math.log(10)
    return rows.withColumn("strength", strength).select(
        "key", "start", "end", "text", "encoding", "n", "z_chi", "z_runs", "z_serial", "p_random", "strength")


def controlled(candidates, rate=0.01, orderly=1e-4):
    """Candidates that stay under the false-discovery ``rate`` in their class of length and are not too orderly to be random."""
    cell = F.least(F.floor(F.col("strength") * STEP), F.lit(CELLS)).cast("int")
    rows = candidates.withColumn("cell", cell).withColumn("class", F.floor(F.log2("n")).cast("int"))
    counts = rows.groupBy("class", "cell").agg(F.count(F.lit(1)).alias("found"))  # classes times cells rows at most
    upper = W.partitionBy("class").orderBy(F.desc("cell"))
    total = W.partitionBy("class")
    steps = counts.withColumn("rank", F.sum("found").over(upper)).withColumn("all", F.sum("found").over(total))
    # step up: the lowest cell whose p is at most rate * rank / all
    good = steps.filter(F.pow(F.lit(10.0), -F.col("cell") / STEP) <= F.lit(rate) * F.col("rank") / F.col("all"))
    cut = good.groupBy("class").agg(F.min("cell").alias("cut"))
    return rows.join(cut, "class").filter((F.col("cell") >= F.col("cut")) & (F.col("p_random") >= orderly))


def scan(docs, rate=0.01):
    """doc_id and the arrays assign, access, hex, random of (start, end, text) of every document."""
    spans = staged(base_spans(docs).withColumn("key", F.monotonically_increasing_id()), "secret-spans")
    candidates = staged(tested(spans, prose_model(docs)), "secret-candidates")
    random = controlled(candidates, rate).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("random"))  # of one text
    none = F.array().cast(SPANS)
    return spans.drop("candidate").join(random, "key", "left").withColumn("random", F.coalesce("random", none)).drop("key")


def _listed(kinds):
    """kind:start:end of the given kinds, by start, then kind."""
    def tagged(k, kind):
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(F.concat(*[tagged(*x) for x in enumerate(kinds)])), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, folder):
    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))
