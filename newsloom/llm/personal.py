"""Personal data (11): fixed kinds, and identifiers found by bootstrapped contextual patterns.

Base kinds are e-mail and IP addresses, payment cards and phone numbers. Their spans are seeds: the words around them induce lexical
patterns ("my number is _", "id: _", "call _ or"). Other strings that look like identifiers are candidates and stand in
patterns too. The graph of patterns and instances (different strings, so copies of a passage count once) is scored in turn: a pattern's
confidence in a kind is the confident share of its instances, with one doubtful instance added; it needs ``support``
of them in as many patterns' worth of seeds. An instance's confidence is one less the chance that all its confident patterns err. After
``rounds`` rounds a candidate in a pattern that reaches ``confident`` is a find, listed as found_<kind>.

A candidate has at least six characters: six or more digits with single separators or brackets between, or a word of letters, digits
and ``_.%+@#/-`` with three digits or an @. One that overlaps a base span is none. Context is the two words before and the word
after, within 64 characters; digits in it are alike, case is ignored. Only words with a letter make a pattern.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap within a kind. Null and empty texts have no span.
Repeated rows get equal results, and count once as instances. An empty table gives no row. Other columns are ignored.
"""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import staged, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: Pattern and screen of each kind. A run of letters is tried at its start or where the last match ended, nowhere else: a later
#: start in it cannot match if the first does not. Possessive repeats give back nothing that could help.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
TOKEN = "A-Za-z0-9_.%+@#/-"
CANDIDATE = (rf"(?<![{TOKEN}])(?:[+(]{{0,2}}[0-9](?:[\x20()./-]{{0,2}}[0-9]){{5,}}+(?![A-Za-z0-9_@])"
             rf"|(?=[A-Za-z_.%+#/-]*+[0-9@])[{TOKEN}]{{6,}}+)")
SCREEN = r"[0-9@]"
#: Matches of one text whose places are summed in one array.
RUN = 1000
CONTEXT = 64
SUPPORT = 5
CONFIDENT = 0.8
ROUNDS = 3


def _mentions(df, name, pattern, screen):
    """Add ``name``: start, end, text, and what stands left and right of each match.

    The pieces between matches and the matches alternate, so their lengths give the places, and a piece is a context.
    """
    df = df.withColumn("m", F.when(F.col("text").rlike(screen), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("g", F.when(F.size("m") > 0, F.split("text", pattern, -1)))
    steps = F.sequence(F.lit(0), F.size("m") - 1)
    df = df.withColumn("n", F.when(F.size("m") > 0, F.transform(steps, lambda k: F.length(F.col("g")[k]) + F.length(F.col("m")[k]))))

    def summed(lengths):
        return F.aggregate(lengths, F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    # running sums by parts, since an array that grows is copied at every step: n matches cost n * RUN, not n * n
    parts = F.sequence(F.lit(0), F.floor((F.size("n") - 1) / RUN).cast("int"))
    df = df.withColumn("e", F.when(F.size("m") > 0, F.transform(parts, lambda p: summed(F.slice("n", p * RUN + 1, RUN)))))
    df = df.withColumn("o", F.when(F.size("m") > 0, summed(F.transform("e", lambda x: F.element_at(x, -1)))))

    def one(k):
        text = F.col("m")[k]
        before = F.concat(F.when(k > 0, F.get("m", k - 1)).otherwise(""), F.col("g")[k])
        part = F.floor(k / RUN).cast("int")
        end = F.col("o")[part] + F.col("e")[part][k - part * RUN + 1]
        return F.struct((end - F.length(text)).alias("start"), end.alias("end"), text.alias("text"),
                        F.right(before, F.lit(CONTEXT)).alias("left"), F.left(F.col("g")[k + 1], F.lit(CONTEXT)).alias("right"))

    none = F.array().cast("array<struct<start:int,end:int,text:string,left:string,right:string>>")
    return df.withColumn(name, F.when(F.size("m") > 0, F.transform(steps, one)).otherwise(none)).drop("m", "g", "n", "e", "o")


def _digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits):
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def add(total, k):
        twice = F.substr(digits, n - k, F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_mentions(docs):
    """key, doc_id, and arrays email, ip, card, phone and candidate of mentions."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, screen) in PATTERNS.items():
        out = _mentions(out, kind, pattern, screen)
    out = _mentions(out, "candidate", CANDIDATE, SCREEN)
    digits = lambda s: F.length(_digits(s["text"]))
    good = {
        "ip": lambda s: s["text"].rlike(OCTETS),
        "card": lambda s: F.when(digits(s) <= 19, _luhn(_digits(s["text"]))).otherwise(False),
        "phone": lambda s: digits(s).between(10, 15),
    }
    out = out.withColumns({kind: F.filter(kind, test) for kind, test in good.items()})
    # a word may end in a full stop
    word = lambda s: F.regexp_replace(s["text"], r"[._%+#/-]+$", "")
    cut = F.transform("candidate", lambda s: s.withField("end", s["start"] + F.length(word(s))).withField("text", word(s)))
    met = [lambda c, k=kind: F.exists(k, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])) for kind in KINDS]
    fits = lambda c: (F.length(c["text"]) >= 6) & ((digits(c) >= 3) | c["text"].contains("@"))
    free = F.filter(cut, lambda c: fits(c) & ~reduce(lambda a, b: a | b, [m(c) for m in met]))
    return out.withColumn("candidate", free).select(F.monotonically_increasing_id().alias("key"), "doc_id", *KINDS, "candidate")


def contexts(left, right):
    """Array of the lexical patterns that a mention stands in."""
    def words(text):
        plain = F.regexp_replace(F.lower(text), "[0-9]", "0")
        return F.filter(F.transform(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[\"'(\[,;]+|[\"'()\],;.!?]+$", "")),
                        lambda w: w != "")
    before, after = words(left), words(right)
    one, two, next_ = F.get(F.reverse(before), F.lit(0)), F.get(F.reverse(before), F.lit(1)), F.get(after, F.lit(0))
    letter = r"\p{L}"
    labelled = one.rlike(letter) & one.rlike("[:=#]$")
    return F.filter(F.array(
        F.when(one.rlike(letter) & two.rlike(letter), F.concat_ws(" ", two, one, F.lit("_"))),
        F.when(one.rlike(letter) & next_.rlike(letter), F.concat_ws(" ", one, F.lit("_"), next_)),
        F.when(labelled, F.concat_ws(" ", one, F.lit("_")))), lambda p: p.isNotNull())


def mention_table(spans):
    """key, start, end, kind (null for a candidate), value, patterns of all mentions."""
    parts = []
    for kind in (*KINDS, "candidate"):
        rows = spans.select("key", F.explode(kind).alias("m"))
        parts.append(rows.select("key", "m.start", "m.end", F.lit(None if kind == "candidate" else kind).cast("string").alias("kind"),
                                 F.lower("m.text").alias("value"), contexts(F.col("m.left"), F.col("m.right")).alias("patterns")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def bootstrapped(mentions, support=SUPPORT, confident=CONFIDENT, rounds=ROUNDS):
    """pattern, kind and confidence of the patterns that are confident after the last round."""
    edges = mentions.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    induced = edges.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= support)
    # only patterns induced by enough different seeds can become confident
    edges = edges.join(induced.select("pattern").distinct(), "pattern")
    edges = staged(edges, "personal-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    known = edges.filter("kind IS NOT NULL").select("value", "kind").distinct().withColumn("trust", F.lit(1.0))
    trusted, found = known, None
    for _ in range(rounds):
        held = edges.select("pattern", "value").join(trusted, "value")
        scores = held.groupBy("pattern", "kind").agg(F.round(F.sum("trust"), 6).alias("held")).join(sizes, "pattern")
        scores = scores.withColumn("confidence", F.round(F.col("held") / (F.col("instances") + 1), 6))
        found = scores.filter((F.col("held") >= support) & (F.col("confidence") >= confident)).select("pattern", "kind", "confidence")
        found = staged(found.join(induced.select("pattern", "kind"), ["pattern", "kind"]), "personal-patterns")
        new = edges.filter("kind IS NULL").select("pattern", "value").join(found, "pattern").groupBy("value", "kind").agg(
            F.round(1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999))))), 6).alias("trust"))
        best = W.partitionBy("value").orderBy(F.desc("trust"), "kind")  # as many rows as kinds
        new = new.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
        trusted = staged(known.unionByName(new), "personal-trusted")
    return found


def scan(docs, support=SUPPORT, confident=CONFIDENT, rounds=ROUNDS):
    """doc_id, the arrays email, ip, card, phone of (start, end, text), and found of (start, kind, end)."""
    spans = staged(base_mentions(docs), "personal-spans")
    mentions = staged(mention_table(spans), "personal-mentions")
    found = bootstrapped(mentions, support, confident, rounds)
    rows = mentions.filter("kind IS NULL").select("key", "start", "end", F.explode("patterns").alias("pattern")).join(found, "pattern")
    rows = rows.groupBy("key", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    rank = reduce(lambda c, k: c.when(F.col("kind") == KINDS[k], k), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    rows = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("kind"), "end"))).alias("found"))  # of one text
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    plain = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).alias(k) for k in KINDS]
    return spans.select("key", "doc_id", *plain).join(rows, "key", "left").select("doc_id", *KINDS, F.coalesce("found", none).alias("found"))


def _listed(base, found=None):
    """kind:start:end by start, then kind."""
    def tagged(k, kind):
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    parts = [tagged(*x) for x in enumerate(base)]
    if found:
        parts.append(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["kind"] + len(base)).alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in (*base, *(f"found_{k}" for k in base))])
    return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark, folder):
    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed(KINDS, "found").alias("spans"))
