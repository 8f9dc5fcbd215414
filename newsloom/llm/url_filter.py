"""URL filters (2): fixed rules first, then a path-template tree per host whose templates are rejected by smoothed purity.

Pages that a rule fits are the labelled ones. Segments that vary by nature (numbers, long identifiers) become wildcards, which leaves
few different paths; only these, with their counts of pages, of labelled and of blocked pages, go on. The tree grows level
by level below each host. Branches of fewer than ``least`` pages share one wildcard. A larger branch has a label class
(blocked, allowed, mixed, none) and a distribution of shapes below it; it merges with its siblings of that class if a
chi-squared test against the distribution of them all together finds no difference. So no branches are compared in pairs.
A branch without labels is also held against the labelled classes beside it and joins the one whose shapes it shares; if it fits
several or none of them it stays by itself. A template's purity is its share of blocked pages among labelled ones, smoothed by
``weight`` pages at its parent template's purity, and so on up to the host, which is smoothed by the overall share (a half at
most). So a template without labels has its parent's purity, a host without any the overall share. Templates with a
purity of ``reject`` or more are blocked, all others allowed. Levels below ``depth`` count as one.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows get equal results. An
empty table gives no row. Other columns are ignored.
"""

import string

from pyspark.sql import functions as F

from newsloom.llm.common import bounded, staged, table

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Segments that vary by nature: numbers, hexadecimal and mixed identifiers; an ending like .html stays.
NUMBER = r"^[0-9]+(?=\.[a-z]{1,5}$|$)"
IDENTIFIER = r"^(?:[0-9a-fA-F-]{8,}|(?=[^.]*[0-9][^.]*[0-9])[^.]{6,})(?=\.[a-z]{1,5}$|$)"
DEPTH = 5
LEAST = 5
WEIGHT = 4.0
REJECT = 0.8
CELL = ["host", "template", "segment", "shape"]


def host_path(url):
    """Host and path as columns."""
    parts = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, as a struct of rule and verdict; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, end, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == end) | F.endswith(host, F.lit("." + end))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(end + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def flat_path(path):
    """The path with wildcards for segments that vary by nature."""
    flat = lambda s: F.regexp_replace(F.regexp_replace(s, NUMBER, "<n>"), IDENTIFIER, "<id>")
    return F.array_join(F.transform(F.split(path, "/"), flat), "/")


def _share(blocked, labelled):
    return (blocked + 1) / (labelled + 2)


def _bound(shapes):
    """Three standard deviations above the mean of chi-squared over so many shapes."""
    return shapes - 1 + 3 * F.sqrt(2.0 * (shapes - 1)) + 1e-6


def _labelled_like(cells, pool, sums):
    """host, template, segment of the branches without labels, and the one labelled class that each is like."""
    branch = ["host", "template", "segment"]
    bare = cells.filter("kind = 'none'").select(*CELL, "pages", "all")
    classes = sums.filter("kind IN ('block', 'allow', 'mixed')").withColumnRenamed("kind", "like")
    met = bare.join(classes, ["host", "template"]).join(pool.withColumnRenamed("kind", "like"), ["host", "template", "like", "shape"], "left")
    own = F.col("pages").cast("double")
    expected = F.col("all") * (own + F.coalesce("pool", F.lit(0))) / (F.col("total") + F.col("all"))
    chi = met.groupBy(*branch, "like").agg(
        (F.sum(own * own / expected) - F.max("all")).alias("chi"),
        (F.max("shapes") + F.count_if(F.col("pool").isNull())).alias("shapes"))
    fits = chi.filter(F.col("chi") <= _bound(F.col("shapes")))
    return fits.groupBy(*branch).agg(F.count(F.lit(1)).alias("n"), F.min("like").alias("like")).filter("n = 1").drop("n")


def templates(paths, depth=DEPTH, least=LEAST):
    """Add the template of every path. ``paths``: host, flat, pages, labelled, blocked, one row per host and flat path."""
    rows = paths.withColumn("template", F.lit("")).withColumn("segments", F.split("flat", "/")).withColumn("trail", F.array(F.lit("")))
    for level in range(1, depth + 1):
        # the path starts with a slash: segment 0 is empty
        here = F.col("segments")[level] if level < depth else F.array_join(F.slice("segments", level + 1, 1 << 30), "/")
        below = F.transform(F.slice("segments", level + 2, 1 << 30), lambda s: F.when(s.startswith("<") | (s == ""), s).otherwise("<w>"))
        rows = rows.withColumn("segment", F.when(F.size("segments") > level, F.get(F.array(here), F.lit(0)) if level == depth else here))
        rows = staged(rows.withColumn("shape", F.array_join(below, "/")), "url-level")
        cells = rows.filter("segment IS NOT NULL").groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")])
        branches = cells.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")])
        share = _share(F.col("blocked"), F.col("labelled"))
        kind = (F.when(F.col("pages") < least, "rare").when(F.col("labelled") == 0, "none")
                .when(share >= 0.8, "block").when(share <= 0.2, "allow").otherwise("mixed"))
        branches = branches.select("host", "template", "segment", kind.alias("kind"), F.col("pages").alias("all"))
        cells = staged(cells.join(branches, ["host", "template", "segment"]), "url-cells")
        pool = cells.groupBy("host", "template", "kind", "shape").agg(F.sum("pages").alias("pool"))
        sums = pool.groupBy("host", "template", "kind").agg(F.sum("pool").alias("total"), F.count(F.lit(1)).alias("shapes"))
        met = cells.join(pool, ["host", "template", "kind", "shape"]).join(sums, ["host", "template", "kind"])
        expected = F.col("all") * F.col("pool") / F.col("total")
        # the sum over all shapes of (seen - expected)^2 / expected needs only those that were seen
        chi = met.groupBy("host", "template", "segment", "kind").agg(
            (F.sum(F.col("pages") * F.col("pages") / expected) - F.max("all")).alias("chi"),
            F.max("shapes").alias("shapes"), F.max("total").alias("total"), F.max("all").alias("all"))
        joins = (F.col("kind") == "rare") | ((F.col("all") < F.col("total")) & (F.col("chi") <= _bound(F.col("shapes"))))
        wild = lambda kind: F.concat(F.lit("<*"), kind, F.lit(">"))
        chi = chi.join(_labelled_like(cells, pool, sums), ["host", "template", "segment"], "left")
        named = chi.select("host", "template", "segment", F.when(F.col("like").isNotNull(), wild("like")).when(
            joins, wild("kind")).otherwise(F.col("segment")).alias("name"), "like", (F.col("all") == F.col("total")).alias("only"))
        # a class of one labelled branch takes the wildcard too if a branch without labels joins it
        joined = named.filter("like IS NOT NULL").select("host", "template", F.col("like").alias("kind")).distinct()
        named = named.join(branches.select("host", "template", "segment", "kind"), ["host", "template", "segment"]).join(
            joined.withColumn("met", F.lit(True)), ["host", "template", "kind"], "left").select(
            "host", "template", "segment", F.when(F.col("met") & F.col("only"), wild("kind")).otherwise(F.col("name")).alias("name"))
        rows = rows.join(bounded(staged(named, "url-branches")), ["host", "template", "segment"], "left").withColumn(
            "template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))).withColumn(
            "trail", F.when(F.col("name").isNull(), F.col("trail")).otherwise(F.concat("trail", F.array("template")))).drop(
            "name", "segment", "shape")
    return rows.drop("segments")


def judged_paths(paths, depth=DEPTH, least=LEAST, weight=WEIGHT, reject=REJECT):
    """host, flat, template, purity and the template's verdict of every path of a written table."""
    rows = staged(templates(paths, depth, least), "url-templates")
    labelled, blocked = paths.agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = min(0.5, (blocked or 0) / max(labelled or 0, 1))
    nodes = rows.select("host", F.explode("trail").alias("node"), "labelled", "blocked").groupBy("host", "node").agg(
        F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    ways = rows.select("host", "template", F.posexplode("trail").alias("level", "node")).distinct()
    steps = ways.join(nodes, ["host", "node"]).groupBy("host", "template").agg(  # one step a level
        F.sort_array(F.collect_list(F.struct("level", "n", "b"))).alias("steps"))
    purity = F.aggregate("steps", F.lit(float(prior)), lambda up, s: (s["b"] + weight * up) / (s["n"] + weight))
    per = steps.select("host", "template", purity.alias("purity"))
    per = per.withColumn("learned", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return rows.select("host", "flat", "template").join(bounded(staged(per, "url-purity")), ["host", "template"])


def filter_urls(pages, rules=RULES, **options):
    """page_id, host, path, rule, template, purity and verdict of every page."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("flat", flat_path(F.col("path"))).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    block = F.when(F.col("fit.verdict") == "block", 1).otherwise(0)
    paths = rows.groupBy("host", "flat").agg(F.count(F.lit(1)).alias("pages"), F.count("fit.verdict").alias("labelled"),
                                             F.sum(block).cast("long").alias("blocked"))
    judged = staged(judged_paths(staged(paths, "url-paths"), **options), "url-judged")
    return rows.join(bounded(judged), ["host", "flat"]).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), "template", "purity",
        F.coalesce("fit.verdict", "learned").alias("verdict"))


def op2_url_filter(spark, folder):
    return filter_urls(table(spark, folder, "pages"))
