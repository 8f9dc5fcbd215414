"""Streaming jobs over several micro-batches against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.session import fresh_path
from newsloom.streaming import jobs as J

CLICK_SCHEMA = "ts timestamp, event_id long, user_id string, article_id long"


def click_files(spark, batches):
    """A stream of clicks (seconds, event, user, article) in which every list is one micro-batch."""
    folder = fresh_path(spark, "clicks")
    for rows in batches:
        df = spark.createDataFrame([(float(s), e, u, a) for s, e, u, a in rows], "s double, event_id long, user_id string, article_id long")
        df.select(F.timestamp_seconds("s").alias("ts"), "event_id", "user_id", "article_id").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CLICK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def sessions_of(spark, stream, **options):
    path = J.run_available(J.stream_sessions(stream, **options), fresh_path(spark, "sessions"), fresh_path(spark, "state"))
    return sorted((r.user_id, r.session_start, tuple((c.ts_ms, c.event_id, c.article_id) for c in r.clicks)) for r in spark.read.parquet(path).collect())


def brute_sessions(clicks, gap_s, closed_before_s):
    by_user = defaultdict(list)
    for s, e, u, a in clicks:
        by_user[u].append((s * 1000, e, a))
    out = []
    for user, rows in by_user.items():
        rows.sort()
        parts = [[rows[0]]]
        for row in rows[1:]:
            if row[0] - parts[-1][-1][0] > gap_s * 1000:
                parts.append([])
            parts[-1].append(row)
        for part in parts:
            first = {}
            for row in part:
                first.setdefault(row[2], row)
            if part[-1][0] + gap_s * 1000 < closed_before_s * 1000 and len(first) >= 2:
                out.append((user, part[0][0], tuple(first.values())))
    return sorted(out)


def test_stream_sessions_out_of_order(spark):
    rng = random.Random(2)
    clicks, batches = [], []
    for batch in range(4):
        base = batch * 4000
        rows = [(base + rng.randrange(4000), batch * 1000 + k, f"u{rng.randrange(6)}", rng.randrange(8)) for k in range(60)]
        batches.append(rows)
        clicks += rows
    # nothing is late: the watermark stays 10 000 s behind
    end = [(100_000, 99_999, "last", 1)]
    got = sessions_of(spark, click_files(spark, batches + [end, [(100_001, 100_000, "last", 2)]]), gap="300 seconds", delay="10000 seconds")
    assert got == brute_sessions(clicks, 300, 90_000)
    assert len(got) > 30


def test_stream_sessions_gap_boundary(spark):
    rows = [(0, 1, "a", 1), (1800, 2, "a", 2), (0, 3, "b", 1), (1799, 4, "b", 2), (0, 5, "c", 1), (1801, 6, "c", 2), (1802, 7, "c", 3)]
    rows = [(s + 1000, *rest) for s, *rest in rows]
    got = sessions_of(spark, click_files(spark, [rows, [(50_000, 8, "z", 1)], [(50_001, 9, "z", 1)]]))
    assert [(u, len(c)) for u, _, c in got] == [("a", 2), ("b", 2), ("c", 2)]


def test_stream_sessions_state_is_bounded_by_articles(spark):
    """A million clicks of one user who never pauses, on 50 articles."""
    folder = fresh_path(spark, "hot")
    for part in range(2):
        spark.range(part * 500_000, (part + 1) * 500_000, numPartitions=1).select(
            F.timestamp_millis(F.col("id") * 100).alias("ts"), F.col("id").alias("event_id"), F.lit("hot").alias("user_id"),
            (F.col("id") % 50).alias("article_id")).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(CLICK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    checkpoint = fresh_path(spark, "hot-state")
    path = J.run_available(J.stream_sessions(stream), fresh_path(spark, "hot-out"), checkpoint)
    assert spark.read.schema("user_id string").parquet(path).count() == 0  # still open
    state = spark.read.format("statestore").load(checkpoint).filter("value.groupState IS NOT NULL").select("value.groupState.*").collect()
    assert [len(r.articles) for r in state] == [50] and list(state[0].ends) == [99_999_900]


@pytest.mark.parametrize("key", ["article_id", None])
def test_last_n_of_a_hot_key(spark, key):
    rng = random.Random(3)
    batches = [[(b * 100 + rng.randrange(100), b * 1000 + k, "u", 1 if rng.random() < .7 else rng.randrange(5)) for k in range(200)] for b in range(3)]
    path = fresh_path(spark, "last")
    J.run_batches(J.stream_last_n(click_files(spark, batches), 10, "60 days", key, salt=4), lambda df, i: J.write_delta(df, path, i),
                  fresh_path(spark, "last-state"), "update")
    changes = spark.read.parquet(path)
    assert changes.filter(F.col("key") == (1 if key else 0)).select("salt").distinct().count() == 4  # spread over tasks
    last = changes.agg(F.max("batch")).first()[0]
    for upto in (0, last):
        seen = sum(batches[:1] if upto == 0 else batches, [])
        want = defaultdict(list)
        for s, e, _, a in sorted(seen, reverse=True):
            want[a if key else 0].append((s * 1000, e))
        got = defaultdict(list)
        for r in sorted(J.last_n(changes, 10, upto).collect(), key=lambda r: r["rank"]):
            got[r.key].append((r.ts_ms, r.event_id))
        assert got == {k: v[:10] for k, v in want.items()}


def test_changes_are_folded_and_summed(spark):
    rng = random.Random(4)
    path, total, seen = fresh_path(spark, "changes"), defaultdict(int), {}
    assert J.read_changes(spark, path, ["k"]) is None
    for batch in range(9):
        rows = [(rng.randrange(5), rng.randrange(10)) for _ in range(6)]
        df = spark.createDataFrame(rows, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        for _ in range(2 if batch in (3, 4) else 1):  # a batch that is repeated replaces what it wrote
            J.write_change(df, path, batch, ["k"], every=4)
        for k, n in rows:
            total[k] += n
        seen[batch + 1] = dict(total)
        assert {r.k: r.n for r in J.read_changes(spark, path, ["k"], every=4).collect()} == total
        # a reader opens one folded part and fewer than four others
        parts = spark.read.parquet(f"{path}/epoch={J.epochs(spark, path)[0]}").select("batch").distinct().count()
        assert parts <= 5
    for before in (1, 4, 5, 8, 9):
        assert {r.k: r.n for r in J.read_changes(spark, path, ["k"], before, every=4).collect()} == seen[before]
    assert J.read_changes(spark, path, ["k"], 0) is None


def test_live_lists_follow_the_rules(spark):
    """A rule added between two batches shows up in the second; unknown articles get the most clicked ones."""
    def flat(sessions):
        rows = [("u", i, p + 1, len(s), x, 1000 * i + p, 1000 * i) for i, s in enumerate(sessions) for p, x in enumerate(s)]
        return spark.createDataFrame(rows, "user_id string, session_id long, pos int, session_size int, item_id long, ts_ms long, session_start long")
    catalog = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "article_id long, title string")
    tables, out, state, folder = (fresh_path(spark, n) for n in ("tables", "lists", "state", "clicks"))

    def feed(rows):
        spark.createDataFrame(rows, "event_id long, article_id long").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("event_id long, article_id long").parquet(folder)
        J.live_lists(stream, tables, out, state, catalog, 2, ["title"])
        found = spark.read.schema("event_id long, article_id long, fallback boolean, rank int, rec_item long, title string, batch int").parquet(out)
        return {(r.event_id, r["rank"]): (r.rec_item, r.fallback, r.title) for r in found.collect()}

    J.write_tables(flat([[1, 2], [1, 2], [9, 1], [1, 9]]), tables, 0)
    first = feed([(10, 1), (11, 77)])
    assert first == {(10, 1): (2, False, "two"), (11, 1): (1, True, "one"), (11, 2): (2, True, "two")}
    J.write_tables(flat([[1, 3], [1, 3], [1, 3]]), tables, 1)
    second = {k: v for k, v in feed([(20, 1), (21, 9)]).items() if k[0] >= 20}
    assert second == {(20, 1): (3, False, "three"), (20, 2): (2, False, "two"), (21, 1): (1, True, "one"), (21, 2): (3, True, "three")}


def test_stretches_are_plain_rows():
    """Cut, joined and reduced without data frames; the event breaks ties of time, a missing one comes last."""
    rows = [(9, 4, 1), (0, 1, 7), (2, 3, 8), (2, 2, 7), (30, None, 5), (30, 9, 5)]
    parts = J._stretches(rows, 10)
    assert parts == [(0, 9, [(0, 1, 7), (2, 3, 8), (9, 4, 1)]), (30, 30, [(30, 9, 5)])]
    late = J._stretches([(20, 6, 8), (20, 5, 2)], 10)
    assert J._merged(parts + late, 11) == [(0, 30, [(0, 1, 7), (2, 3, 8), (9, 4, 1), (20, 5, 2), (30, 9, 5)])]
    assert J._merged(parts + late, 9) == parts[:1] + late + parts[1:]
