"""Gap rule, repeats, hot users, positions and labels on hand-made clicks."""

import random

from newsloom.operators import sessions as S

MIN = 60_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id string, article_id long, ts_ms long")


def brute_sessions(rows, gap):
    """user -> list of sessions; a session is a list of (article, ts, elapsed)."""
    out = {}
    for user in {r[1] for r in rows}:
        last, sessions = None, []
        for eid, _, art, ts in sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0])):
            if last is None or ts - last > gap:
                sessions.append([])
            if art not in [c[0] for c in sessions[-1]]:
                sessions[-1].append((art, ts, 0 if last is None else ts - last))
            last = ts
        out[user] = [s for s in sessions if len(s) >= 2]
    return out


def found_sessions(flat):
    out = {}
    for r in sorted(flat.collect(), key=lambda r: (r.user_id, r.session_id, r.pos)):
        out.setdefault((r.user_id, r.session_id), []).append((r.item_id, r.ts_ms, r.elapsed_ms))
    users = {}
    for (user, _), clicks in sorted(out.items(), key=lambda kv: kv[1][0][1]):
        users.setdefault(user, []).append(clicks)
    return users


def test_gap_boundary(spark):
    start = 1_000 * MIN
    times = [0, 30 * MIN - 1000, 60 * MIN - 1000, 90 * MIN]  # gaps 29:59, 30:00, 30:01
    rows = [(i, "u", i + 1, start + t) for i, t in enumerate(times)]
    seq = {r.event_id: r.session_seq for r in S.sessionize(frame(spark, rows)).collect()}
    assert [seq[i] for i in range(4)] == [1, 1, 1, 2]


def test_repeats_and_elapsed(spark):
    rows = [(0, "u", 1, 0), (1, "u", 2, MIN), (2, "u", 1, 2 * MIN), (3, "u", 3, 5 * MIN),
            (4, "v", 7, 0), (5, "v", 7, MIN)]
    flat = S.session_clicks(frame(spark, rows))
    got = [(r.item_id, r.pos, r.elapsed_ms) for r in flat.orderBy("pos").collect()]
    assert got == [(1, 1, 0), (2, 2, MIN), (3, 3, 3 * MIN)]  # elapsed counts from the second click on 1


def test_same_time_uses_event_id(spark):
    rows = [(2, "u", 20, 5), (1, "u", 10, 5)]
    assert [r.item_id for r in S.session_clicks(frame(spark, rows)).orderBy("pos").collect()] == [10, 20]


def test_random_and_hot_users_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(30)}"
        rows.append((i, user, rng.randrange(12), rng.randrange(4000) * MIN // 2))
    want = {u: s for u, s in brute_sessions(rows, 30 * MIN).items() if s}
    df = frame(spark, rows)
    assert found_sessions(S.session_clicks(df)) == want
    # The hot user is cut into 10-minute chunks: chunks shorter than the gap must not split sessions.
    assert found_sessions(S.session_clicks(df, hot_rows=100, chunk_ms=10 * MIN)) == want


def test_truncation_and_labels(spark):
    rows = [(i, "u", i + 1, i * MIN) for i in range(25)]
    out = S.shift_labels(S.session_clicks(frame(spark, rows))).orderBy("pos").collect()
    assert len(out) == 19 and out[-1].label_next_item == 20 and out[0].label_last_item == 20
