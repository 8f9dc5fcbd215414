"""Item features of steps with and without buffered clicks."""

import pytest

from newsloom.operators import features as Q


def test_novelty_without_buffer(spark):
    items = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11)], "state_step long, item_id long")
    pop = spark.createDataFrame([(s, i, p) for s in (1, 2) for i, p in ((10, 0.5), (11, 0.25))],
                                "state_step long, item_id long, norm_pop double")
    buffer = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "state_step long, item_id long, buffer_pos int")
    got = {(r.state_step, r.item_id): r.novelty for r in Q.novelty(items, pop, buffer).collect()}
    assert got == {k: pytest.approx(-1.0 if k[1] == 10 else 1.0) for k in [(1, 10), (1, 11), (2, 10), (2, 11)]}


def test_recency_without_buffer(spark):
    day = 86_400_000
    items = spark.createDataFrame([(1, 10, 4 * day), (2, 10, 4 * day), (2, 11, 4 * day)],
                                  "state_step long, item_id long, ts_ms long")
    catalog = spark.createDataFrame([(10, 0), (11, 3 * day)], "article_id long, created_at_ts long")
    buffer = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "state_step long, item_id long, buffer_pos int")
    got = {(r.state_step, r.item_id): r.recency for r in Q.recency(items, buffer, catalog).collect()}
    assert got == {(1, 10): pytest.approx(1.0), (2, 10): pytest.approx(1.0), (2, 11): pytest.approx(-1.0)}


def test_context_codes(spark):
    rows = [("ios", "no"), ("ios", "no"), ("ios", "se"), ("mac", "se"), ("mac", None), ("web", "dk"), (None, "dk")]
    clicks = spark.createDataFrame([(f"u{i}", 1, 1, i, 0, 0, o, c) for i, (o, c) in enumerate(rows)],
                                   "user_id string, session_id long, pos int, item_id long, ts_ms long, elapsed_ms long, os string, country string")
    cfg = Q.FeatureConfig(context={"device": {"os": 3}, "location": {"country": None}}, off=("time", "elapsed", "reading"))
    encoder = Q.fit_context(clicks, cfg, 2)
    # os has three codes: pad, infrequent and the most frequent value; ties of country go by value
    assert {tuple(r) for r in encoder.collect()} == {
        ("os", "<PAD>", 0), ("os", "<UNF>", 1), ("os", "ios", 2), ("country", "<PAD>", 0), ("country", "<UNF>", 1),
        ("country", "dk", 2), ("country", "no", 3), ("country", "se", 4)}
    articles = spark.createDataFrame([], "article_id long, text_length int")
    timed = clicks.withColumn("active_time_secs", clicks.item_id * 1.0)
    got = {r.user_id: (r.os_code, r.country_code) for r in Q.click_features(timed, articles, cfg, encoder).collect()}
    assert got == {"u0": (2, 3), "u1": (2, 3), "u2": (2, 4), "u3": (1, 4), "u4": (1, 1), "u5": (1, 2), "u6": (1, 2)}
    assert cfg.types() == {"os_code": ("categorical", "int", 3), "country_code": ("categorical", "int", None)}
    off = Q.FeatureConfig(context=cfg.context, off=("time", "elapsed", "reading", "device"))
    assert off.columns() == ["country_code"]


def test_context_needs_an_encoder(spark):
    clicks = spark.createDataFrame([("u", 1, 1, 1, 0, 0, 1.0, "x")], "user_id string, session_id long, pos int, item_id long,"
                                   "ts_ms long, elapsed_ms long, active_time_secs double, os string")
    articles = spark.createDataFrame([], "article_id long, text_length int")
    with pytest.raises(ValueError):
        Q.click_features(clicks, articles, Q.FeatureConfig(context={"device": {"os": None}}))
