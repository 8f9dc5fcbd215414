"""Sessions: gap rule, dedupe, positions, labels, lists."""

from pyspark.sql import functions as F

from newsloom.checks.base import CLICKS, HASH3, check, session_ctes, truncated, with_sql
from newsloom.functions.numeric import hash_digits, session_hour, session_key
from newsloom.functions.text import join_ids
from newsloom.operators import sessions as S
from newsloom.schema import KEY, MS_HOUR
from newsloom.sources import samples

GAP_24 = 24 * MS_HOUR


@check("e1_sessionize", with_sql(session_ctes(0.5)[:3], """
SELECT event_id, user_id, ts_ms, CAST(session_seq AS BIGINT) AS session_seq FROM seq"""))
def e1(spark, d):
    return S.sessionize(samples.clicks(spark, d)).select("event_id", "user_id", "ts_ms", "session_seq")


@check("e1_sessionize_hot_users", with_sql(session_ctes(6)[:3], """
SELECT event_id, user_id, CAST(session_seq AS BIGINT) AS session_seq, elapsed_ms FROM seq"""))
def e1_hot(spark, d):
    # Every user above 50 clicks is cut into half-day chunks; results must not change.
    cut = S.sessionize(samples.clicks(spark, d), 6 * MS_HOUR, hot_rows=50, chunk_ms=12 * MS_HOUR)
    return cut.select("event_id", "user_id", "session_seq", "elapsed_ms")


@check("e2_dedupe_sessions", with_sql(session_ctes(24), """
SELECT event_id, user_id, article_id, CAST(session_size AS INTEGER) AS session_size
FROM sized WHERE session_size >= 2"""))
def e2(spark, d):
    raw = S.sessionize(samples.clicks(spark, d), GAP_24)
    return S.dedupe_sessions(raw).select("event_id", "user_id", "article_id", "session_size")


@check("e3_elapsed_since_last", with_sql(session_ctes(24)[:3], "SELECT event_id, elapsed_ms FROM seq"))
def e3(spark, d):
    return S.sessionize(samples.clicks(spark, d), GAP_24).select("event_id", "elapsed_ms")


@check("e4_session_positions", with_sql(session_ctes(24), """
SELECT user_id, session_id, session_hour, session_start, session_size, pos, item_id, ts_ms FROM sc"""))
def e4(spark, d):
    return samples.sessions(spark, d, 24).select(
        *KEY, "session_hour", "session_start", "session_size", "pos", "item_id", "ts_ms")


@check("e5_next_item_labels", with_sql(session_ctes(6), """
SELECT user_id, session_id, pos, item_id,
       lead(item_id) OVER w AS label_next_item,
       last_value(item_id) OVER (PARTITION BY user_id, session_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label_last_item
FROM sc WINDOW w AS (PARTITION BY user_id, session_id ORDER BY pos)"""))
def e5(spark, d):
    return S.next_item_labels(samples.sessions(spark, d)).select(
        *KEY, "pos", "item_id", "label_next_item", "label_last_item")


@check("b25_hash_digits", with_sql([CLICKS], f"""
SELECT DISTINCT user_id, {HASH3.format('user_id')} AS h3 FROM clicks"""))
def b25(spark, d):
    return samples.clicks(spark, d).select("user_id").distinct().withColumn("h3", hash_digits("user_id"))


@check("b26_session_keys", with_sql([CLICKS], f"""
SELECT user_id, min(ts_ms) * 100 + {HASH3.format('user_id')} AS session_id,
       CAST((min(ts_ms) - (SELECT min(ts_ms) FROM clicks)) // 3600000 AS INTEGER) AS session_hour
FROM clicks GROUP BY user_id"""))
def b26(spark, d):
    clicks = samples.clicks(spark, d)
    first = clicks.groupBy("user_id").agg(F.min("ts_ms").alias("ts"))
    return first.select("user_id", session_key("ts", "user_id").alias("session_id"),
                        session_hour("ts", S.time_origin(clicks).scalar()).alias("session_hour"))


@check("b27_shift_labels", with_sql(session_ctes(24) + [truncated()], """
SELECT * FROM (
  SELECT user_id, session_id, pos, item_id, session_size,
         lead(item_id) OVER (PARTITION BY user_id, session_id ORDER BY pos) AS label_next_item,
         last_value(item_id) OVER (PARTITION BY user_id, session_id ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label_last_item
  FROM tr) WHERE label_next_item IS NOT NULL"""))
def b27(spark, d):
    return S.shift_labels(samples.sessions(spark, d, 24)).select(
        *KEY, "pos", "item_id", "session_size", "label_next_item", "label_last_item")


@check("f1_order_sessions", with_sql(session_ctes(6), """
SELECT user_id, session_id, session_hour, session_size,
       row_number() OVER (PARTITION BY session_hour ORDER BY session_id, user_id) AS place
FROM sc WHERE pos = 1"""))
def f1(spark, d):
    from pyspark.sql import Window
    ordered = S.order_sessions(samples.sessions(spark, d).filter("pos = 1"))
    place = F.row_number().over(Window.partitionBy("session_hour").orderBy("session_id", "user_id"))
    return ordered.select(*KEY, "session_hour", "session_size", place.alias("place"))


@check("t7_nested_sessions", with_sql(session_ctes(6), """
SELECT user_id, session_id, session_hour, session_size, session_start,
       string_agg(CAST(item_id AS VARCHAR) || ':' || CAST(elapsed_ms AS VARCHAR), ',' ORDER BY pos) AS clicks
FROM sc GROUP BY ALL"""))
def t7(spark, d):
    nested = S.nest_sessions(samples.sessions(spark, d).select(
        *KEY, "session_hour", "session_size", "session_start", "pos", "item_id", "elapsed_ms"))
    text = F.transform("clicks", lambda c: F.concat_ws(":", c["item_id"].cast("string"), c["elapsed_ms"].cast("string")))
    return nested.withColumn("clicks", F.array_join(text, ","))


@check("t8_session_examples", with_sql(session_ctes(24) + [truncated()], """
SELECT user_id, session_id, max(session_size) AS session_size, min(session_hour) AS session_hour,
       string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS item_clicked,
       string_agg(event_type, ',' ORDER BY pos) AS context
FROM tr GROUP BY ALL"""))
def t8(spark, d):
    rows = S.session_lists(samples.sessions(spark, d, 24), ["item_id", "event_type"])
    return rows.select(*KEY, "session_size", "session_hour", join_ids("item_id").alias("item_clicked"),
                       join_ids("event_type").alias("context"))


@check("c14_restrict_to_train_items", with_sql(session_ctes(6), """
SELECT user_id, session_id, pos, item_id FROM (
  SELECT user_id, session_id, pos, item_id, count(*) OVER (PARTITION BY user_id, session_id) AS n
  FROM sc WHERE session_hour >= 600 AND item_id IN (SELECT item_id FROM sc WHERE session_hour < 20))
WHERE n >= 2"""))
def c14(spark, d):
    flat = samples.sessions(spark, d)
    kept = S.restrict_to_train_items(flat.filter("session_hour >= 600"), flat.filter("session_hour < 20"))
    return kept.select(*KEY, "pos", "item_id")


@check("k12_flat_training_table", with_sql(session_ctes(24) + [truncated()], """
SELECT user_id, session_id AS "SessionId", pos, item_id AS "ItemId",
       CASE WHEN lead(item_id) OVER w IS NULL THEN coalesce(lag(ts_ms) OVER w, ts_ms) ELSE ts_ms END AS "Time"
FROM tr WINDOW w AS (PARTITION BY user_id, session_id ORDER BY pos)"""))
def k12(spark, d):
    return S.flat_training_table(samples.sessions(spark, d, 24))
