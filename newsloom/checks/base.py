"""Registry of queries over the sample tables, each with its plain-SQL twin."""

QUERIES = {}
ORACLES = {}


def check(name, sql=None):
    """Register ``fn(spark, folder) -> DataFrame`` and the SQL that must agree with it."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def with_sql(ctes, select):
    return "WITH " + ",\n".join(ctes) + "\n" + select


CLICKS = """clicks AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) + 1 AS article_id,
         epoch_us(ts) // 1000 AS ts_ms, value AS active_time_secs, event_type
  FROM events)"""

HASH3 = "CAST(substr(CAST(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) AS VARCHAR), 1, 3) AS INTEGER)"


def session_ctes(hours=6.0, min_items=2):
    """clicks ... sc: the flat session table."""
    gap = int(hours * 3_600_000)
    return [CLICKS, """raw AS (
  SELECT *, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS prev FROM clicks)""",
            f"""seq AS (
  SELECT *, coalesce(ts_ms - prev, 0) AS elapsed_ms,
         sum(CASE WHEN prev IS NULL OR ts_ms - prev > {gap} THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS session_seq
  FROM raw)""", """firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_seq, article_id
                                              ORDER BY ts_ms, event_id) AS rn FROM seq) WHERE rn = 1)""",
            f"""sized AS (
  SELECT *, count(*) OVER (PARTITION BY user_id, session_seq) AS session_size,
         min(ts_ms) OVER (PARTITION BY user_id, session_seq) AS session_start,
         row_number() OVER (PARTITION BY user_id, session_seq ORDER BY ts_ms, event_id) AS pos
  FROM firsts)""", f"""sc AS (
  SELECT event_id, user_id, session_start * 100 + {HASH3.format('user_id')} AS session_id,
         CAST((session_start - (SELECT min(ts_ms) FROM clicks)) // 3600000 AS INTEGER) AS session_hour,
         session_start, CAST(session_size AS INTEGER) AS session_size, pos, article_id AS item_id,
         ts_ms, elapsed_ms, active_time_secs, event_type
  FROM sized WHERE session_size >= {min_items})"""]


def truncated(name="sc", out="tr", n=20):
    return f"{out} AS (SELECT * REPLACE (least(session_size, {n}) AS session_size) FROM {name} WHERE pos <= {n})"


CATALOG = """catalog AS (
  SELECT f.article_id, e.label AS category_id,
         f.first_ts - (f.article_id % 48) * 3600000 AS created_at_ts,
         greatest(d.n_chars // 6, 1) AS text_length
  FROM (SELECT article_id, min(ts_ms) AS first_ts FROM clicks GROUP BY 1) f
  JOIN embeddings e ON e.vec_id = f.article_id
  JOIN documents d ON d.doc_id = f.article_id)"""

EMB = "emb AS (SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


def fold_ctes(k, source="sc"):
    """folds, tagged: frozen state per test hour (step = chunk)."""
    return [f"""folds AS (
  SELECT session_hour, CAST((rn - 1) // {k} AS INTEGER) AS chunk,
         (rn - 1) % {k} = 0 AND rn > {k} AS is_test
  FROM (SELECT session_hour, row_number() OVER (ORDER BY session_hour) AS rn
        FROM (SELECT DISTINCT session_hour FROM {source})))""",
            f"""tagged AS (
  SELECT s.*, f.chunk AS step, CASE WHEN f.is_test THEN f.chunk END AS state_step
  FROM {source} s JOIN folds f USING (session_hour))"""]


BASKETS = [f"""lines AS (
  SELECT * FROM (SELECT *, epoch_us(l_shipdate) // 1000 AS ship_ms, row_number() OVER (
      PARTITION BY l_orderkey, l_partkey
      ORDER BY l_shipdate, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1)""",
           """baskets AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS user_id, l_orderkey AS session_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY ship_ms, l_linenumber, l_partkey, l_suppkey) AS pos,
         count(*) OVER (PARTITION BY l_orderkey) AS session_size,
         l_partkey AS item_id, ship_ms AS ts_ms
  FROM lines)"""]
