"""Column contracts shared by every job.

A session is identified by (user_id, session_id).  ``session_id`` alone is the
published key ``first_click_ms * 100 + hash3(user)``; two users can share it, so
every grouping and join uses both columns.
"""

from pyspark.sql import types as T

KEY = ["user_id", "session_id"]
CLICK = KEY + ["pos"]

MS_HOUR = 3_600_000
MS_DAY = 86_400_000
MAX_SESSION_ITEMS = 20

PAD_TOKEN = "<PAD>"
UNFREQUENT_TOKEN = "<UNF>"
UNKNOWN_TOKEN = "<UNK>"

CLICKS_JSON = T.StructType([
    T.StructField("userId", T.StringType()),
    T.StructField("time", T.LongType()),
    T.StructField("canonicalUrl", T.StringType()),
    T.StructField("publishtime", T.StringType()),
    T.StructField("activeTime", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("deviceType", T.StringType()),
    T.StructField("referrerHostClass", T.StringType()),
])

CLICK_LOG = T.StructType([
    T.StructField("dt", T.StringType()),
    T.StructField("loc_id", T.IntegerType()),
    T.StructField("os_code", T.IntegerType()),
    T.StructField("top", T.IntegerType()),
    T.StructField("guid", T.StringType()),
    T.StructField("news_id", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("path", T.StringType()),
])

CLICKS_CSV = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("session_start", T.LongType()),
    T.StructField("session_size", T.IntegerType()),
    T.StructField("click_article_id", T.LongType()),
    T.StructField("click_timestamp", T.LongType()),
    T.StructField("click_environment", T.IntegerType()),
    T.StructField("click_deviceGroup", T.IntegerType()),
    T.StructField("click_os", T.IntegerType()),
    T.StructField("click_country", T.IntegerType()),
    T.StructField("click_region", T.IntegerType()),
    T.StructField("click_referrer_type", T.IntegerType()),
])

PORTAL_ARTICLES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("created_at_ts", T.IntegerType()),
    T.StructField("teaser", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("category0", T.IntegerType()),
    T.StructField("persons", T.StringType()),
    T.StructField("locations", T.StringType()),
    T.StructField("text_highlights", T.StringType()),
])
