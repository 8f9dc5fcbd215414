"""Numeric click-feature expressions (all JVM-side columns)."""

import math

from pyspark.sql import functions as F

# Cap, mean and deviation of the numeric click features.
SCALERS = {
    "elapsed_ms": {"valid_max": 3_600_000.0, "avg": 789935.7, "stddev": 1371436.0},
    "active_time_secs": {"valid_max": 900.0, "avg": 65.0, "stddev": 69.37},
    "active_time_secs_by_word": {"valid_max": 10.0, "avg": 1.854, "stddev": 1.474},
}
DEFAULT_TEXT_LENGTH = 728  # fixed value: average article length in words


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def elapsed_minutes(time_secs, publish_secs):
    return ((_col(time_secs) - _col(publish_secs)) / 60).cast("int")


def publish_secs(text):
    """ISO publish time to epoch seconds; unparsable text gives null."""
    return F.unix_timestamp(F.try_to_timestamp(_col(text)))


def local_hour(ts_ms, tz):
    local = F.from_utc_timestamp(F.timestamp_seconds(F.floor(_col(ts_ms) / 1000)), tz)
    return F.hour(local) + F.minute(local) / 60.0


def local_weekday(ts_ms, tz):
    return F.weekday(F.from_utc_timestamp(F.timestamp_seconds(F.floor(_col(ts_ms) / 1000)), tz))


def cyclic(value, period=24):
    angle = (_col(value) + 1e-6) / float(period) * (2 * math.pi)
    return F.sin(angle), F.cos(angle)


def scale_weekday(weekday, centered=True):
    return (_col(weekday) + 1 - (3.5 if centered else 0.0)) / 7


def standardize_capped(c, cap, avg, stddev):
    """Truncates to a whole number before capping, as the stored scalers expect."""
    whole = _col(c).cast("long").cast("double")
    return (F.least(whole, F.lit(float(cap))) - avg) / stddev


def standardize(feature, c):
    s = SCALERS[feature]
    return standardize_capped(c, s["valid_max"], s["avg"], s["stddev"])


def log_base(c, base):
    return F.ln(_col(c)) / math.log(base)


def log1p_base(c, base):
    return F.log1p(_col(c)) / math.log(base)


def days_between(newer_secs, older_secs):
    return (_col(newer_secs) - _col(older_secs)) / 86400.0


def time_decay(newer_secs, older_secs, alpha=0.5):
    return 1.0 / F.pow(F.lit(1.0 + alpha), days_between(newer_secs, older_secs))


def hash_digits(c, digits=3):
    """First decimal digits of the number in the first 8 hex digits of the md5."""
    head = F.conv(F.substring(F.md5(_col(c).cast("binary")), 1, 8), 16, 10)
    return F.substring(head, 1, digits).cast("int")


def session_key(first_ts_ms, user):
    return _col(first_ts_ms) * 100 + hash_digits(user, 3)


def session_hour(first_ts_ms, origin_ms):
    return F.floor((_col(first_ts_ms) - _col(origin_ms)) / 3_600_000).cast("int")


def rank_discount(rank):
    """1 / log2(k + 2) for the 0-based position k, given the 1-based rank."""
    return 1.0 / F.log2(_col(rank) + 1)


def decay(name, distance, clip=False):
    """Distance decay family; ``linear`` turns negative past 10 unless clipped."""
    if callable(name):
        return name(_col(distance))
    d = _col(distance).cast("double")
    if name == "same":
        return F.lit(1.0)
    if name == "div":
        return 1.0 / d
    if name == "quadratic":
        return 1.0 / (d * d)
    if name == "log":
        return 1.0 / F.log10(d + 1.7)
    if name == "linear":
        line = F.when(d <= 100, 1 - 0.1 * d).otherwise(0.0)
        return F.greatest(line, F.lit(0.0)) if clip else line
    raise ValueError(f"unknown decay: {name}")
