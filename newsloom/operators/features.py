"""Click and item features for the rankers."""

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import functions as F

from newsloom.functions import numeric as N
from newsloom.operators.joins import lookup_join
from newsloom.operators.ranking import global_rank
from newsloom.schema import PAD_TOKEN, UNFREQUENT_TOKEN


@dataclass
class FeatureConfig:
    """Which click features are built; groups can be switched off.

    ``context`` names the categorical click columns by group, with the number of codes
    that a model reserves for each (0 pad, 1 infrequent, then by falling count):
    {"device": {"os": 10}, "location": {"country": 30, "region": None}}.  None sets no bound.
    """

    timezone: str = "Europe/Oslo"
    centered_weekday: bool = True
    groups: dict = field(default_factory=lambda: {
        "time": ["local_hour_sin", "local_hour_cos", "weekday"],
        "elapsed": ["user_elapsed_ms_since_last_click"],
        "reading": ["active_time_secs_by_word"],
    })
    context: dict = field(default_factory=dict)
    off: tuple = ()

    def dims(self):
        """Categorical columns in use and their number of codes."""
        return {c: n for g, cols in self.context.items() if g not in self.off for c, n in cols.items()}

    def columns(self):
        return [c for g, cols in self.groups.items() if g not in self.off for c in cols] + [f"{c}_code" for c in self.dims()]

    def types(self):
        """Feature -> (kind, type, number of codes), as a model's input description."""
        codes = {f"{c}_code": n for c, n in self.dims().items()}
        return {c: ("categorical", "int", codes[c]) if c in codes else ("numerical", "double", None) for c in self.columns()}


def fit_context(clicks, cfg, min_freq=100):
    """(feature, value, code) of all categorical columns: one scan, one numbering.

    Codes per feature: 0 pad, 1 infrequent, then by falling count and value.  Values rarer
    than ``min_freq``, nulls and values beyond the feature's number of codes get no row.
    """
    dims = cfg.dims()
    reserved = [(c, v, i) for c in dims for i, v in enumerate((PAD_TOKEN, UNFREQUENT_TOKEN))]
    fixed = clicks.sparkSession.createDataFrame(reserved, "feature string, value string, code int")
    if not dims:
        return fixed
    pairs = clicks.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in dims])))
    counts = (pairs.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("count"))
              .filter(F.col("count") >= min_freq))
    ranked = global_rank(counts, [("feature", True), ("count", False), ("value", True)])
    firsts = ranked.groupBy("feature").agg(F.min("rn").alias("_first"))
    coded = ranked.join(firsts, "feature").select("feature", "value", (F.col("rn") - F.col("_first") + 2).cast("int").alias("code"))
    bound = F.lit(None).cast("int")
    for c, n in dims.items():
        bound = F.when(F.col("feature") == c, F.lit(n).cast("int")).otherwise(bound)
    return fixed.unionByName(coded.filter(bound.isNull() | (F.col("code") < bound)))


def context_codes(clicks, encoder, cfg, default=1):
    """``<column>_code`` of each categorical column; values without a code get ``default``."""
    out = clicks
    for c in cfg.dims():
        codes = encoder.filter((F.col("feature") == c) & (F.col("code") > 1)).select(
            F.col("value").alias("_value"), F.col("code").alias(f"{c}_code"))
        out = lookup_join(out.withColumn("_value", F.col(c).cast("string")), codes, "_value").drop("_value")
    return out.withColumns({f"{c}_code": F.coalesce(f"{c}_code", F.lit(default)) for c in cfg.dims()})


def active_time_by_word(clicks, articles, default=None, out="active_time_secs_by_word",
                        on="item_id", default_length=N.DEFAULT_TEXT_LENGTH):
    """Reading seconds per word, standardised; missing time and unknown article use fixed averages."""
    default = N.SCALERS["active_time_secs"]["avg"] if default is None else default
    lengths = articles.select(F.col("article_id").alias(on), F.col("text_length").alias("_len"))
    joined = lookup_join(clicks, lengths, on)
    by_word = F.coalesce("active_time_secs", F.lit(default)) / F.coalesce("_len", F.lit(default_length))
    return joined.withColumn(out, N.standardize("active_time_secs_by_word", by_word)).drop("_len")


def click_features(flat, articles, cfg=FeatureConfig(), encoder=None):
    """Feature columns of every session click in one projection plus one lookup.

    ``encoder`` (``fit_context``) gives the codes of the categorical columns, one lookup each.
    """
    sin, cos = N.cyclic(N.local_hour("ts_ms", cfg.timezone))
    timed = (flat.withColumn("local_hour_sin", sin).withColumn("local_hour_cos", cos)
             .withColumn("weekday", N.scale_weekday(N.local_weekday("ts_ms", cfg.timezone), cfg.centered_weekday))
             .withColumn("user_elapsed_ms_since_last_click", N.standardize("elapsed_ms", "elapsed_ms")))
    read = active_time_by_word(timed, articles)
    if cfg.dims():
        if encoder is None:
            raise ValueError("categorical features need an encoder: fit_context(clicks, cfg)")
        read = context_codes(read, encoder, cfg)
    keys = [c for c in ["user_id", "session_id", "pos", "item_id", "ts_ms"] if c in read.columns]
    return read.select(*keys, *cfg.columns())


def min_max(c, low, high, lo=-1.0, hi=1.0, eps=1e-24):
    scaled = (c - low + eps) / F.greatest(high - low, F.lit(2 * eps))
    return scaled * (hi - lo) + lo


def _normalise(items, buffer_values, value, by, out):
    """Z-normalise with the buffer's mean and deviation, then min-max to [-1, 1].

    A step without buffer values is normalised with the values of its own items.
    """
    def spread(values):
        return values.groupBy(*by).agg(
            F.avg("x").alias("_m"), F.sqrt(F.var_pop("x") + 1e-24).alias("_s"),
            F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    buffered = spread(buffer_values)
    own = spread(items.select(*by, value.alias("x")))
    stats = buffered.unionByName(own.join(buffered.select(*by), by, "left_anti"))
    joined = lookup_join(items, stats, by, "inner")

    def z(c):
        return (c - F.col("_m")) / F.col("_s")
    return joined.withColumn(out, min_max(z(value), z(F.col("_lo")), z(F.col("_hi")))).drop("_m", "_s", "_lo", "_hi")


def days_since_publishing(ts_ms, created_ms):
    return F.greatest((ts_ms - created_ms) / 86_400_000.0, F.lit(0.0))


def recency(items, buffer, catalog, last_m=1000, base=1.3, by=("state_step",)):
    """Log days since publishing, normalised with the last M buffer clicks.

    ``items``: by, item_id, ts_ms.  The buffer's ages count to the newest click of
    the step.
    """
    by = list(by)
    created = catalog.select(F.col("article_id").alias("item_id"), F.col("created_at_ts").alias("_created"))
    latest = items.groupBy(*by).agg(F.max("ts_ms").alias("_latest"))
    recent = lookup_join(buffer.filter(F.col("buffer_pos") <= last_m).select(*by, "item_id"), created, "item_id", "inner")
    recent = lookup_join(recent, latest, by, "inner")
    values = recent.select(*by, N.log1p_base(days_since_publishing(F.col("_latest"), F.col("_created")), base).alias("x"))
    rows = lookup_join(items, created, "item_id", "inner")
    own = N.log1p_base(days_since_publishing(F.col("ts_ms"), F.col("_created")), base)
    return _normalise(rows, values, own, by, "recency").drop("_created")


def novelty(items, popularity, buffer, last_m=1000, base=2.0, norm_clicks=1000, by=("state_step",)):
    """-log2 of the popularity share, normalised with the last M buffer clicks."""
    by = list(by)
    pop = popularity.select(*by, "item_id", "norm_pop")
    floor = F.lit(1.0 / norm_clicks)

    def of(df):
        return lookup_join(df, pop, by + ["item_id"])
    value = -N.log_base(F.coalesce("norm_pop", floor), base)
    recent = of(buffer.filter(F.col("buffer_pos") <= last_m).select(*by, "item_id"))
    return _normalise(of(items), recent.select(*by, value.alias("x")), value, by, "novelty").drop("norm_pop")


def encode_context(df, cardinalities, one_hot_below=10):
    """One-hot vectors for small code columns; larger ones keep the dense code."""
    small = [c for c, n in cardinalities.items() if n <= one_hot_below]
    sized = df
    for c in small:
        sized = sized.withColumn(c, F.col(c).cast("double"))
    if not small:
        return sized
    # A fixed category list makes the encoder independent of the batch.
    template = df.sparkSession.range(max(cardinalities[c] for c in small)).select(
        *[F.least(F.col("id"), F.lit(cardinalities[c] - 1)).cast("double").alias(c) for c in small])
    encoder = OneHotEncoder(inputCols=small, outputCols=[f"{c}_vec" for c in small],
                            dropLast=False, handleInvalid="keep").fit(template)
    return encoder.transform(sized)


# ---- audits ---------------------------------------------------------------

def describe_col(df, col, probs=(0.1, 0.25, 0.5, 0.75, 0.9), err=None):
    """Count, mean, deviation, range and quantiles; exact, or approximate with ``err``.

    Exact quantiles read the running count of the distinct values (a bucketed
    order, no single sorted group) and interpolate between the two places around
    each position.
    """
    x = F.col(col).cast("double")
    basic = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev(x).alias("std"),
             F.min(x).alias("min"), F.max(x).alias("max")]
    names = [f"q{int(p * 100):02d}" for p in probs]
    if err is not None:
        return df.agg(*basic, *[F.percentile_approx(x, p, int(1 / err)).alias(n) for n, p in zip(names, probs)])
    freq = df.select(x.alias("_x")).filter(F.col("_x").isNotNull()).groupBy("_x").agg(F.count("*").alias("_f"))
    running = global_rank(freq, [("_x", True)], "_end", weight="_f")
    spots = running.withColumn("_n", df.agg(F.count(x)).scalar())

    def at(place):
        return F.max(F.when((place >= F.col("_end") - F.col("_f")) & (place < F.col("_end")), F.col("_x")))
    quantiles = []
    for name, p in zip(names, probs):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        low, part = F.floor(spot), F.max(spot - F.floor(spot))
        quantiles.append((at(low) * (1 - part) + at(F.ceil(spot)) * part).alias(name))
    packed = spots.agg(F.struct(*quantiles)).scalar()
    out = df.agg(*basic).withColumn("_q", packed)
    return out.select("*", "_q.*").drop("_q")


def audit(df, cols, approx=False):
    """Rows, nulls and distinct values per column.

    Exact distinct counts go through one (column, value) aggregation instead of
    one wide expansion per column.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    if approx:
        return long.groupBy("column").agg(
            F.count("*").alias("rows"), F.sum(F.col("value").isNull().cast("long")).alias("nulls"),
            F.approx_count_distinct("value").alias("distinct"))
    per_value = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct"))
