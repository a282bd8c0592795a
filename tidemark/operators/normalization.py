"""Rolling normalisation, distribution profile and feature metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series, with_moments
from ..functions.scalars import clip
from ..sources.local import local_frame
from .technical import BY_SYMBOL

C = F.col
NOT_FEATURES = {"date", "symbol", "asset_id"}


def rolling_zscores(df: DataFrame, features: list[str], window: int = 252,
                    s: Series = BY_SYMBOL) -> DataFrame:
    """Keys, order and the z-score of each feature, from half a window of values on.

    Features are set below each other, so that every (series, feature) is a window
    partition of its own: work is spread by features as well as by series.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("_f"), C(f"`{f}`").cast("double").alias("_v"))
                        for i, f in enumerate(features)])
    long = df.select(*s.keys, s.order, F.inline(entries))
    moments = with_moments(long, Series([*s.keys, "_f"], s.order), "_v", window, "_w")
    std = F.sqrt(C("_w_squares") / (C("_w_n") - 1))
    z = F.when(C("_w_n") >= window // 2, (C("_v") - C("_w_mean")) / (std + 1e-9))
    return moments.withColumn("_z", z).groupBy(*s.keys, s.order).agg(*[
        F.max(F.when(C("_f") == i, C("_z"))).alias(f) for i, f in enumerate(features)])


def normalise(df: DataFrame, features: list[str] | None = None,
              window: int = 252, bound: float = 5.0,
              s: Series = BY_SYMBOL) -> DataFrame:
    """Z-score and clip continuous features; flags and vol-scaled ones stay.

    ``df`` has one row per key and day.
    """
    if features is None:
        fixed = set(cfg.BINARY_FEATURES + cfg.VOL_SCALED_FEATURES)
        features = [c for c in df.columns
                    if c not in NOT_FEATURES and c not in fixed]
    features = [f for f in features if f in df.columns]
    names = df.columns
    if features:
        scores = rolling_zscores(df, features, window, s)
        rest = df.drop(*features)
        df = rest.join(scores, [*s.keys, s.order]).select(*[
            clip(C(f"`{c}`"), -bound, bound).alias(c) if c in features else C(f"`{c}`") for c in names])
    if "overnight_share" in names:
        df = df.withColumn("overnight_share", clip(C("overnight_share"), -1.0, 1.0))
    return df


def distribution_profile(df: DataFrame, names: list[str] | None = None):
    """One row per numeric column from a single aggregation pass; none for an empty frame."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    names = names or [n for n, t in df.dtypes if t in numeric]
    # below each other: one small aggregate instead of six expressions a column
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), C(n).cast("double").alias("x"),
                                 F.lit(n in cfg.BINARY_FEATURES).alias("is_binary")) for n in names])
    x = C("x")
    beyond = F.when(~C("is_binary") & (F.abs(x) > 5), 1).otherwise(0)
    return df.select(F.inline(entries)).groupBy("feature", "is_binary").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.avg(x.isNull().cast("int")) * 100).alias("pct_null"),
        F.sum(beyond).cast("long").alias("outliers_beyond_5"))


def scaling_metadata(spark: SparkSession) -> DataFrame:
    """Type, clip bounds and scaling of the features that are not z-scored."""
    rows = [(f, "binary", None, None, "none") for f in cfg.BINARY_FEATURES]
    rows += [(f, "vol_scaled", -3.0, 3.0, "none") for f in cfg.VOL_SCALED_FEATURES]
    return local_frame(spark, rows, "feature_name string, feature_type string,"
                       " clip_min double, clip_max double, scaling string")


def annotate_registry(registry: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Add scaling, clip bounds, binary and exclusion marks to the registry."""
    kind, name = C("feature_type"), C("feature_name")
    binary_name = name.isin([f for f in cfg.BINARY_FEATURES
                             if f != "days_since_prev"])
    binary = (kind == "regime") | (
        binary_name & ~kind.isin("macro", "lagged", "target"))
    zscore = kind.isin("technical", "macro", "lagged") & ~binary & ~name.isin(
        "days_since_prev")
    bound = F.when(zscore, 5.0).when(kind == "target", 3.0)
    marked = registry.withColumns({
        "scaling_method": (F.when(kind == "target", "vol_scaled")
                           .when(binary, "none").when(zscore, "zscore")),
        "clip_min": -bound, "clip_max": bound, "is_binary": binary})
    gone = exclusions.select("feature_name", F.lit(True).alias("x"))
    return (marked.join(gone, "feature_name", "left")
            .withColumn("is_excluded", F.coalesce("x", F.lit(False))).drop("x"))
