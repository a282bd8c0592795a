"""Dataset views over the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalars import safe_div
from ..sources import market
from .calendars import event_flags, per_date
from .feature_store import unpack_features
from .targets import barrier_classes, target_diagnostics

C = F.col
KEY = ["symbol", "date"]
OHLCV = ["open", "high", "low", "close", "adj_close", "volume"]


@dataclass
class Tables:
    """Stored tables in the shape the views expect."""

    bars: DataFrame
    features: DataFrame
    labels: DataFrame
    macro: DataFrame
    events: DataFrame
    assets: DataFrame

    @staticmethod
    def of(spark: SparkSession, store) -> "Tables":
        return Tables(store.bars.read(), store.features.read(),
                      store.labels.read(), store.macro.read(),
                      store.events.read(), market.assets(spark))

    @property
    def etf_assets(self) -> DataFrame:
        return self.assets.where(C("asset_type") == "ETF")


def star(t: Tables, features: DataFrame | None = None,
         labels: DataFrame | None = None, etf_only: bool = True) -> DataFrame:
    """Bars with their asset, features and labels where present.

    The big tables share the (symbol, date) key, so both left joins run on one
    distribution; the asset dimension is a 14-row local relation.
    """
    who = (t.etf_assets if etf_only else t.assets).select("symbol")
    df = t.bars.select(*KEY, *OHLCV).join(who, "symbol", "left_semi")
    df = df.join(t.features if features is None else features, KEY, "left")
    return df.join(t.labels if labels is None else labels, KEY, "left")


def features_pruned(t: Tables) -> DataFrame:
    return unpack_features(t.features, cfg.PRUNED_FEATURES)


def model_dataset_raw(t: Tables) -> DataFrame:
    """Bars, feature document and legacy labels of all assets."""
    return star(t, labels=t.labels.select(*KEY, "y_1d", "y_5d", "y_thresh"),
                etf_only=False)


def model_dataset(t: Tables) -> DataFrame:
    return star(t, features_pruned(t),
                t.labels.select(*KEY, "y_1d", "y_5d", "y_thresh"))


def model_dataset_enhanced(t: Tables) -> DataFrame:
    """Adds a boolean per event type: does such an event fall on the date."""
    kinds = cfg.CALENDAR_EVENTS + cfg.ALLOWED_EVENTS
    names = {k: f"is_{k}" + ("_day" if k in cfg.ALLOWED_EVENTS else "")
             for k in kinds}
    flags = event_flags(t.events, kinds)
    df = star(t, labels=t.labels.select(*KEY, "y_1d", "y_5d", "y_thresh"))
    df = df.join(per_date(flags), "date", "left")
    marks = [(F.coalesce(C(f"is_{k}"), F.lit(0)) == 1).alias(names[k]) for k in kinds]
    return df.select(*KEY, *OHLCV, "feature_json", "y_1d", "y_5d", "y_thresh", *marks)


def regression_dataset(t: Tables) -> DataFrame:
    labels = t.labels.select(
        *KEY, "y_1d_raw", "y_5d_raw", "y_1d_vol", "y_5d_vol", "y_1d_clipped",
        "y_5d_clipped", C("y_1d").alias("y_1d_class"),
        C("y_5d").alias("y_5d_class"), C("y_thresh").alias("y_thresh_class"))
    return star(t, unpack_features(t.features, cfg.REGRESSION_FEATURES), labels)


def regression_dataset_optimized(t: Tables) -> DataFrame:
    """Primary target and model features, rows with a target only."""
    df = star(t, unpack_features(t.features, cfg.MODEL_FEATURES),
              t.labels.select(*KEY, "primary_target"))
    return df.where(C("primary_target").isNotNull()).select(
        *KEY, "primary_target", *cfg.MODEL_FEATURES)


def regression_diagnostics(t: Tables) -> DataFrame:
    """All targets with their running deviation, newest first."""
    df = target_diagnostics(t.labels.join(
        t.etf_assets.select("symbol"), "symbol", "left_semi"))
    return df.select(
        *KEY, "y_1d_raw", "y_5d_raw", "y_1d_vol", "y_5d_vol", "y_1d_clipped",
        "y_5d_clipped", "y_1d_vol_clip", "y_5d_vol_clip", "primary_target",
        C("y_1d").alias("y_1d_class"), C("y_5d").alias("y_5d_class"),
        C("y_thresh").alias("y_thresh_class"), "y_1d_raw_std_252",
        "y_1d_vol_std_252", "y_1d_vol_clip_std_252",
    ).orderBy(C("date").desc(), "symbol")


def classification_dataset(t: Tables, horizon: int = 1,
                           labels: DataFrame | None = None) -> DataFrame:
    """Class and model features, rows with a known class only."""
    target = f"y_class_{horizon}d"
    labels = (t.labels if labels is None else labels).select(*KEY, target)
    df = star(t, unpack_features(t.features, cfg.MODEL_FEATURES), labels)
    return df.where(C(target).isNotNull()).select(*KEY, target, *cfg.MODEL_FEATURES)


def _class_stats() -> list:
    n = F.count("*")
    out = [n.alias("total_rows")]
    for name, k in (("buy", 1), ("sell", -1), ("hold", 0)):
        hits = F.sum((C("y_class_1d") == k).cast("long"))
        out += [hits.alias(f"count_{name}"),
                F.round(100.0 * hits / n, 2).alias(f"pct_{name}")]
    return out


def _classed(t: Tables) -> DataFrame:
    return (barrier_classes(t.labels).where(C("y_class_1d").isNotNull())
            .join(t.etf_assets.select("symbol"), "symbol", "left_semi"))


def classification_stats(t: Tables) -> DataFrame:
    return _classed(t).groupBy("symbol").agg(*_class_stats()).orderBy("symbol")


def classification_stats_overall(t: Tables) -> DataFrame:
    stats = _classed(t).agg(*_class_stats())
    return stats.select(F.lit("ALL").alias("symbol"), "*")


def feature_manifest(registry: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Registry with scaling rules and the reason of every exclusion."""
    reasons = exclusions.select("feature_name", C("reason").alias("exclusion_reason"))
    return (registry.join(reasons, "feature_name", "left")
            .select("feature_name", "feature_type", "description", "window_size",
                    "scaling_method", "is_binary", "clip_min", "clip_max",
                    "is_excluded", "exclusion_reason")
            .orderBy("is_excluded", "feature_type", "feature_name"))


def optimization_summary(t: Tables, exclusions: DataFrame) -> DataFrame:
    """(category, value, description): fixed facts, counts and coverage."""
    spark = t.bars.sparkSession
    from ..sources.local import local_frame

    fixed = local_frame(spark, cfg.SUMMARY_FACTS, "category string, value string, description string")

    def line(df, category, value, text):
        return df.select(F.lit(category).alias("category"),
                         value.cast("string").alias("value"),
                         F.lit(text).alias("description"))

    classed = _classed(t)
    span = (barrier_classes(t.labels).where(C("y_class_1d").isNotNull())
            .agg(F.min("date").alias("a"), F.max("date").alias("b")))
    return (fixed
            .unionByName(line(exclusions.agg(F.count("*").alias("n")),
                              "Features Excluded", C("n"),
                              cfg.SUMMARY_TEXTS["Features Excluded"]))
            .unionByName(line(t.etf_assets.agg(
                F.countDistinct("symbol").alias("n")), "Total Symbols", C("n"),
                cfg.SUMMARY_TEXTS["Total Symbols"]))
            .unionByName(line(span, "Date Range", F.format_string(
                "%s to %s", C("a").cast("string"), C("b").cast("string")),
                cfg.SUMMARY_TEXTS["Date Range"]))
            .unionByName(line(classed.agg(F.count("*").alias("n")),
                              "Classification Rows", C("n"),
                              cfg.SUMMARY_TEXTS["Classification Rows"])))


# --- readable views ------------------------------------------------------------
def _described(df: DataFrame, t: Tables, *extra: str) -> DataFrame:
    who = t.assets.select("symbol", C("description").alias("asset_description"), *extra)
    return df.join(who, "symbol")


def daily_bars_readable(t: Tables) -> DataFrame:
    pct = safe_div(C("close") - C("open"), C("open")) * 100
    return _described(t.bars, t, "asset_type").select(
        "symbol", "asset_description", "asset_type", "date",
        F.rpad(F.date_format("date", "EEEE"), 9, " ").alias("day_of_week"),
        *OHLCV, F.round(pct, 2).alias("intraday_pct"),
        F.round(C("volume") / 1000000.0, 2).alias("volume_millions"),
    ).orderBy(C("date").desc(), "symbol")


def features_daily_readable(t: Tables) -> DataFrame:
    return _described(t.features, t).select(
        "symbol", "asset_description", "date", "feature_json",
    ).orderBy(C("date").desc(), "symbol")


def labels_daily_readable(t: Tables) -> DataFrame:
    return _described(t.labels, t).select(
        "symbol", "asset_description", "date", "y_1d_raw", "y_5d_raw",
        "y_1d_vol", "y_5d_vol", "y_1d_clipped", "y_5d_clipped", "y_1d", "y_5d",
        "y_thresh").orderBy(C("date").desc(), "symbol")


def macro_daily_readable(t: Tables, catalogue: DataFrame) -> DataFrame:
    meta = catalogue.select("series_key", "name", "description", "units")
    return (t.macro.join(meta, "series_key", "left")
            .select("date", C("series_key").alias("code"), "name",
                    "description", "value", "units")
            .orderBy(C("date").desc(), "name"))


def events_readable(t: Tables, metadata: DataFrame) -> DataFrame:
    text = F.concat(F.rpad(F.date_format("date", "EEEE"), 9, " "),
                    F.date_format("date", ", MMM dd, yyyy"))
    meta = metadata.select("event_type", C("name").alias("event_name"),
                           "description", "typical_impact")
    return (t.events.select("date", "event_type").join(meta, "event_type", "left")
            .select("date", text.alias("date_formatted"),
                    C("event_type").alias("code"), "event_name", "description",
                    "typical_impact")
            .orderBy(C("date").desc()))


# --- wide exports -----------------------------------------------------------------
def wide_export(t: Tables, targets=("y_class_1d",), etf_only: bool = True,
                features: list[str] | None = None) -> DataFrame:
    """Labelled rows joined to their unpacked features, identifiers first."""
    labels = t.labels.where(C(targets[-1]).isNotNull()).select(*KEY, *targets)
    names = cfg.MODEL_FEATURES if features is None else features
    df = labels.join(unpack_features(t.features, names), KEY)
    who = (t.etf_assets if etf_only else t.assets).select("symbol")
    return df.join(who, "symbol", "left_semi").select(*KEY, *targets, *names)


VIEWS = {
    "v_features_pruned": features_pruned,
    "v_model_dataset": model_dataset,
    "v_model_dataset_enhanced": model_dataset_enhanced,
    "v_regression_dataset": regression_dataset,
    "v_regression_dataset_optimized": regression_dataset_optimized,
    "v_regression_diagnostics": regression_diagnostics,
    "v_classification_dataset_1d": classification_dataset,
    "v_classification_dataset_5d": lambda t: classification_dataset(t, 5),
    "v_classification_stats_1d": classification_stats,
    "v_classification_stats_1d_overall": classification_stats_overall,
    "v_daily_bars_readable": daily_bars_readable,
    "v_features_daily_readable": features_daily_readable,
    "v_labels_daily_readable": labels_daily_readable,
}


def register_views(spark: SparkSession, t: Tables) -> list[str]:
    """Expose every view to SQL; Catalyst inlines and prunes them per query."""
    frames = {name: build(t) for name, build in VIEWS.items()}
    frames["v_macro_daily_readable"] = macro_daily_readable(
        t, market.macro_catalogue(spark))
    frames["v_events_readable"] = events_readable(
        t, market.event_type_metadata(spark))
    exclusions = market.feature_exclusions(spark)
    from .normalization import annotate_registry

    frames["v_feature_manifest"] = feature_manifest(
        annotate_registry(market.feature_registry(spark), exclusions), exclusions)
    frames["v_optimization_summary"] = optimization_summary(t, exclusions)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return sorted(frames)
