"""Macro series: alignment to trading days, gap-limited filling, derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series
from ..functions.scalars import flag
from .calendars import BY_DATE, per_date, roll_forward_map

C = F.col
BY_SERIES = Series(["series_key"], "date")


def align_to_trading_days(raw: DataFrame, calendar: DataFrame,
                          max_days: int = 7) -> DataFrame:
    """Move each observation to its trading day; unmatched ones are dropped."""
    return (raw.join(per_date(roll_forward_map(calendar, max_days)), "date")
            .select("series_key", "date", "trading_date", "value"))


def dedupe_by_day(aligned: DataFrame, skip_null: bool = False) -> DataFrame:
    """First observation per (series, trading day) in observation order.

    By default an earlier empty observation wins over a later value, as a
    plain keep-first does; ``skip_null`` ignores empty observations.
    """
    if skip_null:
        aligned = aligned.where(C("value").isNotNull())
    return (aligned.groupBy("series_key", C("trading_date").alias("day"))
            .agg(F.min_by("value", "date").alias("value"))
            .withColumnRenamed("day", "date"))


def fill_with_tracking(obs: DataFrame, max_gap_days: int = cfg.MAX_GAP_DAYS):
    """Daily series carrying each value up to ``max_gap_days`` forward.

    Every observation is expanded over the days it stays current, so the work
    is proportional to the output and needs no calendar join.
    """
    last_day = F.max("date").over(BY_SERIES.whole)
    known = (obs.withColumn("last_day", last_day)
             .where(C("value").isNotNull())
             .withColumn("next_obs", BY_SERIES.lead("date")))
    until = F.least(F.date_sub("next_obs", 1), C("last_day"),
                    F.date_add("date", max_gap_days))
    days = known.select("series_key", C("date").alias("seen"), "value",
                        F.explode(F.sequence(C("date"), until)).alias("date"))
    return days.select("series_key", "date", "value",
                       F.datediff("date", "seen").alias("days_since_update"))


def keep_trading_days(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return df.join(per_date(calendar), "date", "left_semi")


def macro_daily(raw: DataFrame, calendar: DataFrame,
                max_gap_days: int = cfg.MAX_GAP_DAYS,
                skip_null: bool = False) -> DataFrame:
    """(series_key, date, value, days_since_update) on trading days."""
    obs = dedupe_by_day(align_to_trading_days(raw, calendar), skip_null)
    return keep_trading_days(fill_with_tracking(obs, max_gap_days), calendar)


def pivot_series(df: DataFrame, key: str, names: list[str], value: str,
                 suffix: str = "") -> DataFrame:
    """Long to wide on date with a declared column list: one aggregation does
    the work of a chain of outer joins."""
    cells = [F.max(F.when(C(key) == n, C(value))).alias(f"{n}{suffix}")
             for n in names]
    return df.groupBy("date").agg(*cells)


def derived_macro(wide: DataFrame, s: Series = BY_DATE) -> DataFrame:
    """Levels, changes and liquidity columns; absent series are skipped."""
    have = set(wide.columns)
    out: dict = {}
    if "DGS10" in have:
        out["dgs10"] = C("DGS10")
    if "DGS2" in have:
        out["dgs2"] = C("DGS2")
    if {"DGS10", "DGS2"} <= have:
        out["yield_curve_slope"] = C("DGS10") - C("DGS2")
    for raw, name in (("DGS10", "dgs10"), ("DGS2", "dgs2")):
        if raw in have:
            out[f"{name}_change_1d"] = s.diff(raw, 1, shift=1)
            out[f"{name}_change_5d"] = s.diff(raw, 5, shift=1)
    if "BAMLH0A0HYM2" in have:
        out["hy_oas_level"] = C("BAMLH0A0HYM2")
        out["hy_oas_change_1d"] = s.diff("BAMLH0A0HYM2", 1, shift=1)
        out["hy_oas_change_5d"] = s.diff("BAMLH0A0HYM2", 5, shift=1)
    if "WALCL" in have:
        out["fed_balance_sheet_change_pct"] = s.pct_change("WALCL", 5, shift=1)
        out["liquidity_expanding"] = flag(s.diff("WALCL", 20, shift=1) > 0)
    if "RRPONTSYD" in have:
        out["rrp_level"] = C("RRPONTSYD")
        out["rrp_change_pct_5d"] = s.pct_change("RRPONTSYD", 5, shift=1)
    # DGS10 / dgs10 differ only by case: rename the raw ones after use
    return wide.select(
        "date", *[C(k).alias(f"{k}_raw") for k in wide.columns if k != "date"],
        *[v.alias(k) for k, v in out.items()])


def macro_features(daily: DataFrame, names: list[str] | None = None) -> DataFrame:
    return derived_macro(
        pivot_series(daily, "series_key", names or cfg.MACRO_KEYS, "value"))


def bounded_fill(df: DataFrame, s: Series, limit: int = cfg.FILL_LIMIT_ROWS):
    """Forward-fill macro-looking columns over at most ``limit`` rows."""
    hit = [c for c in df.columns
           if any(h in c.lower() for h in cfg.MACRO_COLUMN_HINTS)]
    return df.withColumns({c: s.filled(c, limit) for c in hit}) if hit else df


def merge_latest(history: DataFrame, new: DataFrame, keys: list[str],
                 prefer: str = "new") -> DataFrame:
    """Union of both frames with one row per key, from the preferred side."""
    first, second = (new, history) if prefer == "new" else (history, new)
    return first.unionByName(second.join(first, keys, "left_anti"))
