"""Targets, classes and row-level column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import technical as T
from ..operators import targets as L
from ..sources import market
from .base_sql import over, r, rs
from .registry import query

KEY = ["symbol", "date"]
C = F.col


def labels(spark, sf, **kw):
    return L.build_labels(T.realized_vol_20(market.etf_bars(spark, sf)), **kw)


def _label_query(name, ids, doubles, ints=(), digits=6):
    cols = ", ".join([rs(doubles, digits)] * bool(doubles) + list(ints))

    @query(name, ids, f"SELECT symbol, date, {cols} FROM lab")
    def run(spark, sf):
        return S.round_frame(labels(spark, sf).select(*KEY, *doubles, *ints), digits)


_label_query("outcome_prices", "L1", ["outcome_price_1d", "outcome_price_5d"])
_label_query("forward_returns", "L2", ["y_1d_raw", "y_5d_raw"])
_label_query("vol_scaled_returns", "L3", ["y_1d_vol", "y_5d_vol"])
_label_query("clipped_returns", "L4", ["y_1d_clipped", "y_5d_clipped"])
_label_query("clipped_vol_targets", "L5",
             ["y_1d_vol_clip", "y_5d_vol_clip", "primary_target"])
_label_query("binary_classes", "L6", [], ["y_class_1d", "y_class_5d"])
_label_query("legacy_labels", "L8", [], ["y_1d", "y_5d", "y_thresh"])


@query("triple_barrier_classes", "L7 P6", """
SELECT symbol, date, y_class_1d, y_class_5d FROM lab3""")
def triple_barrier_classes(spark, sf):
    return L.barrier_classes(labels(spark, sf)).select(
        *KEY, "y_class_1d", "y_class_5d")


@query("complete_labels_only", "L9", f"""
SELECT symbol, date, {rs(['y_1d_raw', 'y_5d_raw'])}, y_class_5d FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM lab)
WHERE back > 5""")
def complete_labels_only(spark, sf):
    return S.round_frame(labels(spark, sf, keep_incomplete=False).select(
        *KEY, "y_1d_raw", "y_5d_raw", "y_class_5d"))


@query("backfilled_targets", "L10 P7", f"""
SELECT symbol, date, {rs(['y_1d_vol_clip', 'y_5d_vol_clip'])},
  {r('y_1d_vol_clip', 6, 'primary_target')} FROM lab""")
def backfilled_targets(spark, sf):
    stale = labels(spark, sf).withColumns({
        c: F.lit(None).cast("double")
        for c in ("y_1d_vol_clip", "y_5d_vol_clip", "primary_target")})
    return S.round_frame(L.backfill_targets(stale).select(
        *KEY, "y_1d_vol_clip", "y_5d_vol_clip", "primary_target"))


@query("target_running_deviation", "W23", f"""
SELECT symbol, date, {', '.join(r(f"stddev_samp({c}) " + over(frame='ROWS BETWEEN 252 PRECEDING AND CURRENT ROW'), 6, f'{c}_std_252')
  for c in ('y_1d_raw', 'y_1d_vol', 'y_1d_vol_clip'))} FROM lab""")
def target_running_deviation(spark, sf):
    names = [f"{c}_std_252" for c in ("y_1d_raw", "y_1d_vol", "y_1d_vol_clip")]
    return S.round_frame(L.target_diagnostics(labels(spark, sf)).select(*KEY, *names))


# --- row-level rules ----------------------------------------------------------------
@query("etf_rows_only", "P3", """
SELECT b.symbol, b.date, b.volume FROM dbars b JOIN assets a USING (symbol)
WHERE a.asset_type = 'ETF'""")
def etf_rows_only(spark, sf):
    etf = market.assets(spark).where(C("asset_type") == "ETF").select("symbol")
    return market.daily_bars(spark, sf).join(etf, "symbol", "left_semi").select(
        *KEY, "volume")


@query("labelled_rows", "P4", """
SELECT symbol, date, y_class_5d FROM lab WHERE y_class_5d IS NOT NULL""")
def labelled_rows(spark, sf):
    return labels(spark, sf).where(C("y_class_5d").isNotNull()).select(
        *KEY, "y_class_5d")


@query("guarded_vol_scaling", "P14", f"""
SELECT symbol, date, {r('CASE WHEN vol_20 > 0 THEN y_1d_raw / vol_20 END', 6, 'scaled')}
FROM l2""")
def guarded_vol_scaling(spark, sf):
    tech = T.realized_vol_20(market.etf_bars(spark, sf))
    df = tech.select(*KEY, "vol_20").join(
        labels(spark, sf).select(*KEY, "y_1d_raw"), KEY)
    return S.round_frame(df.select(*KEY, S.vol_scaled(
        C("y_1d_raw"), C("vol_20")).alias("scaled")))


@query("non_hold_rows", "P13", """
SELECT symbol, date, y_class_1d FROM lab3 WHERE y_class_1d <> 0 OR y_class_1d IS NULL""")
def non_hold_rows(spark, sf):
    cls = L.barrier_classes(labels(spark, sf)).select(*KEY, "y_class_1d")
    return cls.where((C("y_class_1d") != 0) | C("y_class_1d").isNull())


@query("coerced_numbers", "P9", """
SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  try_cast(event_type AS DOUBLE) AS word, try_cast(CAST(value AS VARCHAR) AS DOUBLE) AS value
FROM events""")
def coerced_numbers(spark, sf):
    ev = market.table(spark, sf, "events")
    return ev.select(
        "event_id", S.coerce_double(F.get_json_object("props", "$.k")).alias("k"),
        S.coerce_double(C("event_type")).alias("word"),
        S.coerce_double(C("value").cast("string")).alias("value"))


@query("formatted_dates", "P10", """
SELECT date, rpad(dayname(date), 9, ' ') AS day_of_week,
  rpad(dayname(date), 9, ' ') || strftime(date, ', %b %d, %Y') AS date_formatted FROM cal""")
def formatted_dates(spark, sf):
    day = F.rpad(F.date_format("date", "EEEE"), 9, " ")
    return market.trading_calendar(spark, sf).select(
        "date", day.alias("day_of_week"),
        F.concat(day, F.date_format("date", ", MMM dd, yyyy")).alias("date_formatted"))


@query("display_columns", "P11", f"""
SELECT symbol, date, {r('(close - open) / nullif(open, 0) * 100', 6, 'intraday_pct')},
  {r('volume / 1000000e0', 6, 'volume_millions')} FROM dbars""")
def display_columns(spark, sf):
    b = market.daily_bars(spark, sf)
    return S.round_frame(b.select(
        *KEY, (S.safe_div(C("close") - C("open"), C("open")) * 100)
        .alias("intraday_pct"), (C("volume") / 1000000.0).alias("volume_millions")))


@query("surrogate_keys", "S14", """
SELECT b.symbol, b.date, CAST(a.id AS INTEGER) AS asset_id FROM dbars b JOIN (
  SELECT symbol, row_number() OVER (ORDER BY symbol) AS id FROM assets) a USING (symbol)""")
def surrogate_keys(spark, sf):
    from ..sources.keyed import surrogate_ids

    ids = surrogate_ids(market.assets(spark), "symbol", "asset_id")
    return market.daily_bars(spark, sf).select(*KEY).join(ids, "symbol")


