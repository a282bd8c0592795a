"""Macro, cross-asset, event, regime and joined-feature queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalars import round_frame
from ..operators import calendars as K
from ..operators import cross_asset as X
from ..operators import macro as M
from ..operators import regimes as G
from ..plans.feature_build import Inputs, build_features, with_context
from ..operators.technical import BY_SYMBOL
from ..sources import market
from ..sources.keyed import stage
from .base_sql import _MACRO_OUT, last_in, over, r, rs
from .registry import query

KEY = ["symbol", "date"]
# observations are means of a few cents: ten digits lie beyond exact ties
FINE = 10


def _cal(spark, sf):
    return market.trading_calendar(spark, sf)


def _daily(spark, sf):
    return M.macro_daily(market.macro_raw(spark, sf), _cal(spark, sf))


def _events(spark, sf):
    return _events_in(spark, _cal(spark, sf))


def _events_in(spark, calendar):
    """Fixed releases inside the calendar's own range."""
    span = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    fixed = K.fixed_events(spark, shift_days=cfg.FIXTURE_EVENT_SHIFT_DAYS)
    return (fixed.join(F.broadcast(span), F.col("date").between(
        F.col("lo"), F.col("hi"))).drop("lo", "hi"))


def inputs(spark, sf):
    """Bars are used by several branches: reduce the raw rows once, then read
    the daily rows back.  Their dates are the trading calendar."""
    bars = stage(spark, market.daily_bars(spark, sf), "bars")
    calendar = bars.select("date").distinct()
    return Inputs(bars, M.macro_daily(market.macro_raw(spark, sf), calendar),
                  _events_in(spark, calendar))


# --- calendar lookups ------------------------------------------------------------
@query("macro_observations", "S3", f"""
SELECT series_key, date, {r('value', 10)} FROM mraw WHERE date IS NOT NULL""")
def macro_observations(spark, sf):
    df = market.macro_raw(spark, sf).where("date IS NOT NULL")
    return round_frame(df.dropDuplicates(["series_key", "date"]), FINE)


@query("same_or_next_trading_day", "J8 A1", """
SELECT series_key, date, trading_date FROM malign""")
def same_or_next_trading_day(spark, sf):
    return M.align_to_trading_days(
        market.macro_raw(spark, sf), _cal(spark, sf)).drop("value")


@query("next_trading_day", "J9", f"""
SELECT date, CASE WHEN n - date <= 10 THEN n END AS next_date
FROM (SELECT date, lead(date) {over('')} AS n FROM cal)""")
def next_trading_day(spark, sf):
    return K.next_trading_day(_cal(spark, sf))


@query("trading_day_members", "P5 A4", f"""
SELECT series_key, date, {r('value', 10)} FROM mraw WHERE date IN (SELECT date FROM cal)""")
def trading_day_members(spark, sf):
    return round_frame(M.keep_trading_days(
        market.macro_raw(spark, sf), _cal(spark, sf)).select(
            "series_key", "date", "value"), FINE)


# --- macro ---------------------------------------------------------------------------
@query("deduplicated_observations", "A2", f"""
SELECT series_key, date, {r('value', 10)} FROM mdedupe""")
def deduplicated_observations(spark, sf):
    return round_frame(M.dedupe_by_day(M.align_to_trading_days(
        market.macro_raw(spark, sf), _cal(spark, sf))), FINE)


@query("gap_limited_fill", "A3 A4", f"""
SELECT series_key, date, {r('value', 10)}, days_since_update FROM mdaily""")
def gap_limited_fill(spark, sf):
    return round_frame(_daily(spark, sf).select(
        "series_key", "date", "value", "days_since_update"), FINE)


@query("macro_wide", "J2", f"""
SELECT date, {', '.join(r(k + '_raw', FINE, k) for k in cfg.MACRO_KEYS)} FROM mwide""")
def macro_wide(spark, sf):
    return round_frame(M.pivot_series(
        _daily(spark, sf), "series_key", cfg.MACRO_KEYS, "value"), FINE)


@query("macro_features", "A6 A7 A8 A9 A10", f"""
SELECT date, {rs(_MACRO_OUT, FINE)}, liquidity_expanding FROM mfeat""")
def macro_features(spark, sf):
    return round_frame(M.macro_features(_daily(spark, sf)).select(
        "date", *_MACRO_OUT, "liquidity_expanding"), FINE)


@query("merged_history", "A11", f"""
SELECT series_key, date, {r('value', 10)} FROM (
  SELECT series_key, date, value + 1 AS value FROM mdaily WHERE date >= DATE '2000-01-01'
  UNION ALL SELECT series_key, date, value FROM mdaily WHERE date < DATE '2000-01-01')""")
def merged_history(spark, sf):
    daily = _daily(spark, sf).select("series_key", "date", "value")
    new = daily.where("date >= '2000-01-01'").withColumn("value", F.col("value") + 1)
    return round_frame(M.merge_latest(
        daily, new, ["series_key", "date"], prefer="new"), FINE)


@query("bounded_forward_fill", "A5", f"""
SELECT symbol, date, {r(last_in('dgs10', 5), FINE, 'dgs10')},
  {r(last_in('rrp_level', 5), FINE, 'rrp_level')}, {r('m.vix', FINE, 'vix')}
FROM (SELECT b.symbol, b.date, DGS10_raw AS dgs10, RRPONTSYD_raw AS rrp_level, b.close AS vix
      FROM bars b LEFT JOIN mwide USING (date)) m""")
def bounded_forward_fill(spark, sf):
    wide = M.pivot_series(_daily(spark, sf), "series_key",
                          ["DGS10", "RRPONTSYD"], "value")
    df = market.etf_bars(spark, sf).join(K.per_date(wide), "date", "left").select(
        *KEY, F.col("DGS10").alias("dgs10"), F.col("RRPONTSYD").alias("rrp_level"),
        F.col("close").alias("vix"))
    return round_frame(M.bounded_fill(df, BY_SYMBOL), FINE)


# --- cross-asset -----------------------------------------------------------------------
@query("wide_closes", "X1 J2", "SELECT date, " + ", ".join(
    r(f'"{s}_close"', 6, f"{s}_close") for s in cfg.PROXY_SYMBOLS + ["SPY"]) + " FROM xwide")
def wide_closes(spark, sf):
    return round_frame(X.wide_closes(market.daily_bars(spark, sf),
                                     cfg.PROXY_SYMBOLS + ["SPY"]))


def _proxy(names):
    def run(spark, sf):
        df = X.proxy_features(market.daily_bars(spark, sf))
        return round_frame(df.select("date", *names))
    return run


_VIX = ["vix_level", "vix_change_1d", "vix_change_5d", "vix_pct_change_1d",
        "vix_term_structure"]
_RET = [f"{n}_ret_{k}d" for n in ("dxy", "gold", "oil", "hyg") for k in (1, 5, 20)]
_BOND = [f"{n}_ret_{k}d" for n in ("lqd", "tlt") for k in (1, 5, 20)]
for _name, _ids, _cols in (
        ("vix_features", "X2", _VIX), ("delayed_asset_returns", "X3", _RET),
        ("bond_returns", "X4", _BOND),
        ("credit_vs_equity", "X5 X6", ["hyg_vs_spy_5d", "hyg_spy_corr_20d"]),
        ("breadth_ratio", "X7", ["rsp_spy_ratio", "rsp_spy_ratio_ma20",
                                 "rsp_spy_ratio_z"])):
    query(_name, _ids, f"SELECT date, {rs(_cols)} FROM xfeat")(_proxy(_cols))

_REL = [f"{c}_spy_ratio{t}" for c in ("qqq", "iwm") for t in ("", "_ma20", "_z")]


@query("relative_strength_ratios", "X8", f"SELECT date, {rs(_REL)} FROM rfeat")
def relative_strength_ratios(spark, sf):
    return round_frame(X.relative_strength(market.etf_bars(spark, sf)).select(
        "date", *_REL))


# --- events -------------------------------------------------------------------------------
@query("release_calendar", "E1 E2 Q11", """
SELECT date, event_type, event_name, source FROM evcal""")
def release_calendar(spark, sf):
    return _events(spark, sf)


for _name, _ids, _kind, _fn in (
        ("month_end_days", "E3", "month_end", K.month_end_events),
        ("quarter_end_days", "E4", "quarter_end", K.quarter_end_events),
        ("options_expiry_weeks", "E5", "options_expiry_week", K.options_expiry_weeks)):
    query(_name, _ids, f"""
SELECT date, event_type, event_name, source FROM evfull WHERE event_type = '{_kind}'""")(
        lambda spark, sf, fn=_fn: fn(_cal(spark, sf)))


@query("event_flags_on_bars", "E6 J6", """
SELECT symbol, date, coalesce(is_fomc, 0) AS is_fomc,
  coalesce(is_cpi_release, 0) AS is_cpi_release, coalesce(is_nfp_release, 0) AS is_nfp_release
FROM bars LEFT JOIN evflags USING (date)""")
def event_flags_on_bars(spark, sf):
    bars = market.etf_bars(spark, sf).select(*KEY)
    return K.with_event_flags(bars, _events(spark, sf)).select(
        *KEY, *[f"is_{t}" for t in cfg.ALLOWED_EVENTS])


# --- joined features ------------------------------------------------------------------------
@query("context_join", "J1", f"""
SELECT b.symbol, b.date, {r('b.close', 6, 'close')}, {rs(['yield_curve_slope', 'hy_oas_level'], FINE)},
  {rs(['vix_level', 'gold_ret_5d', 'qqq_spy_ratio'])}, coalesce(is_fomc, 0) AS is_fomc
FROM bars b LEFT JOIN mfeat USING (date) LEFT JOIN xfeat USING (date)
LEFT JOIN rfeat USING (date) LEFT JOIN evflags USING (date)""")
def context_join(spark, sf):
    t = inputs(spark, sf)
    df = with_context(t.etf_bars.select(*KEY, "close"), M.macro_features(t.macro),
                      X.proxy_features(t.bars), X.relative_strength(t.bars),
                      events=t.events)
    return round_frame(df.select(*KEY, "close", "yield_curve_slope", "hy_oas_level",
                                 "vix_level", "gold_ret_5d", "qqq_spy_ratio", "is_fomc"),
                       {"": 6, "yield_curve_slope": FINE, "hy_oas_level": FINE})


_FLAGS = ", ".join(cfg.REGIME_FLAGS)


def _regimes(spark, sf):
    t = inputs(spark, sf)
    df = with_context(t.etf_bars.select(*KEY, "close"), M.macro_features(t.macro),
                      X.proxy_features(t.bars))
    return G.with_regimes(M.bounded_fill(df, BY_SYMBOL)).select(
        *KEY, *cfg.REGIME_FLAGS)


@query("regime_flags", "G1 G2 G3 G4 G5", f"SELECT symbol, date, {_FLAGS} FROM regs")
def regime_flags(spark, sf):
    return _regimes(spark, sf)


@query("liquidity_from_balance_sheet", "G4", f"""
SELECT date, CASE WHEN WALCL_raw - lag(WALCL_raw, 20) {over('')} > 0 THEN 1 ELSE 0 END
  AS liquidity_expanding_regime FROM mwide""")
def liquidity_from_balance_sheet(spark, sf):
    wide = M.pivot_series(_daily(spark, sf), "series_key", ["WALCL"], "value")
    return wide.select("date", G.liquidity("WALCL", s=K.BY_DATE)
                       .alias("liquidity_expanding_regime"))


@query("regime_summary", "G6", " UNION ALL ".join(
    f"SELECT '{f}' AS regime, {r(f'avg({f}) * 100', 4, 'pct_active')},"
    f" CAST(sum({f}) AS BIGINT) AS total_days FROM regs" for f in cfg.REGIME_FLAGS))
def regime_summary(spark, sf):
    return round_frame(G.regime_summary(_regimes(spark, sf)), 4)


@query("regime_co_occurrence", "G7", """
SELECT count(*) FILTER (WHERE high_vol_regime = 1 AND curve_inverted = 1) AS days FROM regs""")
def regime_co_occurrence(spark, sf):
    return G.co_occurrence(_regimes(spark, sf))


OUT = ["log_ret_1d", "vol_20", "rsi_14", "macd_hist", "adx_14", "price_rsq_20",
        "return_autocorr_20", "overnight_share", "volume_z", "dd_60",
        "yield_curve_slope", "hy_oas_change_1d", "fed_balance_sheet_change_pct",
        "rrp_change_pct_5d", "vix_level", "vix_term_structure", "hyg_vs_spy_5d",
        "hyg_spy_corr_20d", "rsp_spy_ratio_z", "qqq_spy_ratio_z", "iwm_spy_ratio_z",
        "log_ret_1d_lag5", "vix_change_1d_lag3", "yield_curve_slope_lag1"]
INT = ["sma20_gt_sma50", "dow", "days_since_prev", "is_fomc", *cfg.REGIME_FLAGS]


@query("full_feature_build", "F1 F2", f"""
SELECT symbol, date, {rs(OUT, 4)}, {', '.join(INT)} FROM feats""")
def full_feature_build(spark, sf):
    return round_frame(build_features(inputs(spark, sf)).select(
        *KEY, *OUT, *INT), 4)


