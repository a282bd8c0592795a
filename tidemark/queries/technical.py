"""Sources, returns, indicators and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.ema import with_ema
from ..functions.rolling import Series
from ..functions.scalars import round_frame
from ..operators import technical as T
from ..operators.feature_store import unpack_features
from ..operators.lags import lag_leakage, lag_names, with_lags
from ..operators.normalization import normalise
from ..sources import files, market
from .base_sql import over, pct, r, roll, rs
from .registry import query

KEY = ["symbol", "date"]
W = over()
FINE = 10  # digits off the grid that macro values lie on


# Digits beyond any exact decimal tie of a price average, and few enough for
# smoothed values whose summation order differs.
DIGITS = {"": 6, "sma_5": 7, "sma_10": 7, "sma_20": 7, "sma_50": 7, "sma_200": 7,
          "tr": 7, "atr_14": 7, "macd_hist": 4, "adx_14": 5,
          **{f"ema_{n}": 4 for n in (5, 10, 20, 50, 200)}}


def _technical(names):
    """Selected technical columns; Catalyst prunes every other window."""
    def run(spark, sf):
        df = T.technical_features(market.etf_bars(spark, sf), wanted=names)
        return round_frame(df.select(*KEY, *names), DIGITS)
    return run


def _tech_query(name, ids, names):
    ints = [n for n in names if n in ("dow", "days_since_prev", "sma20_gt_sma50")]
    cols = ", ".join(n if n in ints else rs([n], DIGITS) for n in names)
    cte = "tech" if set(names) & {"ema_20", "ema_50", "macd_hist", "adx_14"} else "t3"
    query(name, ids, f"SELECT symbol, date, {cols} FROM {cte}")(_technical(names))


# --- bars ------------------------------------------------------------------------
@query("bars_in_range", "S1 P1 P2", f"""
SELECT symbol, date, {rs(['open', 'high', 'low', 'close', 'adj_close'])}, volume
FROM dbars WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-29'""")
def bars_in_range(spark, sf):
    from datetime import date
    bars = market.daily_bars(spark, sf)
    return round_frame(files.normalise_bars(
        bars, start=date(1996, 1, 1), end=date(2000, 12, 29)))


@query("corporate_actions", "S2", f"""
SELECT symbol, date, {r('coalesce(dividend, 0)', 6, 'dividend')},
  {r('coalesce(split_ratio, 0)', 6, 'split_ratio')}
FROM (SELECT etf AS symbol, date, sum(round(l_tax * 100))::DOUBLE / 100 AS dividend
      FROM trades WHERE l_linestatus = 'F' GROUP BY 1, 2)
FULL JOIN (SELECT etf AS symbol, date, sum(round(l_discount * 100))::DOUBLE / 100 AS split_ratio
      FROM trades WHERE l_linestatus = 'O' GROUP BY 1, 2) USING (symbol, date)""")
def corporate_actions(spark, sf):
    return round_frame(files.corporate_actions(*market.corporate_actions_raw(spark, sf)))


# --- indicators ----------------------------------------------------------------------
_tech_query("log_returns", "W1", ["log_ret_1d", "log_ret_5d", "log_ret_20d"])
_tech_query("realized_volatility", "W2", ["vol_5", "vol_20", "vol_60"])
_tech_query("moving_averages", "W3", ["sma_20", "sma_50", "sma_200"])
_tech_query("exponential_averages", "W4", ["ema_20", "ema_50"])
_tech_query("average_crossover", "W5", ["sma20_gt_sma50"])
_tech_query("relative_strength_index", "W6", ["rsi_14"])
_tech_query("macd_histogram", "W7", ["macd_hist"])
_tech_query("true_range", "W8", ["tr", "atr_14"])
_tech_query("directional_index", "W10", ["adx_14"])
_tech_query("return_autocorrelation", "W11", ["return_autocorr_20"])
_tech_query("price_trend_fit", "W12", ["price_rsq_20"])
_tech_query("price_ranges", "W13", ["high_low_pct", "close_open_pct"])
_tech_query("volume_features", "W14 W15", ["volume_z", "volume_chg_pct"])
_tech_query("drawdown", "W16", ["rolling_max_60", "dd_60"])
_tech_query("calendar_position", "W17", ["dow", "days_since_prev"])
_tech_query("session_returns", "W18 W19 W20",
            ["overnight_return", "intraday_return", "overnight_mean_20",
             "overnight_std_20", "intraday_mean_20", "intraday_std_20",
             "overnight_share"])
_ALL = cfg.TECHNICAL_FEATURES + cfg.SESSION_FEATURES + cfg.TREND_FEATURES
_tech_query("technical_features", "W1-W20", _ALL)


_GAP = "dayofmonth(date) % 7 = 3"
_SPANS = (9, 20, 50)


@query("averages_over_gaps", "W4 W24", f"""
SELECT symbol, date, {rs([f'ema_{n}' for n in _SPANS], 6)} FROM (
  WITH RECURSIVE g AS (SELECT symbol, date, row_number() {W} AS rn,
      CASE WHEN {_GAP} THEN NULL ELSE close END AS c FROM bars),
  e AS (
    SELECT symbol, date, rn, {', '.join(f'c AS ema_{n}, 1e0 AS w_{n}' for n in _SPANS)} FROM g WHERE rn = 1
    UNION ALL
    SELECT g.symbol, g.date, g.rn, {', '.join(f"""
      CASE WHEN g.c IS NULL THEN p.ema_{n} WHEN p.ema_{n} IS NULL THEN g.c
           ELSE (p.w_{n} * (1 - 2e0 / {n + 1}) * p.ema_{n} + 2e0 / {n + 1} * g.c)
                / (p.w_{n} * (1 - 2e0 / {n + 1}) + 2e0 / {n + 1}) END,
      CASE WHEN g.c IS NOT NULL OR p.ema_{n} IS NULL THEN 1e0 ELSE p.w_{n} * (1 - 2e0 / {n + 1}) END"""
      for n in _SPANS)}
    FROM e p JOIN g ON g.symbol = p.symbol AND g.rn = p.rn + 1)
  SELECT * FROM e)""")
def averages_over_gaps(spark, sf):
    """Closes are missing on some days: the average is carried over them."""
    bars = market.etf_bars(spark, sf).withColumn("close", F.when(~F.expr(_GAP), F.col("close")))
    df = with_ema(bars, T.BY_SYMBOL, {f"ema_{n}": ("close", n) for n in _SPANS}, gaps=True)
    return round_frame(df.select(*KEY, *[f"ema_{n}" for n in _SPANS]), 6)


@query("on_balance_volume", "W9", f"""
SELECT symbol, date, {r(f'sum(coalesce(sign(delta), 0) * v) {W}', 2, 'obv')} FROM t1""")
def on_balance_volume(spark, sf):
    df = T.on_balance_volume(market.etf_bars(spark, sf))
    return round_frame(df.select(*KEY, "obv"), 2)


@query("window_width_sets", "W24", f"""
SELECT b.symbol, b.date, {rs(['log_ret_1d', 'log_ret_5d', 'log_ret_20d'])},
  {r(f"lag(lc, 1) {W} - lag(lc, 11) {W}", 6, 'log_ret_10d')},
  {rs(['vol_5', 'vol_20', 'vol_60'])}, {r(roll('stddev_samp', 'log_ret_1d', 10), 6, 'vol_10')},
  {r(roll('avg', 'close', 5), 7, 'sma_5')}, {r(roll('avg', 'close', 10), 7, 'sma_10')},
  {rs(['sma_20', 'sma_50', 'sma_200'], 7)},
  {r(f"close / nullif({roll('max', 'close', 20)}, 0) - 1", 6, 'dd_20')}, {rs(['dd_60'])},
  {', '.join(r(f'ema_{n}', 4, f'ema_{n}') for n in (5, 10, 20, 50, 200))}
FROM t3 b JOIN (
  WITH RECURSIVE e AS (
    SELECT symbol, date, rn, {', '.join(f'close AS ema_{n}' for n in (5, 10, 20, 50, 200))}
    FROM t1 WHERE rn = 1
    UNION ALL
    SELECT b.symbol, b.date, b.rn,
      {', '.join(f'b.close * (2e0 / {n + 1}) + p.ema_{n} * (1 - 2e0 / {n + 1})' for n in (5, 10, 20, 50, 200))}
    FROM e p JOIN t1 b ON b.symbol = p.symbol AND b.rn = p.rn + 1)
  SELECT * FROM e) e USING (symbol, date)""")
def window_width_sets(spark, sf):
    df = T.window_set(market.etf_bars(spark, sf))
    w = cfg.FeatureWindows()
    returns = [f"log_ret_{n}d" for n in w.returns]
    fine = returns + [f"vol_{n}" for n in w.volatility] + [f"dd_{n}" for n in w.drawdown]
    coarse = [f"sma_{n}" for n in w.sma] + [f"ema_{n}" for n in w.ema]
    return round_frame(df.select(*KEY, *fine, *coarse), DIGITS)


# --- the same kernels over many symbols --------------------------------------------
@query("wide_universe_returns", "W1-W3", f"""
SELECT symbol, date,
  {r(f'lag(ln(close), 1) {W} - lag(ln(close), 2) {W}', 6, 'log_ret_1d')},
  {r(roll('avg', 'close', 20), 7, 'sma_20')},
  {r(roll('stddev_samp', 'close', 20), 6, 'std_20')},
  {r(f"close / nullif({roll('max', 'close', 20)}, 0) - 1", 6, 'dd_20')}
FROM pbars""")
def wide_universe_returns(spark, sf):
    s = Series(["symbol"], "date")
    bars = market.part_bars(spark, sf)
    df = bars.select(*KEY, *[v.alias(k) for k, v in {
        **T.log_returns((1,), s), **T.moving_averages((20,), s),
        "std_20": s.std("close", 20), "dd_20": T.drawdowns((20,), s)["dd_20"],
    }.items()])
    return round_frame(df, DIGITS)


# --- lags and normalisation ----------------------------------------------------------
_LAGS = lag_names()


@query("lagged_features", "W21", "SELECT symbol, date, " + ", ".join(
    r(f"lag({f}, {n}) {W}", FINE, f"{f}_lag{n}") for f, ns in cfg.LAG_SPEC.items() for n in ns) + " FROM regs")
def lagged_features(spark, sf):
    """All lags, from the base columns of the stored documents."""
    bases = unpack_features(_stored_features(spark, sf), list(cfg.LAG_SPEC), {}, ())
    return round_frame(with_lags(bases).select(*KEY, *_LAGS), FINE)


@query("lag_leakage_check", "K18", " UNION ALL ".join(f"""
SELECT '{f}_lag{n}' AS "column",
  count(*) FILTER (WHERE rn <= {n} AND got IS NOT NULL) AS early_values,
  count(*) FILTER (WHERE rn > {n} AND got IS DISTINCT FROM base
    AND NOT coalesce(abs(got - base) <= 1e-8 + 1e-5 * abs(base), false)) AS mismatches
FROM (SELECT {f}_lag{n} AS got, row_number() {W} AS rn, lag({f}, {n}) {W} AS base FROM feats)"""
    for f, ns in cfg.LAG_SPEC.items() for n in ns))
def lag_leakage_check(spark, sf):
    """Lags as stored against their stored base columns."""
    return lag_leakage(unpack_features(_stored_features(spark, sf), [*cfg.LAG_SPEC, *_LAGS], {}, ()))


def _stored_features(spark, sf):
    from ..plans.staging import stored

    return stored(spark, sf).features.read()


_FIXED = [c for c in cfg.MODEL_FEATURES if c in cfg.BINARY_FEATURES + cfg.VOL_SCALED_FEATURES]
_NORM = [c for c in cfg.MODEL_FEATURES if c not in _FIXED]


def _z(c):
    m, s = roll("avg", c, 252, 126), roll("stddev_samp", c, 252, 126)
    z = f"({c} - {m}) / (({s}) + 1e-9)"
    return r(f"CASE WHEN {z} IS NOT NULL THEN greatest(-5e0, least(5e0, {z})) END", 5, c)


@query("normalised_features", "W22", f"""
SELECT symbol, date, {', '.join(_z(c) for c in _NORM)}, {', '.join(
    c if c in cfg.INTEGER_FEATURES else r(f'CASE WHEN {c} IS NOT NULL THEN greatest(-1e0, least(1e0, {c})) END' if c == 'overnight_share' else c, 5, c)
    for c in _FIXED)} FROM dataset""")
def normalised_features(spark, sf):
    """Every model feature, from the stored documents."""
    df = unpack_features(_stored_features(spark, sf), cfg.MODEL_FEATURES)
    return round_frame(normalise(df, _NORM), 5)


@query("relative_volume_change", "W15", f"""
SELECT symbol, date, {r(pct('volume', 1, 0, 'symbol'), 6, 'volume_chg_pct')} FROM pbars""")
def relative_volume_change(spark, sf):
    s = Series(["symbol"], "date")
    return round_frame(market.part_bars(spark, sf).select(
        *KEY, s.pct_change(F.col("volume").cast("double"), 1).alias("volume_chg_pct")))
