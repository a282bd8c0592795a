"""Per-symbol technical indicators.

Kernels return named expressions over one shared window; ``technical_features``
stacks them in a few selects.  Each select adds one Window operator, all of them
on the same (symbol, date) distribution and order: one exchange, one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeatureWindows
from ..functions.ema import with_ema
from ..functions.rolling import Series
from ..functions.scalars import clip, flag, safe_div

C = F.col
BY_SYMBOL = Series(["symbol"], "date")


# --- returns and volatility --------------------------------------------------
def log_returns(widths=(1, 5, 20), s: Series = BY_SYMBOL) -> dict[str, Column]:
    """n-day log return known before today's close (one row of delay)."""
    return {f"log_ret_{n}d": s.diff(F.log("close"), n, shift=1) for n in widths}


def realized_vol(widths=(5, 20, 60), s: Series = BY_SYMBOL) -> dict[str, Column]:
    return {f"vol_{n}": s.std("log_ret_1d", n) for n in widths}


# --- averages, range, volume ---------------------------------------------------
def moving_averages(widths=(20, 50, 200), s: Series = BY_SYMBOL):
    return {f"sma_{n}": s.mean("close", n) for n in widths}


def drawdowns(widths=(60,), s: Series = BY_SYMBOL) -> dict[str, Column]:
    out = {}
    for n in widths:
        peak = s.max("close", n)
        out[f"rolling_max_{n}"] = peak
        out[f"dd_{n}"] = safe_div(C("close"), peak) - 1.0
    return out


def price_ranges() -> dict[str, Column]:
    return {
        "high_low_pct": safe_div(C("high") - C("low"), C("close")),
        "close_open_pct": safe_div(C("close") - C("open"), C("open")),
    }


def volume_features(s: Series = BY_SYMBOL) -> dict[str, Column]:
    v = C("volume").cast("double")
    return {
        "volume_z": (v - s.mean(v, 20)) / (s.std(v, 20) + 1e-9),
        "volume_chg_pct": s.pct_change(v, 1),
    }


def calendar_features(s: Series = BY_SYMBOL) -> dict[str, Column]:
    gap = F.datediff(C("date"), s.lag("date"))
    return {"dow": F.weekday("date"),
            "days_since_prev": F.coalesce(gap, F.lit(1))}


def on_balance_volume(bars: DataFrame, s: Series = BY_SYMBOL) -> DataFrame:
    """Running sum of volume signed by the close-to-close move."""
    move = F.signum(s.diff("close", 1))
    return (bars.withColumn("_signed", F.coalesce(move, F.lit(0.0)) * C("volume"))
            .withColumn("obv", s.cumulative("_signed")).drop("_signed"))


# --- building blocks for second-level indicators ------------------------------
def _moves(s: Series = BY_SYMBOL) -> dict[str, Column]:
    """One-row price moves used by RSI, ATR, ADX and the session split."""
    pc = s.lag("close")
    up, down = C("high") - s.lag("high"), s.lag("low") - C("low")
    delta = C("close") - pc
    return {
        "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
        "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
        # greatest() skips the NULL terms of the first row
        "tr": F.greatest(C("high") - C("low"), F.abs(C("high") - pc),
                         F.abs(C("low") - pc)),
        "_dm_up": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_dm_down": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "overnight_return": F.log(safe_div(C("open"), pc)),
        "intraday_return": F.log(safe_div(C("close"), C("open"))),
        "_prev_ret": s.lag(F.log("close"), 2) - s.lag(F.log("close"), 3),
        "_rn": s.row_number(),
    }


def rsi(window: int = 14, s: Series = BY_SYMBOL) -> dict[str, Column]:
    """Relative strength from simple means of gains and losses."""
    strength = s.mean("_gain", window) / (s.mean("_loss", window) + 1e-12)
    return {f"rsi_{window}": 100.0 - 100.0 / (1.0 + strength)}


def atr(window: int = 14, s: Series = BY_SYMBOL) -> dict[str, Column]:
    return {f"atr_{window}": s.mean("tr", window)}


def session_features(window: int = 20, s: Series = BY_SYMBOL):
    """Overnight / intraday statistics and the bounded overnight share."""
    on, day = C("overnight_return"), C("intraday_return")
    share = on / (F.abs(on) + F.abs(day) + 1e-6)
    return {
        f"overnight_mean_{window}": s.mean(on, window),
        f"overnight_std_{window}": s.std(on, window),
        f"intraday_mean_{window}": s.mean(day, window),
        f"intraday_std_{window}": s.std(day, window),
        "overnight_share": clip(share, -1.0, 1.0),
    }


def return_autocorr(window: int = 20, s: Series = BY_SYMBOL):
    """Lag-1 autocorrelation inside the window (window - 1 pairs)."""
    pairs = s.frame(window - 1)
    enough = F.count("log_ret_1d").over(s.frame(window)) >= window
    return {f"return_autocorr_{window}":
            F.when(enough, s.correlation("log_ret_1d", "_prev_ret", pairs))}


def price_rsquared(window: int = 20, s: Series = BY_SYMBOL):
    """R2 of close against the row index; a flat window scores 0."""
    frame = s.frame(window)
    spread = F.var_pop("close").over(frame) * window
    fit = F.regr_r2(C("close"), C("_rn")).over(frame)
    return {f"price_rsq_{window}":
            F.when(F.count("close").over(frame) >= window,
                   F.when(spread < 1e-9, 0.0).otherwise(clip(fit, 0.0, 1.0)))}


def _directional_index() -> Column:
    scale = C("_tr_ema") + 1e-9
    plus, minus = 100 * C("_up_ema") / scale, 100 * C("_down_ema") / scale
    return 100 * F.abs(plus - minus) / (plus + minus + 1e-9)


HELPERS = ["_gain", "_loss", "_prev_ret", "_rn", "macd_line", "macd_signal", "_dx"]


SMOOTHED = {"ema_20", "ema_50", "macd_hist", "adx_14"}
#: Averages that a later run goes on from.
CARRIED = ["ema_20", "ema_50", "_ema_fast", "_ema_slow", "_tr_ema", "_up_ema",
           "_down_ema", "macd_signal", "adx_14"]


def _smoothed(df: DataFrame, s: Series, wanted: set[str], gaps: bool,
              carried: str | None = None, keep: bool = False) -> DataFrame:
    """EMA-based indicators; two chained passes for MACD and ADX.

    ``keep`` adds ``_state``: the averages of ``CARRIED`` at each row.
    """
    first = {n: ("close", int(n[4:])) for n in ("ema_20", "ema_50") if n in wanted}
    second, lines = {}, {}
    if "macd_hist" in wanted:
        first |= {"_ema_fast": ("close", 12), "_ema_slow": ("close", 26)}
        lines["macd_line"] = C("_ema_fast") - C("_ema_slow")
        second["macd_signal"] = ("macd_line", 9)
    if "adx_14" in wanted:
        first |= {"_tr_ema": ("tr", 14), "_up_ema": ("_dm_up", 14),
                  "_down_ema": ("_dm_down", 14)}
        lines["_dx"] = _directional_index()
        second["adx_14"] = ("_dx", 14)
    df = with_ema(df, s, first, gaps, carried)
    if not second:
        return df
    inner = ["_ema_fast", "_ema_slow", "_tr_ema", "_up_ema", "_down_ema"]
    df = df.withColumns(lines)
    df = with_ema(df if keep else df.drop(*inner), s, second, gaps, carried)
    if keep:
        df = df.withColumn("_state", F.struct(s.order, *CARRIED)).drop(*inner)
    if "macd_hist" in wanted:
        df = df.withColumn("macd_hist", C("macd_line") - C("macd_signal"))
    return df


def technical_features(bars: DataFrame, s: Series = BY_SYMBOL,
                       keep_macd: bool = False, wanted=None, gaps: bool = False,
                       carried: str | None = None, keep_state: bool = False) -> DataFrame:
    """The full technical set next to the bar columns.

    ``wanted`` names the outputs a caller needs: smoothed indicators outside it
    are not planned at all, everything else unused is pruned by Catalyst.
    ``gaps``: prices may be missing; smoothed indicators then carry over them.
    ``carried`` names a column with the ``_state`` that an earlier run kept: ``bars``
    then need to reach back only as far as the widest frame.
    """
    wanted = SMOOTHED if wanted is None else SMOOTHED & set(wanted)
    df = bars.withColumns(_moves(s))
    if wanted:
        # smoothed indicators first, while rows are narrow
        df = _smoothed(df, s, wanted, gaps, carried, keep_state)
    df = df.drop("_dm_up", "_dm_down").withColumns({
        **log_returns(s=s), **moving_averages(s=s), **drawdowns(s=s),
        **price_ranges(), **volume_features(s), **calendar_features(s),
        **rsi(s=s), **atr(s=s), **session_features(s=s), **price_rsquared(s=s)})
    df = df.withColumns({
        **realized_vol(s=s), **return_autocorr(s=s),
        "sma20_gt_sma50": flag(C("sma_20") > C("sma_50"))})
    drop = [h for h in HELPERS if not (keep_macd and h.startswith("macd_"))]
    return df.drop(*drop)


def realized_vol_20(bars: DataFrame, s: Series = BY_SYMBOL) -> DataFrame:
    """Bars with ``vol_20`` alone, the one feature labels depend on."""
    return bars.withColumns(log_returns((1,), s)).withColumns(realized_vol((20,), s))


def window_set(bars: DataFrame, widths: FeatureWindows | None = None,
               s: Series = BY_SYMBOL, gaps: bool = False) -> DataFrame:
    """Every width of the parametric lists, including those usually pruned."""
    widths = widths or FeatureWindows()
    df = bars.withColumns({
        **log_returns(sorted({1, *widths.returns}), s),
        **moving_averages(widths.sma, s), **drawdowns(widths.drawdown, s)})
    df = df.withColumns(realized_vol(widths.volatility, s))
    return with_ema(df, s, {f"ema_{n}": ("close", n) for n in widths.ema}, gaps)
