"""Cross-asset and relative-strength features, one row per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series
from ..functions.scalars import safe_div
from .calendars import BY_DATE
from .macro import pivot_series

C = F.col
# Return family -> (symbol, rows of delay before the change)
RETURN_FAMILIES = {"dxy": ("UUP", 1), "gold": ("GLD", 1), "oil": ("USO", 1),
                   "hyg": ("HYG", 1), "lqd": ("LQD", 0), "tlt": ("TLT", 0)}


def _close(symbol: str) -> Column:
    return C(f"`{symbol}_close`")


def wide_closes(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """``<symbol>_close`` columns over the union of the symbols' dates."""
    return pivot_series(bars.where(C("symbol").isin(symbols)), "symbol",
                        symbols, "close", "_close")


def vix_features(s: Series = BY_DATE) -> dict[str, Column]:
    vix = _close("^VIX")
    return {
        "vix_level": vix,
        "vix_change_1d": s.diff(vix, 1, shift=1),
        "vix_change_5d": s.diff(vix, 5, shift=1),
        "vix_pct_change_1d": s.pct_change(vix, 1, shift=1),
        "vix_term_structure": vix - _close("^VIX9D"),
    }


def return_features(families=None, widths=(1, 5, 20), s: Series = BY_DATE):
    families = families or RETURN_FAMILIES
    return {f"{name}_ret_{n}d": s.pct_change(_close(sym), n, shift)
            for name, (sym, shift) in families.items() for n in widths}


def ratio_features(name: str, ratio: Column, s: Series, width: int = 20):
    """Ratio, its moving average and its z-score (no epsilon)."""
    mean = s.mean(ratio, width)
    return {f"{name}_ratio": ratio, f"{name}_ratio_ma20": mean,
            f"{name}_ratio_z": safe_div(ratio - mean, s.std(ratio, width))}


def proxy_features(bars: DataFrame, base: str = "SPY",
                   s: Series = BY_DATE) -> DataFrame:
    """VIX, cross-asset returns, credit correlation and breadth columns."""
    wide = wide_closes(bars, cfg.PROXY_SYMBOLS + [base])
    spy, hyg = _close(base), _close("HYG")
    df = wide.withColumns({
        **vix_features(s), **return_features(s=s),
        "_spy_ret_5d": s.pct_change(spy, 5),
        "_hyg_ret": s.pct_change(hyg, 1), "_spy_ret": s.pct_change(spy, 1),
        "_breadth": safe_div(_close("RSP"), spy)})
    df = df.withColumns({
        "hyg_vs_spy_5d": C("hyg_ret_5d") - C("_spy_ret_5d"),
        "hyg_spy_corr_20d": s.corr("_hyg_ret", "_spy_ret", 20),
        **ratio_features("rsp_spy", C("_breadth"), s)})
    return df.drop("_spy_ret_5d", "_hyg_ret", "_spy_ret", "_breadth")


def relative_strength(bars: DataFrame, base: str = "SPY",
                      others=("QQQ", "IWM")) -> DataFrame:
    """Ratio features of each symbol against the base.

    Symbols join one after another, so the rolling rows of the n-th ratio are
    the dates known to the base and the first n symbols.
    """
    df = wide_closes(bars, [base, *others])
    seen = _close(base).isNotNull()
    for other in others:
        seen = seen | _close(other).isNotNull()
        member = f"_in_{other}"
        df = df.withColumns({member: seen,
                             "_ratio": safe_div(_close(other), _close(base))})
        name = f"{other.lower()}_{base.lower()}"
        df = df.withColumns(
            ratio_features(name, C("_ratio"), Series([member], "date")))
    return df.select(*[c for c in df.columns
                       if not c.endswith("_close") and not c.startswith("_")])
