"""Market regime flags and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series
from ..functions.scalars import flag
from .technical import BY_SYMBOL

C = F.col


def high_vol(level="vix_level", threshold=20.0, window=60, q=0.75,
             s: Series = BY_SYMBOL) -> Column:
    """Above an absolute level or above its own rolling quantile."""
    return flag(F.coalesce(C(level) > threshold, F.lit(False))
                | F.coalesce(C(level) > s.quantile(level, q, window),
                             F.lit(False)))


def inverted_curve(long="dgs10", short="dgs2") -> Column:
    return flag(C(long) < C(short))


def credit_stress(spread="hy_oas_level", window=60, q=0.80,
                  s: Series = BY_SYMBOL) -> Column:
    return flag(C(spread) > s.quantile(spread, q, window))


def liquidity(balance: str, window=20, s: Series = BY_SYMBOL) -> Column:
    return flag(s.diff(balance, window) > 0)


def with_regimes(df: DataFrame, s: Series = BY_SYMBOL,
                 balance: str = "fed_bs_level") -> DataFrame:
    """All four flags; a flag whose inputs are absent is constant 0."""
    have = {c.lower() for c in df.columns}
    zero = F.lit(0)
    if "liquidity_expanding" in have:
        liquid = C("liquidity_expanding")
    elif balance.lower() in have:
        liquid = liquidity(balance, s=s)
    else:
        liquid = zero
    return df.withColumns({
        "high_vol_regime": high_vol(s=s) if "vix_level" in have else zero,
        "curve_inverted": (inverted_curve() if {"dgs10", "dgs2"} <= have
                           else zero),
        "credit_stress": (credit_stress(s=s) if "hy_oas_level" in have
                          else zero),
        "liquidity_expanding_regime": liquid,
    })


def regime_summary(df: DataFrame) -> DataFrame:
    """(regime, pct_active, total_days) in one aggregation pass."""
    names = [c for c in cfg.REGIME_FLAGS if c in df.columns]
    aggs = [F.avg(n).alias(f"p_{n}") for n in names]
    aggs += [F.sum(n).alias(f"t_{n}") for n in names]
    rows = [F.struct(F.lit(n).alias("regime"),
                     (C(f"p_{n}") * 100).alias("pct_active"),
                     C(f"t_{n}").alias("total_days")) for n in names]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def co_occurrence(df: DataFrame, left="high_vol_regime",
                  right="curve_inverted") -> DataFrame:
    both = (C(left) == 1) & (C(right) == 1)
    return df.agg(F.coalesce(F.sum(both.cast("long")), F.lit(0)).alias("days"))
