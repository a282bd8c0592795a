"""The feature plan for all symbols at once.

Bars are distributed by symbol once.  Context frames hold one row per date and
are broadcast, so regimes and lags run on the distribution the technical
windows already established.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..operators.calendars import per_date, with_event_flags
from ..operators.cross_asset import proxy_features, relative_strength
from ..operators.lags import with_lags
from ..operators.macro import bounded_fill, macro_features
from ..operators.regimes import with_regimes
from ..operators.technical import BY_SYMBOL, technical_features


@dataclass
class Inputs:
    """Stored tables a feature build reads."""

    bars: DataFrame        # all symbols, ETFs and proxies
    macro: DataFrame       # aligned macro_daily
    events: DataFrame | None

    @property
    def etf_bars(self) -> DataFrame:
        return self.bars.where(F.col("symbol").isin(cfg.ETF_SYMBOLS))


def with_context(df: DataFrame, *frames: DataFrame | None,
                 events: DataFrame | None = None) -> DataFrame:
    """Left-join each per-date frame, then add the event flags."""
    for frame in frames:
        if frame is not None:
            df = df.join(per_date(frame), "date", "left")
    return with_event_flags(df, events)


def build_features(inputs: Inputs, state: DataFrame | None = None,
                   keep_state: bool = False) -> DataFrame:
    """Technical -> context -> bounded fill -> regimes -> lags.

    ``state`` holds (symbol, state): the averages that series go on from, where
    the inputs reach back only as far as the widest frame.  ``keep_state`` adds
    ``_state`` and ``_frame_from``, the day ``FRAME_ROWS`` rows before.
    """
    bars = inputs.etf_bars
    if state is not None:
        bars = bars.join(state.select("symbol", F.col("state").alias("_carried")), "symbol", "left")
    df = technical_features(bars, carried=None if state is None else "_carried",
                            keep_state=keep_state)
    if state is not None:
        df = df.drop("_carried")
    if keep_state:
        first = F.min("date").over(BY_SYMBOL.whole)
        df = df.withColumn("_frame_from", F.coalesce(BY_SYMBOL.lag("date", cfg.FRAME_ROWS), first))
    df = with_context(df, macro_features(inputs.macro),
                      proxy_features(inputs.bars),
                      relative_strength(inputs.bars), events=inputs.events)
    df = bounded_fill(df, BY_SYMBOL)
    df = with_regimes(df)
    return with_lags(df)
