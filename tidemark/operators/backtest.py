"""Realised outcomes of stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..functions.scalars import direction, safe_div
from .technical import BY_SYMBOL

C = F.col


def forward_closes(bars: DataFrame, s: Series = BY_SYMBOL) -> DataFrame:
    """Close of each row and of the rows 1 and 5 trading days later."""
    return bars.select("symbol", "date", "close",
                       s.lead("close", 1).alias("close_1d"),
                       s.lead("close", 5).alias("close_5d"))


def backtest(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Realised log return, outcome price and hit flag per prediction.

    A zero return is wrong for either direction; an open outcome is NULL.
    """
    joined = predictions.join(forward_closes(bars), ["symbol", "date"], "left")
    later = F.when(C("horizon") == "1d", C("close_1d")).otherwise(C("close_5d"))
    ret = F.log(safe_div(later, C("close")))
    df = joined.withColumns({"direction": direction(C("pred_class_final")),
                             "actual_return": ret})
    hit = (((C("direction") == "UP") & (C("actual_return") > 0))
           | ((C("direction") == "DOWN") & (C("actual_return") < 0)))
    return df.select(
        "symbol", "date", "horizon", "model_name", "direction", "p_up", "p_down",
        "confidence", "close", "actual_return",
        (C("close") * F.exp("actual_return")).alias("outcome_price"),
        F.when(C("actual_return").isNotNull(), hit).alias("is_correct"))


def latest_per_symbol(df: DataFrame, n: int, *tie_break: str) -> DataFrame:
    """Newest n rows of each symbol; the rank limit is applied before and
    after the exchange, so a hot symbol ships only n rows per task."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(C("date").desc(), *tie_break)
    return (df.withColumn("_rank", F.row_number().over(w))
            .where(C("_rank") <= n).drop("_rank"))
