"""From probabilities to decisions: features, gating, threshold search, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from .evaluation import _ratio

C = F.col
PREDICTION_COLUMNS = ["symbol", "date", "horizon", "model_name", "split",
                      "y_true", "pred_class_raw", "pred_class_final",
                      "p_down", "p_up", "confidence", "margin"]
GROUP = ["horizon", "model_name"]


def prediction_features(df: DataFrame, p_down="p_down", p_up="p_up") -> DataFrame:
    """Most likely class (a tie is DOWN), its probability and the margin."""
    return df.withColumns({
        "pred_class_raw": F.when(C(p_up) > C(p_down), 1).otherwise(-1),
        "confidence": F.greatest(p_down, p_up),
        "margin": F.abs(C(p_down) - C(p_up))})


def three_class_features(df: DataFrame, p_sell="p_sell", p_hold="p_hold",
                         p_buy="p_buy") -> DataFrame:
    """Three-class argmax (first of equals) with the top-two margin."""
    top = F.greatest(p_sell, p_hold, p_buy)
    ordered = F.sort_array(F.array(p_sell, p_hold, p_buy), asc=False)
    return df.withColumns({
        "pred_class_raw": (F.when(C(p_sell) == top, -1)
                           .when(C(p_hold) == top, 0).otherwise(1)),
        "confidence": top, "margin": ordered[0] - ordered[1]})


def gate_binary(df: DataFrame) -> DataFrame:
    """Two-class predictions pass unchanged: there is no hold to fall back to."""
    return df.withColumn("pred_class_final", C("pred_class_raw"))


def gate(raw: Column, confidence: Column, margin: Column, conf_thresh,
         margin_thresh) -> Column:
    """Keep a trade only when confident and distinct enough, else hold."""
    passes = (confidence >= conf_thresh) & (margin >= margin_thresh)
    return F.when(passes, raw).otherwise(0)


def _highest_passed(value: Column, low: int, high: int) -> Column:
    """Largest grid index i with value >= i/100, below ``low`` -> low - 1.

    The floor is corrected against the real threshold on both sides, so the
    index agrees with the floating-point comparison itself.
    """
    i = F.floor(value * 100).cast("int")
    i = (F.when(value >= (i + 1) / 100.0, i + 1)
         .when(value < i / 100.0, i - 1).otherwise(i))
    return F.least(F.greatest(i, F.lit(low - 1)), F.lit(high))


def threshold_grid(df: DataFrame, by: list[str] | None = None,
                   y: str = "y_true") -> DataFrame:
    """Gate metrics for every (confidence, margin) threshold pair.

    Rows collapse to counts per grid cell first.  A cell contributes to all
    thresholds at or below it, so two expansions over the fixed grid give the
    counts of every pair: the data is read once and never paired with the grid.
    """
    by = GROUP if by is None else by
    (c_lo, c_hi), (m_lo, m_hi) = cfg.CONF_GRID, cfg.MARGIN_GRID
    cells = (df.where(C(y).isNotNull())
             .groupBy(*by, C(y).alias("y"), C("pred_class_raw").alias("p"),
                      _highest_passed(C("confidence"), c_lo, c_hi).alias("ci"),
                      _highest_passed(C("margin"), m_lo, m_hi).alias("mi"))
             .agg(F.count("*").alias("n")))
    totals = cells.groupBy(*by, "y").agg(F.sum("n").alias("n"))
    at_conf = (cells.where(C("ci") >= c_lo)
               .select(*by, "y", "p", "mi", "n",
                       F.explode(F.sequence(F.lit(c_lo), C("ci"))).alias("ct"))
               .groupBy(*by, "y", "p", "mi", "ct").agg(F.sum("n").alias("n")))
    passed = (at_conf.where(C("mi") >= m_lo)
              .select(*by, "y", "p", "ct", "n",
                      F.explode(F.sequence(F.lit(m_lo), C("mi"))).alias("mt"))
              .groupBy(*by, "ct", "mt")
              .agg(*[F.sum(F.when((C("y") == a) & (C("p") == b), C("n"))
                           .otherwise(0)).alias(f"n{_t(a)}{_t(b)}")
                     for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    size = totals.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(C("y") == a, C("n")).otherwise(0))
                                 .alias(f"y{_t(a)}") for a in (-1, 0, 1)])
    # the fixed grid itself: every pair exists even when nothing passes it
    grid = size.select(
        *by, "n", *[f"y{_t(a)}" for a in (-1, 0, 1)],
        F.explode(F.sequence(F.lit(c_lo), F.lit(c_hi))).alias("ct")).select(
        "*", F.explode(F.sequence(F.lit(m_lo), F.lit(m_hi))).alias("mt"))
    joined = grid.join(passed, [*by, "ct", "mt"], "left").fillna(0)
    return joined.select(*by, (C("ct") / 100.0).alias("conf_thresh"),
                         (C("mt") / 100.0).alias("margin_thresh"),
                         *_grid_metrics())


def _t(k: int) -> str:
    return {-1: "d", 0: "h", 1: "u"}[k]


def _grid_metrics() -> list[Column]:
    """Metrics after gating: blocked and hold predictions count as hold."""
    f1 = {}
    traded = sum((C(f"n{_t(a)}{b}") for a in (-1, 0, 1) for b in "du"), F.lit(0))
    for k in (-1, 1):
        t = _t(k)
        predicted = C(f"nd{t}") + C(f"nh{t}") + C(f"nu{t}")
        f1[k] = _ratio(2 * C(f"n{t}{t}"), predicted + C(f"y{t}"))
    held = C("n") - traded
    held_right = C("yh") - C("nhd") - C("nhu")
    f1[0] = _ratio(2 * held_right, held + C("yh"))
    right = C("ndd") + C("nuu") + held_right
    return [(right / C("n")).alias("accuracy"),
            ((f1[-1] + f1[0] + f1[1]) / 3).alias("f1_macro"),
            ((f1[-1] + f1[1]) / 2).alias("f1_action"),
            (traded / C("n")).alias("trade_rate")]


def tune_thresholds(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best admissible pair per group: trade rate within the horizon's bounds,
    highest weighted score, then the lowest thresholds."""
    by = GROUP if by is None else by
    a, b = cfg.SCORE_WEIGHTS
    ok = F.lit(False)
    for horizon, (lo, hi) in cfg.TRADE_RATE_BOUNDS.items():
        ok = ok | ((C("horizon") == horizon) & C("trade_rate").between(lo, hi))
    scored = (threshold_grid(df, by).where(ok)
              .withColumn("score", a * C("f1_macro") + b * C("f1_action")))
    rest = [c for c in scored.columns if c not in by]
    pick = F.max_by(F.struct(*rest), F.struct(
        F.round("score", 9), -C("conf_thresh"), -C("margin_thresh")))
    return scored.groupBy(*by).agg(pick.alias("b")).select(*by, "b.*")


def dummy_thresholds(metrics: DataFrame) -> DataFrame:
    """Two-class runs keep every prediction: zero thresholds, F1 as score."""
    return metrics.withColumns({
        "conf_thresh": F.lit(0.0), "margin_thresh": F.lit(0.0),
        "score": C("f1_macro"), "trade_rate": F.lit(1.0)})


def assemble_predictions(df: DataFrame) -> DataFrame:
    return df.select(*PREDICTION_COLUMNS)


def placeholder_predictions(targets: DataFrame, existing: DataFrame,
                            horizons=("1d", "5d")) -> DataFrame:
    """Neutral UP rows for (symbol, date, horizon) without any prediction."""
    wanted = targets.select("symbol", "date", F.explode(
        F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    gaps = wanted.join(existing.select("symbol", "date", "horizon"),
                       ["symbol", "date", "horizon"], "left_anti")
    p_up, p_down = cfg.PLACEHOLDER["p_up"], cfg.PLACEHOLDER["p_down"]
    return gaps.select(
        "symbol", "date", "horizon",
        F.lit(cfg.PLACEHOLDER["model_name"]).alias("model_name"),
        F.lit("production").alias("split"), F.lit(None).cast("int").alias("y_true"),
        F.lit(1).alias("pred_class_raw"), F.lit(1).alias("pred_class_final"),
        F.lit(p_down).alias("p_down"), F.lit(p_up).alias("p_up"),
        F.lit(p_up).alias("confidence"),
        F.lit(abs(p_up - p_down)).alias("margin"))


def missing_dates(wanted: DataFrame, existing: DataFrame,
                  keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(
        existing.select(*keys), keys, "left_anti")


