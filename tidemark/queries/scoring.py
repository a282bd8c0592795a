"""Predictions, evaluation, gating, calibration inputs and back-tests.

The scored rows come from three rule models whose probabilities are plain
functions of stored features, so every downstream number has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalars import (direction, normalised_pct, recommendation,
                                 round_frame)
from ..operators import backtest as B
from ..operators import calibration
from ..operators import decisions as D
from ..operators import evaluation as E
from ..operators import preparation as P
from ..operators import reports as R
from ..operators.calendars import next_trading_day
from ..operators.feature_store import unpack_features
from ..operators.targets import barrier_classes
from ..sources import market
from .base_sql import cte, r, rs
from .registry import query
from .views import PLACES, tables

C = F.col
KEY = ["symbol", "date"]
BY = ["horizon", "model_name"]
BYS = [*BY, "split"]
RULES = {"rsi": "rsi_14 / 100", "trend": "price_rsq_20",
         "momentum": "(return_autocorr_20 + 1) / 2"}
_SRC = ["rsi_14", "price_rsq_20", "return_autocorr_20"]


def split_sql(date: str = "date") -> str:
    parts = " ".join(f"WHEN {date} BETWEEN DATE '{lo}' AND DATE '{hi}' THEN '{n}'"
                     for n, (lo, hi) in cfg.FIXTURE_SPLITS.items())
    return f"CASE {parts} END"


cte("scores", " UNION ALL ".join(f"""
SELECT symbol, date, '{h}' AS horizon, '{m}' AS model_name, y_class_{h} AS y_true,
  round(({e})::DOUBLE, 6) AS p_up, round(1 - round(({e})::DOUBLE, 6), 6) AS p_down
FROM t3 JOIN lab USING (symbol, date)""" for h in ("1d", "5d") for m, e in RULES.items()))
cte("preds", f"""
SELECT symbol, date, horizon, model_name, {split_sql()} AS split, y_true,
  CASE WHEN p_up > p_down THEN 1 ELSE -1 END AS pred_class_raw,
  CASE WHEN p_up > p_down THEN 1 ELSE -1 END AS pred_class_final,
  p_down, p_up, greatest(p_down, p_up) AS confidence, abs(p_down - p_up) AS margin
FROM scores WHERE p_up IS NOT NULL""")
cte("eval", "SELECT * FROM preds WHERE y_true IS NOT NULL")
# three-class scores: the trend fit becomes the hold share
cte("three", f"""
SELECT *, CASE WHEN p_sell = top THEN -1 WHEN p_hold = top THEN 0 ELSE 1 END AS pred_class_raw,
  top AS confidence, top - (p_sell + p_hold + p_buy - top - bottom) AS margin
FROM (SELECT *, greatest(p_sell, p_hold, p_buy) AS top, least(p_sell, p_hold, p_buy) AS bottom
  FROM (SELECT symbol, date, horizon, model_name, split, y_true,
      hold AS p_hold, round((1 - hold) * p_up, 6) AS p_buy,
      round((1 - hold) * (1 - p_up), 6) AS p_sell
    FROM (SELECT s.symbol, s.date, s.horizon, s.model_name, {split_sql('s.date')} AS split,
        CASE s.horizon WHEN '1d' THEN l.y_class_1d ELSE l.y_class_5d END AS y_true,
        s.p_up, round(t.price_rsq_20 / 2, 6) AS hold
      FROM scores s JOIN t3 t USING (symbol, date) JOIN lab3 l USING (symbol, date)
      WHERE s.p_up IS NOT NULL AND t.price_rsq_20 IS NOT NULL)))""")


# --- scored rows ------------------------------------------------------------------
def scores(spark, sf) -> DataFrame:
    """Long (symbol, date, horizon, model) probabilities with true classes."""
    t = tables(spark, sf)
    wide = unpack_features(t.features, _SRC).join(
        t.labels.select(*KEY, "y_class_1d", "y_class_5d"), KEY)
    rows = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model_name"),
                 C(f"y_class_{h}").alias("y_true"),
                 F.round(F.expr(e), 6).alias("p_up"))
        for h in ("1d", "5d") for m, e in RULES.items()])
    return (wide.select(*KEY, "price_rsq_20", F.inline(rows))
            .where(C("p_up").isNotNull())
            .withColumn("p_down", F.round(1 - C("p_up"), 6)))


def predictions(spark, sf) -> DataFrame:
    df = P.with_split(scores(spark, sf), cfg.FIXTURE_SPLITS)
    return D.gate_binary(D.prediction_features(df))


def three_class(spark, sf) -> DataFrame:
    """Three-class probabilities against the triple-barrier classes."""
    barrier = barrier_classes(tables(spark, sf).labels).select(
        *KEY, C("y_class_1d").alias("b1"), C("y_class_5d").alias("b5"))
    df = P.with_split(scores(spark, sf), cfg.FIXTURE_SPLITS).join(barrier, KEY)
    hold = F.round(C("price_rsq_20") / 2, 6)
    df = df.where(C("price_rsq_20").isNotNull()).withColumns({
        "y_true": F.when(C("horizon") == "1d", C("b1")).otherwise(C("b5")),
        "p_hold": hold})
    df = df.withColumns({
        "p_buy": F.round((1 - C("p_hold")) * C("p_up"), 6),
        "p_sell": F.round((1 - C("p_hold")) * (1 - C("p_up")), 6)})
    return D.three_class_features(df)


_PRED = ["p_down", "p_up", "confidence", "margin"]


@query("prediction_table", "C3 C4 C8", f"""
SELECT symbol, date, horizon, model_name, split, y_true, pred_class_raw, pred_class_final,
  {rs(_PRED)} FROM preds""")
def prediction_table(spark, sf):
    return round_frame(D.assemble_predictions(predictions(spark, sf)))


# --- evaluation ------------------------------------------------------------------------
_CLS = """SELECT horizon, model_name, split, k AS class,
  count(*) FILTER (WHERE y_true = k) AS support,
  count(*) FILTER (WHERE pred_class_final = k) AS predicted,
  count(*) FILTER (WHERE y_true = k AND pred_class_final = k) AS tp
FROM eval, (VALUES (-1), (1)) AS c(k) GROUP BY ALL"""
cte("cls", f"""
SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision,
  coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1
FROM ({_CLS}) WHERE support + predicted > 0""")
cte("metrics", """
SELECT horizon, model_name, split, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro,
  sum(f1 * support) / sum(support) AS f1_weighted, avg(precision) AS precision_macro,
  avg(recall) AS recall_macro FROM cls GROUP BY ALL""")
_M = ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"]


def _counts(spark, sf, by=BYS):
    return E.confusion_counts(predictions(spark, sf), by)


@query("classification_metrics", "T6", f"""
SELECT horizon, model_name, split, {rs(_M)} FROM metrics""")
def classification_metrics(spark, sf):
    return round_frame(E.classification_metrics(_counts(spark, sf), BYS))


@query("confusion_matrix", "T7", f"""
SELECT horizon, model_name, split, y_true AS y,
  {r('100.0 * count(*) FILTER (WHERE pred_class_final = -1) / count(*)', 6, 'pct_pred_m1')},
  {r('100.0 * count(*) FILTER (WHERE pred_class_final = 1) / count(*)', 6, 'pct_pred_1')}
FROM eval GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return round_frame(E.confusion_percent(_counts(spark, sf), BYS))


@query("class_report", "T8", f"""
SELECT horizon, model_name, split, class, {rs(['precision', 'recall', 'f1'])}, support,
  predicted, tp FROM cls""")
def class_report(spark, sf):
    return round_frame(E.class_report(_counts(spark, sf), BYS))


@query("model_comparison", "T9", f"""
SELECT horizon, model_name, {rs(_M)} FROM metrics WHERE split = 'val'""")
def model_comparison(spark, sf):
    m = E.classification_metrics(_counts(spark, sf), BYS).where("split = 'val'")
    return round_frame(E.compare_models(m).drop("split"))


@query("action_accuracy", "T11", f"""
SELECT horizon, model_name, split,
  {r('avg(CASE WHEN y_true = pred_class_raw THEN 1.0 ELSE 0 END)', 6, 'action_accuracy')}
FROM three WHERE y_true <> 0 GROUP BY ALL""")
def action_accuracy(spark, sf):
    counts = E.confusion_counts(three_class(spark, sf), BYS, p="pred_class_raw")
    return round_frame(E.action_accuracy(counts, BYS))


@query("brier_scores", "C2", f"""
SELECT horizon, model_name, split,
  {r('avg((p_down - CASE WHEN y_true = -1 THEN 1 ELSE 0 END) ** 2)', 6, 'brier_down')},
  {r('avg((p_up - CASE WHEN y_true = 1 THEN 1 ELSE 0 END) ** 2)', 6, 'brier_up')}
FROM eval GROUP BY ALL""")
def brier_scores(spark, sf):
    df = predictions(spark, sf).where("y_true IS NOT NULL")
    return round_frame(E.brier(df, BYS, {-1: "p_down", 1: "p_up"}))


cte("gatem", """
SELECT horizon, model_name, split,
  count(*) FILTER (WHERE y_true = pred_class_final) / count(*) AS accuracy,
  (coalesce(2 * count(*) FILTER (WHERE y_true = -1 AND pred_class_final = -1)
     / nullif(count(*) FILTER (WHERE y_true = -1) + count(*) FILTER (WHERE pred_class_final = -1), 0), 0)
   + coalesce(2 * count(*) FILTER (WHERE y_true = 1 AND pred_class_final = 1)
     / nullif(count(*) FILTER (WHERE y_true = 1) + count(*) FILTER (WHERE pred_class_final = 1), 0), 0)) / 2
   AS f1_macro
FROM eval GROUP BY ALL""")
_G = ["accuracy", "f1_macro", "f1_action", "trade_rate"]


@query("gate_evaluation", "C7", f"""
SELECT horizon, model_name, split, {rs(['accuracy', 'f1_macro'])},
  {r('f1_macro', 6, 'f1_action')}, 1e0 AS trade_rate FROM gatem""")
def gate_evaluation(spark, sf):
    return round_frame(E.gate_metrics(_counts(spark, sf), BYS))


# --- three-class gating -----------------------------------------------------------------
@query("confidence_gate", "C5", f"""
SELECT symbol, date, horizon, model_name, pred_class_raw, {rs(['confidence', 'margin'])},
  CASE WHEN confidence >= 0.5e0 AND margin >= 0.1e0 THEN pred_class_raw ELSE 0 END
    AS pred_class_final FROM three""")
def confidence_gate(spark, sf):
    df = three_class(spark, sf)
    return round_frame(df.select(
        *KEY, *BY, "pred_class_raw", "confidence", "margin",
        D.gate(C("pred_class_raw"), C("confidence"), C("margin"), 0.5, 0.1)
        .alias("pred_class_final")))


def _f1(k):
    return (f"coalesce(2 * count(*) FILTER (WHERE y = {k} AND p = {k}) / nullif("
            f"count(*) FILTER (WHERE y = {k}) + count(*) FILTER (WHERE p = {k}), 0), 0)")


_GRID_M = (f"count(*) FILTER (WHERE y = p) / count(*) AS accuracy, "
           f"({_f1(-1)} + {_f1(0)} + {_f1(1)}) / 3 AS f1_macro, "
           f"({_f1(-1)} + {_f1(1)}) / 2 AS f1_action, "
           f"count(*) FILTER (WHERE p <> 0) / count(*) AS trade_rate")
# every threshold pair against every row, spelled out
cte("grid", f"""
SELECT horizon, model_name, ct / 100e0 AS conf_thresh, mt / 100e0 AS margin_thresh, {_GRID_M}
FROM (SELECT horizon, model_name, ct, mt, y_true AS y,
        CASE WHEN confidence >= ct / 100e0 AND margin >= mt / 100e0
             THEN pred_class_raw ELSE 0 END AS p
      FROM three, range({cfg.CONF_GRID[0]}, {cfg.CONF_GRID[1] + 1}) AS a(ct),
        range({cfg.MARGIN_GRID[0]}, {cfg.MARGIN_GRID[1] + 1}) AS b(mt)
      WHERE split = 'val' AND y_true IS NOT NULL)
GROUP BY ALL""")


@query("threshold_grid", "C6", f"""
SELECT horizon, model_name, conf_thresh, margin_thresh, {rs(_G)} FROM grid""")
def threshold_grid(spark, sf):
    val = three_class(spark, sf).where("split = 'val'")
    return round_frame(D.threshold_grid(val))


@query("tuned_thresholds", "C6", f"""
SELECT horizon, model_name, conf_thresh, margin_thresh, {rs(_G + ['score'])}
FROM (SELECT *, {cfg.SCORE_WEIGHTS[0]} * f1_macro + {cfg.SCORE_WEIGHTS[1]} * f1_action AS score
      FROM grid)
WHERE (horizon = '1d' AND trade_rate BETWEEN 0.2 AND 0.7)
   OR (horizon = '5d' AND trade_rate BETWEEN 0.15 AND 0.6)
QUALIFY row_number() OVER (PARTITION BY horizon, model_name
  ORDER BY round(score, 9) DESC, conf_thresh, margin_thresh) = 1""")
def tuned_thresholds(spark, sf):
    val = three_class(spark, sf).where("split = 'val'")
    return round_frame(D.tune_thresholds(val))


# --- calibration ----------------------------------------------------------------------
# Isotonic fit of a point: the highest, over block starts at or before it, of
# the lowest mean over block ends at or after it.
for _p, _k in (("p_down", -1), ("p_up", 1)):
    cte(f"pts_{_p}", f"""
SELECT *, row_number() OVER (PARTITION BY horizon, model_name ORDER BY x) AS id,
  sum(s) OVER (PARTITION BY horizon, model_name ORDER BY x) AS cs,
  sum(n) OVER (PARTITION BY horizon, model_name ORDER BY x) AS cn
FROM (SELECT horizon, model_name, {_p} AS x,
        sum(CASE WHEN y_true = {_k} THEN 1 ELSE 0 END) AS s, count(*) AS n
      FROM eval WHERE split = 'val' GROUP BY ALL)""")
    cte(f"fit_{_p}", f"""
SELECT horizon, model_name, x, max(lowest) AS fit FROM (
  SELECT b.horizon, b.model_name, b.x, b.id,
    min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (
      PARTITION BY b.horizon, b.model_name, a.id ORDER BY b.id DESC
      ROWS UNBOUNDED PRECEDING) AS lowest
  FROM pts_{_p} a JOIN pts_{_p} b ON a.horizon = b.horizon
    AND a.model_name = b.model_name AND b.id >= a.id) GROUP BY ALL""")


def calibrated(spark, sf) -> DataFrame:
    """Curves fitted per horizon and model on validation rows, applied to all."""
    rows = predictions(spark, sf)
    out = None
    for horizon in ("1d", "5d"):
        for model in RULES:
            df = rows.where((C("horizon") == horizon) & (C("model_name") == model))
            cal = calibration.fit_calibrator(df.where("split = 'val'"),
                                             {-1: "p_down", 1: "p_up"})
            scored = cal.transform(df)
            out = scored if out is None else out.unionByName(scored)
    return out


@query("calibrated_validation", "C1", f"""
SELECT e.symbol, e.date, e.horizon, e.model_name,
  {r('d.fit / greatest(d.fit + u.fit, 1e-9)', 6, 'p_down')},
  {r('u.fit / greatest(d.fit + u.fit, 1e-9)', 6, 'p_up')}
FROM preds e JOIN fit_p_down d ON d.horizon = e.horizon AND d.model_name = e.model_name
  AND d.x = e.p_down
JOIN fit_p_up u ON u.horizon = e.horizon AND u.model_name = e.model_name AND u.x = e.p_up
WHERE e.split = 'val' AND e.y_true IS NOT NULL""")
def calibrated_validation(spark, sf):
    df = calibrated(spark, sf).where("split = 'val' AND y_true IS NOT NULL")
    return round_frame(df.select(*KEY, *BY, "p_down", "p_up"))


def _between(cls: str) -> str:
    """The fitted curve at a score: its nearest end outside, a line between points."""
    lo, hi, x = f"lo_{cls}", f"hi_{cls}", f"e.{cls}"
    return (f"CASE WHEN {lo}.x IS NULL THEN {hi}.fit WHEN {hi}.x IS NULL OR {lo}.x = {hi}.x THEN {lo}.fit"
            f" ELSE {lo}.fit + ({x} - {lo}.x) / ({hi}.x - {lo}.x) * ({hi}.fit - {lo}.fit) END")


@query("calibrated_predictions", "C1", f"""
SELECT symbol, date, horizon, model_name, {r('d / greatest(d + u, 1e-9)', 6, 'p_down')},
  {r('u / greatest(d + u, 1e-9)', 6, 'p_up')}
FROM (SELECT e.symbol, e.date, e.horizon, e.model_name, {_between('p_down')} AS d, {_between('p_up')} AS u
  FROM preds e {' '.join(f"""
  ASOF LEFT JOIN fit_{c} {side}_{c} ON {side}_{c}.horizon = e.horizon
    AND {side}_{c}.model_name = e.model_name AND e.{c} {sign} {side}_{c}.x"""
  for c in ('p_down', 'p_up') for side, sign in (('lo', '>='), ('hi', '<=')))})""")
def calibrated_predictions(spark, sf):
    return round_frame(calibrated(spark, sf).select(
        *KEY, *BY, "p_down", "p_up"))


# --- summaries and reports --------------------------------------------------------------
_SUM = [f"{s}_{m}" for s in ("val", "test") for m in _G]
cte("summ", "SELECT horizon, model_name AS model, " + ", ".join(
    f"max({'1e0' if m == 'trade_rate' else 'f1_macro' if m == 'f1_action' else m})"
    f" FILTER (WHERE split = '{s}') AS {s}_{m}" for s in ("val", "test") for m in _G)
    + ", 0e0 AS conf_thresh, 0e0 AS margin_thresh FROM gatem GROUP BY ALL")


def _summary(spark, sf):
    return R.summary_by_horizon(E.gate_metrics(_counts(spark, sf), BYS))


@query("summary_by_horizon", "C9 T10", f"""
SELECT horizon, model, {rs(_SUM)}, conf_thresh, margin_thresh FROM summ""")
def summary_by_horizon(spark, sf):
    return round_frame(_summary(spark, sf))


@query("markdown_rows", "C9", """
SELECT horizon, model, """ + ", ".join(f"""printf('| %s | %.4f | %.4f | %.4f | %.2f%% |{more}', model,
  {s}_accuracy, {s}_f1_macro, {s}_f1_action, {s}_trade_rate * 100{args}) AS {s}_row""" for s, more, args in (
    ("val", " %.2f | %.2f |", ", conf_thresh, margin_thresh"), ("test", "", ""))) + """
FROM summ""")
def markdown_rows(spark, sf):
    return R.markdown_rows(_summary(spark, sf)).select("horizon", "model", "val_row", "test_row")


@query("best_models", "Q9", f"""
SELECT horizon, model, {r('test_accuracy')} FROM summ
QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY test_accuracy DESC, model) = 1""")
def best_models(spark, sf):
    return round_frame(E.best_per_group(
        _summary(spark, sf).select("horizon", "model", "test_accuracy"),
        "horizon", "test_accuracy", "model"))


@query("horizon_improvement", "Q10", f"""
SELECT {r("(avg(test_accuracy) FILTER (WHERE horizon = '5d') - avg(test_accuracy) FILTER (WHERE horizon = '1d')) / avg(test_accuracy) FILTER (WHERE horizon = '1d') * 100", 6, 'improvement_pct')}
FROM summ""")
def horizon_improvement(spark, sf):
    return round_frame(R.horizon_improvement(_summary(spark, sf)))


@query("accuracy_by_horizon", "C13", f"""
SELECT horizon, count(*) AS n,
  {r('avg(CASE WHEN y_true = pred_class_final THEN 1.0 ELSE 0 END)', 6, 'accuracy')}
FROM eval WHERE split = 'test' GROUP BY horizon""")
def accuracy_by_horizon(spark, sf):
    df = predictions(spark, sf).where("split = 'test' AND y_true IS NOT NULL")
    return round_frame(R.accuracy_by_horizon(df))


# --- back-test ------------------------------------------------------------------------------
cte("bt", """
SELECT p.symbol, p.date, p.horizon, p.model_name, p.p_up, p.p_down, p.confidence, b.close,
  CASE WHEN p.pred_class_final = 1 THEN 'UP' ELSE 'DOWN' END AS direction,
  ln(CASE p.horizon WHEN '1d' THEN b.c1 ELSE b.c5 END / b.close) AS actual_return
FROM preds p LEFT JOIN (SELECT symbol, date, close,
  lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) AS c1,
  lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) AS c5 FROM bars) b USING (symbol, date)""")


@query("backtest", "C12 J10 P12", f"""
SELECT symbol, date, horizon, model_name, direction,
  {rs(['p_up', 'p_down', 'confidence', 'close', 'actual_return'])},
  {r('close * exp(actual_return)', 6, 'outcome_price')},
  CASE WHEN actual_return IS NOT NULL THEN (direction = 'UP' AND actual_return > 0)
    OR (direction = 'DOWN' AND actual_return < 0) END AS is_correct FROM bt""")
def backtest(spark, sf):
    return round_frame(B.backtest(predictions(spark, sf), tables(spark, sf).bars))


@query("directions", "P12", """
SELECT symbol, date, horizon, model_name,
  CASE WHEN pred_class_final = 1 THEN 'UP' ELSE 'DOWN' END AS direction FROM preds""")
def directions(spark, sf):
    return predictions(spark, sf).select(
        *KEY, *BY, direction(C("pred_class_final")).alias("direction"))


@query("recommendations", "P12", """
SELECT symbol, date, horizon, model_name,
  CASE pred_class_raw WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END || ' ('
    || CAST(CAST(round(CAST(confidence AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2)) AS VARCHAR) || ')' AS rec
FROM three""")
def recommendations(spark, sf):
    return three_class(spark, sf).select(*KEY, *BY, recommendation(
        C("pred_class_raw"), C("p_sell"), C("p_hold"), C("p_buy")).alias("rec"))


@query("probability_percentages", "C14", f"""
SELECT symbol, date, horizon, model_name,
  {r('p_buy / CASE WHEN p_buy + p_sell = 0 THEN 1 ELSE p_buy + p_sell END * 100', 6, 'pct_up')},
  {r('p_sell / CASE WHEN p_buy + p_sell = 0 THEN 1 ELSE p_buy + p_sell END * 100', 6, 'pct_down')}
FROM three""")
def probability_percentages(spark, sf):
    df = three_class(spark, sf)
    up, down = C("p_buy"), C("p_sell")
    return round_frame(df.select(
        *KEY, *BY, normalised_pct(up, up, down).alias("pct_up"),
        normalised_pct(down, up, down).alias("pct_down")))


# --- missing and placeholder predictions ----------------------------------------------------
@query("dates_without_prediction", "J7", """
SELECT DISTINCT f.symbol, f.date, h.horizon FROM bars f, (VALUES ('1d'), ('5d')) AS h(horizon)
WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.symbol = f.symbol AND p.date = f.date
  AND p.horizon = h.horizon)""")
def dates_without_prediction(spark, sf):
    wanted = tables(spark, sf).features.select(*KEY, F.explode(
        F.array(F.lit("1d"), F.lit("5d"))).alias("horizon"))
    return D.missing_dates(wanted, predictions(spark, sf), [*KEY, "horizon"])


@query("placeholder_predictions", "C11 J7", f"""
SELECT DISTINCT f.symbol, f.date, h.horizon, 'placeholder_xgb' AS model_name,
  'production' AS split, CAST(NULL AS INTEGER) AS y_true, 1 AS pred_class_raw,
  1 AS pred_class_final, 0.45e0 AS p_down, 0.55e0 AS p_up, 0.55e0 AS confidence,
  {r('0.55e0 - 0.45e0', 6, 'margin')}
FROM bars f, (VALUES ('1d'), ('5d')) AS h(horizon)
WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.symbol = f.symbol AND p.date = f.date
  AND p.horizon = h.horizon)""")
def placeholder_predictions(spark, sf):
    return round_frame(D.placeholder_predictions(
        tables(spark, sf).features, predictions(spark, sf)))


@query("next_day_targets", "C10 Q7 J9", """
SELECT symbol, max(date) AS feature_date, max_by(next_date, date) AS date
FROM bars JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM cal) USING (date)
WHERE next_date IS NOT NULL GROUP BY symbol""")
def next_day_targets(spark, sf):
    """Newest features that a trading day follows, and the day they predict."""
    nxt = next_trading_day(market.trading_calendar(spark, sf)).where("next_date IS NOT NULL")
    return (tables(spark, sf).features.select(*KEY).join(nxt, "date").groupBy("symbol")
            .agg(F.max("date").alias("feature_date"), F.max_by("next_date", "date").alias("date")))


# --- dataset preparation -----------------------------------------------------------------
_FEATS = cfg.MODEL_FEATURES
cte("train1", "SELECT d.*, l.y_class_1d FROM dataset d JOIN lab l USING (symbol, date) "
    "WHERE l.y_class_1d IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'")


def _dataset(spark, sf):
    from ..operators.datasets import classification_dataset

    return classification_dataset(tables(spark, sf))


def _train(spark, sf):
    lo, hi = cfg.FIXTURE_SPLITS["train"]
    return _dataset(spark, sf).where(C("date").between(F.lit(lo), F.lit(hi)))


@query("split_class_distribution", "D1", f"""
SELECT split, y_class_1d AS class, count(*) AS n,
  {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split)', 6, 'pct')}
FROM (SELECT {split_sql()} AS split, y_class_1d FROM lab WHERE y_class_1d IS NOT NULL)
GROUP BY 1, 2""")
def split_class_distribution(spark, sf):
    return round_frame(P.class_distribution(
        _dataset(spark, sf), "y_class_1d", cfg.FIXTURE_SPLITS))


@query("selected_features", "D2", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS rows, count({f}) AS known FROM train1"
    for f in _FEATS))
def selected_features(spark, sf):
    df = _train(spark, sf)
    names = P.feature_columns(df)
    row = df.agg(F.count("*").alias("_n"), *[F.count(n).alias(n) for n in names])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), C("_n").alias("rows"), C(n).alias("known"))
        for n in names])))


@query("missing_rate_drop", "D3", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'1 - count({f}) / count(*)', 6, 'missing_rate')},"
    f" 1 - count({f}) / count(*) > 0.3 AS dropped FROM train1" for f in _FEATS))
def missing_rate_drop(spark, sf):
    df = P.missing_rates(_train(spark, sf), _FEATS)
    return round_frame(df.withColumn("dropped", C("missing_rate") > 0.30))


_IMP = cfg.MODEL_FEATURES


@query("median_imputation", "D4", "SELECT symbol, date, " + ", ".join(
    r(f"coalesce(d.{c}, (SELECT median({c}) FROM train1))", PLACES.get(c, 6), c)
    for c in _IMP)
    + " FROM dataset d JOIN lab l USING (symbol, date) WHERE l.y_class_1d IS NOT NULL")
def median_imputation(spark, sf):
    prep = P.Preprocessor(drop_threshold=1.0).fit(_train(spark, sf), _IMP)
    return round_frame(prep.transform(_dataset(spark, sf).select(*KEY, *_IMP)), PLACES)


@query("standard_scaling", "D5", "SELECT symbol, date, " + ", ".join(
    r(f"(coalesce(d.{c}, m.m_{c}) - s.a_{c}) / coalesce(nullif(s.s_{c}, 0), 1)", 6, c) for c in _IMP)
    + " FROM dataset d JOIN lab l USING (symbol, date), (SELECT "
    + ", ".join(f"median({c}) AS m_{c}" for c in _IMP) + " FROM train1) m, (SELECT "
    + ", ".join(f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}"
                for c in _IMP)
    + " FROM train1, (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in _IMP)
    + " FROM train1)) s WHERE l.y_class_1d IS NOT NULL")
def standard_scaling(spark, sf):
    prep = P.Preprocessor(drop_threshold=1.0, scaling=True).fit(_train(spark, sf), _IMP)
    return round_frame(prep.transform(_dataset(spark, sf).select(*KEY, *_IMP)))


@query("class_weights", "D6", f"""
SELECT y_class_1d AS class, count(*) AS n_class,
  {r('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 6, 'weight')}
FROM lab3 WHERE y_class_1d IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'
GROUP BY y_class_1d""")
def class_weights(spark, sf):
    lo, hi = cfg.FIXTURE_SPLITS["train"]
    rows = barrier_classes(tables(spark, sf).labels).where(
        C("date").between(F.lit(lo), F.lit(hi)))
    return round_frame(P.class_weights(rows, "y_class_1d"))


