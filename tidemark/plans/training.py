"""Train, calibrate, gate and store: the classification run.

The driver loops over a handful of (horizon, model) pairs; every fit, scoring
and metric inside is a distributed job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration
from ..operators import decisions as D
from ..operators import evaluation as E
from ..operators import models as MD
from ..operators import preparation as P
from ..operators import reports as R
from ..session import at_once
from ..sources.keyed import KeyedTable, stage

C = F.col
# Models per horizon
REGISTRY = {
    "1d": ("y_class_1d", ["random_forest", "lightgbm", "xgboost"]),
    "5d": ("y_class_5d", ["random_forest", "lightgbm", "xgboost"]),
}
PROBS = {-1: "p_down", 1: "p_up"}
BY = ["horizon", "model_name", "split"]
#: Models fitted side by side; each holds its training rows while it is.
PARALLEL = 6


@dataclass
class RunResult:
    predictions: DataFrame
    summary: DataFrame
    models: dict[tuple[str, str], MD.TrainedModel]


def score_rows(model: MD.TrainedModel, df: DataFrame, horizon: str) -> DataFrame:
    """Probabilities with the identifying columns of the prediction table."""
    return model.probabilities(df).select(
        "symbol", "date", F.lit(horizon).alias("horizon"),
        F.lit(model.name).alias("model_name"), "split",
        C(model.target).alias("y_true"), "p_down", "p_up")


def run_model(dataset: DataFrame, horizon: str, target: str, name: str,
              splits=None, **overrides) -> tuple[DataFrame, MD.TrainedModel]:
    """Fit on train, calibrate on validation, decide on validation and test."""
    labelled = P.with_split(dataset, splits)
    features = P.feature_columns(dataset)
    model = MD.train(labelled.where("split = 'train'"), features, target, name,
                     **overrides)
    # both curves and the decisions read the scores
    scored = stage(dataset.sparkSession, score_rows(model, labelled.where("split <> 'train'"), horizon), "scored")
    curve = calibration.fit_calibrator(scored.where("split = 'val'"), PROBS)
    decided = D.gate_binary(D.prediction_features(curve.transform(scored)))
    return D.assemble_predictions(decided), model


def run_registry(datasets: dict[str, DataFrame], registry=None, splits=None,
                 overrides: dict[str, dict] | None = None,
                 table: KeyedTable | None = None) -> RunResult:
    """All horizons and models; summary rows carry zero thresholds because
    two-class decisions are not gated.

    Fits are made of many small jobs, so ``PARALLEL`` models are fitted side by side.
    With a ``table`` their predictions are then merged into it, and the summary is made
    from what is read back.
    """
    registry = registry or REGISTRY
    entries = [(h, target, name) for h, (target, names) in registry.items() for name in names]
    predictions, models = None, {}
    for i in range(0, len(entries), PARALLEL):
        fits = [partial(run_model, datasets[h], h, target, name, splits, **(overrides or {}).get(name, {}))
                for h, target, name in entries[i:i + PARALLEL]]
        done = at_once(next(iter(datasets.values())).sparkSession, *fits)
        for (horizon, _, name), (_, model) in zip(entries[i:], done):
            models[horizon, name] = model
        rows = reduce(DataFrame.unionByName, [r for r, _ in done])
        if table is not None:
            table.merge(rows)
        else:
            predictions = rows if predictions is None else predictions.unionByName(rows)
    if table is not None:
        predictions = table.read()
    metrics = E.gate_metrics(E.confusion_counts(predictions, BY), BY)
    return RunResult(predictions, R.summary_by_horizon(metrics), models)


def next_day_predictions(model: MD.TrainedModel, features: DataFrame,
                         calendar_next: DataFrame, existing: DataFrame,
                         horizon: str) -> DataFrame:
    """Score each symbol's newest features for the next trading day, unless a
    prediction for that day is already stored."""
    newest = features.groupBy("symbol").agg(F.max("date").alias("date"))
    rows = features.join(newest, ["symbol", "date"], "left_semi")
    rows = rows.withColumns({"split": F.lit("production"),
                             model.target: F.lit(None).cast("int")})
    scored = score_rows(model, rows, horizon).join(
        F.broadcast(calendar_next), "date").where("next_date IS NOT NULL")
    scored = scored.withColumn("date", C("next_date")).drop("next_date")
    keys = ["symbol", "date", "horizon", "model_name"]
    fresh = scored.join(existing.select(*keys), keys, "left_anti")
    return D.assemble_predictions(D.gate_binary(D.prediction_features(fresh)))


