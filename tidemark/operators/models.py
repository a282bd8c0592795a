"""Direction classifiers: MLlib pipelines and the boosted trees of this package."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, BoostParams, fit_boosted
from .preparation import Preprocessor, with_class_weights

C = F.col
# Hyper-parameters per model family
MODEL_PARAMS = {
    "logistic_regression": {"maxIter": 1000},
    "random_forest": {"numTrees": 100, "maxDepth": 10,
                      "minInstancesPerNode": 20, "seed": 42},
    "lightgbm": {"trees": 200, "rate": 0.05, "leaves": 31, "depth": 8, "min_rows": 50,
                 "row_share": 0.8, "column_share": 0.8, "l1": 0.1, "l2": 0.1, "seed": 42},
    "xgboost": {"trees": 200, "rate": 0.05, "leaves": None, "depth": 6, "min_curvature": 5.0,
                "row_share": 0.8, "column_share": 0.8, "l1": 0.1, "l2": 1.0, "seed": 42},
}
_FAMILIES = {"logistic_regression": LogisticRegression,
             "random_forest": RandomForestClassifier}
BOOSTED = {"lightgbm", "xgboost"}
PROBABILITIES = {-1: "p_down", 0: "p_hold", 1: "p_up"}


@dataclass
class TrainedModel:
    """Fitted preprocessor and classifier with their target."""

    name: str
    target: str
    prep: Preprocessor
    pipeline: PipelineModel | BoostedTrees
    classes: list[int]

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Input rows with ``p_down``/``p_up`` (``p_hold`` for three classes)."""
        rows, names = self.prep.transform(df), [PROBABILITIES[k] for k in self.classes]
        if isinstance(self.pipeline, BoostedTrees):
            return rows.withColumns(dict(zip(names, self.pipeline.probabilities())))
        probs = vector_to_array("probability")
        return self.pipeline.transform(rows).withColumns(
            {name: probs[i] for i, name in enumerate(names)}).drop(
            "features", "rawPrediction", "probability", "prediction")

    def save(self, path: str, metrics: dict | None = None) -> None:
        spark = SparkSession.active()
        if isinstance(self.pipeline, BoostedTrees):
            self.pipeline.save(f"{path}/model")
        else:
            self.pipeline.write().save(f"{path}/model")
        meta = json.dumps({"name": self.name, "target": self.target,
                           "classes": self.classes, "prep": asdict(self.prep),
                           "metrics": metrics or {}})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(
            f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainedModel":
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        prep = Preprocessor(**meta["prep"])
        prep.scales = {k: tuple(v) for k, v in prep.scales.items()}
        pipeline = (BoostedTrees.load(spark, f"{path}/model") if meta["name"] in BOOSTED
                    else PipelineModel.load(f"{path}/model"))
        return TrainedModel(meta["name"], meta["target"], prep, pipeline, meta["classes"])


def train(train_df: DataFrame, features: list[str], target: str, name: str,
          classes: tuple[int, ...] = (-1, 1), weighted: bool = True,
          **overrides) -> TrainedModel:
    """Fit preprocessing and one classifier family on the training rows only.

    Classes map to label indices in ascending order; balanced class weights
    enter through the weight column.
    """
    # every fitting pass rereads the training rows: parse them once
    train_df = train_df.select(*features, target).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        prep = Preprocessor(scaling=name == "logistic_regression").fit(
            train_df, features)
        rows = prep.transform(train_df.where(C(target).isin(list(classes))))
        index = F.lit(None).cast("double")
        for i, k in enumerate(classes):
            index = F.when(C(target) == k, float(i)).otherwise(index)
        rows = rows.withColumn("label", index)
        params = {**MODEL_PARAMS[name], **overrides}
        if weighted:
            rows = with_class_weights(rows, target)
            if name not in BOOSTED:
                params["weightCol"] = "weight"
        if name == "logistic_regression":
            # unit inverse regularisation over the summed loss
            params.setdefault("regParam", 1.0 / max(rows.count(), 1))
        if name in BOOSTED:
            fitted = fit_boosted(rows, prep.kept, "label", len(classes),
                                 "weight" if weighted else None, BoostParams(**params))
        else:
            assembler = VectorAssembler(inputCols=prep.kept, outputCol="features")
            fitted = Pipeline(stages=[assembler, _FAMILIES[name](**params)]).fit(rows)
    finally:
        train_df.unpersist()
    return TrainedModel(name, target, prep, fitted, list(classes))
