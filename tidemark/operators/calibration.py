"""One-vs-rest isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
FLOOR = 1e-9


@dataclass
class Calibrator:
    """One isotonic curve per class; predictions outside the fitted range
    take the nearest end, and rows are renormalised to sum to one."""

    models: dict[str, IsotonicRegressionModel]

    def transform(self, df: DataFrame) -> DataFrame:
        for column, model in self.models.items():
            df = (model.setFeaturesCol(column).setPredictionCol(f"_cal_{column}")
                  .transform(df))
        total = sum((C(f"_cal_{c}") for c in self.models), F.lit(0.0))
        total = F.greatest(total, F.lit(FLOOR))
        df = df.withColumns({c: C(f"_cal_{c}") / total for c in self.models})
        return df.drop(*[f"_cal_{c}" for c in self.models])

    def save(self, path: str) -> None:
        for column, model in self.models.items():
            model.write().save(f"{path}/{column}")

    @staticmethod
    def load(spark: SparkSession, path: str, columns: list[str]) -> "Calibrator":
        return Calibrator({c: IsotonicRegressionModel.load(f"{path}/{c}")
                           for c in columns})


def fit_calibrator(val: DataFrame, probs: dict[int, str],
                   y: str = "y_true") -> Calibrator:
    """Fit on validation rows only."""
    models = {}
    for cls, column in probs.items():
        rows = val.where(C(y).isNotNull()).select(
            C(column).alias("x"), (C(y) == cls).cast("double").alias("hit"))
        # equal scores share one fitted value: pre-aggregate them with weights
        rows = rows.groupBy("x").agg(F.avg("hit").alias("hit"),
                                     F.count("*").cast("double").alias("w"))
        models[column] = IsotonicRegression(
            featuresCol="x", labelCol="hit", weightCol="w").fit(rows)
    return Calibrator(models)
