"""Run summaries and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
METRICS = ["accuracy", "f1_macro", "f1_action", "trade_rate"]


def summary_by_horizon(metrics: DataFrame, thresholds: DataFrame | None = None,
                       splits=("val", "test")) -> DataFrame:
    """One row per (horizon, model) with the metrics of both splits."""
    cells = [F.max(F.when(C("split") == s, C(m))).alias(f"{s}_{m}")
             for s in splits for m in METRICS]
    wide = metrics.groupBy("horizon", C("model_name").alias("model")).agg(*cells)
    if thresholds is None:
        return wide.withColumns({"conf_thresh": F.lit(0.0),
                                 "margin_thresh": F.lit(0.0)})
    return wide.join(thresholds.select(
        "horizon", C("model_name").alias("model"), "conf_thresh", "margin_thresh"),
        ["horizon", "model"], "left")


def markdown_rows(summary: DataFrame) -> DataFrame:
    """Table rows of both splits as text."""
    def row(split, tail=""):
        return (f"| %s | %.4f | %.4f | %.4f | %.2f%% |{tail}", "model",
                f"{split}_accuracy", f"{split}_f1_macro", f"{split}_f1_action",
                C(f"{split}_trade_rate") * 100)

    return summary.select(
        "horizon", "model",
        F.format_string(*row("val", " %.2f | %.2f |"), "conf_thresh",
                        "margin_thresh").alias("val_row"),
        F.format_string(*row("test")).alias("test_row"))


def horizon_improvement(summary: DataFrame, short="1d", long="5d") -> DataFrame:
    """Relative change of mean test accuracy from one horizon to the other."""
    def mean(h):
        return F.avg(F.when(C("horizon") == h, C("test_accuracy")))

    return summary.agg((F.try_divide(mean(long) - mean(short), mean(short)) * 100)
                       .alias("improvement_pct"))


def accuracy_by_horizon(predictions: DataFrame) -> DataFrame:
    hit = (C("y_true") == C("pred_class_final")).cast("int")
    return predictions.groupBy("horizon").agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"))
