"""Classifier evaluation from confusion counts.

Predictions are reduced to (group, true, predicted, n) by one partial
aggregation; every metric is closed-form arithmetic on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def confusion_counts(df: DataFrame, by: list[str], y: str = "y_true",
                     p: str = "pred_class_final") -> DataFrame:
    return (df.where(C(y).isNotNull() & C(p).isNotNull())
            .groupBy(*by, C(y).alias("y"), C(p).alias("p"))
            .agg(F.count("*").alias("n")))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def class_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class seen in either column."""
    hit = C("y") == C("p")
    sides = F.array(
        F.struct(C("y").alias("class"), C("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(hit, C("n")).otherwise(0).alias("tp")),
        F.struct(C("p").alias("class"), F.lit(0).cast("long").alias("support"),
                 C("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")))
    per_class = (counts.select(*by, F.inline(sides))
                 .groupBy(*by, "class")
                 .agg(*[F.sum(c).alias(c)
                        for c in ("support", "predicted", "tp")]))
    return per_class.select(
        *by, "class", _ratio(C("tp"), C("predicted")).alias("precision"),
        _ratio(C("tp"), C("support")).alias("recall"),
        _ratio(2 * C("tp"), C("predicted") + C("support")).alias("f1"),
        "support", "predicted", "tp")


def classification_metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro / weighted F1, macro precision and recall."""
    total = F.sum("support")
    return class_report(counts, by).groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"), F.avg("f1").alias("f1_macro"),
        (F.sum(C("f1") * C("support")) / total).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"))


def _label_f1(label: int) -> Column:
    """F1 of one class straight from confusion counts."""
    tp = F.sum(F.when((C("y") == label) & (C("p") == label), C("n")).otherwise(0))
    seen = F.sum(F.when(C("y") == label, C("n")).otherwise(0)
                 + F.when(C("p") == label, C("n")).otherwise(0))
    return _ratio(2 * tp, seen)


def _mean_f1(labels) -> Column:
    return sum((_label_f1(x) for x in labels[1:]), _label_f1(labels[0])) / len(labels)


def gate_metrics(counts: DataFrame, by: list[str], labels=(-1, 1)) -> DataFrame:
    """Accuracy, F1 over the given labels, F1 over trades, share of trades.

    ``labels`` are fixed in advance, so an absent class scores 0.
    """
    n = F.sum("n")
    return counts.groupBy(*by).agg(
        (F.sum(F.when(C("y") == C("p"), C("n")).otherwise(0)) / n).alias("accuracy"),
        _mean_f1(labels).alias("f1_macro"), _mean_f1((-1, 1)).alias("f1_action"),
        (F.sum(F.when(C("p") != 0, C("n")).otherwise(0)) / n).alias("trade_rate"))


def confusion_percent(counts: DataFrame, by: list[str],
                      classes=(-1, 1)) -> DataFrame:
    """Rows of the confusion matrix as percentages of each true class."""
    n = F.sum("n")
    return counts.groupBy(*by, "y").agg(*[
        (100 * F.sum(F.when(C("p") == k, C("n")).otherwise(0)) / n)
        .alias(f"pct_pred_{'m' if k < 0 else ''}{abs(k)}") for k in classes])


def action_accuracy(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy on rows whose true class is not hold."""
    return counts.where(C("y") != 0).groupBy(*by).agg(
        (F.sum(F.when(C("y") == C("p"), C("n")).otherwise(0)) / F.sum("n"))
        .alias("action_accuracy"))


def compare_models(metrics: DataFrame, order: str = "f1_macro") -> DataFrame:
    return metrics.orderBy(C(order).desc(), "model_name")


def best_per_group(metrics: DataFrame, group: str, score: str,
                   name: str = "model_name") -> DataFrame:
    """Highest score per group; ties go to the first name."""
    top = metrics.groupBy(group).agg(F.max(score).alias("_top"))
    tied = metrics.join(top, group).where(C(score) == C("_top"))
    others = [c for c in metrics.columns if c != group]
    return (tied.groupBy(group)
            .agg(F.min_by(F.struct(*others), name).alias("b"))
            .select(group, "b.*"))


def brier(df: DataFrame, by: list[str], probs: dict[int, str],
          y: str = "y_true") -> DataFrame:
    """Mean squared error of each class probability."""
    names = {-1: "down", 0: "hold", 1: "up"}
    return df.groupBy(*by).agg(*[
        F.avg(F.pow(C(p) - (C(y) == k).cast("int"), 2)).alias(f"brier_{names[k]}")
        for k, p in probs.items()])
