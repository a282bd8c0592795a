"""Dataset preparation: splits, imputation, scaling and class weights.

Fitting returns a handful of numbers per feature from single-pass aggregates;
those numbers become literals of the transform plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg

C = F.col
NOT_FEATURES = ("symbol", "date", "y_class_1d", "y_class_5d")


# --- splits ------------------------------------------------------------------
def check_split_borders(splits: dict[str, tuple[date, date]]) -> None:
    for left, right in (("train", "val"), ("val", "test")):
        if splits[left][1] >= splits[right][0]:
            raise ValueError(f"{left} and {right} periods overlap")


def with_split(df: DataFrame, splits=None) -> DataFrame:
    """Label rows train / val / test by date; rows outside are dropped."""
    splits = splits or cfg.SPLITS
    check_split_borders(splits)
    name = F.lit(None).cast("string")
    for split, (lo, hi) in splits.items():
        name = F.when(C("date").between(F.lit(lo), F.lit(hi)), split).otherwise(name)
    return df.withColumn("split", name).where(C("split").isNotNull())


def time_splits(df: DataFrame, splits=None) -> dict[str, DataFrame]:
    """The three frames; an empty one is an error."""
    splits = splits or cfg.SPLITS
    check_split_borders(splits)
    out = {name: df.where(C("date").between(F.lit(lo), F.lit(hi)))
           for name, (lo, hi) in splits.items()}
    for name, part in out.items():
        if part.limit(1).count() == 0:
            raise ValueError(f"{name} split is empty")
    return out


def class_distribution(df: DataFrame, target: str, splits=None) -> DataFrame:
    """(split, class, n, pct of the split)."""
    counts = (with_split(df, splits).groupBy("split", C(target).alias("class"))
              .agg(F.count("*").alias("n")))
    totals = counts.groupBy("split").agg(F.sum("n").alias("total"))
    return (counts.where(C("class").isNotNull()).join(totals, "split")
            .select("split", "class", "n", (100 * C("n") / C("total")).alias("pct")))


def feature_columns(df: DataFrame) -> list[str]:
    """Everything but identifiers and both targets."""
    return [c for c in df.columns if c not in NOT_FEATURES]


def long_form(df: DataFrame, names: list[str]) -> DataFrame:
    """(f, v) for every value of the named columns; ``f`` is the place of the column among them."""
    return df.select(F.posexplode(F.array(*[F.col(f"`{n}`").cast("double") for n in names])).alias("f", "v"))


# --- exact medians -------------------------------------------------------------
def exact_medians(df: DataFrame, names: list[str],
                  accuracy: int = 10000) -> dict[str, float | None]:
    """Medians without gathering a column in one place.

    An approximate pass brackets the middle ranks of every column.  A second
    pass counts the values below each bracket and groups those inside it, which
    is a sliver of the data, and the middle ranks are read off its running
    counts.  Both take (column, value) rows: one aggregate over all columns side by
    side is a plan whose compilation costs more than small tables do.
    """
    slack = 2.0 / accuracy
    values = long_form(df, names).where("v IS NOT NULL")
    probe = {r.f: r for r in values.groupBy("f").agg(
        F.count("v").alias("n"),
        F.percentile_approx("v", [0.5 - slack, 0.5 + slack], accuracy).alias("b")).collect()}
    if not probe:
        return {n: None for n in names}

    def of(value) -> Column:
        """A number of the row's own column."""
        known = [F.lit(value(probe[i]) if i in probe else None) for i in range(len(names))]
        return F.element_at(F.array(*known), C("f") + 1)

    # values inside the bracket of their column one by one, those below it as one group
    below = C("v") < of(lambda r: r.b[0])
    inside = (values.where(C("v") <= of(lambda r: r.b[1]))
              .groupBy("f", F.when(~below, C("v")).alias("v")).agg(F.count("*").alias("n")))
    from pyspark.sql import Window

    run = Window.partitionBy("f").orderBy(C("v").asc_nulls_first())
    ranked = inside.withColumn("upto", F.sum("n").over(run)).withColumn("from", C("upto") - C("n"))
    total = of(lambda r: r.n)
    left = F.floor((total - 1) / 2)
    right = F.floor(total / 2)
    rows = ranked.groupBy("f").agg(
        F.max(F.when((C("from") <= left) & (left < C("upto")), C("v"))).alias("a"),
        F.max(F.when((C("from") <= right) & (right < C("upto")), C("v"))).alias("b")
    ).collect()
    out: dict[str, float | None] = {n: None for n in names}
    for row in rows:
        if row.a is None or row.b is None:
            raise ArithmeticError("median rank outside its bracket")
        out[names[row.f]] = (row.a + row.b) / 2
    return out


# --- preprocessor ----------------------------------------------------------------
@dataclass
class Preprocessor:
    """Missing-rate drop, imputation and optional scaling, fitted on train."""

    drop_threshold: float = 0.30
    strategy: str = "median"           # median | mean | most_frequent
    scaling: bool = False
    dropped: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    fills: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, train: DataFrame, names: list[str] | None = None) -> "Preprocessor":
        names = names or feature_columns(train)
        rates = train.agg(*[F.avg(C(n).isNull().cast("int")).alias(n)
                            for n in names]).first().asDict()
        self.dropped = [n for n in names if rates[n] > self.drop_threshold]
        self.kept = [n for n in names if n not in set(self.dropped)]
        self.fills = self._fit_fills(train)
        if self.scaling:
            filled = train.select(*[self._filled(n).alias(n) for n in self.kept])
            row = filled.agg(*[x for n in self.kept for x in (
                F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))]).first()
            self.scales = {n: (row[f"m_{n}"], row[f"s_{n}"] or 1.0)
                           for n in self.kept}
        return self

    def _fit_fills(self, train: DataFrame) -> dict[str, float]:
        if self.strategy == "median":
            found = exact_medians(train, self.kept)
        elif self.strategy == "mean":
            found = train.agg(*[F.avg(n).alias(n)
                                for n in self.kept]).first().asDict()
        else:
            found = modes(train, self.kept)
        return {n: float(v) for n, v in found.items() if v is not None}

    def _filled(self, name: str):
        value = C(name).cast("double")
        return (F.coalesce(value, F.lit(self.fills[name]))
                if name in self.fills else value)

    def transform(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns
                if c not in self.kept and c not in self.dropped]
        cols = []
        for n in self.kept:
            value = self._filled(n)
            if self.scaling:
                mean, std = self.scales[n]
                value = (value - mean) / std
            cols.append(value.alias(n))
        return df.select(*rest, *cols)


def modes(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Most frequent value per column, the smallest of equals."""
    entries = F.array(*[F.struct(F.lit(n).alias("f"),
                                 C(n).cast("double").alias("v")) for n in names])
    counts = (df.select(F.inline(entries)).where(C("v").isNotNull())
              .groupBy("f", "v").agg(F.count("*").alias("n")))
    rows = counts.groupBy("f").agg(F.max_by(
        "v", F.struct("n", -C("v"))).alias("v")).collect()
    return {r.f: r.v for r in rows}


def missing_rates(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, missing_rate) from one pass."""
    row = df.agg(*[F.avg(C(n).isNull().cast("int")).alias(n) for n in names])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), C(n).alias("missing_rate"))
        for n in names])))


def class_weights(df: DataFrame, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Balanced weight n / (k * n_class) per class."""
    counts = (df.where(C(target).isNotNull()).groupBy(*by, C(target).alias("class"))
              .agg(F.count("*").alias("n_class")))
    from pyspark.sql import Window

    # one row per class: a handful of rows per group
    group = Window.partitionBy(*(by or [F.lit(0)]))
    n, k = F.sum("n_class").over(group), F.count("*").over(group)
    return counts.select(*by, "class", "n_class",
                         (n / (k * C("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, target: str) -> DataFrame:
    weights = {r["class"]: r["weight"] for r in class_weights(df, target).collect()}
    expr = F.create_map(*[x for k, v in weights.items()
                          for x in (F.lit(k), F.lit(v))])
    return df.withColumn("weight", expr[C(target)])
