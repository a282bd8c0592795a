"""Lagged features and the check that they only look back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series
from .technical import BY_SYMBOL


def lag_names(spec: dict[str, list[int]] | None = None) -> list[str]:
    spec = cfg.LAG_SPEC if spec is None else spec
    return [f"{f}_lag{n}" for f, ns in spec.items() for n in ns]


def with_lags(df: DataFrame, spec: dict[str, list[int]] | None = None,
              s: Series = BY_SYMBOL) -> DataFrame:
    """Add ``<feature>_lag<n>``; features the frame lacks are skipped."""
    spec = cfg.LAG_SPEC if spec is None else spec
    return df.withColumns({f"{f}_lag{n}": s.lag(f, n)
                           for f, ns in spec.items() if f in df.columns
                           for n in ns})


def lag_leakage(df: DataFrame, s: Series = BY_SYMBOL, rtol: float = 1e-5,
                atol: float = 1e-8) -> DataFrame:
    """One row per lag column: early non-null rows and value mismatches."""
    pairs = []
    for name in df.columns:
        base, sep, tail = name.rpartition("_lag")
        if sep and tail.isdigit() and base in df.columns:
            pairs.append((name, base, int(tail)))
    marks = {"_rn": s.row_number()}
    for name, base, n in pairs:
        marks[f"_ref_{name}"] = s.lag(base, n)
    checked = df.withColumns(marks)
    aggs = []
    for name, _, n in pairs:
        got, ref = F.col(name), F.col(f"_ref_{name}")
        early = (F.col("_rn") <= n) & got.isNotNull()
        close = got.eqNullSafe(ref) | F.coalesce(
            F.abs(got - ref) <= atol + rtol * F.abs(ref), F.lit(False))
        wrong = (F.col("_rn") > n) & ~close
        aggs += [F.sum(early.cast("long")).alias(f"e_{name}"),
                 F.sum(wrong.cast("long")).alias(f"w_{name}")]
    rows = [F.struct(F.lit(name).alias("column"),
                     F.col(f"e_{name}").alias("early_values"),
                     F.col(f"w_{name}").alias("mismatches"))
            for name, _, _ in pairs]
    return checked.agg(*aggs).select(F.inline(F.array(*rows)))
