"""Exponential moving averages as a short chain of LAG windows.

An EMA is the infinite sum  e_t = sum_j d^j * u_{t-j}  with d = 1 - alpha,
u_0 = x_0 for the first row and u_t = alpha * x_t afterwards.  Let E_s(t) be
the part of that sum over the latest s rows.  Then

    E_{r*s}(t) = sum_{i<r} d^(i*s) * E_s(t - i*s)

so each pass multiplies the covered span by the radix r.  A pass reads only
earlier rows at constant offsets, which is a plain LAG over the very window
used by all other features: no recursion, no extra shuffle, no extra sort, and
linear cost per row.  Passes stop once the omitted weight d^s is below double
precision, so the result equals the recursive definition to rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import Series

NEGLIGIBLE = 1e-18
WIDE_RADIX = 8        # measured best: a few cheap offsets per pass


def decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def rows_needed(span: int) -> int:
    """Rows after which the remaining weight is below double precision."""
    if span <= 1:
        return 1
    return math.ceil(math.log(NEGLIGIBLE) / math.log(decay(span)))


def plan_passes(rows: int) -> tuple[int, int]:
    """(passes, radix): fewest passes whose radix stays moderate."""
    passes = 1
    while math.ceil(rows ** (1 / passes)) > WIDE_RADIX:
        passes += 1
    return passes, max(2, math.ceil(rows ** (1 / passes)))


def with_ema(df: DataFrame, series: Series,
             targets: dict[str, tuple[str, int]], gaps: bool = False,
             carried: str | None = None) -> DataFrame:
    """Add EMA columns: ``targets`` maps output name -> (input column, span).

    All targets advance together, one Window operator per pass.  Without
    ``gaps`` inputs must be non-null; seeds and LAG defaults are therefore
    never null, which keeps the generated projection small enough for the JIT
    even with many targets.  Inputs that may be null need ``gaps``.

    ``carried`` names a struct column, null for series that start in ``df``: the
    row ``order`` from which an average goes on and its value there, by output
    name.  Rows before it hold nothing of use.
    """
    if gaps:
        for out, (src, span) in targets.items():
            df = _with_gapped_ema(df, series, out, src, span)
        return df
    keys = ", ".join(series.keys) or "0"
    over = f"OVER (PARTITION BY {keys} ORDER BY {series.order})"
    df = df.withColumns({out: F.expr(_seed_sql(out, src, span, series.order, over, carried))
                         for out, (src, span) in targets.items()})
    passes, radix = plan_passes(max(rows_needed(n) for _, n in targets.values()))
    for level in range(passes):
        step = radix ** level
        df = df.withColumns({
            out: F.expr(_pass_sql(out, decay(span), step, radix, over))
            for out, (_, span) in targets.items()
            if step <= rows_needed(span)})
    return df


def _seed_sql(out: str, src: str, span: int, order: str, over: str, carried: str | None) -> str:
    """What a row adds: all of its value where the series starts, its share later.

    A carried average stands for all rows up to its own.
    """
    share = f"{1.0 - decay(span)!r}D"
    fresh = f"coalesce({src}, 0D) * CASE WHEN row_number() {over} = 1 THEN 1D ELSE {share} END"
    if not carried:
        return fresh
    return (f"CASE WHEN {carried} IS NULL THEN {fresh} WHEN {order} < {carried}.{order} THEN 0D"
            f" WHEN {order} = {carried}.{order} THEN {carried}.{out} ELSE coalesce({src}, 0D) * {share} END")


def _with_gapped_ema(df: DataFrame, series: Series, out: str, src: str,
                     span: int) -> DataFrame:
    """EMA of a column with missing values.

    A missing value carries the average on; the next observation, g rows after
    the one before, weighs alpha against d^g.  Observed rows are thus a chain of
    maps  e -> A e + B  with A = d^g / (d^g + alpha) and B = alpha x / (d^g + alpha),
    and the passes compose maps instead of adding weighted values.  They run over
    the observed rows alone, so a gap takes no part of the covered span.
    """
    d = decay(span)
    keys = ", ".join(series.keys) or "0"
    every = f"OVER (PARTITION BY {keys} ORDER BY {series.order})"
    over = f"OVER (PARTITION BY {keys}, {src} IS NULL ORDER BY {series.order})"
    weight = f"pow({d!r}D, _at - lag(_at) {over})"
    df = df.withColumn("_at", F.expr(f"row_number() {every}"))
    df = df.withColumns({
        "_a": F.expr(f"coalesce({weight} / ({weight} + {1.0 - d!r}D), 0D)"),
        "_b": F.expr(f"CASE WHEN {src} IS NULL THEN 0D ELSE"
                     f" {src} * coalesce({1.0 - d!r}D / ({weight} + {1.0 - d!r}D), 1D) END")})
    passes, radix = plan_passes(rows_needed(span))
    for level in range(passes):
        step = radix ** level
        product, terms = "1D", []
        for i in range(radix):
            terms.append(f"({product}) * lag(_b, {i * step}, 0D) {over}")
            product = f"{product} * lag(_a, {i * step}, 0D) {over}"
        df = df.withColumns({"_b": F.expr(" + ".join(terms)), "_a": F.expr(product)})
    known = F.when(F.col(src).isNotNull(), F.col("_b"))
    return (df.withColumn(out, F.last(known, ignorenulls=True).over(series.so_far))
            .drop("_at", "_a", "_b"))


def _pass_sql(name: str, d: float, step: int, radix: int, over: str) -> str:
    """One pass as SQL text: the mechanical part of the sum above."""
    terms = [name]
    for i in range(1, radix):
        weight = d ** (i * step)
        if weight < NEGLIGIBLE:
            break
        terms.append(f"{weight!r}D * lag({name}, {i * step}, 0D) {over}")
    return " + ".join(terms)
