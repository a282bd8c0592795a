"""Row-positional window expressions over one ordered series.

``Series(keys, order)`` fixes the partition and order once; every expression
it returns shares that specification, so Catalyst plans one exchange and one
sort for all of them.  A partition holds one row per key and trading day, which
bounds its size by the calendar no matter how many raw rows were aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import safe_div


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Series:
    """Window vocabulary for one (partition keys, order column) pair."""

    def __init__(self, keys=("symbol",), order: str = "date"):
        self.keys = list(keys)
        self.order = order

    @property
    def whole(self):
        # Series without a key (one row per date) live in a single partition.
        return Window.partitionBy(*(self.keys or [F.lit(0)]))

    @property
    def ordered(self):
        return self.whole.orderBy(self.order)

    @property
    def so_far(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def frame(self, width: int) -> Window:
        return self.ordered.rowsBetween(1 - width, 0)

    # positional access -----------------------------------------------------
    def lag(self, value, n: int = 1) -> Column:
        return F.lag(_col(value), n).over(self.ordered)

    def lead(self, value, n: int = 1) -> Column:
        return F.lead(_col(value), n).over(self.ordered)

    def row_number(self) -> Column:
        return F.row_number().over(self.ordered)

    def diff(self, value, n: int = 1, shift: int = 0) -> Column:
        """``shift`` rows back, then the n-row difference."""
        value = _col(value)
        newer = self.lag(value, shift) if shift else value
        return newer - self.lag(value, shift + n)

    # full-window aggregates (NULL until the frame holds w non-null rows) ----
    def _gated(self, value: Column, agg: Column, width: int,
               min_rows: int | None = None) -> Column:
        need = width if min_rows is None else min_rows
        frame = self.frame(width)
        return F.when(F.count(value).over(frame) >= need, agg.over(frame))

    def mean(self, value, width: int, min_rows: int | None = None) -> Column:
        value = _col(value)
        return self._gated(value, F.avg(value), width, min_rows)

    def std(self, value, width: int, min_rows: int | None = None) -> Column:
        value = _col(value)
        return self._gated(value, F.stddev_samp(value), width, min_rows)

    def max(self, value, width: int) -> Column:
        value = _col(value)
        return self._gated(value, F.max(value), width)

    def quantile(self, value, q: float, width: int) -> Column:
        value = _col(value)
        return self._gated(value, F.percentile(value, q), width)

    def correlation(self, left, right, frame) -> Column:
        """Pearson correlation over a frame; NULL when either side is constant.

        The built-in ``corr`` raises on a constant side under ANSI rules.
        """
        left, right = _col(left), _col(right)
        joint = left.isNotNull() & right.isNotNull()
        spread = (F.stddev_pop(F.when(joint, left)).over(frame)
                  * F.stddev_pop(F.when(joint, right)).over(frame))
        return safe_div(F.covar_pop(left, right).over(frame), spread)

    def corr(self, left, right, width: int) -> Column:
        """Correlation once the frame holds ``width`` joint values."""
        left, right = _col(left), _col(right)
        frame = self.frame(width)
        joint = F.when(left.isNotNull() & right.isNotNull(), 1)
        return F.when(F.count(joint).over(frame) >= width,
                      self.correlation(left, right, frame))

    def cumulative(self, value) -> Column:
        return F.sum(_col(value)).over(self.so_far)

    # forward filling and relative change -------------------------------------
    def filled(self, value, limit: int | None = None) -> Column:
        """Last known value, optionally at most ``limit`` rows old."""
        frame = (self.so_far if limit is None
                 else self.ordered.rowsBetween(-limit, 0))
        return F.last(_col(value), ignorenulls=True).over(frame)

    def filled_before(self, value, shift: int) -> Column:
        """The filled value as it stood ``shift`` rows ago."""
        frame = self.ordered.rowsBetween(Window.unboundedPreceding, -shift)
        return F.last(_col(value), ignorenulls=True).over(frame)

    def pct_change(self, value, n: int = 1, shift: int = 0) -> Column:
        """Relative change over n rows of the forward-filled series.

        A leading shift delays the whole series first; filling a delayed
        series equals delaying the filled one, so one frame serves each end.
        """
        newer = (self.filled_before(value, shift) if shift
                 else self.filled(value))
        return safe_div(newer, self.filled_before(value, shift + n)) - 1


def with_moments(df: DataFrame, s: Series, value: str, width: int, out: str) -> DataFrame:
    """Count, mean and centred squares of ``value`` over the last ``width`` rows.

    Adds ``<out>_n``, ``<out>_mean`` and ``<out>_squares``.  Moments of blocks are merged:
    those of 2, 4, 8 ... rows from two halves each, by LAGs at constant offsets,
    and those of the frame from the blocks that its width is made of.  A row costs
    log2(width) merges instead of ``width`` updates, and no large sums are
    subtracted from each other, so a far offset takes no digits away.
    """
    keys = ", ".join(f"`{k}`" for k in s.keys) or "0"
    over = f"OVER (PARTITION BY {keys} ORDER BY {s.order})"
    parts, zeros = ("n", "mean", "squares"), {"n": "0L", "mean": "0D", "squares": "0D"}
    known = f"`{value}` IS NOT NULL"
    df = df.withColumns({"_b_n": F.expr(f"IF({known}, 1L, 0L)"), "_b_mean": F.expr(f"coalesce(`{value}`, 0D)"),
                         "_b_squares": F.lit(0.0)})
    covered, size = 0, 1
    while size <= width:
        last = size * 2 > width
        # the block behind what the frame has so far, and the one behind the block itself
        wanted = {"_p": covered} if width & size else {}
        wanted |= {} if last else {"_q": size}
        df = df.withColumns({f"{name}_{part}": F.expr(f"lag(_b_{part}, {offset}, {zeros[part]}) {over}")
                             if offset else F.col(f"_b_{part}")
                             for name, offset in wanted.items() for part in parts})
        merged = {}
        if "_p" in wanted:
            merged |= _merged_moments(out, "_p", out) if covered else {
                f"{out}_{part}": F.col(f"_p_{part}") for part in parts}
            covered += size
        if not last:
            merged |= _merged_moments("_b", "_q", "_b")
        df = df.withColumns(merged).drop(*[f"{name}_{part}" for name in wanted for part in parts])
        size *= 2
    return df.drop(*[f"_b_{part}" for part in parts])


def _merged_moments(a: str, b: str, out: str) -> dict[str, Column]:
    n, apart = f"({a}_n + {b}_n)", f"({b}_mean - {a}_mean)"
    return {f"{out}_n": F.expr(n),
            f"{out}_mean": F.expr(f"{a}_mean + coalesce(try_divide({apart} * {b}_n, {n}), 0D)"),
            f"{out}_squares": F.expr(f"{a}_squares + {b}_squares"
                                     f" + coalesce(try_divide({apart} * {apart} * {a}_n * {b}_n, {n}), 0D)")}
