"""Row-level column helpers with the null rules used across the package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(numerator, denominator) -> Column:
    """Division that yields NULL instead of infinity for a zero denominator."""
    return F.try_divide(numerator, denominator)


def flag(condition: Column) -> Column:
    """0/1 flag; an unknown comparison counts as 0, not NULL."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def clip(value: Column, low, high) -> Column:
    """Bound ``value`` to [low, high], keeping NULL (least/greatest skip it)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    inf = float("inf")
    return F.when(~F.isnan(value) & (value != inf) & (value != -inf), value)


def rounded(value, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def round_frame(df, digits: int | dict[str, int] = 6):
    """Round every double column; other columns pass through.

    A mapping gives digits per column, with the key ``""`` as the default.
    """
    def places(name):
        if isinstance(digits, int):
            return digits
        return digits.get(name, digits.get("", 6))

    return df.select(*[
        rounded(F.col(f"`{name}`"), places(name)).alias(name)
        if kind == "double" else F.col(f"`{name}`")
        for name, kind in df.dtypes])


def to_int(value: Column) -> Column:
    """Numeric text or double to int, rounding halves away from zero."""
    return F.round(value.cast("double")).cast("int")


def coerce_double(value: Column) -> Column:
    """Parse to double; anything unparsable becomes NULL."""
    return value.try_cast("double")


def vol_scaled(ret: Column, vol: Column) -> Column:
    """Return divided by volatility; NULL when volatility is missing or <= 0."""
    return F.when(vol > 0, ret / vol)


def direction(pred: Column) -> Column:
    """Predicted class 1 is UP, every other class DOWN."""
    return F.when(pred == 1, F.lit("UP")).otherwise(F.lit("DOWN"))


def recommendation(pred: Column, *probs: Column) -> Column:
    """Three-class text such as ``BUY (0.71)`` with the top probability."""
    word = (F.when(pred == 1, "BUY").when(pred == -1, "SELL").otherwise("HOLD"))
    return F.format_string("%s (%.2f)", word, F.greatest(*probs))


def triple_barrier(vol_ret: Column, barrier: float) -> Column:
    """1 above +barrier, -1 below -barrier, 0 between, NULL when unknown."""
    return (F.when(vol_ret.isNull(), F.lit(None).cast("int"))
            .when(vol_ret > barrier, 1)
            .when(vol_ret < -barrier, -1)
            .otherwise(0))


def binary_class(raw: Column) -> Column:
    """1 for a positive return, -1 for zero or negative, NULL when unknown."""
    return F.when(raw > 0, 1).when(raw <= 0, -1)


def normalised_pct(part: Column, *parts: Column) -> Column:
    """Share of ``part`` in the sum of ``parts`` as a percentage (sum 0 -> 1)."""
    total = sum(parts[1:], parts[0])
    return part / F.when(total == 0, 1.0).otherwise(total) * 100
