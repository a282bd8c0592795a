"""Trading calendar and event calendar.

The calendar has one row per trading day.  Everything keyed by date alone is
bounded by it, which is the size argument behind every broadcast of such a
frame and behind the single-partition windows over it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series
from ..sources.local import local_frame

BY_DATE = Series([], "date")
EVENT_COLUMNS = ["date", "event_type", "event_name", "source"]


def per_date(frame: DataFrame) -> DataFrame:
    """Mark a frame with at most one row per (date, few fixed types) for
    broadcast: a century of trading days is below 40,000 rows."""
    return F.broadcast(frame)


def roll_forward_map(calendar: DataFrame, max_days: int = 7) -> DataFrame:
    """(date, trading_date): every day to the same or next trading day.

    Each trading day claims the days since its predecessor, at most
    ``max_days`` back, so an as-of-forward lookup becomes an equi-join.
    """
    earliest = F.date_sub("date", max_days)
    after_prev = F.date_add(BY_DATE.lag("date"), 1)
    return (calendar.select("date", F.greatest(earliest, after_prev).alias("lo"))
            .select(F.explode(F.sequence("lo", "date")).alias("date"),
                    F.col("date").alias("trading_date")))


def next_trading_day(calendar: DataFrame, max_days: int = 10) -> DataFrame:
    """(date, next_date): first later trading day within ``max_days``."""
    nxt = BY_DATE.lead("date")
    return calendar.select("date", nxt.alias("n")).select(
        "date", F.when(F.datediff("n", "date") <= max_days, F.col("n"))
        .alias("next_date"))


# --- event calendar ------------------------------------------------------------
def fixed_events(spark: SparkSession, event_types=tuple(cfg.ALLOWED_EVENTS),
                 shift_days: int = 0) -> DataFrame:
    """Known release dates, optionally moved ``shift_days`` into the past."""
    rows = [(date.fromisoformat(d), kind, name, source)
            for kind in event_types
            for name, source, days in [cfg.FIXED_EVENTS[kind]]
            for d in days]
    frame = local_frame(spark, rows, "date date, event_type string,"
                                     " event_name string, source string")
    return frame.withColumn("date", F.date_sub("date", shift_days))


def build_events(spark: SparkSession, start, end, shift_days: int = 0) -> DataFrame:
    """Union of the fixed lists inside [start, end]; empty when none match."""
    return (fixed_events(spark, shift_days=shift_days)
            .where(F.col("date").between(F.lit(start), F.lit(end))))


def month_end_events(calendar: DataFrame) -> DataFrame:
    return _period_end(calendar, "month", "month_end", "Month End")


def quarter_end_events(calendar: DataFrame) -> DataFrame:
    return _period_end(calendar, "quarter", "quarter_end", "Quarter End")


def _period_end(calendar, unit, kind, name):
    return (calendar.groupBy(F.trunc("date", unit).alias("period"))
            .agg(F.max("date").alias("date"))
            .select("date", F.lit(kind).alias("event_type"),
                    F.lit(name).alias("event_name"),
                    F.lit("NYSE calendar").alias("source")))


def options_expiry_weeks(calendar: DataFrame) -> DataFrame:
    """Trading days in the Monday-Sunday week of each third Friday.

    A week belongs to at most one month's third Friday, found from the Friday
    of that very week: it is the third one when its day of month is 15..21.
    """
    monday = F.date_sub("date", F.weekday("date"))
    friday = F.date_add(monday, 4)
    return (calendar.withColumn("friday", friday)
            .where(F.dayofmonth("friday").between(15, 21))
            .select("date", F.lit("options_expiry_week").alias("event_type"),
                    F.concat(F.lit("Options Expiry Week "),
                             F.date_format("friday", "yyyy-MM")).alias("event_name"),
                    F.lit("computed").alias("source")))


def full_events(spark, calendar: DataFrame, start, end, shift_days: int = 0):
    """Fixed releases plus the computed calendar events."""
    out = build_events(spark, start, end, shift_days)
    for extra in (month_end_events, quarter_end_events, options_expiry_weeks):
        out = out.unionByName(extra(calendar))
    return out


def event_flags(events: DataFrame, event_types=tuple(cfg.ALLOWED_EVENTS),
                prefix: str = "is_", suffix: str = "") -> DataFrame:
    """One row per event date with a 0/1 column per requested type."""
    flags = [F.max((F.col("event_type") == t).cast("int"))
             .alias(f"{prefix}{t}{suffix}") for t in event_types]
    return (events.where(F.col("event_type").isin(list(event_types)))
            .groupBy("date").agg(*flags))


def with_event_flags(df: DataFrame, events: DataFrame | None) -> DataFrame:
    """``is_<type>`` flags for the allowed types; none without an event frame."""
    if events is None:
        return df
    names = [f"is_{t}" for t in cfg.ALLOWED_EVENTS]
    return (df.join(per_date(event_flags(events)), "date", "left")
            .fillna(0, subset=names))
