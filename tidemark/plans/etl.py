"""Backfill and incremental runs over the stored tables.

A run resolves its date range from the stored high-water mark, merges the new
raw rows and derives what they change, so that any sequence of runs leaves what
one backfill would: features from shortly before the start, as a late macro
observation fills days before it; labels and outcomes of the rows whose outcome was
open; older labels whose clip the new deviation of the whole series moves; and
calendar events of the quarter that was open.  One plan serves all symbols.

What depends on a series' first row is carried from run to run: the smoothed
averages at every row, and count, mean and centred squares of the known returns.  An
incremental run therefore reads bars back to the widest frame only.  State is
stored before what it describes, and a run goes on from the state before its first
day, so one that failed halfway can be repeated.  Series without state, as in
stores of an older form, are rebuilt from their first row.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..operators import targets as L
from ..operators.calendars import fixed_events, full_events
from ..operators.feature_store import pack_features
from ..operators.macro import macro_daily
from ..operators.targets import HORIZONS, build_labels
from ..operators.technical import CARRIED, realized_vol_20
from ..sources.files import date_range
from ..session import at_once
from ..sources.keyed import KeyedTable, staged
from .feature_build import Inputs, build_features

OUTCOMES = ["outcome_price_1d", "outcome_price_5d"]


@dataclass
class Feeds:
    """Raw inputs: bars, macro observations and the trading calendar."""

    bars: DataFrame
    macro: DataFrame
    calendar: DataFrame
    event_shift_days: int = 0


class Store:
    """The keyed tables of one deployment below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        by_asset = ["symbol", "date"]
        self.bars = KeyedTable(spark, f"{root}/daily_bars", by_asset)
        self.macro = KeyedTable(spark, f"{root}/macro_daily", ["series_key", "date"])
        self.features = KeyedTable(spark, f"{root}/features_daily", by_asset)
        self.labels = KeyedTable(spark, f"{root}/labels_daily", by_asset)
        self.averages = KeyedTable(spark, f"{root}/feature_state", by_asset)
        self.moments = KeyedTable(spark, f"{root}/label_state", by_asset)
        self.events = KeyedTable(spark, f"{root}/events_calendar",
                                 ["event_type", "date"])
        self.predictions = KeyedTable(
            spark, f"{root}/predictions",
            ["symbol", "date", "horizon", "model_name", "split"])

    def high_water_mark(self) -> date | None:
        """Smallest of the latest dates of bars, features and labels."""
        marks = [t.read().agg(F.max("date").alias("d"))
                 for t in (self.bars, self.features, self.labels) if t.exists()]
        if not marks:
            return None
        union = marks[0]
        for m in marks[1:]:
            union = union.unionByName(m)
        return union.agg(F.min("d")).first()[0]

    def clear_data(self) -> None:
        """Empty every data table; metadata tables are not touched."""
        for t in (self.bars, self.macro, self.features, self.labels, self.averages,
                  self.moments, self.events, self.predictions):
            if t.exists():
                t.clear()


@dataclass
class Window:
    """A run's days; ``read_from``: first day of the bars it read, None for all."""

    start: date
    end: date
    mode: str
    read_from: date | None = None
    reclipped: int = 0


def resolve_window(store: Store, calendar: DataFrame, end: date,
                   start: date | None = None,
                   mode: str = "backfill") -> Window | None:
    """Date range of a run, or None when there is nothing to do."""
    if start is None:
        mark = store.high_water_mark()
        if mark is None:
            start, mode = cfg.DEFAULT_START, "backfill"
        else:
            later = calendar.where((F.col("date") > F.lit(mark))
                                   & (F.col("date") <= F.lit(end)))
            start, mode = later.agg(F.min("date")).first()[0], "incremental"
            if start is None:
                return None
    in_range = calendar.where(F.col("date").between(F.lit(start), F.lit(end)))
    if in_range.limit(1).count() == 0:
        return None
    return Window(start, end, mode)


def is_run_day(day: date, force: bool = False) -> bool:
    """Weekend runs are skipped unless forced."""
    return force or day.weekday() < 5


def renewed_from(store: Store, feeds: Feeds, window: Window) -> date:
    """First day whose macro values a run can change.

    A series is carried on only once its next observation is there, so one that
    reports rarely fills days right after its last stored one.
    """
    recent = window.start - timedelta(days=cfg.RENEWED_DAYS)
    reporting = date_range(feeds.macro, window.start, window.end).select("series_key").distinct()
    last = (store.macro.read().join(reporting, "series_key").groupBy("series_key")
            .agg(F.max("date").alias("d")).agg(F.min("d")).first()[0])
    return min(recent, last or recent)


# --- carried state -------------------------------------------------------------------
#: Days before a run in which nearly every live series has a state.
STATE_DAYS = 400


def latest_state(table: KeyedTable, symbols: DataFrame, before: date) -> DataFrame | None:
    """(symbol, state) of the newest row before a day; None if a table has none at all.

    Series that were silent for longer than ``STATE_DAYS`` cost a look at older partitions.
    """
    if not table.exists():
        return None
    edge = before - timedelta(days=STATE_DAYS)

    def newest(rows: DataFrame, of: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "symbol"]
        return (rows.join(of, "symbol", "left_semi").groupBy("symbol")
                .agg(F.max_by(F.struct(*rest), "date").alias("state")))

    recent = newest(table.read(edge, before - timedelta(days=1)), symbols)
    silent = symbols.join(recent, "symbol", "left_anti")
    if not silent.head(1):
        return recent
    return recent.unionByName(newest(table.read(None, edge - timedelta(days=1)), silent))


@dataclass
class Carried:
    """State of the ETF series that a run goes on from, and the day back to which bars are needed."""

    averages: DataFrame
    moments: DataFrame
    since: date


def carried_state(store: Store, window: Window, renewed: date, scope: ExitStack) -> Carried | None:
    """None where a series would have to be rebuilt from its first row.

    The state is copied for as long as ``scope``, as the run replaces its tables.
    """
    if window.mode != "incremental":
        return None
    etf = store.bars.read(renewed, window.end).where(F.col("symbol").isin(cfg.ETF_SYMBOLS))
    symbols = etf.select("symbol").distinct()
    averages = latest_state(store.averages, symbols, renewed)
    moments = latest_state(store.moments, symbols, window.start)
    if averages is None or moments is None:
        return None
    averages, moments = (scope.enter_context(staged(store.spark, x, "state")) for x in (averages, moments))
    unknown = symbols.join(averages, "symbol", "left_anti").unionByName(symbols.join(moments, "symbol", "left_anti"))
    if unknown.head(1) and store.bars.read(None, renewed - timedelta(days=1)).join(
            unknown.distinct(), "symbol", "left_semi").head(1):
        return None
    row = averages.agg(F.min("state.frame_from").alias("f")).first()
    opened = moments.agg(F.min(F.least(*[F.col(f"state.upto_{h}d") for h in HORIZONS])).alias("f")).first()
    since = min(d for d in (row.f, opened.f, renewed) if d is not None)
    return Carried(averages, moments, since)


def bars_since(store: Store, since: date, end: date) -> DataFrame:
    """Bars of a range, and the last earlier one of each context series that has none in it.

    A context series that fell silent is still filled forward.
    """
    bars = store.bars.read(since, end)
    context = [*cfg.PROXY_SYMBOLS, *cfg.ETF_SYMBOLS]
    seen = {r.symbol for r in bars.where(F.col("symbol").isin(context)).select("symbol").distinct().collect()}
    silent = [s for s in context if s not in seen]
    older = store.bars.read(None, since - timedelta(days=1)).where(F.col("symbol").isin(silent))
    if not silent or not older.head(1):
        return bars
    rest = [c for c in bars.columns if c != "symbol"]
    last = older.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("r")).select("symbol", "r.*")
    return bars.unionByName(last.select(*bars.columns))


def macro_since(store: Store, since: date, end: date) -> DataFrame:
    """Macro rows of a range and the last earlier value of each series, which may still be filled forward."""
    rows = store.macro.read(since, end)
    rest = [c for c in rows.columns if c != "series_key"]
    older = store.macro.read(None, since - timedelta(days=1)).where("value IS NOT NULL")
    last = older.groupBy("series_key").agg(F.max_by(F.struct(*rest), "date").alias("r")).select("series_key", "r.*")
    return rows.unionByName(last.select(*rows.columns))


def _derive(spark: SparkSession, store: Store, feeds: Feeds, window: Window, renewed: date) -> None:
    """Features, labels and outcomes that the merged raw rows change."""
    with ExitStack() as scope:
        end, carried = window.end, carried_state(store, window, renewed, scope)
        if carried is None:
            bars, macro = store.bars.read(None, end), store.macro.read(None, end)
        else:
            window.read_from = carried.since
            bars, macro = bars_since(store, carried.since, end), macro_since(store, carried.since, end)
        # outcomes lie ahead of their row: they are no feature
        inputs = Inputs(bars=bars.drop(*OUTCOMES), macro=macro, events=fixed_events(
            spark, shift_days=feeds.event_shift_days).where(F.col("date") <= F.lit(end)))
        built = build_features(inputs, carried and carried.averages, keep_state=True)
        features = scope.enter_context(staged(spark, built.where(F.col("date") >= F.lit(renewed)), "features"))
        store.averages.merge(features.select(
            "symbol", "date", F.col("_frame_from").alias("frame_from"), *[f"_state.{c}" for c in CARRIED]))
        store.features.merge(pack_features(features.drop("_state", "_frame_from")))

        # labels need closes and one volatility column, not the feature plan
        returns = realized_vol_20(inputs.etf_bars)
        if carried is None:
            labels = scope.enter_context(staged(spark, build_labels(returns), "labels"))
            store.moments.merge(L.return_moments(labels))
        else:
            labels = _open_labels(spark, store, window, returns, carried, scope)
        store.bars.merge(labels.select("symbol", "date", *OUTCOMES), columns=OUTCOMES)
        store.labels.merge(labels.drop(*OUTCOMES))


def _open_labels(spark: SparkSession, store: Store, window: Window, returns: DataFrame,
                 carried: Carried, scope: ExitStack) -> DataFrame:
    """Labels of the rows whose outcome was open; moves the clip of older ones where the deviations do."""
    days = carried.moments.select("symbol", "state.*")
    upto = days.select("symbol", *[F.col(f"upto_{h}d").alias(f"_upto_{h}d") for h in HORIZONS])
    fresh = L.raw_returns(returns).join(upto, "symbol", "left").withColumns({
        f"y_{h}d_raw": F.when(F.coalesce(F.col("date") > F.col(f"_upto_{h}d"), F.lit(True)), F.col(f"y_{h}d_raw"))
        for h in HORIZONS})
    moments = scope.enter_context(staged(spark, L.merged_moments(days, L.return_moments(fresh)), "moments"))
    store.moments.merge(moments)
    bounds = moments.select("symbol", *[L.deviation(h).alias(f"sigma_{h}d") for h in HORIZONS]).join(
        days.select("symbol", *[L.deviation(h).alias(f"before_{h}d") for h in HORIZONS],
                    F.least(*[f"upto_{h}d" for h in HORIZONS]).alias("_settled")), "symbol", "left")
    bounds = scope.enter_context(staged(spark, bounds, "bounds"))
    settled = F.coalesce(F.col("date") <= F.col("_settled"), F.lit(False))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(bounds.select("symbol", "_settled"), "symbol")

    labels = marked(build_labels(returns, deviations=bounds)).where(~settled).drop("_settled")
    labels = scope.enter_context(staged(spark, labels, "labels"))
    old = marked(store.labels.read()).where(settled).drop("_settled")
    moved = scope.enter_context(staged(spark, L.reclipped(old, bounds), "reclipped"))
    window.reclipped = moved.count()
    if window.reclipped:
        store.labels.merge(moved, columns=[f"y_{h}d_clipped" for h in HORIZONS])
    return labels


def run_etl(spark: SparkSession, store: Store, feeds: Feeds, end: date,
            start: date | None = None, mode: str = "backfill") -> Window | None:
    window = resolve_window(store, feeds.calendar, end, start, mode)
    if window is None:
        return None
    start, calendar = window.start, feeds.calendar
    renewed = renewed_from(store, feeds, window) if window.mode == "incremental" else start

    def merge_macro() -> None:
        seen = date_range(feeds.macro, renewed - timedelta(days=cfg.RENEWED_DAYS), end)
        store.macro.merge(date_range(macro_daily(seen, calendar), renewed, end))

    def merge_events() -> None:
        quarter = date(renewed.year, (renewed.month - 1) // 3 * 3 + 1, 1)
        since = quarter if window.mode == "incremental" else start
        if store.events.exists():
            # the last day of a period that was open may not be its end any more
            store.events.delete((F.col("date") >= F.lit(since))
                                & F.col("event_type").isin(cfg.CALENDAR_EVENTS))
        store.events.merge(full_events(spark, date_range(calendar, since, end),
                                       since, end, feeds.event_shift_days))

    # what is derived needs all of it; the days count as done only with features and labels
    at_once(spark, lambda: store.bars.merge(date_range(feeds.bars, start, end)), merge_macro, merge_events)
    _derive(spark, store, feeds, window, renewed)
    return window


def run_daily(spark: SparkSession, store: Store, feeds: Feeds, day: date,
              predict: Callable[[Store], DataFrame] | None = None,
              fallback: Callable[[Store], DataFrame] | None = None,
              force: bool = False) -> str:
    """ETL, then predictions; placeholders where there is no trained model.

    ``predict`` raises LookupError if it finds none; all other errors are raised.
    """
    if not is_run_day(day, force):
        return "weekend"
    run_etl(spark, store, feeds, day)
    try:
        if predict is None:
            raise LookupError("no trained model")
        store.predictions.merge(predict(store))
        return "predicted"
    except LookupError:
        if fallback is None:
            raise
        store.predictions.merge(fallback(store))
        return "placeholder"


__all__ = ["Feeds", "Store", "Window", "run_etl", "run_daily",
           "resolve_window"]
