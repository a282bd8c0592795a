"""Runs that go on from carried state against one rebuild, and moments against numpy."""

from __future__ import annotations

import json
import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions.ema import with_ema
from tidemark.functions.rolling import Series
from tidemark.operators import targets as L
from tidemark.plans import staging
from tidemark.plans.etl import Feeds, Store, run_etl
from tidemark.session import scratch_path
from tidemark.sources import market as sources
from tidemark.sources.local import local_frame

BARS = ("symbol string, date date, open double, high double, low double, close double, adj_close double,"
        " volume long")


def market(spark, days: int = 420):
    """Two ETFs, one of them young, and proxies; the last two days move far."""
    rng = np.random.default_rng(8)
    calendar = [d for d in (date(2010, 1, 4) + timedelta(days=i) for i in range(days * 2)) if d.weekday() < 5][:days]
    bars = []
    for symbol, first in {"SPY": 0, "QQQ": 150, "HYG": 0, "^VIX": 0, "RSP": 0, "UUP": 0}.items():
        price = 100.0
        for i, day in enumerate(calendar[first:], first):
            if symbol == "UUP" and i > 60:
                break  # falls silent long before the runs
            jump = 0.3 if i >= days - 2 else 0.0
            last, price = price, price * math.exp(rng.normal(0, 0.01) * (8 if i % 97 == 5 else 1) + jump)
            bars.append((symbol, day, last, max(last, price) * 1.01, min(last, price) * 0.99, price, price,
                         int(rng.integers(1000, 9000))))
    macro = [(key, day, float(rng.normal())) for key in cfg.MACRO_KEYS[:4] for i, day in enumerate(calendar)
             if i % 5 == 0 or key == cfg.MACRO_KEYS[0]]
    return calendar, Feeds(
        bars=local_frame(spark, bars, BARS), macro=local_frame(spark, macro, "series_key string, date date, value double"),
        calendar=local_frame(spark, [(d,) for d in calendar], "date date"))


@pytest.fixture(scope="module")
def runs(spark):
    calendar, feeds = market(spark)
    steps, whole = (Store(spark, scratch_path(spark, name)) for name in ("steps", "whole"))
    run_etl(spark, steps, feeds, end=calendar[-3], start=calendar[0])
    windows = [run_etl(spark, steps, feeds, end=day) for day in calendar[-2:]]
    run_etl(spark, whole, feeds, end=calendar[-1], start=calendar[0])
    return calendar, steps, whole, windows


def close(a, b) -> bool:
    return a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-9))


def by_key(df):
    return {(r["symbol"], r["date"]): r.asDict() for r in df.collect()}


def test_features_equal_a_rebuild(runs):
    _, steps, whole, _ = runs
    got, want = by_key(steps.features.read()), by_key(whole.features.read())
    assert got.keys() == want.keys()
    for key, row in want.items():
        a, b = json.loads(got[key]["feature_json"]), json.loads(row["feature_json"])
        assert a.keys() == b.keys()
        wrong = {c: (a[c], b[c]) for c in b if not close(a[c], b[c])}
        assert not wrong, (key, wrong)


@pytest.mark.parametrize("name", ["labels", "bars", "averages"])
def test_tables_equal_a_rebuild(runs, name):
    _, steps, whole, _ = runs
    got, want = (by_key(getattr(s, name).read()) for s in (steps, whole))
    assert got.keys() == want.keys()
    for key, row in want.items():
        wrong = {c: (got[key][c], v) for c, v in row.items() if not close(got[key][c], v) and c != "frame_from"}
        assert not wrong, (key, wrong)


def test_a_one_day_run_reads_the_widest_frame_only(runs):
    calendar, steps, _, windows = runs
    for window, day in zip(windows, calendar[-2:]):
        assert (window.start, window.end, window.mode) == (day, day, "incremental")
        place = calendar.index(window.read_from)
        # the frame before the first renewed day
        assert calendar.index(day) - place <= cfg.FRAME_ROWS + cfg.RENEWED_DAYS
        assert place > 0 and steps.bars.read(window.read_from, day).where("symbol = 'SPY'").count() < 250


def test_only_rows_whose_clip_moves_are_rewritten(spark, runs):
    calendar, steps, whole, windows = runs
    labels = [r for r in whole.labels.read().collect()]
    expected = 0
    for h in L.HORIZONS:
        assert any(abs(r[f"y_{h}d_raw"]) > abs(r[f"y_{h}d_clipped"]) + 1e-12 for r in labels if r[f"y_{h}d_raw"] is not None)
    for symbol in ("SPY", "QQQ"):
        known = [(r.date, r.y_1d_raw) for r in labels if r.symbol == symbol and r.y_1d_raw is not None]
        last = calendar[-2]  # the return that the last run learns
        before = np.std([v for d, v in known if d < last], ddof=1)
        after = np.std([v for _, v in known], ddof=1)
        expected += sum(abs(v) > 3 * min(before, after) for d, v in known if d <= calendar[-8])
    assert 0 < expected <= windows[-1].reclipped < 40 < len(labels)


def test_a_store_without_state_is_rebuilt(spark, runs):
    calendar, _, whole, _ = runs
    _, feeds = market(spark)
    store = Store(spark, scratch_path(spark, "old-form"))
    run_etl(spark, store, feeds, end=calendar[-2], start=calendar[0])
    store.averages.clear()
    window = run_etl(spark, store, feeds, end=calendar[-1])
    assert window.read_from is None
    got, want = (s.labels.read().agg(F.sum("y_1d_clipped"), F.count("*")).first() for s in (store, whole))
    assert got[1] == want[1] and got[0] == pytest.approx(want[0])


def test_feeds_read_the_tables_once(spark, tmp_path):
    """Runs take their days from reduced rows, which are those that the tables give."""
    at = lambda day: None if day is None else datetime(2020, 1, day)
    lines = [(1, 1, 5.0, 100.0, "A", "F", at(6)), (1, 2, 3.0, 40.0, "R", "O", at(6)), (2, 1, 1.0, 7.0, "N", "F", at(7)),
             (3, 1, 2.0, 8.0, "A", "O", at(11)), (4, 1, 2.0, 8.0, "X", "F", at(8)), (5, 7, None, None, None, "F", at(9)),
             (6, 1, 2.0, 8.0, "A", "F", None), (1, 1, 5.0, 100.0, "A", "F", at(6))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
                          " l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT", "F", 10.0, at(6)), (2, "1-URGENT", "F", 20.0, at(6)), (3, "2-HIGH", "O", 1.0, at(7)),
                           (4, "5-LOW", "P", 3.0, None)], "o_orderkey long, o_orderpriority string, o_orderstatus string,"
                          " o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = staging.feeds(spark, str(tmp_path))
    for df, want in ((got.bars, sources.daily_bars), (got.macro, sources.macro_raw),
                     (got.calendar, sources.trading_calendar)):
        assert not any("lineitem" in f or "orders" in f for f in df.inputFiles())
        assert sorted(map(str, df.collect())) == sorted(map(str, want(spark, str(tmp_path)).collect()))
    assert [r.date.day for r in got.calendar.orderBy("date").collect()] == [6, 7, 8, 9]


# --- parts ------------------------------------------------------------------------------
def test_moments_of_parts(spark):
    rng = np.random.default_rng(2)
    values = {"A": rng.normal(1e6, 1, 50), "B": rng.normal(0, 1, 3), "C": np.array([1.0]), "D": np.array([])}
    rows = [(s, date(2020, 1, 1) + timedelta(days=i), float(v), float(v) if i % 2 else None)
            for s, xs in values.items() for i, v in enumerate(xs)] + [("D", date(2020, 1, 1), None, None)]
    df = local_frame(spark, rows, "symbol string, date date, y_1d_raw double, y_5d_raw double")
    cut = date(2020, 1, 10)
    parts = L.merged_moments(L.return_moments(df.where(F.col("date") < F.lit(cut))),
                             L.return_moments(df.where(F.col("date") >= F.lit(cut))))
    got = {r.symbol: r for r in parts.withColumns({f"s{h}": L.deviation(h) for h in L.HORIZONS}).collect()}
    for symbol, xs in values.items():
        for h, own in ((1, xs), (5, xs[1::2])):
            assert got[symbol][f"n_{h}d"] == len(own)
            sigma = got[symbol][f"s{h}"]
            assert sigma is None if len(own) < 2 else sigma == pytest.approx(np.std(own, ddof=1), rel=1e-9)


def test_averages_go_on(spark):
    rng = np.random.default_rng(3)
    xs = rng.normal(size=300).tolist()
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(300)]
    s = Series(["symbol"], "date")
    df = local_frame(spark, [(k, d, x) for k in ("old", "new") for d, x in zip(days, xs) if k == "old" or d >= days[250]],
                     "symbol string, date date, x double")
    spec = {"slow": ("x", 50), "fast": ("x", 9)}
    whole = by_key(with_ema(df, s, spec))
    at = whole["old", days[249]]
    state = local_frame(spark, [("old", days[249], at["slow"], at["fast"])],
                        "symbol string, date date, slow double, fast double").select(
        "symbol", F.struct("date", "slow", "fast").alias("went"))
    part = with_ema(df.where(F.col("date") >= F.lit(days[240])).join(state, "symbol", "left"), s, spec, carried="went")
    for key, row in by_key(part).items():
        if key[1] >= days[249]:
            assert row["slow"] == pytest.approx(whole[key]["slow"], rel=1e-12)
            assert row["fast"] == pytest.approx(whole[key]["fast"], rel=1e-12)
