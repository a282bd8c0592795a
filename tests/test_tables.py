"""Merge semantics, stored tables, documents, medians, gating and ingestion."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import calendars as K
from tidemark.operators import decisions as D
from tidemark.operators import evaluation as E
from tidemark.operators import feature_store as M
from tidemark.operators import preparation as P
from tidemark.operators import quality as Q
from tidemark.operators.backtest import backtest
from tidemark.plans.etl import Store, is_run_day, resolve_window
from tidemark.session import scratch_path
from tidemark.sources import files, keyed
from tidemark.sources.local import local_frame
from tidemark.streaming.ingest import ingest_new_bars

KV = "symbol string, date date, a double, b double"
D1, D2, D3 = date(2024, 1, 2), date(2024, 1, 3), date(2025, 1, 2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_semantics(spark):
    old = local_frame(spark, [("S", D1, 1.0, 1.0), ("S", D2, 2.0, 2.0)], KV)
    new = local_frame(spark, [("S", D2, None, 9.0), ("S", D3, 3.0, 3.0)], KV)
    keys = ["symbol", "date"]
    assert rows(keyed.upsert(old, new, keys)) == [
        ("S", D1, 1.0, 1.0), ("S", D2, None, 9.0), ("S", D3, 3.0, 3.0)]
    assert rows(keyed.upsert_columns(old, new, keys, ["a"]))[:2] == [
        ("S", D1, 1.0, 1.0), ("S", D2, None, 2.0)]
    assert rows(keyed.insert_ignore(old, new, keys))[1] == ("S", D2, 2.0, 2.0)
    kept = keyed.delete_where(new, F.col("a") > 1)
    assert rows(kept) == [("S", D2, None, 9.0)]      # unknown condition keeps


def test_keyed_table_is_idempotent_and_partial(spark):
    t = keyed.KeyedTable(spark, scratch_path(spark, "t"), ["symbol", "date"])
    t.merge(local_frame(spark, [("S", D1, 1.0, 1.0), ("S", D3, 3.0, 3.0)], KV))
    batch = local_frame(spark, [("S", D1, 5.0, 5.0), ("T", D1, 6.0, 6.0)], KV)
    t.merge(batch)
    once = rows(t.read().select("symbol", "date", "a", "b"))
    t.merge(batch)
    assert rows(t.read().select("symbol", "date", "a", "b")) == once
    t.merge(batch.select("symbol", "date", F.lit(None).cast("double").alias("a")), ["a"])
    assert ("S", D1, None, 5.0) in [tuple(r) for r in t.read().select(
        "symbol", "date", "a", "b").collect()]
    assert t.read(since=D3).count() == 1
    t.clear()
    assert t.read().count() == 0 and "a" in t.read().columns


def test_documents_keep_keys_and_null_bad_values(spark):
    df = local_frame(spark, [("S", D1, float("nan"), float("inf")),
                             ("S", D2, 1.0, None)], KV)
    docs = M.pack_features(df).orderBy("date").collect()
    assert docs[0].feature_json == '{"a":null,"b":null}'
    wide = M.unpack_features(M.pack_features(df), ["a", "missing"], {}, ("a",))
    assert [tuple(r)[2:] for r in wide.orderBy("date").collect()] == [
        (None, None), (1, None)]
    assert M.infer_keys(M.pack_features(df)) == ["a", "b"]


def test_exact_medians_on_hot_values(spark):
    rng = np.random.default_rng(1)
    xs = np.where(rng.random(20001) < 0.34, 7.0, rng.normal(size=20001) * 10)
    df = local_frame(spark, [(float(x), None if i % 3 else float(x), None)
                             for i, x in enumerate(xs)],
                     "x double, y double, z double")
    got = P.exact_medians(df, ["x", "y", "z"])
    assert got["x"] == np.median(xs) and got["y"] == np.median(xs[::3])
    assert got["z"] is None


def test_split_errors(spark):
    bad = {"train": (D1, D3), "val": (D2, D3), "test": (D3, D3)}
    with pytest.raises(ValueError):
        P.check_split_borders(bad)
    df = local_frame(spark, [("S", D1, 1.0, 1.0)], KV)
    with pytest.raises(ValueError):
        P.time_splits(df, cfg.SPLITS)


def test_threshold_grid_against_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 400
    conf = np.round(rng.uniform(0.3, 0.8, n), 2)      # many values on a border
    margin = np.round(rng.uniform(0, 0.4, n), 2)
    y, p = rng.integers(-1, 2, n), rng.integers(-1, 2, n)
    df = local_frame(spark, [("1d", "m", int(a), int(b), float(c), float(d))
                             for a, b, c, d in zip(y, p, conf, margin)],
                     "horizon string, model_name string, y_true int,"
                     " pred_class_raw int, confidence double, margin double")
    grid = {(round(r.conf_thresh, 2), round(r.margin_thresh, 2)): r
            for r in D.threshold_grid(df).collect()}
    assert len(grid) == 42 * 36
    for ct in range(34, 76, 7):
        for mt in range(0, 36, 5):
            final = np.where((conf >= ct / 100) & (margin >= mt / 100), p, 0)
            r = grid[round(ct / 100, 2), round(mt / 100, 2)]
            assert r.accuracy == pytest.approx((final == y).mean())
            assert r.trade_rate == pytest.approx((final != 0).mean())
            f1 = []
            for k in (-1, 0, 1):
                tp = ((final == k) & (y == k)).sum()
                den = (final == k).sum() + (y == k).sum()
                f1.append(2 * tp / den if den else 0.0)
            assert r.f1_macro == pytest.approx(np.mean(f1))


def test_ties_and_absent_classes(spark):
    df = local_frame(spark, [(0.5, 0.5)], "p_down double, p_up double")
    assert D.prediction_features(df).first().pred_class_raw == -1
    one = local_frame(spark, [("m", 1, 1)], "g string, y_true int, pred_class_final int")
    m = E.gate_metrics(E.confusion_counts(one, ["g"]), ["g"]).first()
    assert m.accuracy == 1.0 and m.f1_macro == 0.5


def test_zero_return_is_never_correct(spark):
    bars = local_frame(spark, [("S", D1, 10.0), ("S", D2, 10.0)],
                       "symbol string, date date, close double")
    preds = local_frame(spark, [("S", D1, "1d", "m", k, 0.5, 0.5, 0.5) for k in (1, -1)]
                        + [("S", D2, "1d", "m", 1, 0.5, 0.5, 0.5)],
                        "symbol string, date date, horizon string, model_name string,"
                        " pred_class_final int, p_up double, p_down double,"
                        " confidence double")
    out = {(r.date, r.direction): r.is_correct for r in backtest(preds, bars).collect()}
    assert out == {(D1, "UP"): False, (D1, "DOWN"): False, (D2, "UP"): None}


def test_third_friday_weeks(spark):
    cal = local_frame(spark, [(date(2024, 3, d),) for d in range(1, 31)
                              if date(2024, 3, d).weekday() < 5], "date date")
    got = [r.date.day for r in K.options_expiry_weeks(cal).orderBy("date").collect()]
    assert got == [11, 12, 13, 14, 15]
    assert K.build_events(spark, date(1990, 1, 1), date(1990, 12, 31)).count() == 0


def test_run_guards(spark):
    assert not is_run_day(date(2024, 1, 6)) and is_run_day(date(2024, 1, 6), force=True)
    cal = local_frame(spark, [(D1,)], "date date")
    empty = Store(spark, scratch_path(spark, "empty"))
    assert resolve_window(empty, cal, date(2014, 1, 1)) is None
    assert resolve_window(empty, cal, D1).start == cfg.DEFAULT_START


def test_checks_fail_when_they_should(spark):
    df = local_frame(spark, [("S", D1, 5.0, 0.0), ("S", D1, 1.0, 0.0)], KV)
    assert Q.duplicate_keys(df).first().status == "FAIL"
    assert Q.class_balance(df, "b").first().status == "FAIL"
    assert Q.extreme_targets(df, "a").first().status == "FAIL"
    assert Q.target_variance(df, "b").first().status == "FAIL"
    assert {r.status: r.n for r in Q.tally(Q.report([
        Q.duplicate_keys(df), Q.class_domain(df, "b")])).collect()} == {
        "FAIL": 1, "PASS": 1}


def test_csv_dataset(spark):
    path = scratch_path(spark, "csv")
    df = local_frame(spark, [("S", D2, 1, 2.5, 3), ("S", D1, -1, None, 1)],
                     "symbol string, date date, y_class_1d int, rsi_14 double, dow int")
    files.write_csv(df, path)
    back = files.read_dataset_csv(spark, path)
    assert [tuple(r) for r in back.collect()] == [
        ("S", D1, -1, None, 1), ("S", D2, 1, 2.5, 3)]
    with pytest.raises(ValueError):
        files.read_dataset_csv(spark, path, target="absent")


def test_stream_ingestion_is_incremental(spark):
    root = scratch_path(spark, "stream")
    table = keyed.KeyedTable(spark, f"{root}/bars", ["symbol", "date"])
    schema = ("symbol string, date date, open double, high double, low double,"
              " close double, adj_close double, volume long")

    def arrive(day, close, name):
        local_frame(spark, [("S", day, close, close, close, close, close, 1)],
                    schema).write.mode("append").parquet(f"{root}/in")
        ingest_new_bars(spark, f"{root}/in", table, f"{root}/progress")

    arrive(D1, 1.0, "a")
    arrive(D2, 2.0, "b")
    arrive(D1, 9.0, "c")
    assert rows(table.read().select("date", "close")) == [(D1, 9.0), (D2, 2.0)]
