"""Window rules and indicators against pandas on small frames."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ema import with_ema
from tidemark.functions.rolling import Series, with_moments
from tidemark.functions.scalars import clip, flag, to_int
from tidemark.operators import technical as T
from tidemark.operators.lags import lag_leakage, with_lags
from tidemark.operators.macro import (align_to_trading_days, bounded_fill,
                                      dedupe_by_day, fill_with_tracking)
from tidemark.operators.normalization import normalise
from tidemark.operators.quality import feature_count, label_overlap
from tidemark.operators.regimes import with_regimes
from tidemark.operators.targets import build_labels
from tidemark.sources.local import local_frame

S = Series(["symbol"], "date")
D0 = date(2020, 1, 1)


def frame(spark, values, column="x"):
    rows = [("S", D0 + timedelta(days=i), v) for i, v in enumerate(values)]
    return local_frame(spark, rows, f"symbol string, date date, {column} double")


def column(df, expr):
    return [r[0] for r in df.orderBy("date").select(expr.alias("v"), "date")
            .orderBy("date").collect()]


def same(got, want, tol=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None
        else:
            assert g == pytest.approx(w, rel=tol, abs=tol)


def test_rolling_needs_full_windows(spark):
    xs = [1.0, 2.0, None, 4.0, 5.0, 6.0, 9.0]
    df, p = frame(spark, xs), pd.Series(xs, dtype=float)
    same(column(df, S.mean("x", 3)), p.rolling(3).mean().tolist())
    same(column(df, S.std("x", 3)), p.rolling(3).std().tolist())
    same(column(df, S.quantile("x", 0.75, 3)), p.rolling(3).quantile(0.75).tolist())


def test_pct_change_fills_before_comparing(spark):
    xs = [1.0, None, 2.0, 0.0, 3.0]
    got = column(frame(spark, xs), S.pct_change("x", 1))
    same(got, [None, 0.0, 1.0, -1.0, None])   # the change from zero is undefined
    ys = [1.0, None, 2.0, 5.0, 4.0, None, 8.0]
    shifted = pd.Series(ys).shift(1).ffill()
    same(column(frame(spark, ys), S.pct_change("x", 2, shift=1)),
         (shifted / shifted.shift(2) - 1).tolist())


def test_row_rules(spark):
    df = local_frame(spark, [(1.0, 2.7), (None, -2.7), (9.0, None)],
                     "a double, b double")
    rows = df.select(flag(F.col("a") > 2).alias("f"), clip(F.col("a"), 0, 3).alias("c"),
                     to_int(F.col("b")).alias("i")).collect()
    assert [r.f for r in rows] == [0, 0, 1]
    assert [r.c for r in rows] == [1.0, None, 3.0]
    assert [r.i for r in rows] == [3, -3, None]


@pytest.mark.parametrize("span", [2, 9, 14, 50, 200])
def test_ema_equals_recursion(spark, span):
    rng = np.random.default_rng(span)
    xs = (100 + rng.normal(size=1500).cumsum()).tolist()
    got = column(with_ema(frame(spark, xs), S, {"e": ("x", span)}), F.col("e"))
    want = pd.Series(xs).ewm(span=span, adjust=False).mean()
    assert np.abs(np.array(got) - want.values).max() < 1e-9


def bars(spark, n=260, seed=3, flat=False):
    rng = np.random.default_rng(seed)
    close = np.full(n, 50.0) if flat else 50 + rng.normal(size=n).cumsum() * 0.3
    rows = []
    for i, c in enumerate(close):
        o, spread = c + rng.normal() * 0.1, abs(rng.normal()) + 0.05
        rows.append(("S", D0 + timedelta(days=i), o, max(o, c) + spread,
                     min(o, c) - spread, float(c), float(c), int(1000 + 10 * (i % 7))))
    return local_frame(spark, rows, "symbol string, date date, open double, high double,"
                       " low double, close double, adj_close double, volume long")


def test_indicators_match_pandas(spark):
    df = bars(spark)
    got = T.technical_features(df).toPandas().sort_values("date").reset_index(drop=True)
    p = df.toPandas().sort_values("date").reset_index(drop=True)
    ret = np.log(p.close).shift(1).diff(1)
    auto = ret.rolling(20).apply(lambda x: pd.Series(x).autocorr(1), raw=True)
    index = pd.Series(np.arange(len(p), dtype=float))
    rsq = p.close.rolling(20).corr(index) ** 2
    gain, loss = p.close.diff().clip(lower=0), (-p.close.diff()).clip(lower=0)
    rsi = 100 - 100 / (1 + gain.rolling(14).mean() / (loss.rolling(14).mean() + 1e-12))
    for name, want in (("log_ret_1d", ret), ("vol_20", ret.rolling(20).std()),
                       ("return_autocorr_20", auto), ("price_rsq_20", rsq),
                       ("rsi_14", rsi), ("sma_200", p.close.rolling(200).mean()),
                       ("dd_60", p.close / p.close.rolling(60).max() - 1)):
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-7, atol=1e-9,
                                   err_msg=name)
    assert got.tr[0] == pytest.approx(p.high[0] - p.low[0])
    assert got.days_since_prev[0] == 1


def test_flat_prices_do_not_fail(spark):
    got = T.technical_features(bars(spark, 80, flat=True)).toPandas()
    assert (got.price_rsq_20.dropna() == 0).all()
    assert got.return_autocorr_20.isna().all()


def test_features_do_not_look_ahead(spark):
    df = bars(spark, 230)
    cut = D0 + timedelta(days=180)
    names = ["log_ret_1d", "vol_20", "ema_50", "macd_hist", "adx_14", "rsi_14",
             "price_rsq_20", "volume_z"]
    full = T.technical_features(df).where(F.col("date") <= cut)
    early = T.technical_features(df.where(F.col("date") <= cut))
    a = full.select("date", *names).toPandas().sort_values("date").reset_index(drop=True)
    b = early.select("date", *names).toPandas().sort_values("date").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)


def test_lags_look_back_only(spark):
    df = frame(spark, [float(i * i) for i in range(12)], "log_ret_1d")
    clean = with_lags(df, {"log_ret_1d": [1, 3]})
    assert all(r.early_values == 0 and r.mismatches == 0
               for r in lag_leakage(clean).collect())
    leaky = clean.withColumn("log_ret_1d_lag1", S.lead("log_ret_1d", 1))
    bad = {r["column"]: r for r in lag_leakage(leaky).collect()}["log_ret_1d_lag1"]
    assert bad.early_values == 1 and bad.mismatches > 0


def test_labels_at_the_end_of_a_series(spark):
    df = bars(spark, 40)
    tech = T.technical_features(df)
    rows = build_labels(tech).orderBy("date").collect()
    assert rows[-1].y_class_1d is None and rows[-1].y_1d == 0
    assert [r.y_class_5d for r in rows[-5:]] == [None] * 5
    assert build_labels(tech, keep_incomplete=False).count() == 35
    short = T.technical_features(df.limit(4))
    assert build_labels(short, keep_incomplete=False).count() == 0


# --- macro -------------------------------------------------------------------------
def days(*numbers):
    return [date(2024, 1, n) for n in numbers]


def test_alignment_and_first_observation_wins(spark):
    calendar = local_frame(spark, [(d,) for d in days(2, 3, 8, 9, 17)], "date date")
    raw = local_frame(spark, [("A", d, v) for d, v in zip(
        days(2, 6, 7, 8, 9, 10), [1.0, None, 6.5, 8.0, 9.0, 10.0])],
        "series_key string, date date, value double")
    aligned = align_to_trading_days(raw, calendar)
    moved = {r.date.day: r.trading_date.day for r in aligned.collect()}
    assert moved == {2: 2, 6: 8, 7: 8, 8: 8, 9: 9, 10: 17}
    keep = {r.date.day: r.value for r in dedupe_by_day(aligned).collect()}
    assert keep == {2: 1.0, 8: None, 9: 9.0, 17: 10.0}
    fixed = {r.date.day: r.value for r in dedupe_by_day(aligned, True).collect()}
    assert fixed[8] == 6.5


def test_fill_stops_at_the_gap_limit(spark):
    obs = local_frame(spark, [("A", date(2024, 1, 1), 1.0), ("A", date(2024, 1, 9), 2.0),
                              ("A", date(2024, 1, 18), 3.0)],
                      "series_key string, date date, value double")
    out = {r.date.day: (r.value, r.days_since_update)
           for r in fill_with_tracking(obs).collect()}
    assert out[8] == (1.0, 7) and out[9] == (2.0, 0) and out[16] == (2.0, 7)
    assert 17 not in out and max(out) == 18


def test_bounded_fill_limit(spark):
    xs = [1.0] + [None] * 6 + [2.0]
    got = column(bounded_fill(frame(spark, xs, "dgs10"), S), F.col("dgs10"))
    assert got == [1.0] * 6 + [None, 2.0]


def test_regimes_without_inputs_are_zero(spark):
    row = with_regimes(frame(spark, [1.0])).first()
    assert (row.high_vol_regime, row.curve_inverted, row.credit_stress,
            row.liquidity_expanding_regime) == (0, 0, 0, 0)


@pytest.mark.parametrize("width", [1, 2, 7, 20, 252])
def test_merged_moments_equal_direct_ones(spark, width):
    rng = np.random.default_rng(width)
    xs = rng.normal(size=400)
    xs[150:] += 1e9      # a far step: differences of large sums would lose it
    xs = [None if rng.random() < 0.1 else float(x) for x in xs]
    got = with_moments(frame(spark, xs), S, "x", width, "w").orderBy("date").collect()
    for i, r in enumerate(got):
        own = [x for x in xs[max(0, i - width + 1):i + 1] if x is not None]
        assert r.w_n == len(own)
        if own:
            assert r.w_mean == pytest.approx(np.mean(own), rel=1e-12)
            assert r.w_squares == pytest.approx(len(own) * np.var(own), rel=1e-6, abs=1e-9)


def test_normalised_columns_keep_their_place(spark):
    rng = np.random.default_rng(1)
    rows = [(s, D0 + timedelta(days=i), float(rng.normal()), i % 2, float(rng.normal() * 3), None)
            for s in "AB" for i in range(60)]
    df = local_frame(spark, rows, "symbol string, date date, x double, dow int, overnight_share double, gone double")
    out = normalise(df, window=20)
    assert out.columns == df.columns
    got = {(r.symbol, r.date): r for r in out.collect()}
    for s in "AB":
        own = pd.DataFrame([r[2] for r in rows if r[0] == s])[0]
        roll = own.rolling(20, min_periods=10)
        want = ((own - roll.mean()) / (roll.std() + 1e-9)).clip(-5, 5)
        same([got[s, D0 + timedelta(days=i)].x for i in range(60)], want.tolist())
    assert all(r.gone is None and abs(r.overnight_share) <= 1 for r in got.values())


def test_checks_see_a_planted_leak(spark):
    xs = [float(i * i % 17) for i in range(30)]
    base = frame(spark, xs, "log_ret_1d")
    right = with_lags(base, {"log_ret_1d": [1, 2]})
    leaking = right.withColumn("log_ret_1d_lag2", F.col("log_ret_1d_lag1"))
    assert [(r.early_values, r.mismatches) for r in lag_leakage(right).orderBy("column").collect()] == [(0, 0)] * 2
    (ok, bad) = lag_leakage(leaking).orderBy("column").collect()
    assert (ok.early_values, ok.mismatches) == (0, 0) and bad.early_values == 1 and bad.mismatches > 10
    bars = frame(spark, xs, "close")
    labels = bars.withColumn("y_1d", flag(S.lead("close") > F.col("close")))
    late = bars.withColumn("y_1d", flag(F.col("close") > S.lag("close")))
    assert label_overlap(bars, labels).first().status == "PASS"
    assert label_overlap(bars, late).first().status == "FAIL"
    assert feature_count(bars, 2, ("symbol", "date")).first().status == "WARN"
    assert feature_count(bars, 1, ("symbol", "date")).first().status == "PASS"
