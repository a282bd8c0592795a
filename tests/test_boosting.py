"""Boosted trees against trees grown one leaf at a time in plain Python."""

from __future__ import annotations

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import boosting as B
from tidemark.operators import models as MD
from tidemark.plans import training as TR
from tidemark.queries import runs

FEATURES = ["a", "b", "c", "flat"]


def rows(n: int = 200, classes: int = 2):
    draw = random.Random(4)
    out = []
    for i in range(n):
        a, b, c = draw.randrange(40) / 4, draw.gauss(0, 1), draw.choice([0.0, 1.0])
        y = int(a + 3 * b * c + draw.gauss(0, 1) > 5) if classes == 2 else min(int(a / 4 + c), 2)
        out.append((i, a, b, c, 1.0, y, 1.5 if i % 3 else 0.5))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id int, a double, b double, c double, flat double, y int, w double").repartition(5)


def whole_scale(weights) -> float:
    return 2.0 ** min(40, math.floor(62 - math.log2(len(weights) * max(max(weights), 1.0) * 2)))


def grow(x, g, h, edges, p: B.BoostParams):
    """Best-first growth: (splits as (rows, feature, edge), leaf rows), scanning all rows for every split."""
    def value(rows):
        return sum(g[i] for i in rows), sum(h[i] for i in rows)

    def score(gs, hs):
        return max(abs(gs) - p.l1, 0.0) ** 2 / (hs + p.l2)

    def best(rows, depth):
        top = (0.0, None, None)
        if depth >= p.depth:
            return top
        for f, own in enumerate(edges):
            for e in own:
                left = [i for i in rows if x[i][f] < e]
                right = [i for i in rows if x[i][f] >= e]
                (gl, hl), (gr, hr) = value(left), value(right)
                if min(len(left), len(right)) < max(p.min_rows, 1) or min(hl, hr) < p.min_curvature:
                    continue
                gain = score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr)
                if gain > top[0] + 1e-12:
                    top = (gain, f, e)
        return top

    leaves = [(list(range(len(x))), 0)]
    tops = [best(*leaves[0])]
    splits = []
    while p.leaves is None or len(leaves) < p.leaves:
        i = max(range(len(leaves)), key=lambda k: tops[k][0])
        gain, f, e = tops[i]
        if f is None:
            break
        members, depth = leaves.pop(i)
        tops.pop(i)
        splits.append((tuple(members), f, e, gain))
        for part in ([m for m in members if x[m][f] < e], [m for m in members if x[m][f] >= e]):
            leaves.append((part, depth + 1))
            tops.append(best(part, depth + 1))
    return splits, [m for m, _ in leaves], value


CASES = [B.BoostParams(trees=3, leaves=6, depth=8, l1=0.1, l2=0.1, min_rows=5),
         B.BoostParams(trees=2, leaves=None, depth=3, l1=0.1, l2=1.0, min_curvature=2.0),
         B.BoostParams(trees=2, leaves=31, depth=8, l1=3.0, l2=0.0, min_rows=1)]


@pytest.mark.parametrize("params", CASES)
def test_trees_equal_growth_by_hand(spark, params):
    data = rows()
    edges = {"a": [i / 2 for i in range(1, 20)], "b": [-1.0, -0.3, 0.0, 0.4, 1.1], "c": [1.0], "flat": []}
    model = B.fit_boosted(frame(spark, data), FEATURES, "y", 2, "w", params, edges=edges)
    x = [r[1:5] for r in data]
    y, w = [r[5] for r in data], [r[6] for r in data]
    scale = whole_scale(w)
    margin = [model.start[0]] * len(data)
    assert model.start[0] == pytest.approx(math.log(sum(a for a, b in zip(w, y) if b) / sum(
        a for a, b in zip(w, y) if not b)))
    for tree in model.trees[0]:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round(wi * (pi - yi) * scale) / scale for wi, pi, yi in zip(w, p, y)]
        h = [round(wi * pi * (1 - pi) * scale) / scale for wi, pi in zip(w, p)]
        splits, leaves, value = grow(x, g, h, [edges[c] for c in FEATURES], params)
        own, reached = [], {0: list(range(len(x)))}
        for i, f in enumerate(tree["f"]):
            if f >= 0:
                left = tree["l"][i]
                reached[left] = [m for m in reached[i] if x[m][f] < tree["t"][i]]
                reached[left + 1] = [m for m in reached[i] if x[m][f] >= tree["t"][i]]
                own.append((tuple(reached[i]), f, tree["t"][i]))
                assert tree["rows"][i] == len(reached[i])
        assert sorted(own) == sorted(s[:3] for s in splits)
        assert sorted(t for t in tree["gain"] if t) == pytest.approx(sorted(s[3] for s in splits), rel=1e-6)
        assert sum(f < 0 for f in tree["f"]) == len(leaves) <= (params.leaves or 2 ** params.depth)
        for i, f in enumerate(tree["f"]):
            if f < 0:
                gs, hs = value(reached[i])
                want = -math.copysign(max(abs(gs) - params.l1, 0.0), gs) / (hs + params.l2) * params.rate
                assert tree["v"][i] == pytest.approx(want, rel=1e-6, abs=1e-12)
                for m in reached[i]:
                    margin[m] += tree["v"][i]
    got = frame(spark, data).select("id", *[p.alias(f"p{k}") for k, p in enumerate(model.probabilities())]).collect()
    for r in got:
        assert r.p1 == pytest.approx(1 / (1 + math.exp(-margin[r.id])), abs=1e-9) and r.p0 + r.p1 == pytest.approx(1)


def test_penalties_and_limits_take_effect(spark):
    df = frame(spark, rows()).cache()
    fit = lambda **x: B.fit_boosted(df, FEATURES, "y", 2, None, B.BoostParams(trees=1, **x)).trees[0][0]
    wide = fit(leaves=31, depth=8)
    assert sum(f < 0 for f in fit(leaves=4, depth=8)["f"]) == 4 < sum(f < 0 for f in wide["f"]) <= 31
    assert B.depth_of(fit(leaves=None, depth=2)) == 2
    assert max(map(abs, fit(leaves=31, depth=8, l2=50.0)["v"])) < max(map(abs, wide["v"])) / 3
    assert not B.fit_boosted(df, FEATURES, "y", 2, None, B.BoostParams(trees=1, l1=1e6)).trees[0]
    assert min(n for n, f in zip(*(fit(leaves=31, depth=8, min_rows=30)[k] for k in ("rows", "f"))) if f < 0) >= 30


def test_partitioning_changes_nothing(spark):
    data = rows(600)
    params = B.BoostParams(trees=4, leaves=8, row_share=0.7, column_share=0.7)
    one = B.fit_boosted(frame(spark, data).coalesce(1), FEATURES, "y", 2, "w", params, key=["id"])
    many = B.fit_boosted(frame(spark, data[::-1]).repartition(13), FEATURES, "y", 2, "w", params, key=["id"])
    assert one.trees == many.trees


def test_few_rows_take_one_task_a_round(spark, monkeypatch):
    parts, measure = [], B.histograms

    def noted(rows, *rest):
        parts.append(rows.rdd.getNumPartitions())
        return measure(rows, *rest)

    monkeypatch.setattr(B, "histograms", noted)
    B.fit_boosted(frame(spark, rows()), FEATURES, "y", 2, None, B.BoostParams(trees=2, leaves=4))
    assert set(parts) == {1}
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    B.fit_boosted(frame(spark, rows()), FEATURES, "y", 2, None, B.BoostParams(trees=1, leaves=4))
    assert parts[-1] > 1


@pytest.mark.parametrize("classes", [2, 3])
def test_a_long_fit_of_few_rows_is_one_task(spark, monkeypatch, classes):
    """The same trees as by rounds, sampled rows and columns included."""
    data = [(*r[:2], None, *r[3:]) if r[0] % 17 == 0 else r for r in rows(300, classes)]
    params = B.BoostParams(trees=B.STORED_EVERY, rate=0.2, leaves=5, l1=0.1, l2=0.1, row_share=0.7, column_share=0.7, seed=7)
    fit = lambda: B.fit_boosted(frame(spark, data), FEATURES, "y", classes, "w", params, key=["id"])
    asked, measure = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: asked.append(a) or measure(*a))
    whole = fit()
    assert not asked and {len(t) for t in whole.trees} == {B.STORED_EVERY}
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    rounds = fit()
    assert asked and whole.start == rounds.start and len(whole.trees) == len(rounds.trees)
    for a, b in zip(sum(whole.trees, []), sum(rounds.trees, [])):
        assert all(a[k] == b[k] for k in ("f", "b", "l", "t", "rows"))
        assert a["v"] == pytest.approx(b["v"], rel=1e-9, abs=1e-12)


def test_registry_runs_grow_the_configured_trees(spark, monkeypatch):
    asked = {}

    def noted(datasets, **rest):
        asked.update(rest)
        raise LookupError

    monkeypatch.setattr(runs.TR, "run_registry", noted)
    monkeypatch.setattr(runs, "tables", lambda *_: None)
    monkeypatch.setattr(runs.V, "classification_dataset", lambda *_: None)
    with pytest.raises(LookupError):
        runs._registry_run(spark, "nowhere")
    assert not any((asked.get("overrides") or {}).values()) and asked["splits"] == cfg.FIXTURE_SPLITS
    assert {MD.MODEL_PARAMS[name]["trees"] for name in MD.BOOSTED} == {200}


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def fitted(dataset, horizon, target, name, splits, **_):
        both.wait()
        row = (horizon, name, "val", 1, 1 if name == "b" else -1)
        return spark.createDataFrame([row], "horizon string, model_name string, split string, y_true int,"
                                            " pred_class_final int"), name

    monkeypatch.setattr(TR, "run_model", fitted)
    run = TR.run_registry({"1d": spark.range(1)}, {"1d": ("y", ["a", "b"])})
    assert run.models == {("1d", "a"): "a", ("1d", "b"): "b"}
    assert sorted((r.model_name, r.pred_class_final) for r in run.predictions.collect()) == [("a", -1), ("b", 1)]


def test_edges_are_the_quantiles_of_each_column(spark):
    df = frame(spark, rows())
    got = B.quantile_edges(df.withColumn("b", F.when(F.col("b") > 0, F.col("b"))), FEATURES, 4)
    a = sorted(r[1] for r in rows())
    assert got["a"] == sorted({a[len(a) * k // 4 - 1] for k in (1, 2, 3)} - {a[0]})
    assert len(got["b"]) == 3 and min(got["b"]) > 0 and got["c"] == [1.0] and got["flat"] == []


def test_softmax_and_saved_model(spark, tmp_path):
    data = rows(400, classes=3)
    df = frame(spark, data)
    model = B.fit_boosted(df, FEATURES, "y", 3, None, B.BoostParams(trees=8, rate=0.3, leaves=8))
    assert len(model.trees) == 3 and {len(t) for t in model.trees} == {8}
    model.save(f"{tmp_path}/m")
    loaded = B.BoostedTrees.load(spark, f"{tmp_path}/m")
    both = df.select("y", F.array(*model.probabilities()).alias("p"), F.array(*loaded.probabilities()).alias("q")).collect()
    assert all(r.p == r.q and sum(r.p) == pytest.approx(1) for r in both)
    assert np.mean([int(np.argmax(r.p)) == r.y for r in both]) > 0.95


def test_missing_values_go_right(spark):
    data = [(i, float(i % 10), None, 0.0, 1.0, int(i % 10 > 4), 1.0) for i in range(100)]
    data += [(200 + i, None, None, 0.0, 1.0, 1, 1.0) for i in range(30)]
    df = frame(spark, data)
    model = B.fit_boosted(df, FEATURES, "y", 2, None, B.BoostParams(trees=10, rate=0.5, leaves=4))
    scores = df.select("a", "y", model.probabilities()[1].alias("p")).collect()
    assert all((r.p > 0.5) == (r.y == 1) for r in scores)


def test_nothing_to_split(spark):
    df = frame(spark, [(i, 1.0, 2.0, 3.0, 4.0, int(i < 5), 1.0) for i in range(20)])
    model = B.fit_boosted(df, FEATURES, "y", 2)
    assert model.trees == [[]] or all(len(t["f"]) == 1 for t in model.trees[0])
    assert df.select(model.probabilities()[1].alias("p")).first().p == pytest.approx(0.25)
