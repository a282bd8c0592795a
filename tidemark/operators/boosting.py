"""Gradient-boosted trees, grown from the best leaf on over binned gradient sums.

Feature values are binned once by quantiles.  A tree grows in rounds: one
aggregation per round sums gradients, curvatures and rows by (leaf, feature, bin)
for the smaller child of every leaf that was split, the larger one is its parent
less its sibling.  The best split of a leaf comes from running sums over these few
numbers.  Leaves are split in order of gain until the leaf limit; a round looks at
all leaves that this order reaches as far as gains are known, so a tree takes about
as many rounds as it has levels, not as it has leaves.

Gradients enter as whole multiples of a power of two.  Their sums are exact and do
not depend on how rows are partitioned, so equal data give equal trees.

What the driver holds is bounded by leaves x features x bins, whatever the rows.
Rows with their margins are cached from tree to tree and stored in the shared folder
every ``STORED_EVERY`` trees, which ends their lineage.  A round over few rows costs as
much as any job, so a fit of that many trees over at most ``TASK_ROWS`` rows is made by
one task that holds them: the same sums, splits and trees without a job for each round.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready, scratch_path
from .preparation import long_form

STORED_EVERY = 10
#: Rows that are worth a task of their own; a round over fewer is one task without shuffle, and so is a long fit.
TASK_ROWS = 10_000
#: Least curvature of a row.
FLAT = 1e-16


@dataclass
class BoostParams:
    """``leaves`` limits a tree besides ``depth``; None leaves depth alone."""

    trees: int = 200
    rate: float = 0.05
    leaves: int | None = 31
    depth: int = 8
    l1: float = 0.0
    l2: float = 0.0
    min_rows: int = 1
    min_curvature: float = 1e-3
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 255
    seed: int = 42


def shrunk(g, l1: float):
    """A gradient sum less the L1 penalty, not past zero."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g, h, p: BoostParams):
    return -shrunk(g, p.l1) / (h + p.l2)


def leaf_score(g, h, p: BoostParams):
    """Twice the loss that the leaf's best value saves."""
    return shrunk(g, p.l1) ** 2 / np.maximum(h + p.l2, FLAT)


@dataclass
class Leaf:
    """A node while its tree grows: sums by feature and bin, and its best split."""

    sums: np.ndarray                 # feature, bin, (gradient, curvature, rows)
    depth: int
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[int, int] | None = None


class Growth:
    """One tree in the making; whole-number sums in, splits out."""

    def __init__(self, params: BoostParams, scale: float, columns: np.ndarray, root: np.ndarray) -> None:
        self.p, self.scale, self.columns = params, scale, columns
        self.nodes: list[Leaf] = []
        self.add(root, 0)

    def add(self, sums: np.ndarray, depth: int) -> int:
        leaf = Leaf(sums, depth)
        if depth < self.p.depth:
            leaf.gain, leaf.feature, leaf.bin = self.best_split(sums)
        self.nodes.append(leaf)
        return len(self.nodes) - 1

    def best_split(self, sums: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, last bin on the left); the first of equals, gain 0 if none."""
        left = np.cumsum(sums, axis=1)[:, :-1]
        right = sums.sum(axis=1, keepdims=True) - left
        (gl, hl), (gr, hr) = ([x[..., i] / self.scale for i in (0, 1)] for x in (left, right))
        ok = ((left[..., 2] >= self.p.min_rows) & (right[..., 2] >= self.p.min_rows)
              & (hl >= self.p.min_curvature) & (hr >= self.p.min_curvature) & self.columns[:, None])
        if not ok.any():
            return 0.0, -1, -1
        gain = leaf_score(gl, hl, self.p) + leaf_score(gr, hr, self.p) - leaf_score(gl + gr, hl + hr, self.p)
        gain = np.where(ok, gain, -np.inf)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-12 else (0.0, -1, -1)

    def order(self) -> tuple[list[int], list[int]]:
        """(leaves split by descending gain as far as known, those whose children are not)."""
        heap, split, pending = [], [], []

        def push(i: int) -> None:
            if self.nodes[i].gain > 0:
                heapq.heappush(heap, (-self.nodes[i].gain, i))

        push(0)
        while heap and (self.p.leaves is None or len(split) < self.p.leaves - 1):
            _, i = heapq.heappop(heap)
            split.append(i)
            if self.nodes[i].children:
                for child in self.nodes[i].children:
                    push(child)
            else:
                pending.append(i)
        return split, pending

    def open(self, i: int) -> tuple[int, bool]:
        """Makes room for both children of leaf ``i``: (number of the left one, whether it is the smaller)."""
        leaf = self.nodes[i]
        first = len(self.nodes)
        leaf.children = (first, first + 1)
        self.nodes += [None, None]
        rows = leaf.sums[leaf.feature, :, 2]
        left = rows[:leaf.bin + 1].sum()
        return first, bool(left * 2 <= rows.sum())

    def close(self, i: int, small: np.ndarray, left_is_small: bool) -> None:
        """Both children of leaf ``i`` from the smaller one's sums."""
        leaf, rest = self.nodes[i], self.nodes[i].sums - small
        for number, sums in zip(leaf.children, (small, rest) if left_is_small else (rest, small)):
            child = Leaf(sums, leaf.depth + 1)
            if child.depth < self.p.depth:
                child.gain, child.feature, child.bin = self.best_split(sums)
            self.nodes[number] = child
        leaf.sums = leaf.sums[:1]  # the totals are all that is still needed

    def routes(self, known: int) -> dict[str, list[int]]:
        """Feature, bin and left child of every node, -1 for leaves; those from ``known`` on have no sums yet."""
        inner = [i < known and n.children is not None for i, n in enumerate(self.nodes)]
        return {"f": [n.feature if x else -1 for n, x in zip(self.nodes, inner)],
                "b": [n.bin if x else -1 for n, x in zip(self.nodes, inner)],
                "l": [n.children[0] if x else -1 for n, x in zip(self.nodes, inner)]}

    def tree(self) -> dict:
        """The finished tree, renumbered: only splits that the leaf limit reached."""
        split = set(self.order()[0])
        out = {"f": [], "b": [], "l": [], "v": [], "gain": [], "rows": []}
        queue = [0]
        for at, i in enumerate(queue):
            node = self.nodes[i]
            g, h, n = node.sums[0].sum(axis=0)
            inner = i in split
            out["f"].append(node.feature if inner else -1)
            out["b"].append(node.bin if inner else -1)
            out["l"].append(len(queue) if inner else -1)
            out["v"].append(float(leaf_value(g / self.scale, max(h / self.scale, FLAT), self.p)) * self.p.rate)
            out["gain"].append(node.gain if inner else 0.0)
            out["rows"].append(int(n))
            if inner:
                queue += node.children
        return out


def depth_of(tree: dict) -> int:
    """Steps from the root to the deepest leaf."""
    depth = [0] * len(tree["f"])
    for i, left in enumerate(tree["l"]):
        if left >= 0:
            depth[left] = depth[left + 1] = depth[i] + 1
    return max(depth)


def numbers(values) -> str:
    return f"array({', '.join(map(str, values))})"


def routed(tree: dict, depth: int) -> str:
    """SQL of the node that a row's ``bins`` lead to."""
    if depth == 0:
        return "0"
    f, b, left = (numbers(tree[k]) for k in ("f", "b", "l"))
    return (f"aggregate(array_repeat(0, {depth}), 0, (n, i) -> IF(element_at({f}, n + 1) < 0, n,"
            f" element_at({left}, n + 1) + IF(element_at(bins, element_at({f}, n + 1) + 1)"
            f" > element_at({b}, n + 1), 1, 0)))")


# --- the fitted model ----------------------------------------------------------------
@dataclass
class BoostedTrees:
    """Trees by class; rows with a value at or above a split's go right, as missing ones do."""

    features: list[str]
    start: list[float]
    trees: list[list[dict]] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def margins(self) -> list[Column]:
        x = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features])
        kind = "array<struct<f array<int>, t array<double>, l array<int>, v array<double>>>"
        out = []
        for start, trees in zip(self.start, self.trees):
            text = json.dumps([{k: t[k] for k in "ftlv"} for t in trees])
            out.append(F.lit(start) + _summed(F.from_json(F.lit(text), kind), x, max(map(depth_of, trees), default=0)))
        return out

    def probabilities(self) -> list[Column]:
        """One column per class, in class order."""
        margins = self.margins()
        if len(margins) == 1:
            up = 1.0 / (1.0 + F.exp(-margins[0]))
            return [1.0 - up, up]
        top = F.greatest(*margins)
        parts = [F.exp(m - top) for m in margins]
        return [p / sum(parts[1:], parts[0]) for p in parts]

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = [(-1, json.dumps({"features": self.features, "start": self.start, "params": self.params}))]
        rows += [(k, json.dumps(t)) for k, trees in enumerate(self.trees) for t in trees]
        spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "at int, class int, tree string").coalesce(
            1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedTrees":
        head, *rows = spark.read.parquet(path).orderBy("at").collect()
        out = BoostedTrees(**json.loads(head["tree"]))
        out.trees = [[] for _ in out.start]
        for row in rows:
            out.trees[row["class"]].append(json.loads(row["tree"]))
        return out


def _summed(trees: Column, x: Column, steps: int) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda total, t: total + F.element_at(t["v"], 1 + _leaf(t, x, steps)))


def _leaf(tree: Column, x: Column, steps: int) -> Column:
    def step(node: Column, _: Column) -> Column:
        feature = F.element_at(tree["f"], node + 1)
        right = F.coalesce(F.element_at(x, feature + 1) >= F.element_at(tree["t"], node + 1), F.lit(True))
        return F.when(feature < 0, node).otherwise(F.element_at(tree["l"], node + 1) + right.cast("int"))
    return F.aggregate(F.array_repeat(F.lit(0), steps), F.lit(0), step)


# --- fitting ---------------------------------------------------------------------------
def quantile_edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct inner quantiles of every feature, above its least value; one pass for all."""
    shares = [i / bins for i in range(1, bins)]
    found = {r.f: r for r in long_form(df, features).groupBy("f").agg(
        F.percentile_approx("v", shares, 10_000).alias("q"), F.min("v").alias("m")).collect()}
    return {c: sorted({q for q in (found[i].q if i in found else None) or []
                       if q > found[i].m and math.isfinite(q)}) for i, c in enumerate(features)}


def binned(df: DataFrame, edges: dict[str, list[float]], *kept: Column) -> DataFrame:
    """``bins``: the number of edges at or below each value; missing values come last."""
    used = [c for c, e in edges.items() if e]
    plain = df.select(*kept, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(math.nan)).alias(f"_x{i}")
                               for i, c in enumerate(used)])
    cut = Bucketizer(splitsArray=[[-math.inf, *edges[c], math.inf] for c in used], handleInvalid="keep",
                     inputCols=[f"_x{i}" for i in range(len(used))],
                     outputCols=[f"_b{i}" for i in range(len(used))]).transform(plain) if used else plain
    bins = (F.array(*[F.col(f"_b{i}").cast("smallint") for i in range(len(used))]) if used
            else F.array().cast("array<smallint>"))
    return cut.select(*[c for c in plain.columns if not c.startswith("_x")], bins.alias("bins"))


def histograms(rows: DataFrame, targets: list[tuple[str, list[int]]],
               shape: tuple[int, int]) -> list[dict[int, np.ndarray]]:
    """Sums by feature and bin of the wanted nodes, for each class in one aggregation.

    ``targets`` has for each class its SQL of a row's node and the wanted nodes.  One
    statement per round: building it step by step would cost as much as running it.
    """
    out: list[dict[int, np.ndarray]] = [{n: np.zeros((*shape, 3), np.int64) for n in wanted} for _, wanted in targets]
    asked = [k for k, (_, wanted) in enumerate(targets) if wanted]
    if not asked:
        return out
    nodes = ", ".join(f"{targets[k][0]} AS _n{k}" for k in asked)
    entries = ", ".join(f"struct({k} AS k, IF(array_contains({numbers(targets[k][1])}, _n{k}), _n{k}, -1) AS node,"
                        f" g{k} AS g, h{k} AS h)" for k in asked)
    measured = rows.sparkSession.sql(f"""
        SELECT k, node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n
        FROM (SELECT k, node, g, h, posexplode(bins) AS (f, b)
              FROM (SELECT bins, inline(array({entries})) FROM (SELECT *, {nodes} FROM {{rows}} WHERE sampled))
              WHERE node >= 0)
        GROUP BY k, node, f, b""", rows=rows).toArrow()
    k, node, f, b, g, h, n = (measured[c].to_numpy() for c in ("k", "node", "f", "b", "g", "h", "n"))
    for i, found in enumerate(out):
        for number, sums in found.items():
            own = (k == i) & (node == number)
            sums[f[own], b[own]] = np.stack([g[own], h[own], n[own]], axis=1)
    return out


#: Sums of the wanted nodes of each class, given the routes to them, their depth and their numbers.
Measure = Callable[[list[tuple[dict, int, list[int]]]], list[dict[int, np.ndarray]]]


def grown(measure: Measure, classes: int, params: BoostParams, scale: float, columns: np.ndarray) -> list[Growth]:
    """One tree per class, round by round."""
    growths = [Growth(params, scale, columns, found[0]) for found in measure([({}, 0, [0])] * classes)]
    while True:
        opened, targets = [], []
        for tree in growths:
            pending = tree.order()[1]
            before = len(tree.nodes)
            opens = [(i, *tree.open(i)) for i in pending]
            opened.append(opens)
            depth = 1 + max((tree.nodes[i].depth for i in pending), default=0)
            wanted = [first if small else first + 1 for _, first, small in opens]
            targets.append((tree.routes(before), depth, wanted))
        if not any(opened):
            return growths
        for tree, opens, found in zip(growths, opened, measure(targets)):
            for i, first, small in opens:
                tree.close(i, found[first if small else first + 1], small)


def fit_boosted(df: DataFrame, features: list[str], label: str, classes: int, weight: str | None = None,
                params: BoostParams | None = None, key: list[str] | None = None,
                edges: dict[str, list[float]] | None = None) -> BoostedTrees:
    """Boosted trees over rows with a class number in ``label``: logistic for two classes, else softmax.

    ``key`` names the columns that draw a row into a tree's sample; without it all
    columns of the row do.  Features that hold one value are never split.
    """
    params = params or BoostParams()
    edges = edges or quantile_edges(df, features, params.bins)
    used = [c for c in features if edges[c]]
    shape = (max(len(used), 1), max((len(edges[c]) for c in used), default=0) + 2)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    draw = F.xxhash64(*(key or [F.col(f"`{c}`") for c in df.columns]))
    quick = _quick(df.sparkSession)
    state = _stored(binned(df, {c: edges[c] for c in used}, F.col(label).cast("int").alias("label"),
                                          w.alias("w"), draw.alias("draw")), quick)
    total = state.groupBy("label").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.max("w").alias("top")).collect()
    share = np.full(classes, FLAT)
    for row in total:
        share[row["label"]] += row["w"] / sum(r["w"] for r in total)
    trees = classes if classes > 2 else 1
    start = [math.log(s) for s in share] if trees > 1 else [math.log(share[1] / share[0])]
    rows_n, top = sum(r["n"] for r in total), max((r["top"] for r in total), default=1.0)
    # sums of all rows stay below 2^62
    scale = 2.0 ** min(40, math.floor(62 - math.log2(max(rows_n, 1) * max(top, 1.0) * 2)))
    model = BoostedTrees(features, start, [[] for _ in range(trees)], asdict(params))
    state = state.coalesce(max(1, math.ceil(rows_n / TASK_ROWS)))
    places = {c: i for i, c in enumerate(features)}

    def add(done: list[dict]) -> None:
        for k, t in enumerate(done):
            model.trees[k].append({**t, "t": [edges[used[f]][b] if f >= 0 else 0.0 for f, b in zip(t["f"], t["b"])],
                                   "f": [places[used[f]] if f >= 0 else -1 for f in t["f"]]})

    if rows_n <= TASK_ROWS and params.trees >= STORED_EVERY:
        ready(df.sparkSession)
        in_task = state.mapInArrow(partial(_grown_in_task, params, start, scale, shape, len(used)),
                                   "number int, trees string")
        for row in sorted(in_task.collect()):
            add(json.loads(row["trees"]))
        return model
    state = state.withColumns({f"m{k}": F.lit(start[k]) for k in range(trees)})
    drawn = drawn_columns(params, len(used), shape[0])
    held: DataFrame | None = None
    for number in range(params.trees):
        rows = _with_gradients(state, trees, scale, params, number).persist(StorageLevel.MEMORY_AND_DISK)

        def measure(targets, rows=rows):
            return histograms(rows, [(routed(*to), wanted) for *to, wanted in targets], shape)

        done = [g.tree() for g in grown(measure, trees, params, scale, next(drawn))]
        if held is not None:
            held.unpersist()
        held = rows
        if _settled(done, params):
            break
        state = rows.select("label", "w", "draw", "bins", *[
            F.expr(f"m{k} + element_at({numbers(t['v'])}, 1 + {routed(t, depth_of(t))})").alias(f"m{k}")
            for k, t in enumerate(done)])
        add(done)
        if number % STORED_EVERY == STORED_EVERY - 1:
            state = _stored(state, quick).coalesce(max(1, math.ceil(rows_n / TASK_ROWS)))
    if held is not None:
        held.unpersist()
    return model


def drawn_columns(params: BoostParams, used: int, width: int) -> Iterator[np.ndarray]:
    """The columns that each tree may split."""
    draws = np.random.default_rng(params.seed)
    while True:
        columns = np.zeros(width, bool)
        columns[draws.permutation(used)[:math.ceil(used * params.column_share)]] = True
        yield columns


def _settled(done: list[dict], params: BoostParams) -> bool:
    """Whether no later tree can split what these did not."""
    return all(len(t["f"]) == 1 for t in done) and params.row_share == params.column_share == 1.0


# --- a fit in one task ------------------------------------------------------------------
def _grown_in_task(params: BoostParams, start: list[float], scale: float, shape: tuple[int, int], used: int,
                   batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, trees of all classes) of every tree, grown over the rows of this task."""
    rows = pa.Table.from_batches(list(batches))
    if not len(rows):
        return
    label, w, draw = (rows[c].to_numpy() for c in ("label", "w", "draw"))
    w = np.nan_to_num(w)  # no weight: counted only
    bins = rows["bins"].combine_chunks().flatten().to_numpy().reshape(len(rows), used).astype(np.int64)
    cells = bins + np.arange(used) * shape[1]
    m = [np.full(len(rows), x) for x in start]
    drawn = drawn_columns(params, used, shape[0])
    for number in range(params.trees):
        g, h = _whole_gradients(label, w, m, scale)
        sampled = _sampled(draw, params, number)

        def measure(targets):
            out = []
            for k, (routes, depth, wanted) in enumerate(targets):
                node = _nodes(routes, depth, bins)
                out.append({n: _sums(cells, g[k], h[k], sampled & (node == n), shape) for n in wanted})
            return out

        done = [t.tree() for t in grown(measure, len(start), params, scale, next(drawn))]
        if _settled(done, params):
            return
        m = [own + np.array(t["v"])[_nodes(t, depth_of(t), bins)] for own, t in zip(m, done)]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([json.dumps(done)])],
                                         names=["number", "trees"])


def _nodes(tree: dict, depth: int, bins: np.ndarray) -> np.ndarray:
    """The node that each row's bins lead to."""
    node = np.zeros(len(bins), np.int64)
    if depth:
        f, b, left = (np.array(tree[x]) for x in ("f", "b", "l"))
        every = np.arange(len(bins))
        for _ in range(depth):
            at = f[node]
            node = np.where(at < 0, node, left[node] + (bins[every, at] > b[node]))
    return node


def _sums(cells: np.ndarray, g: np.ndarray, h: np.ndarray, taken: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums by feature and bin of the taken rows, in whole numbers."""
    at, width = cells[taken].ravel(), cells.shape[1]
    out = np.zeros((3, shape[0] * shape[1]), np.int64)
    for i, x in enumerate((g, h)):
        np.add.at(out[i], at, np.repeat(x[taken], width))
    out[2] = np.bincount(at, minlength=shape[0] * shape[1])
    return np.ascontiguousarray(out.T).reshape(*shape, 3)


def _whole_gradients(label: np.ndarray, w: np.ndarray, m: list[np.ndarray],
                     scale: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What ``_with_gradients`` states in SQL."""
    if len(m) == 1:
        p, hit, stretch = [1.0 / (1.0 + np.exp(-m[0]))], [label == 1], 1.0
    else:
        top = np.max(m, axis=0)
        parts = [np.exp(x - top) for x in m]
        total = sum(parts[1:], parts[0])
        p, hit, stretch = [x / total for x in parts], [label == k for k in range(len(m))], len(m) / (len(m) - 1)

    def whole(x: np.ndarray) -> np.ndarray:
        return np.trunc(x * scale + np.copysign(0.5, x)).astype(np.int64)

    return ([whole(w * (x - y)) for x, y in zip(p, hit)],
            [whole(w * np.maximum(x * (1.0 - x) * stretch, FLAT)) for x in p])


def _sampled(draw: np.ndarray, params: BoostParams, number: int) -> np.ndarray:
    """Spark's ``pmod(xxhash64(draw, seed, number), 1000000)`` below the share."""
    if params.row_share >= 1:
        return np.ones(len(draw), bool)
    one, two, three, four, five = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def finished(x):
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return x ^ (x >> np.uint64(32))

    def of_long(value, x):
        return finished(turned((x + five + np.uint64(8)) ^ (turned(value * two, 31) * one), 27) * one + four)

    def of_int(value, x):
        return finished(turned((x + five + np.uint64(4)) ^ (value * one), 23) * two + three)

    x = of_long(draw.view(np.uint64), np.full(len(draw), 42, np.uint64))
    for value in (params.seed, number):
        small = -2**31 <= value < 2**31
        own = np.full(len(draw), value & (0xFFFFFFFF if small else 0xFFFFFFFFFFFFFFFF), np.uint64)
        x = (of_int if small else of_long)(own, x)
    return np.mod(x.view(np.int64), 1_000_000) < int(params.row_share * 1_000_000)


def _quick(spark: SparkSession) -> SparkSession:
    """A session for many small jobs: aggregates bounded by the tree gain nothing from re-planning at run time."""
    quick = spark.newSession()
    quick.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    quick.conf.set("spark.sql.adaptive.enabled", "false")
    quick.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return quick


def _stored(df: DataFrame, session: SparkSession) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here."""
    path = scratch_path(session, "boosting")
    df.write.parquet(path)
    return session.read.parquet(path)


def _with_gradients(state: DataFrame, trees: int, scale: float, params: BoostParams, number: int) -> DataFrame:
    """Whole-number gradients and curvatures of each class, and whether the tree samples the row."""
    if trees == 1:
        p = [1.0 / (1.0 + F.exp(-F.col("m0")))]
        hit, stretch = [F.col("label") == 1], 1.0
    else:
        top = F.greatest(*[f"m{k}" for k in range(trees)])
        parts = [F.exp(F.col(f"m{k}") - top) for k in range(trees)]
        p = [x / sum(parts[1:], parts[0]) for x in parts]
        hit, stretch = [F.col("label") == k for k in range(trees)], trees / (trees - 1)
    whole = lambda x: F.round(x * scale).cast("long")
    out = {}
    for k in range(trees):
        out[f"g{k}"] = whole(F.col("w") * (p[k] - hit[k].cast("double")))
        out[f"h{k}"] = whole(F.col("w") * F.greatest(p[k] * (1.0 - p[k]) * stretch, F.lit(FLAT)))
    sampled = F.lit(True)
    if params.row_share < 1:
        sampled = F.pmod(F.xxhash64("draw", F.lit(params.seed), F.lit(number)),
                         F.lit(1_000_000)) < int(params.row_share * 1_000_000)
    return state.withColumns({**out, "sampled": sampled})


def root_gains(df: DataFrame, features: list[str], edges: dict[str, list[float]], label: str,
               params: BoostParams) -> DataFrame:
    """(feature, rows_left, rows_right, gain) of each edge at the root of a first tree, from the same sums.

    A distributed form of what the driver does for every leaf: running sums by bin.
    """
    from pyspark.sql import Window

    used = [c for c in features if edges[c]]
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rows = binned(df, {c: edges[c] for c in used}, (F.lit(share) - F.col(label)).alias("g"))
    sums = (rows.select("g", F.posexplode("bins").alias("f", "b")).groupBy("f", "b")
            .agg(F.sum("g").alias("g"), F.count("*").alias("n")))
    run = Window.partitionBy("f").orderBy("b")
    whole = Window.partitionBy("f")
    curve = share * (1 - share)
    scored = sums.select("f", "b", F.sum("g").over(run).alias("gl"), F.sum("n").over(run).alias("nl"),
                         F.sum("g").over(whole).alias("gt"), F.sum("n").over(whole).alias("nt"))
    soft = lambda g: F.greatest(F.abs(g) - params.l1, F.lit(0.0))
    score = lambda g, n: soft(g) * soft(g) / (n * curve + params.l2)
    gl, nl, gt, nt = (F.col(c) for c in ("gl", "nl", "gt", "nt"))
    names = F.array(*map(F.lit, used))
    return scored.where(nl < nt).select(
        F.element_at(names, F.col("f") + 1).alias("feature"), nl.alias("rows_left"), (nt - nl).alias("rows_right"),
        (score(gl, nl) + score(gt - gl, nt - nl) - score(gt, nt)).alias("gain"))
