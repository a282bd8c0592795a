"""A Merkle manifest of a corpus: trees over sources, stored in van Emde Boas layout.

Every row is a leaf; the leaves of a source form a tree of runs of ``ARITY`` and
the roots of all sources form one more tree.  A tree is cut into aligned subtrees
of ``HEIGHT`` steps.  One task builds each subtree and stores its digests as one
array in van Emde Boas order: the array holds the upper half of the levels, then
the lower subtrees one after another, each laid out the same way.  A node's place
follows from its depth and number alone, so construction and the retrieval of
siblings share one address arithmetic and no pointers are stored.  The roots of
the subtrees are the leaves of the next round, until one is left per source.

Proofs run the other way: the siblings above a subtree are the same for all its
leaves and are handed down round by round, from the manifest's root to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import ready, stored

#: Children of a node, and steps from a stored subtree's leaves to its root.
ARITY, HEIGHT = 3, 6
#: Bytes of a digest.
WIDE = 32

PROOF = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string,"
         " verified boolean")


def size(levels: int, arity: int = ARITY) -> int:
    """Nodes of a full tree."""
    return (arity ** levels - 1) // (arity - 1)


def addresses(levels: int, depth: int, index: np.ndarray, arity: int = ARITY) -> np.ndarray:
    """Places of the nodes ``index`` of one depth (0: root) in a tree of so many levels."""
    at, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = arity ** (depth - top)
        at += size(top, arity) + index // below * size(levels - top, arity)
        index, depth, levels = index % below, depth - top, levels - top
    return at


def combined(digests: Sequence[bytes]) -> bytes:
    """The digest of a run: SHA-256 over the hex forms of its nodes."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def needed(leaves: int, arity: int = ARITY) -> int:
    """Levels of the smallest tree that holds so many leaves."""
    levels = 1
    while arity ** (levels - 1) < leaves:
        levels += 1
    return levels


def layout(leaves: Sequence[bytes], levels: int, arity: int = ARITY) -> bytes:
    """All digests above and at ``leaves``, in van Emde Boas order; absent nodes are zero."""
    out = bytearray(size(levels, arity) * WIDE)
    row = list(leaves)
    for depth in range(levels - 1, -1, -1):
        for at, digest in zip((addresses(levels, depth, np.arange(len(row)), arity) * WIDE).tolist(), row):
            out[at:at + WIDE] = digest
        if depth:
            row = [combined(row[i:i + arity]) for i in range(0, len(row), arity)]
    return bytes(out)


def paths(tree: bytes, leaves: int, levels: int, arity: int = ARITY) -> list[bytes]:
    """For each leaf its siblings up to the root of ``tree``.

    Per step: a byte for its place in its run, one for the number of siblings, and
    these, left to right.
    """
    out = [b""] * leaves
    index, count = np.arange(leaves), leaves
    for depth in range(levels - 1, 0, -1):
        places = (addresses(levels, depth, np.arange(count), arity) * WIDE).tolist()
        nodes = [tree[at:at + WIDE] for at in places]
        steps = []
        for i in range(count):
            run = i - i % arity
            rest = nodes[run:i] + nodes[i + 1:run + arity]
            steps.append(bytes((i - run, len(rest))) + b"".join(rest))
        out = [path + steps[i] for path, i in zip(out, index.tolist())]
        index, count = index // arity, -(-count // arity)
    return out


def steps_of(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(place in the run, siblings) of each step."""
    at = 0
    while at < len(path):
        place, rest = path[at], path[at + 1] * WIDE
        yield place, path[at + 2:at + 2 + rest]
        at += 2 + rest


def proof_digest(steps: list[tuple[int, bytes]]) -> str:
    return hashlib.sha256(b"".join(rest for _, rest in steps).hex().encode()).hexdigest()


def folded(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that ``leaf`` and its siblings lead to."""
    for place, rest in steps:
        cut = place * WIDE
        leaf = combined([rest[:cut], leaf, rest[cut:]])
    return leaf


# --- rows to subtrees ----------------------------------------------------------------
def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``pos`` (from 0) and ``total`` of each row within its tree, in ``order``.

    Rows are dealt out by ranges of (tree, order), so a tree that holds most rows is
    spread over the tasks; only the counts per range and tree are put in line.
    """
    placed = stored(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    line = Window.partitionBy("tree").orderBy("part")
    runs = (placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
            .withColumn("before", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("total", F.sum("n").over(Window.partitionBy("tree")))
            .select("tree", "part", "first", F.coalesce("before", F.lit(0)).alias("before"), "total"))
    return (placed.join(runs, ["tree", "part"])
            .withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before"))


def levels_of(total: int, n: int, height: int, arity: int) -> int:
    """Levels of a subtree with ``n`` leaves, in a tree with ``total`` of them."""
    return height + 1 if total > arity ** height else needed(n, arity)


def builder(carry: dict[str, pa.DataType], height: int, arity: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of a block to one subtree: tree, block, total, n, layout and the carried columns as lists."""
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        total, n = rows["total"][0].as_py(), rows.num_rows
        tree = layout(rows["digest"].to_pylist(), levels_of(total, n, height, arity), arity)
        names = ["tree", "block", "total", "n", "layout", *carry]
        values = [pa.array([rows["tree"][0].as_py()], pa.string()), pa.array([rows["block"][0].as_py()], pa.int64()),
                  pa.array([total], pa.int64()), pa.array([n], pa.int64()), pa.array([tree], pa.binary())]
        values += [pa.array([rows[c].to_pylist()], pa.list_(t)) for c, t in carry.items()]
        return pa.Table.from_arrays(values, names)
    return build


_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def forest(rows: DataFrame, order: Sequence[Column], carry: dict[str, pa.DataType],
           height: int = HEIGHT, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """Subtrees of every tree of ``rows`` (tree, digest and more), and the trees' roots.

    Returns the stored subtrees round by round, and (tree, top, digest): the
    round at which one subtree was left, and its root.
    """
    rows, rounds, roots = numbered(rows, order), [], None
    block = arity ** height
    while True:
        lists = carry if not rounds else {}
        schema = ", ".join(["tree string", "block long", "total long", "n long", "layout binary",
                            *(f"{c} array<{_SQL[t]}>" for c, t in lists.items())])
        cut = rows.withColumn("block", F.floor(F.col("pos") / block))
        blocks = stored(cut.groupBy("tree", "block").applyInArrow(
            builder(lists, height, arity), schema), "subtrees")
        done = (blocks.where(F.col("total") <= block)
                .select("tree", F.lit(len(rounds)).alias("top"), F.substring("layout", 1, WIDE).alias("digest")))
        roots = done if roots is None else roots.union(done)
        rounds.append(blocks)
        tall = blocks.where(F.col("total") > block)
        if not tall.head(1):
            return rounds, roots
        rows = tall.select("tree", F.col("block").alias("pos"), F.substring("layout", 1, WIDE).alias("digest"),
                           F.ceil(F.col("total") / block).alias("total"))


# --- subtrees to proofs --------------------------------------------------------------
def _handed(height: int, arity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Siblings from each leaf of a subtree up to the manifest's root, by the leaf's number."""
    for batch in batches:
        for b in batch.to_pylist():
            found = paths(b["layout"], b["n"], levels_of(b["total"], b["n"], height, arity), arity)
            first = b["block"] * arity ** height
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["tree"]] * b["n"], pa.string()),
                 pa.array(range(first, first + b["n"]), pa.int64()),
                 pa.array([p + b["path"] for p in found], pa.binary()),
                 pa.array([b["subroot"]] * b["n"], pa.binary()),
                 pa.array([b["root"]] * b["n"], pa.binary()),
                 pa.array(b["name"] if "name" in b else [None] * b["n"], pa.string())],
                names=["tree", "block", "path", "subroot", "root", "name"])


HANDED = "tree string, block long, path binary, subroot binary, root binary, name string"


def descended(rounds: list[DataFrame], tops: DataFrame, height: int, arity: int) -> DataFrame:
    """The first round's subtrees with the siblings above each of them.

    ``tops`` holds tree, top, path, subroot and root of every tree.
    """
    above = None
    for level in range(len(rounds) - 1, -1, -1):
        here = (tops.where(F.col("top") == level)
                .select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root"))
        if above is not None:
            here = here.union(above.select("tree", "block", "path", "subroot", "root"))
        joined = rounds[level].join(here, ["tree", "block"])
        if level:
            above = joined.mapInArrow(partial(_handed, height, arity), HANDED)
    return joined


def _proved(height: int, arity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof digest and folded root of every row of a subtree."""
    names = [x.split()[0] for x in PROOF.split(", ")]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for batch in batches:
        for i in range(batch.num_rows):
            b = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
            levels = levels_of(b["total"], b["n"], height, arity)
            places = addresses(levels, levels - 1, np.arange(b["n"]), arity) * WIDE
            found = paths(b["layout"], b["n"], levels, arity)
            above, rows = list(steps_of(b["path"])), []
            subroot, root = b["subroot"].hex(), b["root"].hex()
            for doc_id, judged, at, path in zip(b["doc_id"], b["judged"], places.tolist(), found):
                steps = [*steps_of(path), *above]
                top = folded(judged, steps)
                rows.append((doc_id, b["layout"][at:at + WIDE].hex(), subroot, root, proof_digest(steps),
                             top.hex(), top == b["root"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 over the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in text]), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             judged: dict[str, Column] | None = None, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """One row per row of ``docs``: its leaf, its roots, its proof and whether that proof holds.

    A leaf covers ``fields``.  Leaves of a source ascend by doc_id, null last, and by
    leaf where an id repeats, so equal rows are interchangeable; sources ascend by
    UTF-8 bytes, null first.  A null source is a source of its own.  ``judged``
    replaces fields by what a holder of the data shows, and ``folded_root`` is what
    that leads to: ``verified`` says whether it is the root.  Null and empty
    texts differ; texts of any length are read once and only their digest is kept.
    Other columns are not read.  An empty table has no rows and no root.
    """
    spark = docs.sparkSession
    ready(spark)
    judged = judged or {}
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"),
        F.unhex(leaf_digest([F.col(c) for c in fields])).alias("digest"),
        F.unhex(leaf_digest([judged.get(c, F.col(c)) for c in fields])).alias("judged")), "leaves")
    kinds = {"doc_id": pa.int64(), "judged": pa.binary()}
    trees, subroots = forest(rows, [F.col("doc_id").asc_nulls_last(), F.col("digest")], kinds, height, arity)
    subroots = stored(subroots, "subroots")
    named = subroots.select(F.lit("all").alias("tree"), "digest", F.col("tree").alias("name"))
    all_, roots = forest(named, [F.col("name")], {"name": pa.string()}, height, arity)
    crown = roots.select("tree", "top", F.lit(b"").alias("path"), F.col("digest").alias("subroot"),
                         F.col("digest").alias("root"))
    above = (descended(all_, crown, height, arity).mapInArrow(partial(_handed, height, arity), HANDED)
             .select(F.col("name").alias("tree"), "path", "root"))
    tops = stored(subroots.select("tree", "top", F.col("digest").alias("subroot")).join(above, "tree"), "tops")
    return descended(trees, tops, height, arity).mapInArrow(partial(_proved, height, arity), PROOF)
