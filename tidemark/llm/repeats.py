"""Removes byte strings that occur earlier in the corpus, by column-wise sorting.

A string of ``LENGTH`` bytes is compared at the one anchor it holds: the first of
its substrings of ``SEED`` bytes whose hash is smallest.  Equal strings hold equal
anchors at equal places, so only anchors that occur more than once matter, and
each string is compared once.  Around such an anchor a document gives a piece: all
strings that this anchor stands for.

Pieces of equal anchors meet in one task, aligned on the anchor, and are sorted as
a collection that grows by columns from right to left.  Each round inserts one
symbol per piece: the column read in the current order is the collection's
Burrows-Wheeler transform at that column, its stable sort is the next order, and
the common prefixes of neighbours are carried over as minima between equal
symbols.  Neighbours with a common prefix of ``LENGTH`` are the same string; all
but the earliest of a class are removed.  Rounds are bounded by the piece's width
and the arrays they pass over in sequence by ``CHUNK`` pieces, so they are held in
memory rather than in external files.

Copies of whole texts are settled before.  Frequent anchors are dealt over several
tasks; what is still first of its class in one of them is settled between tasks by
the string's 128-bit hash, which is combined before it is shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import ready, release, scratch_path, stored
from tidemark.llm.syncmers import window_hashes

LENGTH, SEED = 100, 32
#: Strings that one anchor may stand for, and columns of the widest piece.
REACH = LENGTH - SEED
WIDTH = REACH + LENGTH
#: Pieces of one anchor in a task, and pieces that are sorted together, about.
CAP, CHUNK = 4_000, 40_000
LAST = (1 << 63) - 1

ANCHORS = "doc long, tie int, hash long, packed long"
PIECES = "hash long, salt int, salts int, doc long, tie int, packed long, bytes binary"
MARKS = "doc long, tie int, start int, stop int, d1 long, d2 long"
KEPT = "sha string, doc long, n_removed long, n_spans long, kept_sha256 string"


def anchored(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, first, last string start) of a text's anchors."""
    hashes = window_hashes(np.frombuffer(text, np.uint8), SEED)
    value, place = hashes, np.arange(len(hashes), dtype=np.int32)
    size, want = 1, REACH + 1

    def least(step: int, n: int) -> None:
        nonlocal value, place
        later = value[step:step + n] < value[:n]
        value, place = (np.where(later, value[step:step + n], value[:n]),
                        np.where(later, place[step:step + n], place[:n]))

    while size * 2 <= want:
        least(size, len(value) - size)
        size *= 2
    if size < want:
        least(want - size, len(value) - (want - size))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    at = place[first]
    return hashes[at].view(np.int64), at.astype(np.int64), first, last


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        docs, ties, hashes, packed, size = [], [], [], [], 0
        for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            if len(text) < LENGTH:
                continue
            h, at, first, last = anchored(text)
            docs.append(np.full(len(h), doc))
            ties.append(np.full(len(h), tie, np.int32))
            hashes.append(h)
            packed.append(at << 14 | (at - first) << 7 | (last - first))
            size += len(h)
            if size > 100_000:
                yield _table([docs, ties, hashes, packed], types, ["doc", "tie", "hash", "packed"])
                docs, ties, hashes, packed, size = [], [], [], [], 0
        if size:
            yield _table([docs, ties, hashes, packed], types, ["doc", "tie", "hash", "packed"])


def _table(columns: list[list[np.ndarray]], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, types)], names=names)


def _pieces(cap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the pieces of a document's repeated anchors out of its text."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        rows = []
        for doc, tie, text, found in zip(*[batch.column(i) for i in range(4)]):
            doc, tie, text = doc.as_py(), tie.as_py(), text.as_py()
            draw = xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True), 3)
            for a in found.as_py():
                if a["tie"] != tie:
                    continue
                salts = -(-a["n"] // cap)
                at, left, width = a["packed"] >> 14, a["packed"] >> 7 & 127, a["packed"] & 127
                rows.append((a["hash"], draw % salts, salts, doc, tie, a["packed"],
                             text[at - left:at - left + width + LENGTH]))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)


def common(lcp: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest common prefix within (left, right] of the old order, for each pair."""
    span = right - left
    level = np.frexp(span.astype(np.float64))[1] - 1
    rows, step = [lcp], 1
    for _ in range(int(level.max(initial=0))):
        low = rows[-1].copy()
        np.minimum(low[:-step], rows[-1][step:], out=low[:-step])
        rows.append(low)
        step *= 2
    table = np.concatenate(rows)
    base = level * len(lcp)
    return np.minimum(table[base + left + 1], table[base + right + 1 - (1 << level)])


def repeated_strings(pieces: list[bytes], left: np.ndarray, width: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether the string at [piece, column] occurs in a piece of smaller rank, or at an earlier place.

    Columns run over the ``REACH`` + 1 starts before and at the anchor.
    """
    m = len(pieces)
    begin = REACH - left
    end = begin + width + LENGTH
    symbols = np.zeros((WIDTH, m), np.uint16)  # 0: the piece does not reach here
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = width + LENGTH
    row = np.repeat(np.arange(m), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    symbols[column, row] = flat.astype(np.uint16) + 1
    del row, column
    marked = np.zeros((m, REACH + 1), bool)
    order, lcp = np.arange(m), np.zeros(m, np.uint8)
    for c in range(WIDTH - 1, -1, -1):
        transform = symbols[c][order]
        by = np.argsort(transform, kind="stable")
        sorted_ = transform[by]
        new = np.zeros(m, np.uint8)
        same = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] > 0)) + 1
        if len(same):
            new[same] = np.minimum(LENGTH - 1, common(lcp, by[same - 1], by[same])) + 1
        order, lcp = order[by], new
        if c <= REACH and (lcp >= LENGTH).any():
            starts = np.flatnonzero(lcp < LENGTH)
            ranks = rank[order]
            least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, m)))
            marked[order[ranks > least], c] = True
    assert (end <= WIDTH).all()
    return marked


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts pieces chunk by chunk; rows come ordered by anchor, so none is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            hashes, salts = table["hash"].to_numpy(), table["salt"].to_numpy()
            new = np.flatnonzero((hashes[1:] != hashes[:-1]) | (salts[1:] != salts[:-1])) + 1
            if len(new):
                yield from _mark(table.slice(0, new[-1]))
                held = table.slice(new[-1]).to_batches()
    if held:
        yield from _mark(pa.Table.from_batches(held))


def _mark(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    packed, docs, ties = (table[c].to_numpy() for c in ("packed", "doc", "tie"))
    at, left, width = packed >> 14, packed >> 7 & 127, packed & 127
    by = np.lexsort((at, ties, docs))
    place = np.stack([docs[by], ties[by], at[by]])
    rank = np.empty(len(at), np.int64)  # a repeated row stands at one place
    rank[by] = np.concatenate([[0], np.cumsum((place[:, 1:] != place[:, :-1]).any(axis=0))])
    pieces = table["bytes"].to_pylist()
    marked = repeated_strings(pieces, left, width, rank)
    edges = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    stops = np.nonzero(edges == -1)[1]
    names = [x.split()[0] for x in MARKS.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array(docs[rows]), pa.array(ties[rows], pa.int32()),
         pa.array((at[rows] + starts - REACH).astype(np.int32)),
         pa.array((at[rows] + stops - 1 - REACH + LENGTH).astype(np.int32)),
         pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
    dealt = np.flatnonzero(table["salts"].to_numpy() > 1)
    out = []
    for r in dealt.tolist():
        first = int(REACH - left[r])
        for c in np.flatnonzero(~marked[r, first:first + int(width[r]) + 1]).tolist():
            digest = xxhash.xxh3_128_digest(pieces[r][c:c + LENGTH])
            start = int(at[r] - left[r]) + c
            out.append((int(docs[r]), int(ties[r]), start, start + LENGTH,
                        int.from_bytes(digest[:8], "little", signed=True),
                        int.from_bytes(digest[8:], "little", signed=True)))
        if len(out) > 50_000:
            yield _survivors(out, names)
            out = []
    if out:
        yield _survivors(out, names)


def _survivors(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in KEPT.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for doc, tie, sha, text, marks in zip(*[batch.column(i) for i in range(5)]):
            tie, text = tie.as_py(), text.as_py()
            spans = merged_spans([(x["start"], x["stop"]) for x in marks.as_py() or () if x["tie"] == tie])
            at, digest = 0, hashlib.sha256()
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((sha.as_py(), doc.as_py(), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], names=names)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """doc, tie, sha, text of the first row of every text, stored by doc.

    The table is bucketed, so that joins on doc move no text again.
    """
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(order_key().alias("doc"), F.sha2(body, 256).alias("sha"), body.alias("text"))
    tie = F.row_number().over(Window.partitionBy("doc").orderBy("head")) - 1
    heads = rows.groupBy("sha").agg(F.min("doc").alias("doc")).select("doc", F.col("sha").alias("head"))
    heads = heads.withColumn("tie", tie.cast("int"))
    # equal length: beginning with it is being equal, and keeps doc the only join key
    first = (rows.join(heads, "doc").where(F.startswith("sha", "head")).select("doc", "tie", "sha", "text"))
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (first.write.bucketBy(n, "doc").option("path", scratch_path(spark, "texts")).format("parquet").saveAsTable(name))
    return spark.table(name)


def order_key() -> F.Column:
    """doc_id; rows without one come last, by a hash of their text."""
    late = F.lit(LAST) - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 40))
    return F.coalesce(F.col("doc_id").cast("long"), late)


def removed_repeats(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier: in a
    document of smaller id, or before in its own.  Strings never cross documents
    and are judged on the input.  Null texts are empty and lose nothing.  Rows
    without id come after all others, ordered by a hash of their text; equal
    ones count as one document, as rows that repeat id and text do.  Rows that
    repeat an id with another text are ordered by the texts' SHA-256.  Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = distinct_texts(docs)
    release(spark)
    anchors = texts.select("doc", "tie", "text").mapInArrow(_anchors, ANCHORS)
    often = anchors.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    found = stored(anchors.join(often, "hash"), "anchors")
    release(spark)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("tie", "hash", "packed", "n")).alias("found"))
    pieces = (texts.select("doc", "tie", "text").join(by_doc, "doc").select("doc", "tie", "text", "found")
              .mapInArrow(partial(_pieces, cap), PIECES))
    marks = stored(pieces.repartition("hash", "salt").sortWithinPartitions("hash", "salt")
                   .mapInArrow(_marks, MARKS), "marks")
    release(spark)
    between = marks.where("d1 IS NOT NULL")
    place = F.struct("doc", "tie", "start")
    firsts = (between.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    later = between.join(firsts, ["d1", "d2"]).where(place > F.col("first"))
    columns = ["doc", "tie", "start", "stop"]
    spans = (marks.where("d1 IS NULL").select(*columns).union(later.select(*columns))
             .groupBy("doc").agg(F.collect_list(F.struct("tie", "start", "stop")).alias("marks")))
    kept = (texts.join(spans, "doc", "left").select("doc", "tie", "sha", "text", "marks")
            .mapInArrow(_kept, KEPT).dropDuplicates(["sha", "doc"]))
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_key().alias("key"),
                       F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))
    own = F.col("key") == F.col("doc")
    whole = F.col("n_bytes") >= LENGTH  # a copy of an earlier text: removed as a whole or too short
    return rows.join(kept, "sha").select(
        "doc_id", "n_bytes",
        F.when(own, F.col("n_removed")).when(whole, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(own, F.col("n_spans")).when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(own, F.col("kept_sha256")).when(whole, F.lit(hashlib.sha256().hexdigest()))
        .otherwise(F.col("sha")).alias("kept_sha256"))
