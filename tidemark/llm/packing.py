"""Documents packed into token sequences of several context sizes.

A document is routed by its length: whole windows of the largest size are cut off
first, the rest goes to the smallest tier that holds it.  Tiers are packed from the
longest down.  A window is opened by its tier's longest document, which fills more
than half of it; the gap is filled with the longest documents of shorter tiers that
fit, and the last bit with the beginning of one that does not.  So every sequence
is exactly full.  Only what a task has left at its end is broken down to the
shorter tiers, and at most one sequence per task, shorter than the smallest tier,
is padded.

Sequences of one tier are then grouped into steps of equal token counts; the
sequences left over in each tier share the last steps.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import ready, stored
from tidemark.llm.encoding import encoder

TIERS = (256, 512, 1024, 2048)
#: Tokens that a task holds before it packs them, and tokens of a step.
POOL, STEP = 4_000_000, 1 << 17

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, number long, offset long,"
          " tier int, tier_number long")
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


class Piece:
    """Consecutive ids of one document; ordered by length, then by arrival."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens", "key")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int, arrival: int) -> None:
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens
        self.key = (len(ids), arrival)

    def cut(self, at: int) -> tuple[Piece, Piece]:
        arrival = self.key[1]
        return (Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens, arrival),
                Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens, arrival))


class Packer:
    """Packs the documents of one task; ``full`` sequences can be taken away at any time."""

    def __init__(self, tiers: Sequence[int] = TIERS) -> None:
        self.tiers = sorted(tiers)
        self.pool: list[Piece] = []
        self.held = self.arrivals = 0
        self.full: list[tuple[int, list[Piece]]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        largest, at, n = self.tiers[-1], 0, len(ids)
        while n - at >= largest:
            self.full.append((largest, [Piece(doc_id, at, ids[at:at + largest], n, self.arrivals)]))
            at += largest
        if at < n:  # copied, so that the batch's ids can go
            self.pool.append(Piece(doc_id, at, ids[at:].copy(), n, self.arrivals))
            self.held += n - at
        self.arrivals += 1

    def pack(self) -> None:
        """Fills windows as long as documents are there; the unfinished one stays in the pool."""
        pool = sorted(self.pool, key=lambda p: p.key)
        keys = [p.key for p in pool]
        self.pool, self.held = [], 0
        while pool:
            window = [pool.pop()]
            size = keys.pop()[0]
            tier = self.tiers[bisect.bisect_left(self.tiers, size)]
            gap = tier - size
            while gap and pool:
                i = bisect.bisect_left(keys, (gap + 1, -1)) - 1
                if i >= 0:
                    piece = pool.pop(i)
                    keys.pop(i)
                else:
                    keys.pop(0)
                    piece, rest = pool.pop(0).cut(gap)
                    i = bisect.bisect_left(keys, rest.key)
                    pool.insert(i, rest)
                    keys.insert(i, rest.key)
                window.append(piece)
                gap -= piece.key[0]
            if gap:
                self.pool, self.held = window, tier - gap
            else:
                self.full.append((tier, window))

    def finish(self) -> None:
        """Breaks what is left down to the tiers; less than the smallest one is padded to the largest."""
        self.pack()
        left, self.pool = self.pool, []
        for tier in [*reversed(self.tiers), 0]:
            while left and sum(p.key[0] for p in left) >= tier:
                window, gap = [], tier or self.tiers[0]
                while gap and left:
                    piece = left.pop(0)
                    if piece.key[0] > gap:
                        piece, rest = piece.cut(gap)
                        left.insert(0, rest)
                    window.append(piece)
                    gap -= piece.key[0]
                self.full.append((tier or self.tiers[-1], window))


def _packed(tokenizer: str, end_id: int, tiers: Sequence[int],
            batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code, packer = encoder(tokenizer), Packer(tiers)
    part, end, rows = TaskContext.get().partitionId(), np.array([end_id], "<u4"), []
    numbers = dict.fromkeys(tiers, 0)

    def taken() -> Iterator[pa.RecordBatch]:
        for tier, window in packer.full:
            at = 0
            for p in window:
                n = p.key[0]
                rows.append((p.doc_id, p.start, n, zlib.crc32(np.ascontiguousarray(p.ids)), p.doc_tokens, part,
                             sum(numbers.values()), at, tier, numbers[tier]))
                at += n
            numbers[tier] += 1
        packer.full.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)
            rows.clear()

    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), code.encoded(batch.column(1))):
            packer.add(doc_id, np.concatenate([ids, end]))
            if packer.held >= POOL:
                packer.pack()
            if len(packer.full) >= 5_000:
                yield from taken()
    packer.finish()
    yield from taken()


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: Sequence[int] = TIERS,
                     step: int = STEP) -> DataFrame:
    """Pieces of every row of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    A document's ids are its text's and ``end_id``; each of them lies in exactly one
    piece.  Null and empty texts have just ``end_id``; a long text fills windows as it
    comes and only its own ids are held.  Rows are packed where they are read: equal
    rows and rows without doc_id are documents like others.  Sequences are numbered
    from 0 without gaps; ``tier`` is a sequence's size, also with padding.  Steps hold
    ``step`` tokens of one tier; at their end the tiers share steps.  Columns besides
    doc_id and text are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_packed, tokenizer, end_id, tuple(tiers)), PIECES), "pieces")
    # one row per task and tier
    counts = pieces.groupBy("part", "tier").agg((F.max("tier_number") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (counts.groupBy("part").agg(F.sum("n").alias("n")).withColumn("first", F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(
        "part", F.coalesce("first", F.lit(0)).alias("first")))
    per = F.floor(F.lit(step) / F.col("tier"))
    tiers_ = (counts.groupBy("tier").agg(F.sum("n").alias("sequences"))
              .withColumn("groups", F.floor(F.col("sequences") / per))
              .withColumn("tail", (F.col("sequences") - F.col("groups") * per) * F.col("tier")))
    line = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    tiers_ = (tiers_.withColumn("steps_before", F.coalesce(F.sum("groups").over(line), F.lit(0)))
              .withColumn("tail_before", F.coalesce(F.sum("tail").over(line), F.lit(0)))
              .withColumn("all_groups", F.sum("groups").over(Window.partitionBy())))
    runs = (counts.withColumn("tier_first", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .join(parts, "part").join(tiers_, "tier")
            .select("part", "tier", "first", "tier_first", "groups", "steps_before", "tail_before", "all_groups"))
    number = F.col("tier_number") + F.col("tier_first")
    past = number - F.col("groups") * per
    placed = pieces.join(runs, ["part", "tier"])
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("number")).alias("sequence_id"),
        "offset", "tier",
        F.when(past < 0, F.col("steps_before") + F.floor(number / per))
        .otherwise(F.col("all_groups") + F.floor((F.col("tail_before") + past * F.col("tier")) / step)).alias("step_id"))
