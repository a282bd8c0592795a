"""Document fingerprints from closed syncmers.

A k-mer of bytes is an anchor if the smallest hash of its inner substrings of
length s stands at its first or last place; that depends on the k-mer alone, so
equal passages have equal anchors wherever they stand.  A fingerprint keeps the
anchors of smallest hash together with their places.  Two fingerprints are
compared over the smallest hashes of both: an anchor counts as shared if both
have it and its shift from place to place is that of most shared anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import ready

K, S = 24, 8
#: Anchors of a fingerprint.
KEPT = 64
#: Bytes of text that two places of a shared anchor may differ by, besides the common shift.
TOLERANCE = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the bytes from each place on, ``size`` a power of two times 1 or 3."""
    parts, step = data.astype(np.uint64), 1
    while step * 2 <= size:
        parts = mixed(parts[:-step] * _MIX2 + parts[step:] + np.uint64(step))
        step *= 2
    if step < size:
        rest = size - step
        parts = mixed(parts[:len(parts) - rest] * _MIX2 + parts[rest:] + np.uint64(size))
    return parts


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all closed syncmers; a shorter text has one, of itself."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < K:
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.zeros(1, np.int64), np.array([int.from_bytes(hashlib.sha256(text).digest()[:8], "little")], np.uint64)
    inner = window_hashes(data, S)
    span = K - S + 1
    n = len(data) - K + 1
    least, step = inner, 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[span - step:span - step + n])
    at = np.flatnonzero((inner[:n] == least) | (inner[span - 1:span - 1 + n] == least))
    return at, window_hashes(data, K)[at]


def fingerprint(text: str) -> str:
    """Length in bytes, then hash and place of the kept anchors, in hex."""
    data = text.encode()
    at, hashes = anchors(data)
    hashes, first = np.unique(hashes, return_index=True)  # ascending; of repeats the first place
    rows = zip(hashes[:KEPT].tolist(), at[first[:KEPT]].tolist())
    return f"{len(data):x}" + "".join(f".{h:016x}{p:x}" for h, p in rows)


def likeness(a: str, b: str) -> float:
    """Share of the smallest anchors of both that are shared in place, 0 to 1.

    Equal fingerprints give 1, also empty ones.
    """
    if a == b:
        return 1.0
    one, two = ({x[:16]: int(x[16:], 16) for x in f.split(".")[1:]} for f in (a, b))
    if not one or not two:
        return 0.0
    union = sorted(one.keys() | two.keys())[:KEPT]
    shifts = sorted(two[h] - one[h] for h in union if h in one and h in two)
    best = j = 0
    for i, shift in enumerate(shifts):
        while shift - shifts[j] > 2 * TOLERANCE:
            j += 1
        best = max(best, i - j + 1)
    return best / len(union)


def edited(text: str, following: str) -> str:
    """The last third replaced by as many first characters of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
          " near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, descending id; one marked as border only ends its bucket."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in RESULT.split(", ")]
    held = None

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(zip(*rows), types)] if rows
            else [pa.array([], t) for t in types], names=names)

    for batch in batches:
        rows, size = [], 0
        for bucket, border, doc_id, text in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3)):
            text = text.as_py() or ""
            mark = fingerprint(text)
            if held is not None and held[0] == bucket:
                _, own_id, own, own_mark = held
                new = edited(own, text)
                new_mark = fingerprint(new)
                rows.append((own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), own_mark, new_mark,
                             likeness(own_mark, new_mark), likeness(own_mark, mark)))
            held = None if border else (bucket, doc_id, text, mark)
            if len(rows) == 2_000:
                yield pack(rows)
                rows = []
        yield pack(rows)


def bucket_of(cuts: list[int]) -> F.Column:
    """How many of the descending cuts are above the key, looked up in blocks."""
    size = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i:i + size] for i in range(0, len(cuts), size)]
    above = lambda values: F.size(F.filter(values, lambda c: c > F.col("key")))
    block = above(F.array(*[F.lit(b[0]) for b in blocks]))
    inside = above(F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block - 1))
    return F.when(block == 0, 0).otherwise((block - 1) * size + inside).cast("int")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``, compared with its edited text and the next document.

    The next document is the one of the next smaller doc_id, null last; after the
    last comes the first.  Rows that repeat a doc_id follow each other by text.
    Null texts are empty; the fingerprint of an empty text has no anchors and is
    like none but itself.  Columns besides doc_id and text are not read; an empty
    table gives no rows.

    Documents are dealt into ranges of ids; the first document of each range is
    also sent to the range before it, so one exchange brings all neighbours
    together.  Only one id per range reaches the driver.
    """
    spark = docs.sparkSession
    ready(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_.alias("key"),
                       F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0]
    if cuts is None:
        return spark.createDataFrame([], RESULT)
    dealt = rows.withColumn("bucket", bucket_of(sorted(set(cuts), reverse=True)))
    heads = sorted((r["bucket"], r["head"]) for r in
                   dealt.groupBy("bucket").agg(F.max("key").alias("head")).collect())
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    # of rows that repeat a range's first id the one with the least text comes first
    first = (dealt.where(F.col("key").isin([head for _, head in heads])).groupBy("key", "bucket")
             .agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id")))
    to = F.create_map(*[F.lit(x) for a, b in before.items() for x in (a, b)])
    borders = first.select(F.try_element_at(to, F.col("bucket")).alias("bucket"), F.lit(True).alias("border"),
                           "doc_id", "key", "text")
    both = dealt.select("bucket", F.lit(False).alias("border"), "doc_id", "key", "text").union(borders)
    return (both.repartition(n, "bucket")
            .sortWithinPartitions("bucket", "border", F.desc("key"), "text")
            .select("bucket", "border", "doc_id", "text").mapInArrow(_compare, RESULT))
