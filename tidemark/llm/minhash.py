"""Near-duplicate documents: circulant MinHash, banding, exact verification.

One pass turns a document into its set of word shingles, the set's 128-bit
key and a signature.  Documents of one set are one class from then on.  A
signature uses two permutations of the hashed universe: the first shuffles
positions, the second, shifted circularly by 0, 1, 2..., gives all coordinates,
so a shingle contributes one contiguous slice of the second permutation.
Classes that agree in a whole band are candidates and every link is confirmed
on full sets, in three steps that never list all pairs of a large bucket:

1. every member of a bucket against the bucket's smallest class;
2. where a bucket still holds several components: all pairs between them if it
   has at most ``SMALL`` classes (and the pair shares two bands), else a few
   pseudo-random leaders against the members of other components, in turns;
3. large buckets that still hold several components: an exact similarity join of
   their members over the globally rarest shingles of each set (prefix filter).

With 48 bands of 5 a pair at the threshold of 0.8 shares no band with
probability 5e-9 and fewer than two with 1e-7; pairs above it do so more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import ready, stored
from tidemark.llm.components import components

BANDS, ROWS = 48, 5
UNIVERSE = 1 << 21
SMALL = 32
LEADERS, TURNS = 2, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_TABLES: dict[int, np.ndarray] = {}

SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX2 ^ (x >> np.uint64(32))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Fewer words than a shingle takes: the whole sequence is the only one.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    total = each[:n].copy()
    for j in range(1, words):
        total = mixed(total) + each[j:j + n]
    return np.unique(mixed(total))


def second_permutation() -> np.ndarray:
    """Row p holds what the shingle at position p gives to each coordinate."""
    size = BANDS * ROWS
    if size not in _TABLES:
        ring = np.random.default_rng(7).permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([ring, ring[:size]])
        _TABLES[size] = np.lib.stride_tricks.sliding_window_view(ring, size)
    return _TABLES[size]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of every coordinate over a non-empty set."""
    first = (hashes * np.uint64(0x2545F4914F6CDD1D) + np.uint64(12345)) >> np.uint64(13)
    at = (first & np.uint64(UNIVERSE - 1)).astype(np.int64)
    slices = second_permutation()
    out = slices[at[:1024]].min(axis=0)
    for k in range(1024, len(at), 1024):
        np.minimum(out, slices[at[k:k + 1024]].min(axis=0), out=out)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One key per band; a band takes coordinates that lie far apart."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in coordinates.reshape(ROWS, BANDS).astype(np.uint64):
        total = mixed(total + row)
    return total.view(np.int64)


def _sign(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py(), words)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            bands.append(band_keys(signature(found)) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "bands"])


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shingles(t.as_py(), words).view(np.int64)
                                        for t in batch.column(1)], pa.list_(pa.int64()))],
            names=["class_id", "items"])


def similar_sizes(a: str, b: str, percent: int) -> F.Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("class_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("class_id").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return (both.withColumn("i", shared)
            .where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("i")))
            .select("a", "b").distinct())


def labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with theirs."""
    known = (buckets.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
             .withColumn("label", F.coalesce("label", "class_id")))
    open_keys = (known.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"))
                 .where("l != h").select("key"))
    return known.join(open_keys, "key")


def small_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share two small buckets."""
    member = F.struct("class_id", "n", "label")
    grouped = left.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(member).alias("all"))
    return (grouped.select(F.explode("all").alias("l"), "all").select("l", F.explode("all").alias("r"))
            .where("l.class_id < r.class_id AND l.label != r.label")
            .where(similar_sizes("l.n", "r.n", percent))
            .groupBy(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b"))
            .count().where("count > 1").select("a", "b"))


def drawn_pairs(left: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members of large buckets against leaders of other components, drawn anew each turn."""
    large = left.where(F.col("size") > SMALL).drop("lead")
    leads = large.groupBy("key").agg(*[
        F.min(F.struct(F.xxhash64("class_id", F.lit(turn * LEADERS + j)).alias("draw"), "class_id", "n", "label"))
        .alias(f"lead{j}") for j in range(LEADERS)])
    leads = leads.select("key", F.explode(F.array(*[f"lead{j}" for j in range(LEADERS)])).alias("l"))
    return (large.join(leads, "key").where("label != l.label").where(similar_sizes("n", "l.n", percent))
            .select(F.least("class_id", "l.class_id").alias("a"),
                    F.greatest("class_id", "l.class_id").alias("b")).distinct())


def rarest_joined(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle among their rarest.

    Two sets of the wanted similarity share one within the first
    n - ceil(n * percent / 100) + 1 shingles in any common order; the order by
    frequency keeps the posting lists short, and from the places of the first
    shared one follows how many can be shared at all.  No pair is lost.
    """
    who = members.select("class_id", "label").distinct()
    rows = sets.join(who, "class_id").select(
        "class_id", "label", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = rows.groupBy("item").agg(F.count("*").alias("df"))
    first = F.expr(f"n - cast(ceil(n * {percent} / 100) as int) + 1")
    prefix = (rows.join(often, "item").groupBy("class_id", "label", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("sorted"))
              .select("class_id", "label", "n", F.posexplode(F.slice("sorted", F.lit(1), first)).alias("at", "s"))
              .select("class_id", "label", "n", "at", F.col("s.item").alias("item")))
    l, r = prefix.alias("l"), prefix.alias("r")
    most = f"least(l.n - l.at, r.n - r.at) * {100 + percent} >= {percent} * (l.n + r.n)"
    return (l.join(r, F.expr(f"l.item = r.item AND l.class_id < r.class_id AND l.label != r.label AND {most}"))
            .select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their shingle sets is at
    least ``percent``; component_id is the smallest doc_id reachable over links.
    Nulls, empty texts and texts without words have no shingles, are linked
    with nothing and kept.  Rows without doc_id are linked with nothing, kept,
    and have no component.  Rows that repeat a doc_id are one document: each is
    returned.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    signed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                F.col("text").cast("binary").alias("text"))
                    .mapInArrow(partial(_sign, words), SIGNED), "signed")
    classes = stored(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("class_id"), F.any_value("n_shingles").alias("n"),
             F.any_value("bands").alias("bands")), "classes")
    keys = classes.select("class_id", "n", F.explode("bands").alias("key"))
    shared = (keys.groupBy("key").agg(F.count("*").alias("size"),
                                      F.min(F.struct("class_id", "n")).alias("lead"))
              .where("size > 1"))
    buckets = stored(keys.join(shared, "key"), "buckets")

    members = buckets.select("class_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"),
                        F.col("text").cast("binary").alias("text"))
    sets = stored(texts.join(members, "class_id", "left_semi").mapInArrow(
        partial(_sets, words), "class_id long, items array<long>"), "sets")

    stars = (buckets.where("class_id != lead.class_id")
             .where(similar_sizes("n", "lead.n", percent))
             .select(F.col("lead.class_id").alias("a"), F.col("class_id").alias("b")).distinct())
    links = stored(verified(stars, sets, percent), "links")
    labels = components(links)

    for turn in range(TURNS):
        left = stored(labelled(buckets, labels), "open")
        if turn:
            pairs = drawn_pairs(left, turn, percent)
        else:
            pairs = small_pairs(left, percent).union(drawn_pairs(left, turn, percent)).distinct()
        more = stored(verified(pairs, sets, percent), "links")
        if not more.head(1):
            break
        links = links.union(more)
        labels = components(links)
    rest = labelled(buckets.where(F.col("size") > SMALL), labels)
    if rest.head(1):
        last = stored(verified(rarest_joined(rest, sets, percent), sets, percent), "links")
        if last.head(1):
            labels = components(links.union(last))

    label = labels.withColumnRenamed("id", "class_id")
    return (signed.drop("bands")
            .join(classes.select("set_key", "class_id").join(label, "class_id", "left"), "set_key", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(),
                                               F.coalesce("label", "class_id", "doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
