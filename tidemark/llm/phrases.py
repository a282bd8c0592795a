"""Collocations of each language by SON partitioning.

A phrase with ``support`` occurrences has, in at least one shard, its share of
them: the support times the shard's part of the language's bytes.  First pass:
every shard is mined completely at that lowered support, word by word longer, and a
phrase is only extended where its beginning and its end are frequent.  The union
over shards, less what cannot reach the support even if it just missed the bar
wherever it was not frequent, are the candidates.  Second pass: all candidates are
counted in all shards, and the sums are exact.

The candidates reach the tasks of the second pass as a Bloom filter of bounded size.
What it lets through besides candidates is counted in every shard as well, so that
counts are exact either way and the support alone decides.

A shard is what a task reads, in parts of ``SHARD`` bytes at most: memory is bounded.
A corpus has ``SHARDS`` of them at least, so that up to ``SHARD`` * ``SHARDS`` bytes
the lowered support is the same at every size.  Beyond, it falls with the number of
shards, to one at last, where a shard would have to send every phrase it has.  Below
``LOWEST`` the first pass is therefore made in rounds of a few lengths each: a round
counts all phrases of its lengths, and only those that reach the support in the whole
corpus are extended in the next one.  What a round sends is then bounded by what is
frequent in the corpus, not in a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import ready, stored
from tidemark.llm.syncmers import mixed

#: Occurrences of a candidate, words of the longest one, rows returned per language.
SUPPORT, LONGEST, BEST = 100, 5, 2_000
#: Bytes of text that are mined together at most, and shards of a corpus at least.
SHARD, SHARDS = 20_000_000, 32
#: Least lowered support that is mined in one round; below it, last lengths of the rounds before the last.
LOWEST, ROUNDS = 3, (2, 3)
#: Rows of a batch of counts.
SENT = 1 << 17
#: Bits of the largest filter, probes, and bits of a part of it.
FILTER_BITS, PROBES, PART_BITS = 1 << 28, 4, 1 << 19
#: Rows of a per-language table that may be broadcast.
FEW = 100_000

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\v\f\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

LOCAL = "lang string, hash long, n long, bar long"
ROUND = "hash long, n int"
COUNTED = "lang string, phrase string, words int, n long"


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word numbers, piece numbers, vocabulary) of all words of the texts, in order."""
    data = _LOWER[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int32), pa.array([], pa.binary())
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts).astype(np.int32)
    del kind, edge, starts, ends
    words = pa.Array.from_buffers(pa.binary(), len(piece),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return words.indices.to_numpy(), piece, words.dictionary


def word_hashes(lang: str, vocabulary: pa.Array) -> np.ndarray:
    """Sums of hashes of (byte, place in the word), seeded by the language."""
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int32)[vocabulary.offset:vocabulary.offset + len(vocabulary) + 1]
    if not len(vocabulary):
        return np.empty(0, np.uint64)
    data = np.frombuffer(vocabulary.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    starts = (offsets - offsets[0])[:-1]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(offsets))
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    # words are not empty, so each has bytes of its own
    return mixed(np.add.reduceat(mixed(data + (place.astype(np.uint64) << np.uint64(8)) + seed), starts))


def mined(words: np.ndarray, piece: np.ndarray, hashes: np.ndarray, longest: int,
          keep: Callable[[np.ndarray], np.ndarray] | None = None,
          lets: Callable[[int, np.ndarray], np.ndarray] | None = None,
          ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, first places, counts, hashes) of the phrases that ``lets`` keeps by length and hash and ``keep`` by count.

    A phrase is looked at where both the phrase without its last word and the one
    without its first were kept.  Places are dropped by ``lets`` before phrases are numbered.
    """
    n = len(words)
    at, number, before = np.arange(n, dtype=np.int32), words, hashes
    for length in range(1, longest + 1):
        counts = np.bincount(number, minlength=len(before))
        first = np.empty(len(before), np.int64)
        first[number[::-1]] = at[::-1]
        kept = np.ones(len(before), bool) if keep is None else keep(counts)
        if lets is not None and length == 1:
            kept &= lets(length, before)
        yield length, first[kept], counts[kept], before[kept]
        if length == longest or not kept.any():
            return
        # places whose phrase and whose next place's phrase were kept, within one piece
        renumbered = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
        here = np.full(n + 1, -1, np.int32)
        here[at] = renumbered[number]
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0)).astype(np.int32)
        at = at[at + length < n]
        at = at[piece[at] == piece[at + length]]
        before = before[kept]
        if lets is not None:
            at = at[lets(length + 1, extended(before[here[at]], hashes[words[at + length]]))]
        if not len(at):
            return
        keys = pa.array(here[at] * np.int64(len(hashes)) + words[at + length]).dictionary_encode()
        del here, renumbered
        pairs = keys.dictionary.to_numpy()
        before = extended(before[pairs // len(hashes)], hashes[pairs % len(hashes)])
        number = keys.indices.to_numpy()


def extended(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases by one word longer."""
    return mixed(phrases * np.uint64(31) + words)


def phrases_at(first: np.ndarray, length: int, words: np.ndarray, vocabulary: pa.Array) -> pa.Array:
    parts = [vocabulary.take(pa.array(words[first + i])) for i in range(length)]
    joined = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, b" ")
    return joined.cast(pa.string())


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, its texts, bytes of the language in the corpus), as parts of a task's rows.

    Parts hold ``limit`` bytes, the last one between a half and one and a half of that,
    as a small remainder would be mined at a low support.
    """
    held: list[tuple[str, bytes, int]] = []
    size = 0

    def taken(upto: int) -> Iterator[tuple[str, list[bytes], int]]:
        nonlocal held, size
        texts: dict[str, list[bytes]] = {}
        total: dict[str, int] = {}
        taken_size = n = 0
        while n < len(held) and (taken_size < upto or not n):
            lang, text, whole = held[n]
            texts.setdefault(lang, []).append(text)
            total[lang], taken_size, n = whole, taken_size + len(text), n + 1
        held, size = held[n:], size - taken_size
        return ((lang, own, total[lang]) for lang, own in texts.items())

    for batch in batches:
        for lang, text, whole in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            held.append((lang, text.as_py(), whole))
            size += len(held[-1][1])
            if size >= 2 * limit:
                yield from taken(limit)
    if size > 1.5 * limit:
        yield from taken(size // 2)
    while held:
        yield from taken(size + 1)


def _locally_frequent(support: int, longest: int, limit: int,
                      batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard and language: hash and count of what is frequent there, and a row without hash with all words."""
    for lang, texts, whole in shards(batches, limit):
        words, piece, vocabulary = words_of(texts)
        bar = max(1, -(-support * sum(map(len, texts)) // max(whole, 1)))
        yield _local(lang, [None], [len(words)], bar)
        for _, _, counts, found in mined(words, piece, word_hashes(lang, vocabulary), longest, lambda n: n >= bar):
            yield _local(lang, found.view(np.int64), counts, bar)


def _local(lang: str, hashes, counts, bar: int) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), pa.array(hashes, pa.int64()),
         pa.array(counts, pa.int64()), pa.array(np.full(n, bar))], names=["lang", "hash", "n", "bar"])


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's bits of each hash, probe by probe."""
    step = mixed(hashes) | np.uint64(1)
    for i in range(PROBES):
        yield (hashes + np.uint64(i) * step) & np.uint64(bits - 1)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each hash, one row per probe."""
    return np.stack([*probes(hashes, bits)])


def _filter_parts(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(places(batch.column(0).to_numpy().view(np.uint64), bits))
        yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(PART_BITS)).astype(np.int32)),
                                          pa.array((at % np.uint64(PART_BITS)).astype(np.int32))], names=["part", "at"])


def _filter_part(rows: pa.Table) -> pa.Table:
    marks = np.zeros(PART_BITS, np.uint8)
    marks[rows["at"].to_numpy()] = 1
    return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()),
                     "bitmap": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})


def bloom_filter(hashes: DataFrame, limit: int = FILTER_BITS) -> np.ndarray:
    """A bitmap over the ``hash`` column: 12 bits a row, a power of two, ``limit`` at most."""
    bits = PART_BITS
    count = hashes.count()
    while bits < min(12 * count, limit):
        bits *= 2
    parts = (hashes.select("hash").mapInArrow(partial(_filter_parts, bits), "part int, at int").distinct()
             .groupBy("part").applyInArrow(_filter_part, "part int, bitmap binary"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        first = row["part"] * PART_BITS // 8
        out[first:first + PART_BITS // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter lets each hash through."""
    ok = np.ones(len(hashes), bool)
    for at in probes(hashes, len(bitmap) * 8):
        ok &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _round_counts(shared, known: int, longest: int, limit: int,
                  batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard hash and count of all phrases of more than ``known`` words whose parts of that many the filter lets through."""
    def lets(length: int, hashes: np.ndarray) -> np.ndarray:
        return passes(shared.value, hashes) if length <= known else np.ones(len(hashes), bool)

    for lang, texts, _ in shards(batches, limit):
        words, piece, vocabulary = words_of(texts)
        for length, _, counts, found in mined(words, piece, word_hashes(lang, vocabulary), longest, None, lets):
            for i in range(0, len(found) if length > known else 0, SENT):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[i:i + SENT].view(np.int64)), pa.array(counts[i:i + SENT].astype(np.int32))],
                    names=["hash", "n"])


def _count_candidates(shared, longest: int, limit: int,
                      batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard and language the count of every phrase that the filter lets through, and a row without phrase with all words."""
    for lang, texts, _ in shards(batches, limit):
        words, piece, vocabulary = words_of(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([len(words)], pa.int64())],
            names=["lang", "phrase", "words", "n"])
        for length, first, counts, _ in mined(words, piece, word_hashes(lang, vocabulary), longest,
                                              lets=lambda _, hashes: passes(shared.value, hashes)):
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), phrases_at(first, length, words, vocabulary),
                 pa.array(np.full(n, length, np.int32)), pa.array(counts, pa.int64())],
                names=["lang", "phrase", "words", "n"])


def per_language(df: DataFrame) -> DataFrame:
    """A stored table of one row per language; broadcast if it is small."""
    df = stored(df, "languages")
    return F.broadcast(df) if df.count() <= FEW else df


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST,
                     shard: int = SHARD, least: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases with ``support`` occurrences, and (lang, words_total)."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sizes = per_language(texts.groupBy("lang").agg(F.sum(F.octet_length("text")).cast("long").alias("whole")))
    whole = sizes.agg(F.sum("whole")).first()[0] or 0
    shard = min(shard, max(1, whole // least))
    dealt = texts.join(sizes, "lang").select("lang", "text", "whole")
    if support * shard > (LOWEST - 1) * whole:
        candidates = _shard_candidates(dealt, support, longest, shard)
    else:
        shard = max(1, shard // 2)  # without a lowered support, smaller shards only save memory
        candidates = _round_candidates(dealt, support, longest, shard)
    shared = spark.sparkContext.broadcast(bloom_filter(candidates))
    counted = stored(dealt.mapInArrow(partial(_count_candidates, shared, longest, shard), COUNTED)
                     .groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("f"))
                     .where(F.col("phrase").isNull() | (F.col("f") >= support)), "frequent")
    totals = per_language(counted.where("phrase IS NULL").select("lang", F.col("f").alias("words_total")))
    return counted.where("phrase IS NOT NULL"), totals


def _shard_candidates(dealt: DataFrame, support: int, longest: int, shard: int) -> DataFrame:
    """Hashes of what is frequent in a shard at its lowered support and may be so in the corpus."""
    local = stored(dealt.mapInArrow(partial(_locally_frequent, support, longest, shard), LOCAL), "local")
    missed = per_language(local.where("hash IS NULL").groupBy("lang").agg(F.sum(F.col("bar") - 1).alias("missed")))
    bound = F.sum("n") - F.sum(F.col("bar") - 1)
    return stored(local.where("hash IS NOT NULL").groupBy("lang", "hash").agg(bound.alias("bound"))
                  .join(missed, "lang").where(F.col("bound") + F.col("missed") >= support)
                  .select("hash"), "candidates")


def _round_candidates(dealt: DataFrame, support: int, longest: int, shard: int) -> DataFrame:
    """Hashes of what is frequent in the corpus, a few lengths after the other."""
    candidates, shared, known = None, None, 0
    for upto in [*(n for n in ROUNDS if n < longest), longest]:
        counts = dealt.mapInArrow(partial(_round_counts, shared, known, upto, shard), ROUND)
        found = stored(counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
                       .select("hash"), "candidates")
        candidates = found if candidates is None else candidates.unionByName(found)
        if upto < longest:
            shared, known = dealt.sparkSession.sparkContext.broadcast(bloom_filter(candidates)), upto
    return candidates


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, best: int = BEST,
                 contained: int = 100, shard: int = SHARD) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are split at spaces and tabs, pieces at punctuation and line breaks; A-Z
    count as a-z.  Null languages are ``und``; null and empty texts have no words.
    Equal rows count each.  A phrase's cut is the one of lowest score, the first of
    equal ones; phrases of which ``contained`` percent stand inside one longer
    candidate are left out.  Scores are computed in decimals of 38 digits.  Texts are
    mined whole; a text longer than ``shard`` is a shard by itself.  Columns besides
    lang and text are not read; an empty table gives no rows.
    """
    found, totals = frequent_phrases(docs, support, longest, shard)
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    # joins on the parts of a cut: found has one row per phrase
    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("first", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "))
            .withColumn("rest", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ")))
    left = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
              .withColumn("score", score("a", "words_total", "l", "r")).groupBy("lang", "phrase").agg(
                  F.first("a").alias("a"), F.first("words_total").alias("n"),
                  F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1),
                                 lambda at: F.array_join(F.slice(parts, at, size), " "))))
    longer = (candidates.where("words > 2").select("lang", "a", F.explode(spans).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("inside")))
    left_ = (scored.join(longer, ["lang", "phrase"], "left")
             .where(F.col("inside").isNull() | (F.col("inside") * 100 < F.col("a") * contained)))
    return ranked(left_.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), best)


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) in whole decimals."""
    whole = "decimal(38,0)"
    return F.expr(f"cast(cast(1000 as {whole}) * {a} * {n} div (cast({left} as {whole}) * {right}) as long)")


def ranked(rows: DataFrame, best: int) -> DataFrame:
    """The first rows of each language, drawn from the first rows of its parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    top = some.where(F.col("rank") <= best).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return top.where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
