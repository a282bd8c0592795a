"""Benchmark decontamination: short items found inside long documents.

Documents are long and items short, so their Jaccard similarity is near zero
and MinHash bands would need one row and as many bands as shingles.  In that
limit the exact choice is made on the item's side: of its n shingles at least
ceil(n * percent / 100) must occur in the document, so one of any
n - ceil(n * percent / 100) + 1 of them does.  An item is looked up by that many
of its shingles with the smallest MinHash values; how many follows from the
item's size partition and size, and a document's size partition rules out items
that are too long for it.  Matches are then verified on all shingles, as text.
No pair is lost and none is wrong.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import PLAIN_WORD, ascii_lower, stored

#: Probes (24 bytes each) up to which their table is broadcast; beyond, it is shuffled.
BROADCAST_PROBES = 500_000


def words_of(text: Column) -> Column:
    """Lower-case words without punctuation; none for a null."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(PLAIN_WORD), F.lit(0))


def shingle_count(words: str, k: int) -> Column:
    return F.expr(f"CASE WHEN size({words}) = 0 THEN 0 ELSE greatest(size({words}) - {k - 1}, 1) END")


def shingle_texts(words: str, k: int) -> Column:
    """Distinct shingles as text; a shorter text is one shingle itself."""
    return F.expr(f"""array_distinct(transform(
        slice(sequence(1, size({words}) + 1), 1, CASE WHEN size({words}) = 0 THEN 0
              ELSE greatest(size({words}) - {k - 1}, 1) END),
        i -> array_join(slice({words}, i, {k}), ' ')))""")


def shingle_hashes(words: str, k: int) -> Column:
    """A 64-bit hash for each shingle, without building its text."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    short = ", ".join(f"get({words}, {j})" for j in range(k))
    return F.expr(f"""CASE WHEN size({words}) = 0 THEN cast(array() AS array<bigint>)
        WHEN size({words}) < {k} THEN array(xxhash64({short}))
        ELSE transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})) END""")


def probes_of(items: DataFrame, k: int, percent: int) -> DataFrame:
    """item_id, n, need and the hashes that the item is looked up by."""
    w = items.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w"))
    h = (w.select("item_id", F.array_distinct(shingle_hashes("w", k)).alias("h"))
         .select("item_id", "h", F.size("h").alias("n"),
                 F.ceil(F.size("h") * F.lit(percent) / 100).cast("int").alias("need")))
    return h.select("item_id", "n", "need", F.floor(F.log2("need")).cast("int").alias("partition"),
                    F.explode_outer(F.expr("slice(array_sort(h), 1, n - need + 1)")).alias("h")
                    ).where("h IS NOT NULL")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared, containment) that reach ``percent``.

    Texts are compared as distinct shingles of ``k`` lower-case words, anywhere
    in the document.  A text of fewer words is one shingle, so a shorter item
    is found only where it is a whole document.  Null, empty and wordless texts
    and rows without id match nothing.  Rows that repeat an id are one text each:
    the pair's greatest containment is returned once.  Other columns are not
    read; an empty table on either side gives no rows.
    """
    probes = stored(probes_of(items, k, percent), "probes")
    bounded = probes.count() <= BROADCAST_PROBES
    words = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    hashed = (words.select("doc_id", shingle_count("w", k).alias("size"), shingle_hashes("w", k).alias("hs"))
              .select("doc_id", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int").alias("doc_partition"),
                      F.explode_outer("hs").alias("h")))  # inner would repeat the hashing in a pushed filter
    lookup = probes.select("h", "item_id", "partition")
    found = hashed.join(F.broadcast(lookup) if bounded else lookup, "h").where("partition <= doc_partition")
    pairs = stored(found.select("doc_id", "item_id").distinct(), "candidates")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = (texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
             .select("doc_id", words_of(F.col("text")).alias("w"))
             .select("doc_id", shingle_texts("w", k).alias("ds")))
    wanted = (items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w"))
              .select("item_id", shingle_texts("w", k).alias("bs")))
    overlap = (pairs.join(wanted, "item_id").join(whole, "doc_id")
               .select("doc_id", "item_id", F.size("bs").cast("long").alias("item_shingles"),
                       F.size(F.array_intersect("bs", "ds")).cast("long").alias("shared"))
               .where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
               .withColumn("containment", F.col("shared") / F.col("item_shingles")))
    return (overlap.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("containment", "item_shingles", "shared")).alias("m"))
            .select("doc_id", "item_id", "m.item_shingles", "m.shared", "m.containment"))
