"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, its
source's target over its size.  The whole part is taken as it is.  The rest is
rounded in pairs: mass, in words, moves from one document of a pair to the other
until one of them is 0 or 1, at random but with each expectation kept, so the
words that a source takes stay the same.  Each bucket of documents leaves at
most one that is still fractional; these residuals are paired again level by
level, ``FAN_IN`` buckets at a time, until one per source is left, which is
rounded by a coin.  A source thus misses its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import SPACED_WORD, ready, stored

#: Documents of a bucket, about; buckets whose residuals meet at each level.
BUCKET, FAN_IN = 20_000, 256
#: Sources whose targets may be broadcast.
FEW = 100_000
#: Copies of a document at most.
MOST = 3
ROUNDED = "doc_id long, source string, size long, copies long, p double, bucket long, seed long"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, held to ``most`` times the size.

    ``weights`` repeat over the sources by code point, null last.  What a source
    cannot take is shared again among the others by weight, until none is above:
    one level of words per weight, found from running sums over the sources
    ordered by the level at which each is full.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = rows.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    full = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    upto = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    level = (weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
             .withColumn("full_at", F.col("cap") / F.col("weight"))
             .withColumn("total", F.sum("source_size").over(whole))
             .withColumn("before", F.sum("cap").over(upto) - F.col("cap"))
             .withColumn("ahead", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
             # the level if all sources before this one are full
             .withColumn("level", (F.col("total") - F.col("before")) / F.col("ahead"))
             .withColumn("open", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level")))
                         .over(whole)))
    return level.select("source", "source_size", F.least(
        "cap", F.col("weight") * F.col("open.level")).cast("double").alias("target"))


def pivotal(sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Rounds ``p`` pair by pair; at most one entry stays between 0 and 1."""
    p, draws = p.copy(), np.random.default_rng(seed % (1 << 63)).random(len(p))
    i = -1
    for j in range(len(p)):
        if not 1e-12 < p[j] < 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        up = min((1 - p[i]) * sizes[i], p[j] * sizes[j])      # words that i may gain
        down = min(p[i] * sizes[i], (1 - p[j]) * sizes[j])    # words that i may lose
        move = up if draws[j] * (up + down) < down else -down
        p[i] += move / sizes[i]
        p[j] -= move / sizes[j]
        for k in (i, j):
            if not 1e-9 < p[k] < 1 - 1e-9:
                p[k] = round(p[k])
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def round_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of one source, in an order that no partitioning changes.

    Long documents come first, so that what stays fractional is a short one.
    """
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    p = pivotal(rows["size"].to_numpy(float), rows["p"].to_numpy(float), int(rows["seed"].iloc[0]))
    return rows.assign(p=p)


def coin(seed: int) -> F.Column:
    """A draw from [0, 1) that depends on the row and the seed alone."""
    return (F.pmod(F.xxhash64("source", "doc_id", "size", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))


def mixed_copies(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST,
                 seed: int = 1, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    size counts words between ASCII white space; null and empty texts have size
    0 and no copies.  Null sources are one source, the last; null ids are allowed.
    Repeated rows are rounded one by one.  Reruns agree, however the rows
    are partitioned.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    sizes = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = stored(source_targets(sizes, weights, most), "targets")
    # a row per source: else a source with a third of all rows would meet its target in one task
    few = F.broadcast if targets.count() <= FEW else (lambda df: df)
    counts = sizes.where("size > 0").groupBy("source").agg(F.count("*").alias("rows"))
    per_source = (targets.withColumnRenamed("source", "s")
                  .join(counts, F.col("s").eqNullSafe(F.col("source")), "left")
                  .select("s", "source_size", "target", F.coalesce("rows", F.lit(0)).alias("rows")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = (sizes.join(few(per_source), F.col("source").eqNullSafe(F.col("s")))
             .withColumn("rate", F.least(rate, F.lit(float(most))))
             .withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("rate") + 1e-12)).otherwise(0))
             .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("copies"), F.lit(0.0)))
                         .otherwise(0.0))
             .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)),
                                          F.greatest(F.ceil(F.col("rows") / bucket), F.lit(1)))))
    columns = ["doc_id", "source", "size", "copies", "p", "bucket"]
    open_rows = rated.select(*columns).where("p > 0")
    settled = [rated.select(*columns).where("p <= 0")]
    level = 0
    while True:
        keyed = open_rows.withColumn("seed", F.xxhash64("source", "bucket", F.lit(level), F.lit(seed)))
        done = stored(keyed.groupBy("source", "bucket").applyInPandas(round_bucket, ROUNDED), "rounded")
        settled.append(done.where("p = 0 OR p = 1").select(*columns))
        left = done.where("p > 0 AND p < 1").select(*columns)
        if not left.where("bucket > 0").head(1):
            settled.append(left.withColumn("p", (coin(seed) < F.col("p")).cast("double")))
            break
        open_rows = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level += 1
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.union(more)
    return (rows.join(few(targets.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("copies") + F.col("p")).cast("long").alias("copies")))


def mixture(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows without doc_id are matched by source and size.  Rows that repeat id,
    source and size share what was drawn for them: they are numbered alike on
    both sides.
    """
    key = [F.col("doc_id").cast("long"), F.col("source"),
           F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long")]
    drawn = (mixed_copies(docs, weights, most, seed).groupBy("doc_id", "source", "size")
             .agg(F.sum("copies").alias("__sum"), F.count("*").alias("__rows"))
             .select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                     F.col("size").alias("__size"), "__sum", "__rows").where("__sum > 0"))
    named = docs.select("*", key[2].alias("__own_size"))
    on = (key[0].eqNullSafe(F.col("__id")) & key[1].eqNullSafe(F.col("__source"))
          & (F.col("__own_size") == F.col("__size")))
    joined = named.join(drawn, on)
    single = joined.where("__rows = 1").withColumn("__take", F.col("__sum"))
    order = Window.partitionBy("__id", "__source", "__size").orderBy("text")
    again = (joined.where("__rows > 1").withColumn("__at", F.row_number().over(order))
             .withColumn("__take", F.expr("__sum div __rows + if(__at <= __sum % __rows, 1, 0)")).drop("__at"))
    taken = single.unionByName(again).where("__take > 0")
    return (taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__take").cast("int"))))
            .select(*docs.columns))
