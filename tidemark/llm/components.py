"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import stored


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id that has an edge to another.

    ``edges`` has two long columns; direction, repeats and loops do not matter.
    Returns (id, label) for all ids but the labels themselves.  Each round
    points every node's larger neighbours, then its smaller ones, at the least
    node it knows, so a round never holds more edges than it was given and
    no neighbourhood is gathered: minima are combined before the shuffle.
    """
    a, b = edges.columns
    links = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen or not now["n"]:
            return links.select(F.col("u").alias("id"), F.col("v").alias("label"))
        seen = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lower.select("u", F.col("m").alias("v"))))
        links = stored(small.distinct(), "links")
