"""License scans: set-similarity join of text blocks with license templates.

A document is cut into overlapping blocks of words.  Template words are ordered
by how many documents hold them, rarest first.  A template of n distinct words
that must be contained to the share t needs k = ceil(n * t) of them, so a block
that qualifies holds one of the template's first n - k + 1 words: only
these are looked up (prefix filter), only blocks of at least k template words are
compared (length filter), and the places of the first shared word in both orders
bound how many can follow (positional filter).  What remains is verified on full
sets, and a notice's distinguishing words must be among the block's.  Base phrases
are templates of share 1 whose words must also stand consecutively.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import PLAIN_WORD, ascii_lower, stored

#: Words between the starts of two blocks, and words of a block.
STEP, BLOCK = 48, 96
#: Share of a notice's distinct words that a block must hold, in percent; of a notice with
#: fewer than ``SHORT`` distinct words it must hold all.
CONTAINED, SHORT = 80, 12


@dataclass(frozen=True)
class Template:
    """A phrase must stand word by word; a notice only be contained.

    ``required`` words tell a notice from others of nearly the same words.
    """

    label: str
    text: str
    phrase: bool = False
    required: str = ""


#: License phrases and notices (fixed values).
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3",
             required="gnu 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms"
                           " of the gnu general public license as published by the free software foundation",
             required="gnu"),
    Template("lgpl", "this library is free software licensed under the gnu lesser general public license",
             required="lesser"),
    Template("agpl", "licensed under the gnu affero general public license", required="affero"),
    Template("apache-2", "licensed under the apache license version 2 0", required="apache 2"),
    Template("apache-notice", "licensed under the apache license version 2 0 you may not use this file except in"
                              " compliance with the license",
             required="apache 2"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this"
                           " software and associated documentation files"),
    Template("mit-release", "released under the mit license", required="mit"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "cc by nc", required="nc"),
    Template("cc-by-sa", "cc by sa", required="sa"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
             required="mozilla"),
    Template("all-rights", "all rights reserved no part of this publication may be reproduced"),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    rows = ", ".join(f"({i}, '{t.label}', {str(t.phrase).lower()}, '{t.text}', '{t.required}')"
                     for i, t in enumerate(templates))
    return (spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, phrase, text, required)")
            .select("template", "label", "phrase", F.split("text", " ").alias("seq"),
                    F.when(F.col("required") == "", F.array().cast("array<string>"))
                    .otherwise(F.split("required", " ")).alias("required"))
            .withColumn("set", F.array_distinct("seq"))
            .withColumn("need", F.when(F.col("phrase") | (F.size("set") < SHORT), F.size("set"))
                        .otherwise(F.ceil(F.size("set") * F.lit(CONTAINED) / 100)).cast("int")))


def worded(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(
        F.coalesce(ascii_lower(F.col("text")), F.lit("")), F.lit(PLAIN_WORD), F.lit(0)).alias("words"))


def ranked_words(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Rank of every template word by the number of documents that hold it.

    Counted over all documents; the result is bounded by the templates' words.
    """
    words = sorted({w for t in templates for w in t.text.split()})
    held = worded(docs).select(F.explode_outer(F.array_intersect(
        "words", F.array(*map(F.lit, words)))).alias("word"))
    often = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (often.get(w, 0), w)))}


def license_matches(docs: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents, matches).

    documents: doc_id and n_words per row of ``docs``, and row_key, the hash of
    id and words that matches refer to.  matches: row_key, label, phrase, start
    and containment; for a phrase one row per place where it stands, for a notice
    one row per block that contains it, start being the block's first word.
    Null and empty texts have no words and no matches; null ids are allowed.
    Equal rows have equal matches, given once.  Other columns are not read.
    """
    spark = docs.sparkSession
    rank = ranked_words(docs, templates)
    # template words as ranks, all others dropped: they add to no overlap
    table = template_table(spark, templates)
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    ordered = table.withColumns({c: F.array_sort(F.transform(c, lambda w: F.element_at(ranks, w)))
                                 for c in ("set", "required")})
    prefix = ordered.select("template", "label", "phrase", "seq", "set", "required", "need", F.posexplode(
        F.expr("slice(set, 1, size(set) - need + 1)")).alias("t_at", "rank"))
    prefix_words = {w for w, r in rank.items()
                    if r in {x["rank"] for x in prefix.select("rank").distinct().collect()}}

    keyed = worded(docs).select("doc_id", "words", F.size("words").cast("long").alias("n_words"),
                                F.struct(
                                    F.coalesce("doc_id", F.lit(-1)).alias("id"),
                                    F.xxhash64("doc_id", "words").alias("hash")).alias("row_key"),
                                F.arrays_overlap("words", F.array(*map(F.lit, sorted(prefix_words)))).alias("some"))
    split = keyed.select("doc_id", "n_words", "row_key", F.when(F.col("some"), F.col("words")).alias("words"))
    kept = stored(split, "license-words")
    documents = kept.select("doc_id", "n_words", "row_key")

    starts = F.expr(f"sequence(0, greatest(size(words) - 1, 0), {STEP})")
    held = ranked_filter(rank)
    blocks = (kept.where("words IS NOT NULL").dropDuplicates(["row_key"])
              .select("row_key", "words", F.explode(starts).alias("first"))
              .select("row_key", "first", F.slice("words", F.col("first") + 1, BLOCK).alias("block"))
              .withColumn("set", F.array_sort(F.array_distinct(held))))
    probes = blocks.select("row_key", "first", "block", F.col("set").alias("held"),
                           F.posexplode("set").alias("b_at", "rank"))
    found = (probes.join(F.broadcast(prefix), "rank")
             .where("size(held) >= need")
             .where("least(size(held) - b_at, size(set) - t_at) >= need")
             .dropDuplicates(["row_key", "first", "template"])
             .withColumn("shared", F.size(F.array_intersect("held", "set")))
             .where("shared >= need")
             .where(F.size(F.array_except("required", "held")) == 0))
    stands = F.expr(f"""filter(sequence(0, least({STEP}, size(block)) - 1),
        i -> slice(block, i + 1, size(seq)) = seq)""")
    phrases = (found.where("phrase").select("row_key", "label", "phrase", F.explode(stands).alias("i"), "first")
               .select("row_key", "label", "phrase", (F.col("first") + F.col("i")).cast("long").alias("start"),
                       F.lit(1.0).alias("containment")))
    notices = found.where("NOT phrase").select(
        "row_key", "label", "phrase", F.col("first").cast("long").alias("start"),
        (F.col("shared") / F.size("set")).alias("containment"))
    return documents, phrases.union(notices)


def ranked_filter(rank: dict[str, int]) -> F.Column:
    """Ranks of the block's words that templates use."""
    words = ", ".join(f"'{w}', {r}" for w, r in rank.items())
    return F.expr(f"filter(transform(block, w -> try_element_at(map({words}), w)), r -> r IS NOT NULL)")


def license_summary(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with what its matches say."""
    documents, matches = license_matches(docs)
    base = F.col("phrase")
    most = max(len(t.text.split()) for t in TEMPLATES)
    assert most <= BLOCK - STEP, "a template must fit into the overlap of two blocks"
    per_row = matches.groupBy("row_key").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("containment").alias("score"))
    return (documents.join(per_row, "row_key", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
