"""Training corpus: filter, deduplicate, decontaminate, mix and tokenize ``documents``.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept and
returns a DataFrame; ``run`` writes each result to the shared folder as Parquet
and hands it on.  All stages but the last return the columns of ``documents``.
Documents of null or empty text are clean, unique and uncontaminated; the mix,
which takes words, has no use for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import containment, minhash, mixing, records, toxicity
from tidemark.llm.base import stored, table
from tidemark.llm.queries import tokenizer_path

#: Near duplicates and benchmark items are compared by shingles of so many words.
SHINGLE = 5


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids``; rows without id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scores = toxicity.toxicity_scores(docs, labels)
    return without(docs, stored(scores.where(F.col("score") >= toxicity.THRESHOLD).select("doc_id"), "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id."""
    return without(docs, minhash.near_duplicates(docs, words=SHINGLE).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without(docs, containment.contained_items(docs, table(spark, sf_dir, "benchmark"), k=SHINGLE))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What reading the written token records back gives, one row per record."""
    return records.token_records(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]

#: A learnt classifier, a seeded draw and a tokenizer are nothing that SQL states.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
