"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ready, scratch_path  # noqa: F401  ready: for the other modules

#: Words between ASCII white space; same class as ``bytes.split()``.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Words of ASCII letters and digits and of all characters beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder of this package through the store's own client."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose results have been stored."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
