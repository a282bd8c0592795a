"""Keyed tables: merge semantics as DataFrames and a partitioned parquet home.

The merge functions are pure (old, new) -> merged plans.  ``KeyedTable`` applies
them to the partitions a batch touches: the merged rows are first written to the
shared folder, so a lost executor or a failed overwrite never reads half-replaced
input, and then replace exactly those partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that ``new`` supplies replace stored ones on the key; others stay."""
    return upsert_columns(old, new, keys, [c for c in new.columns if c not in keys])


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str],
                   columns: list[str]) -> DataFrame:
    """Only ``columns`` change; a supplied NULL overwrites a stored value."""
    supplied = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns],
                          F.lit(True).alias("_present"))
    joined = old.join(supplied, keys, "full")
    kept = [c for c in old.columns if c not in keys]
    missing = [c for c in columns if c not in old.columns]

    def merged(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        before = F.col(c) if c in old.columns else F.lit(None)
        return F.when(F.col("_present"), F.col(f"_new_{c}")).otherwise(before).alias(c)

    return joined.select(*keys, *[merged(c) for c in kept + missing])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is already stored are left untouched."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"),
                           allowMissingColumns=True)


def upsert_refresh(old: DataFrame, new: DataFrame, keys: list[str],
                   constants: dict[str, Column]) -> DataFrame:
    """Upsert that also stamps constant columns on every supplied row."""
    return upsert(old, new.withColumns(constants), keys)


def newest_per_key(batch: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row per key: the one with the greatest ``newest``."""
    rest = [c for c in batch.columns if c not in keys]
    return (batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_row"))
            .select(*keys, "_row.*").select(*batch.columns))


def reject_repeated_keys(rows: DataFrame, keys: list[str]) -> None:
    """A key stands for one row; a batch that repeats one is an error."""
    repeated = rows.groupBy(*keys).count().where("count > 1").head(1)
    if repeated:
        raise ValueError(f"repeated key {tuple(repeated[0][k] for k in keys)}")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop matching rows; an unknown condition keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def surrogate_ids(dim: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Dense surrogate ids in key order, for small dimensions."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy(key)
    return dim.select(key).distinct().select(
        key, F.row_number().over(order).alias(name))


class KeyedTable:
    """Parquet table partitioned by the year of its date column."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str],
                 date_column: str = "date"):
        self.spark, self.path = spark, path
        self.keys, self.date_column = keys, date_column

    def exists(self) -> bool:
        jvm = self.spark._jvm
        location = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark._jsc.hadoopConfiguration()
        return location.getFileSystem(conf).exists(location)

    def read(self, since=None, until=None) -> DataFrame:
        """Stored rows; date bounds also prune year partitions."""
        df = self.spark.read.parquet(self.path)
        day = F.col(self.date_column)
        if since is not None:
            df = df.where((F.col("year") >= since.year) & (day >= F.lit(since)))
        if until is not None:
            df = df.where((F.col("year") <= until.year) & (day <= F.lit(until)))
        return df.drop("year")

    def _write(self, df: DataFrame) -> None:
        (df.withColumn("year", F.year(self.date_column))
         .repartition("year", self.keys[0])
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "snappy").partitionBy("year").parquet(self.path))

    def _partition(self, year: int):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/year={year}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def merge(self, new: DataFrame, columns: list[str] | None = None,
              newest: str | None = None) -> None:
        """Upsert a batch: all columns it supplies, or only ``columns`` of them.

        Stored columns that the batch lacks stay as they are.  A key that the
        batch repeats is an error, unless ``newest`` names the column whose
        greatest value wins.
        """
        if newest:
            new = newest_per_key(new, self.keys, newest)
        with staged(self.spark, new, "batch") as batch:
            # checked before anything of it can be read
            if not newest:
                reject_repeated_keys(batch, self.keys)
            if not self.exists():
                self._write(batch)
                return
            years = [row.y for row in batch.select(
                F.year(self.date_column).alias("y")).distinct().collect()]
            if not years:
                return
            old = (self.spark.read.parquet(self.path)
                   .where(F.col("year").isin(years)).drop("year"))
            merged = (upsert(old, batch, self.keys) if columns is None
                      else upsert_columns(old, batch, self.keys, columns))
            with staged(self.spark, merged, "merge") as rows:
                self._write(rows)

    def delete(self, condition: Column) -> None:
        """Drop the rows that match; only their partitions are rewritten."""
        stored = self.spark.read.parquet(self.path)
        years = [row.year for row in stored.where(condition).select("year").distinct().collect()]
        if not years:
            return
        kept = delete_where(stored.where(F.col("year").isin(years)).drop("year"), condition)
        with staged(self.spark, kept, "kept") as rows:
            left = {row.y for row in rows.select(
                F.year(self.date_column).alias("y")).distinct().collect()}
            self._write(rows)
        for year in set(years) - left:
            store, path = self._partition(year)
            store.delete(path, True)

    def clear(self) -> None:
        """Remove all rows, keeping the schema and the location."""
        schema = self.read().schema
        (self.spark.createDataFrame([], schema)
         .withColumn("year", F.year(self.date_column))
         .write.mode("overwrite").option("partitionOverwriteMode", "static")
         .parquet(self.path))


@contextmanager
def staged(spark: SparkSession, df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder for the time of the block."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, computes once."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)
