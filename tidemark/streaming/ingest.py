"""Incremental ingestion of new bar files.

The incremental run is a batch job; this drives its raw-upsert step from a file
stream instead of a date range.  ``availableNow`` drains what has arrived and
stops, progress lives in the stream checkpoint, and the keyed merge makes a
replayed micro-batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import normalise_bars
from ..sources.keyed import KeyedTable, newest_per_key

BAR_SCHEMA = ("symbol string, date date, open double, high double, low double,"
              " close double, adj_close double, volume bigint")


def ingest_new_bars(spark: SparkSession, source: str, table: KeyedTable,
                    checkpoint: str, max_files: int = 1000) -> None:
    """Upsert every bar file not seen before into the keyed table."""
    stream = (spark.readStream.schema(BAR_SCHEMA)
              .option("maxFilesPerTrigger", max_files).parquet(source)
              .withColumn("_arrived", F.struct("_metadata.file_modification_time",
                                               "_metadata.file_path")))

    def merge(batch: DataFrame, _: int) -> None:
        # a later file may repeat a day: the last one to arrive wins
        rows = newest_per_key(batch, table.keys, "_arrived").drop("_arrived")
        table.merge(normalise_bars(rows))

    (stream.writeStream.foreachBatch(merge)
     .option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
