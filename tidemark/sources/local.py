"""Fixed small tables as local relations.

Going through Arrow gives Catalyst the exact size, so joins against these
tables are broadcast by the normal size check rather than by a hint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(),
          "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_()}


def local_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """``schema`` is ``"name type, name type"``; ``rows`` are tuples."""
    fields = [part.split() for part in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(values), type=_TYPES[kind])
              for values, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(
        pa.Table.from_arrays(arrays, names=[name for name, _ in fields]))
