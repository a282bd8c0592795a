"""File sources and sinks: bars, datasets, exports and filtered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg

# Vendor header -> column name
BAR_HEADERS = {"Date": "date", "Open": "open", "High": "high", "Low": "low",
               "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}


def normalise_bars(df: DataFrame, symbol: str | None = None, start=None,
                   end=None) -> DataFrame:
    """Vendor columns to snake case, timestamps to dates, end date inclusive."""
    df = df.withColumnsRenamed(BAR_HEADERS).withColumn("date", F.to_date("date"))
    df = date_range(df, start, end)
    if symbol is not None:
        df = df.withColumn("symbol", F.lit(symbol))
    keep = [c for c in ["symbol"] if c in df.columns] + cfg.BAR_COLUMNS
    return df.select(*keep)


def date_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Closed range; an open side is skipped."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    return df


def read_bars(spark: SparkSession, path: str, symbol=None, start=None, end=None,
              fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(
            "Date timestamp, Open double, High double, Low double,"
            " Close double, `Adj Close` double, Volume bigint")
    return normalise_bars(reader.load(path), symbol, start, end)


def corporate_actions(dividends: DataFrame, splits: DataFrame, start=None,
                      end=None) -> DataFrame:
    """Outer join of both action kinds on (symbol, date), absent ones 0.0."""
    keys = ["symbol", "date"]
    joined = date_range(dividends, start, end).join(
        date_range(splits, start, end), keys, "full")
    return joined.fillna(0.0, subset=["dividend", "split_ratio"]).orderBy(*keys)


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def read_dataset_csv(spark: SparkSession, path: str, target: str = "y_class_1d",
                     integers=tuple(cfg.INTEGER_FEATURES)) -> DataFrame:
    """CSV dataset with a header: dates parsed, features double, sorted.

    The header alone fixes the schema, so the data is read once.
    """
    header = spark.read.option("header", True).csv(path).columns
    require_columns(spark.createDataFrame([], ", ".join(
        f"`{c}` string" for c in header)), ["symbol", "date", target])
    kinds = {"symbol": "string", "date": "date", target: "int"}
    schema = ", ".join(
        f"`{c}` " + kinds.get(c, "int" if c in integers or c.startswith("y_class")
                              else "double") for c in header)
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.orderBy("symbol", "date")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "snappy").parquet(path)


def scan(df: DataFrame, eq: dict | None = None, gte: dict | None = None,
         lte: dict | None = None, not_null=(), order=(), descending: bool = False,
         limit: int | None = None, columns=None) -> DataFrame:
    """Filtered, ordered, limited table read; filters reach the file scan."""
    for c, v in (eq or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    for c, v in (gte or {}).items():
        df = df.where(F.col(c) >= F.lit(v))
    for c, v in (lte or {}).items():
        df = df.where(F.col(c) <= F.lit(v))
    for c in not_null:
        df = df.where(F.col(c).isNotNull())
    if order:
        df = df.orderBy(*[F.col(c).desc() if descending else F.col(c)
                          for c in order])
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df
