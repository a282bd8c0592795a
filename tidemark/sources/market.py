"""Market inputs derived from the order and line-item tables.

Every derivation is a partial aggregate straight off the scan: raw rows are
reduced to one row per (symbol, trading day) or (series, date) before anything
is shuffled, so hot symbols cost no more than cold ones.  Only primitive and
decimal aggregation buffers are used, which keeps the plan on hash aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from .local import local_frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade_date() -> Column:
    return F.to_date("l_shipdate")


def _sequence_key() -> Column:
    """Total order of trades inside a day as one decimal number.

    (order key, line number, price in cents); rows equal in all three carry
    the same price, so first and last price are well defined.
    """
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    cents = (F.col("l_extendedprice") * 100 + 0.5).cast("long")
    return (line.cast("decimal(20,0)") * F.lit(10 ** 10).cast("decimal(11,0)")
            + cents.cast("decimal(19,0)"))


def _weekday_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem")
            .withColumn("date", _trade_date())
            .where(F.weekday("date") < 5))


def _ohlcv(trades: DataFrame, symbol: Column, price: Column) -> DataFrame:
    return (
        trades.select(symbol.alias("symbol"), "date", price.alias("price"),
                      _sequence_key().alias("seq"), "l_quantity")
        .groupBy("symbol", "date")
        .agg(F.min_by("price", "seq").alias("open"),
             F.max("price").alias("high"),
             F.min("price").alias("low"),
             F.max_by("price", "seq").alias("close"),
             F.sum("l_quantity").cast("long").alias("volume"))
        .select("symbol", "date", "open", "high", "low", "close",
                F.col("close").alias("adj_close"), "volume")
    )


def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct weekdays with at least one trade."""
    return _weekday_trades(spark, sf_dir).select("date").distinct()


def _etf() -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in cfg.FLAG_TO_TICKER.items()
                             for x in kv])
    return mapping[F.col("l_returnflag")]


def _proxy() -> Column:
    slot = F.pmod(F.col("l_linenumber") * 2 + 6
                  + (F.col("l_linestatus") == "F").cast("int"),
                  F.lit(len(cfg.PROXY_SYMBOLS)))
    return F.array(*[F.lit(s) for s in cfg.PROXY_SYMBOLS])[slot]


def etf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the index ETFs, one symbol per return flag."""
    return _ohlcv(_weekday_trades(spark, sf_dir), _etf(),
                  F.col("l_extendedprice") / 100.0)


def proxy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the cross-asset proxies, keyed by line number and status."""
    return _ohlcv(_weekday_trades(spark, sf_dir), _proxy(),
                  F.col("l_extendedprice") / 2500.0)


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with one symbol per part: the many-symbols stress input."""
    return _ohlcv(_weekday_trades(spark, sf_dir),
                  F.col("l_partkey").cast("string"),
                  F.col("l_extendedprice") / 100.0)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored bars, ETFs and proxies, from one scan: each trade counts for both."""
    price = F.col("l_extendedprice")
    both = F.inline(F.array(
        F.struct(_etf().alias("symbol"), (price / 100.0).alias("price")),
        F.struct(_proxy().alias("symbol"), (price / 2500.0).alias("price"))))
    trades = _weekday_trades(spark, sf_dir).select(
        "date", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", both)
    return _ohlcv(trades, F.col("symbol"), F.col("price"))


def macro_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro observations (series_key, date, value), weekends included.

    Series are slots of (priority, status); the mean is taken over exact cents.
    """
    slot = F.pmod(F.substring("o_orderpriority", 1, 1).cast("int") * 3
                  + F.when(F.col("o_orderstatus") == "F", 0)
                  .when(F.col("o_orderstatus") == "O", 1).otherwise(2),
                  F.lit(len(cfg.MACRO_KEYS)))
    names = F.array(*[F.lit(s) for s in cfg.MACRO_KEYS])
    return (
        table(spark, sf_dir, "orders")
        .select(names[slot].alias("series_key"),
                F.to_date("o_orderdate").alias("date"),
                (F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))
        .groupBy("series_key", "date")
        .agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
        .select("series_key", "date",
                (F.col("cents") / F.col("n") / 10000000.0).alias("value"))
    )


def corporate_actions_raw(spark: SparkSession, sf_dir: str):
    """(dividends, splits): tax rows stand in for cash, discounts for splits."""
    mapping = F.create_map(*[F.lit(x) for kv in cfg.FLAG_TO_TICKER.items()
                             for x in kv])
    rows = _weekday_trades(spark, sf_dir).select(
        mapping[F.col("l_returnflag")].alias("symbol"), "date", "l_linestatus",
        (F.col("l_tax") * 100 + 0.5).cast("long").alias("tax"),
        (F.col("l_discount") * 100 + 0.5).cast("long").alias("disc"))
    paid = (rows.where("l_linestatus = 'F'").groupBy("symbol", "date")
            .agg((F.sum("tax") / 100.0).alias("dividend")))
    split = (rows.where("l_linestatus = 'O'").groupBy("symbol", "date")
             .agg((F.sum("disc") / 100.0).alias("split_ratio")))
    return paid, split


def assets(spark: SparkSession) -> DataFrame:
    """Asset dimension: ETFs plus proxies (14 fixed rows)."""
    rows = [(s, s, "ETF", "NYSE/NASDAQ", "USD", cfg.ETF_DESCRIPTIONS[s])
            for s in cfg.ETF_SYMBOLS]
    rows += [(s, name, kind, "NYSE/NASDAQ", "USD", None)
             for s, (name, kind) in cfg.PROXIES.items()]
    return local_frame(
        spark, rows, "symbol string, name string, asset_type string, exchange string,"
              " currency string, description string")


def macro_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(k, n, f, "FRED", u, d)
            for k, (n, f, u, d) in cfg.MACRO_SERIES.items()]
    return local_frame(
        spark, rows, "series_key string, name string, frequency string,"
              " source string, units string, description string")


def event_type_metadata(spark: SparkSession) -> DataFrame:
    return local_frame(
        spark, cfg.EVENT_TYPE_METADATA,
        "event_type string, name string, description string,"
        " typical_impact string, frequency_per_year int")


def feature_registry(spark: SparkSession) -> DataFrame:
    return local_frame(
        spark, cfg.FEATURE_REGISTRY, "feature_name string, feature_type string,"
                              " description string, window_size int")


def feature_exclusions(spark: SparkSession) -> DataFrame:
    return local_frame(
        spark, cfg.FEATURE_EXCLUSIONS, "feature_name string, reason string")
