"""Daily market time-series analytics expressed as Spark jobs."""
