"""Data-quality checks: every check yields (check_name, status, details) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.rolling import Series
from .normalization import distribution_profile

C = F.col
KEY = ["symbol", "date"]


def _row(df: DataFrame, name: str, status: Column | str, details: Column) -> DataFrame:
    status = F.lit(status) if isinstance(status, str) else status
    return df.select(F.lit(name).alias("check_name"), status.alias("status"),
                     details.alias("details"))


def _verdict(ok: Column, otherwise: str = "FAIL") -> Column:
    return F.when(ok, "PASS").otherwise(otherwise)


def duplicate_keys(df: DataFrame, keys: list[str] | None = None,
                   name: str = "no_duplicates") -> DataFrame:
    """Counts key groups with more than one row."""
    groups = df.groupBy(*(keys or KEY)).agg(F.count("*").alias("n")).where("n > 1")
    return _row(groups.agg(F.count("*").alias("n")), name, _verdict(C("n") == 0),
                F.format_string("%d duplicate (symbol, date) pairs", "n"))


def event_types(events: DataFrame, allowed=tuple(cfg.ALLOWED_EVENTS)) -> DataFrame:
    """One row per event type with its count; types outside the list fail."""
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select(
        F.concat(F.lit("event_type:"), "event_type").alias("check_name"),
        _verdict(C("event_type").isin(list(allowed))).alias("status"),
        F.format_string("%d events", "n").alias("details"))


def warm_up(df: DataFrame, origin="2000-01-01", need: int = 200) -> DataFrame:
    """Days between the origin and each symbol's first row."""
    first = df.groupBy("symbol").agg(F.min("date").alias("d"))
    days = F.datediff("d", F.lit(origin).cast("date"))
    return first.select(
        F.concat(F.lit("warm_up:"), "symbol").alias("check_name"),
        _verdict(days >= need).alias("status"),
        F.format_string("%d days warm-up", days).alias("details"))


def early_nulls(df: DataFrame, rows: int = 260, limit: int = 5) -> DataFrame:
    """Nulls of the slow features before and after the warm-up rows, per symbol."""
    early = C("_rn") <= rows
    marked = df.withColumn("_rn", Series(["symbol"], "date").row_number())

    def gone(name, when):
        return F.sum((C(name).isNull() & when).cast("long"))

    out = marked.groupBy("symbol").agg(
        gone("sma_200", early).alias("a"), gone("vol_60", early).alias("b"),
        gone("sma_200", ~early).alias("c"), gone("vol_60", ~early).alias("d"))
    return out.select(
        F.concat(F.lit("null_pattern:"), "symbol").alias("check_name"),
        _verdict(C("c") <= limit).alias("status"),
        F.format_string("early sma_200=%d vol_60=%d; later sma_200=%d vol_60=%d",
                        "a", "b", "c", "d").alias("details"))


def label_overlap(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Dates shared by bars and labels, and labels that are not the next move."""
    s = Series(["symbol"], "date")
    nxt = bars.select(*KEY, (F.coalesce((s.lead("close") > C("close")).cast("int"),
                                        F.lit(0))).alias("expected"))
    joined = nxt.join(labels.select(*KEY, "y_1d"), KEY)
    out = joined.agg(F.count("*").alias("n"), F.coalesce(F.sum(
        (C("expected") != C("y_1d")).cast("long")), F.lit(0)).alias("bad"))
    return _row(out, "label_shift", _verdict((C("n") > 0) & (C("bad") == 0)),
                F.format_string("%d overlapping rows, %d not shifted forward",
                                "n", "bad"))


def feature_count(df: DataFrame, expected: int, ignore) -> DataFrame:
    """Compares the frame's feature columns with the manifest size."""
    actual = len([c for c in df.columns if c not in ignore])
    text = f"{actual} features (expected {expected})"
    return _row(df.agg(F.count("*").alias("n")), "feature_count",
                "PASS" if actual == expected else "WARN", F.lit(text))


def null_targets(df: DataFrame, target: str, warmup: int = cfg.WARMUP_DAYS,
                 required: Column | None = None) -> DataFrame:
    """No missing target later than ``warmup`` calendar days after the start."""
    first = df.agg(F.min("date").alias("start"))
    required = F.lit(True) if required is None else required
    # a single-row frame: the global first date
    late = df.join(F.broadcast(first), F.lit(True)).where(
        C("date") > F.date_add("start", warmup))
    out = late.agg(F.coalesce(F.sum((C(target).isNull() & required).cast("long")),
                              F.lit(0)).alias("n"), F.count("*").alias("rows"))
    return _row(out, "no_null_targets", _verdict(C("n") == 0), F.format_string(
        f"%d rows with NULL {target} of %d after warm-up", "n", "rows"))


def class_domain(df: DataFrame, target: str, allowed=(-1, 0, 1)) -> DataFrame:
    bad = C(target).isNotNull() & ~C(target).isin(list(allowed))
    out = df.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n"))
    return _row(out, "valid_class_values", _verdict(C("n") == 0),
                F.format_string("%d rows with invalid class values", "n"))


def _share(target: str, k: int) -> Column:
    return 100.0 * F.try_divide(F.sum((C(target) == k).cast("long")),
                                F.count(target))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Hold above 90 % fails, above 85 % warns."""
    out = df.agg(_share(target, 1).alias("b"), _share(target, 0).alias("h"),
                 _share(target, -1).alias("s"))
    status = (F.when(C("h") > 90, "FAIL").when(C("h") > 85, "WARN")
              .otherwise("PASS"))
    return _row(out, "class_balance", status, F.format_string(
        "Buy=%.1f%%, Hold=%.1f%%, Sell=%.1f%%", "b", "h", "s"))


def hold_per_symbol(df: DataFrame, target: str) -> DataFrame:
    out = df.groupBy("symbol").agg(_share(target, 0).alias("h"))
    return out.select(F.concat(F.lit("hold_share:"), "symbol").alias("check_name"),
                      F.lit("INFO").alias("status"),
                      F.format_string("Hold=%.1f%%", "h").alias("details"))


def target_variance(df: DataFrame, target: str) -> DataFrame:
    """Symbols whose target does not vary."""
    flat = (df.where(C(target).isNotNull()).groupBy("symbol")
            .agg(F.stddev_samp(target).alias("sd"))
            .where(C("sd").isNull() | (C("sd") == 0)))
    return _row(flat.agg(F.count("*").alias("n")), "target_variance",
                _verdict(C("n") == 0),
                F.format_string("%d symbols with zero target variance", "n"))


def extreme_targets(df: DataFrame, target: str, bound: float = 3.0,
                    otherwise: str = "FAIL") -> DataFrame:
    out = df.agg(F.coalesce(F.sum((F.abs(target) > bound).cast("long")),
                            F.lit(0)).alias("n"))
    return _row(out, "extreme_outliers", _verdict(C("n") == 0, otherwise),
                F.format_string(f"%d rows with |{target}| > {bound}", "n"))


def date_span(df: DataFrame, min_years: float = 10) -> DataFrame:
    out = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = F.datediff("b", "a")
    return _row(out, "date_range", _verdict(days / 365.25 >= min_years, "WARN"),
                F.format_string("%s to %s (%d days)", C("a").cast("string"),
                                C("b").cast("string"), days))


def distributions(df: DataFrame, names: list[str], max_null: float = 50.0,
                  max_outlier_share: float = 0.01) -> DataFrame:
    """Flags mostly-null features and features with many values beyond five."""
    profile = distribution_profile(df, names)
    total = df.agg(F.count("*").alias("rows"))
    bad = ~C("is_binary") & ((C("pct_null") > max_null)
                             | (C("outliers_beyond_5") > C("rows") * max_outlier_share))
    joined = profile.join(F.broadcast(total), F.lit(True))
    return joined.select(
        F.concat(F.lit("distribution:"), "feature").alias("check_name"),
        _verdict(~bad, "WARN").alias("status"),
        F.format_string("%.1f%% null, %d beyond 5", "pct_null",
                        "outliers_beyond_5").alias("details"))


def truncated_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Complete labels must be fewer than feature rows, or the future leaked."""
    a = features.agg(F.count("*").alias("f"))
    b = labels.agg(F.count("*").alias("l"))
    return _row(a.join(F.broadcast(b), F.lit(True)), "labels_truncated",
                _verdict(C("l") < C("f")),
                F.format_string("%d labels, %d feature rows", "l", "f"))


def rows_per_symbol(df: DataFrame) -> DataFrame:
    out = (df.groupBy("symbol").agg(F.count("*").alias("n"))
           .agg(F.count("*").alias("s"), F.avg("n").alias("a")))
    return _row(out, "row_count_per_symbol", "INFO", F.format_string(
        "%d symbols with avg %.0f rows each", "s", "a"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def tally(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def classification_report_checks(df: DataFrame, target: str = "y_class_1d",
                                 expected: int = len(cfg.MODEL_FEATURES)):
    return report([
        null_targets(df, target), class_domain(df, target),
        class_balance(df, target), duplicate_keys(df),
        feature_count(df, expected, ("symbol", "date", target)),
        hold_per_symbol(df, target), rows_per_symbol(df)])


def regression_report_checks(df: DataFrame, target: str = "primary_target",
                             expected: int = len(cfg.MODEL_FEATURES)):
    return report([
        null_targets(df, target), duplicate_keys(df), target_variance(df, target),
        feature_count(df, expected, ("symbol", "date", target, "asset_id")),
        extreme_targets(df, target), date_span(df)])
