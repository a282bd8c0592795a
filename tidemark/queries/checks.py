"""Summaries, listings and data-quality checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalars import round_frame
from ..operators import backtest as B
from ..operators import datasets as V
from ..operators import normalization as N
from ..operators import quality as Q
from ..operators.feature_store import unpack_features
from ..operators.targets import barrier_classes
from ..sources import files, market
from .base_sql import r
from .registry import query
from .scoring import predictions
from .views import tables

C = F.col
KEY = ["symbol", "date"]


# --- aggregation and listing ---------------------------------------------------------
@query("table_scan", "S6 Q15", """
SELECT symbol, date, y_class_1d, y_class_5d FROM lab
WHERE symbol = 'SPY' AND date >= DATE '1996-01-01' AND date <= DATE '2000-12-31'
  AND y_class_5d IS NOT NULL ORDER BY date DESC LIMIT 500""")
def table_scan(spark, sf):
    return files.scan(tables(spark, sf).labels, eq={"symbol": "SPY"},
                      gte={"date": date(1996, 1, 1)}, lte={"date": date(2000, 12, 31)},
                      not_null=["y_class_5d"], order=["date"], descending=True,
                      limit=500, columns=[*KEY, "y_class_1d", "y_class_5d"])


@query("group_counts", "Q2", """
SELECT symbol, y_class_1d, count(*) AS n FROM lab GROUP BY ALL""")
def group_counts(spark, sf):
    return tables(spark, sf).labels.groupBy("symbol", "y_class_1d").agg(
        F.count("*").alias("n"))


@query("date_bounds", "Q3", """
SELECT symbol, min(date) AS first, max(date) AS last,
  CAST(max(date) - min(date) AS INTEGER) AS span_days FROM dbars GROUP BY symbol""")
def date_bounds(spark, sf):
    return market.daily_bars(spark, sf).groupBy("symbol").agg(
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.datediff(F.max("date"), F.min("date")).alias("span_days"))


@query("repeated_order_lines", "Q4", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_order_lines(spark, sf):
    return (market.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
            .agg(F.count("*").alias("n")).where("n > 1"))


@query("constant_series", "Q5", """
SELECT symbol, count(*) AS n FROM pbars GROUP BY symbol
HAVING stddev_samp(close) = 0 OR stddev_samp(close) IS NULL""")
def constant_series(spark, sf):
    g = market.part_bars(spark, sf).groupBy("symbol").agg(
        F.count("*").alias("n"), F.stddev_samp("close").alias("sd"))
    return g.where(C("sd").isNull() | (C("sd") == 0)).drop("sd")


@query("distinct_counts", "Q6", """
SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates FROM dbars""")
def distinct_counts(spark, sf):
    return market.daily_bars(spark, sf).agg(
        F.countDistinct("symbol").alias("symbols"),
        F.countDistinct("date").alias("dates"))


@query("latest_row_per_symbol", "Q7", f"""
SELECT symbol, date, {r('close', 6, 'close')}, volume FROM pbars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""")
def latest_row_per_symbol(spark, sf):
    g = market.part_bars(spark, sf).groupBy("symbol").agg(
        F.max("date").alias("date"), F.max_by("close", "date").alias("close"),
        F.max_by("volume", "date").alias("volume"))
    return round_frame(g)


@query("latest_predictions", "Q8", """
SELECT symbol, date, horizon, model_name, pred_class_final FROM preds
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC, horizon, model_name) <= 100""")
def latest_predictions(spark, sf):
    return B.latest_per_symbol(predictions(spark, sf), 100, "horizon", "model_name").select(
        *KEY, "horizon", "model_name", "pred_class_final")


@query("distinct_sorted_dates", "Q12", "SELECT DISTINCT date FROM dbars ORDER BY date")
def distinct_sorted_dates(spark, sf):
    return market.daily_bars(spark, sf).select("date").distinct().orderBy("date")


@query("high_water_mark", "Q13", """
SELECT least((SELECT max(date) FROM dbars), (SELECT max(date) FROM feats),
  (SELECT max(date) FROM lab)) AS mark""")
def high_water_mark(spark, sf):
    t = tables(spark, sf)
    marks = [x.agg(F.max("date").alias("d")) for x in (t.bars, t.features, t.labels)]
    return (marks[0].unionByName(marks[1]).unionByName(marks[2])
            .agg(F.min("d").alias("mark")))


@query("table_row_counts", "Q14", """
SELECT 'daily_bars' AS name, count(*) AS n, NULL::VARCHAR AS classes FROM dbars
UNION ALL SELECT 'features_daily', count(*), NULL FROM feats
UNION ALL SELECT 'labels_daily', count(*), array_to_string(list_sort(
  list(DISTINCT y_class_1d) FILTER (WHERE y_class_1d IS NOT NULL)), ',') FROM lab""")
def table_row_counts(spark, sf):
    t = tables(spark, sf)

    def line(name, df, extra=None):
        extra = F.lit(None).cast("string") if extra is None else extra
        return df.agg(F.count("*").alias("n"), extra.alias("classes")).select(
            F.lit(name).alias("name"), "n", "classes")

    classes = F.array_join(F.array_sort(F.collect_set("y_class_1d")), ",")
    return (line("daily_bars", t.bars).unionByName(line("features_daily", t.features))
            .unionByName(line("labels_daily", t.labels, classes)))


@query("recent_labels_listing", "Q15", """
SELECT symbol, date, y_class_1d, y_class_5d FROM lab WHERE date >= DATE '2001-10-01'""")
def recent_labels_listing(spark, sf):
    return files.scan(tables(spark, sf).labels, gte={"date": date(2001, 10, 1)},
                      order=["date", "symbol"],
                      columns=[*KEY, "y_class_1d", "y_class_5d"])


# --- distribution profile -------------------------------------------------------------
_PROFILE = cfg.MODEL_FEATURES


def _profile_sql(c):
    binary = c in cfg.BINARY_FEATURES
    beyond = "0::BIGINT" if binary else f"count(*) FILTER (WHERE abs({c}) > 5)"
    return f"""SELECT '{c}' AS feature, {r(f'avg({c})', 4, 'mean')},
  {r(f'stddev_samp({c})', 4, 'std')}, {r(f'min({c})', 4, 'min')}, {r(f'max({c})', 4, 'max')},
  {r(f'100.0 * (count(*) - count({c})) / count(*)', 4, 'pct_null')},
  {beyond} AS outliers_beyond_5, {str(binary).lower()} AS is_binary FROM dataset"""


@query("distribution_profile", "K15", " UNION ALL ".join(_profile_sql(c) for c in _PROFILE))
def distribution_profile(spark, sf):
    df = unpack_features(tables(spark, sf).features, _PROFILE)
    return round_frame(N.distribution_profile(df, _PROFILE), 4)


# --- checks ----------------------------------------------------------------------------
def _check(name, ids, sql):
    return query(name, ids, f"SELECT check_name, status, details FROM ({sql})")


def _verdict(cond, other="FAIL"):
    return f"CASE WHEN {cond} THEN 'PASS' ELSE '{other}' END AS status"


_DUP = "SELECT count(*) AS n FROM (SELECT symbol, date FROM {} GROUP BY ALL HAVING count(*) > 1)"


@_check("check_duplicate_keys", "K1 K11", " UNION ALL ".join(f"""
SELECT '{n}' AS check_name, {_verdict('n = 0')},
  n || ' duplicate (symbol, date) pairs' AS details FROM ({_DUP.format(t)})"""
    for n, t in (("duplicates:features", "feats"), ("duplicates:labels", "lab"))))
def check_duplicate_keys(spark, sf):
    t = tables(spark, sf)
    return Q.report([Q.duplicate_keys(t.features, name="duplicates:features"),
                     Q.duplicate_keys(t.labels, name="duplicates:labels")])


@_check("check_event_types", "K2", f"""
SELECT 'event_type:' || event_type AS check_name,
  {_verdict("event_type IN ('fomc', 'cpi_release', 'nfp_release')")},
  count(*) || ' events' AS details FROM evfull GROUP BY event_type""")
def check_event_types(spark, sf):
    return Q.event_types(tables(spark, sf).events)


@_check("check_warm_up", "K3", f"""
SELECT 'warm_up:' || symbol AS check_name,
  {_verdict("min(date) - DATE '1994-01-01' >= 200")},
  (min(date) - DATE '1994-01-01') || ' days warm-up' AS details FROM bars GROUP BY symbol""")
def check_warm_up(spark, sf):
    return Q.warm_up(tables(spark, sf).features, origin="1994-01-01")


@_check("check_null_pattern", "K4", f"""
SELECT 'null_pattern:' || symbol AS check_name,
  {_verdict('count(*) FILTER (WHERE rn > 260 AND sma_200 IS NULL) <= 5')},
  printf('early sma_200=%d vol_60=%d; later sma_200=%d vol_60=%d',
    count(*) FILTER (WHERE rn <= 260 AND sma_200 IS NULL),
    count(*) FILTER (WHERE rn <= 260 AND vol_60 IS NULL),
    count(*) FILTER (WHERE rn > 260 AND sma_200 IS NULL),
    count(*) FILTER (WHERE rn > 260 AND vol_60 IS NULL)) AS details
FROM t3 GROUP BY symbol""")
def check_null_pattern(spark, sf):
    return Q.early_nulls(unpack_features(
        tables(spark, sf).features, ["sma_200", "vol_60"]))


@_check("check_label_shift", "K5", f"""
SELECT 'label_shift' AS check_name, {_verdict('n > 0 AND bad = 0')},
  n || ' overlapping rows, ' || bad || ' not shifted forward' AS details
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE y_1d <> CASE WHEN next > close THEN 1 ELSE 0 END) AS bad
  FROM (SELECT symbol, date, close, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS next FROM bars)
  JOIN (SELECT symbol, date, y_1d FROM lab) USING (symbol, date))""")
def check_label_shift(spark, sf):
    t = tables(spark, sf)
    return Q.label_overlap(t.bars, t.labels)


def _count_sql(expected, names, rows):
    """Columns of the view's rows that are no keys and no target, counted from the rows."""
    kept = "[x for x in json_keys(to_json(v)) if x NOT IN ('symbol', 'date', 'y_class_1d', 'primary_target')]"
    return f"""SELECT 'feature_count' AS check_name, CASE WHEN n = {expected} THEN 'PASS' ELSE 'WARN' END AS status,
  n || ' features (expected {expected})' AS details
FROM (SELECT max(len({kept})) AS n FROM (SELECT {names} FROM {rows} LIMIT 1) v)"""


_PRUNED_SQL = ", ".join(["symbol", "date", *cfg.PRUNED_FEATURES])
_WIDE_SQL = ", ".join(["symbol", "date", *cfg.MODEL_FEATURES])


@_check("check_feature_count", "K6", f"""{_count_sql(53, _PRUNED_SQL, 'dataset')}
UNION ALL {_count_sql(83, _WIDE_SQL, 'dataset')}""")
def check_feature_count(spark, sf):
    t = tables(spark, sf)
    return Q.report([
        Q.feature_count(V.features_pruned(t), 53, KEY),
        Q.feature_count(V.classification_dataset(t), 83, [*KEY, "y_class_1d"])])


_LATE = ("(SELECT * FROM {t} WHERE date > (SELECT min(date) FROM {t}) + 252)")


@_check("check_null_targets", "K7", f"""
SELECT 'no_null_targets' AS check_name, {_verdict('n = 0')},
  n || ' rows with NULL primary_target of ' || total || ' after warm-up' AS details
FROM (SELECT count(*) - count(primary_target) AS n, count(*) AS total
      FROM {_LATE.format(t='lab')})""")
def check_null_targets(spark, sf):
    return Q.null_targets(tables(spark, sf).labels, "primary_target")


def _classed(spark, sf):
    return barrier_classes(tables(spark, sf).labels)


@_check("check_class_domain", "K8", f"""
SELECT 'valid_class_values' AS check_name, {_verdict('n = 0')},
  n || ' rows with invalid class values' AS details
FROM (SELECT count(*) FILTER (WHERE y_class_1d NOT IN (-1, 0, 1)) AS n FROM lab3)""")
def check_class_domain(spark, sf):
    return Q.class_domain(_classed(spark, sf), "y_class_1d")


def _share(k):
    return f"100.0 * count(*) FILTER (WHERE y_class_1d = {k}) / count(y_class_1d)"


@_check("check_class_balance", "K9", f"""
SELECT 'class_balance' AS check_name,
  CASE WHEN h > 90 THEN 'FAIL' WHEN h > 85 THEN 'WARN' ELSE 'PASS' END AS status,
  printf('Buy=%.1f%%, Hold=%.1f%%, Sell=%.1f%%', b, h, s) AS details
FROM (SELECT {_share(1)} AS b, {_share(0)} AS h, {_share(-1)} AS s FROM lab3)""")
def check_class_balance(spark, sf):
    return Q.class_balance(_classed(spark, sf), "y_class_1d")


@_check("check_hold_share", "K10", f"""
SELECT 'hold_share:' || symbol AS check_name, 'INFO' AS status,
  printf('Hold=%.1f%%', {_share(0)}) AS details FROM lab3 GROUP BY symbol""")
def check_hold_share(spark, sf):
    return Q.hold_per_symbol(_classed(spark, sf), "y_class_1d")


@_check("check_target_variance", "K12", f"""
SELECT 'target_variance' AS check_name, {_verdict('n = 0')},
  n || ' symbols with zero target variance' AS details
FROM (SELECT count(*) AS n FROM (SELECT symbol FROM lab WHERE primary_target IS NOT NULL
  GROUP BY symbol HAVING stddev_samp(primary_target) = 0 OR stddev_samp(primary_target) IS NULL))""")
def check_target_variance(spark, sf):
    return Q.target_variance(tables(spark, sf).labels, "primary_target")


@_check("check_extreme_targets", "K13", f"""
SELECT 'extreme_outliers' AS check_name, {_verdict('n = 0')},
  n || ' rows with |primary_target| > 3.0' AS details
FROM (SELECT count(*) FILTER (WHERE abs(primary_target) > 3) AS n FROM lab)
UNION ALL SELECT 'extreme_outliers', {_verdict('n = 0', 'WARN')},
  n || ' rows with |y_5d_vol| > 10'
FROM (SELECT count(*) FILTER (WHERE abs(y_5d_vol) > 10) AS n FROM lab)""")
def check_extreme_targets(spark, sf):
    labels = tables(spark, sf).labels
    return Q.report([Q.extreme_targets(labels, "primary_target"),
                     Q.extreme_targets(labels, "y_5d_vol", 10, "WARN")])


@_check("check_date_span", "K14", f"""
SELECT 'date_range' AS check_name, {_verdict('d / 365.25 >= 10', 'WARN')},
  a || ' to ' || b || ' (' || d || ' days)' AS details
FROM (SELECT min(date) AS a, max(date) AS b, max(date) - min(date) AS d FROM lab)""")
def check_date_span(spark, sf):
    return Q.date_span(tables(spark, sf).labels)


def _dist_sql(c):
    if c in cfg.BINARY_FEATURES:
        bad, beyond = "false", "0"
    else:
        beyond = f"count(*) FILTER (WHERE abs({c}) > 5)"
        bad = (f"100.0 * (count(*) - count({c})) / count(*) > 50"
               f" OR {beyond} > count(*) * 0.01")
    return f"""SELECT 'distribution:{c}' AS check_name,
  CASE WHEN {bad} THEN 'WARN' ELSE 'PASS' END AS status,
  printf('%.1f%% null, %d beyond 5', 100.0 * (count(*) - count({c})) / count(*),
    {beyond}) AS details FROM dataset"""


@_check("check_distributions", "K15", " UNION ALL ".join(_dist_sql(c) for c in _PROFILE))
def check_distributions(spark, sf):
    df = unpack_features(tables(spark, sf).features, _PROFILE)
    return Q.distributions(df, _PROFILE)


@query("scaling_metadata", "K16", " UNION ALL ".join(
    f"SELECT '{f}' AS feature_name, '{k}' AS feature_type, {lo}::DOUBLE AS clip_min,"
    f" {hi}::DOUBLE AS clip_max, 'none' AS scaling, count({f}) AS observed FROM feats"
    for f, k, lo, hi in
    [(f, "binary", "NULL", "NULL") for f in cfg.BINARY_FEATURES]
    + [(f, "vol_scaled", "-3", "3") for f in cfg.VOL_SCALED_FEATURES]))
def scaling_metadata(spark, sf):
    names = cfg.BINARY_FEATURES + cfg.VOL_SCALED_FEATURES
    seen = unpack_features(tables(spark, sf).features, names).agg(
        *[F.count(n).alias(n) for n in names]).select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("feature_name"), C(n).alias("observed"))
            for n in names])))
    return N.scaling_metadata(spark).join(seen, "feature_name")


@_check("check_labels_truncated", "K17", f"""
SELECT 'labels_truncated' AS check_name, {_verdict('l < f')},
  l || ' labels, ' || f || ' feature rows' AS details
FROM (SELECT (SELECT count(*) FROM lab WHERE y_5d_raw IS NOT NULL) AS l,
             (SELECT count(*) FROM feats) AS f)""")
def check_labels_truncated(spark, sf):
    t = tables(spark, sf)
    return Q.truncated_labels(t.features, t.labels.where("y_5d_raw IS NOT NULL"))


@_check("check_rows_per_symbol", "K19 J13", """
SELECT 'row_count_per_symbol' AS check_name, 'INFO' AS status,
  printf('%d symbols with avg %.0f rows each', count(*), avg(n)) AS details
FROM (SELECT symbol, count(*) AS n FROM lab3 WHERE y_class_1d IS NOT NULL GROUP BY symbol)""")
def check_rows_per_symbol(spark, sf):
    return Q.rows_per_symbol(_classed(spark, sf).where("y_class_1d IS NOT NULL"))


_ROWS = ("(SELECT symbol, date, {t} FROM {l} JOIN (SELECT symbol, date FROM bars) USING (symbol, date)"
         " WHERE {t} IS NOT NULL)")
_CLASSED = _ROWS.format(t="y_class_1d", l="lab3")
_TARGETS = _ROWS.format(t="primary_target", l="lab")


def _null_targets_sql(target, rows):
    return f"""SELECT 'no_null_targets' AS check_name, {_verdict('n = 0')},
  n || ' rows with NULL {target} of ' || total || ' after warm-up' AS details
FROM (SELECT count(*) - count({target}) AS n, count(*) AS total FROM {rows}
      WHERE date > (SELECT min(date) FROM {rows}) + 252)"""


def _duplicates_sql(rows):
    return f"""SELECT 'no_duplicates', {_verdict('n = 0')}, n || ' duplicate (symbol, date) pairs'
FROM (SELECT count(*) AS n FROM (SELECT symbol, date FROM {rows} GROUP BY ALL HAVING count(*) > 1))"""


@query("classification_quality_report", "K20", f"""
{_null_targets_sql('y_class_1d', _CLASSED)}
UNION ALL SELECT 'valid_class_values', {_verdict('n = 0')}, n || ' rows with invalid class values'
FROM (SELECT count(*) FILTER (WHERE y_class_1d NOT IN (-1, 0, 1)) AS n FROM {_CLASSED})
UNION ALL SELECT 'class_balance', CASE WHEN {_share(0)} > 90 THEN 'FAIL' WHEN {_share(0)} > 85 THEN 'WARN'
  ELSE 'PASS' END, printf('Buy=%.1f%%, Hold=%.1f%%, Sell=%.1f%%', {_share(1)}, {_share(0)}, {_share(-1)})
FROM {_CLASSED}
UNION ALL {_duplicates_sql(_CLASSED)}
UNION ALL {_count_sql(len(cfg.MODEL_FEATURES), _WIDE_SQL, 'dataset')}
UNION ALL SELECT 'hold_share:' || symbol, 'INFO', printf('Hold=%.1f%%', {_share(0)}) FROM {_CLASSED} GROUP BY symbol
UNION ALL SELECT 'row_count_per_symbol', 'INFO', printf('%d symbols with avg %.0f rows each', count(*), avg(n))
FROM (SELECT symbol, count(*) AS n FROM {_CLASSED} GROUP BY symbol)""")
def classification_quality_report(spark, sf):
    df = V.classification_dataset(tables(spark, sf), labels=_classed(spark, sf))
    return Q.classification_report_checks(df)


@query("regression_quality_report", "K20", f"""
{_null_targets_sql('primary_target', _TARGETS)}
UNION ALL {_duplicates_sql(_TARGETS)}
UNION ALL SELECT 'target_variance', {_verdict('n = 0')}, n || ' symbols with zero target variance'
FROM (SELECT count(*) AS n FROM (SELECT symbol FROM {_TARGETS} GROUP BY symbol
      HAVING coalesce(stddev_samp(primary_target), 0) = 0))
UNION ALL {_count_sql(len(cfg.MODEL_FEATURES), _WIDE_SQL, 'dataset')}
UNION ALL SELECT 'extreme_outliers', {_verdict('n = 0')}, n || ' rows with |primary_target| > 3.0'
FROM (SELECT count(*) FILTER (WHERE abs(primary_target) > 3) AS n FROM {_TARGETS})
UNION ALL SELECT 'date_range', {_verdict('(b - a) / 365.25 >= 10', 'WARN')},
  a || ' to ' || b || ' (' || (b - a) || ' days)' FROM (SELECT min(date) AS a, max(date) AS b FROM {_TARGETS})""")
def regression_quality_report(spark, sf):
    return Q.regression_report_checks(V.regression_dataset_optimized(tables(spark, sf)))


@query("quality_tally", "K20", """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN count(*) = count(DISTINCT (symbol, date)) THEN 'PASS' ELSE 'FAIL' END AS status
    FROM lab
  UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE y_class_1d NOT IN (-1, 0, 1)) = 0
    THEN 'PASS' ELSE 'FAIL' END FROM lab3
  UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE abs(primary_target) > 3) = 0
    THEN 'PASS' ELSE 'FAIL' END FROM lab
  UNION ALL SELECT CASE WHEN (max(date) - min(date)) / 365.25 >= 10 THEN 'PASS' ELSE 'WARN' END
    FROM lab) GROUP BY status""")
def quality_tally(spark, sf):
    labels = tables(spark, sf).labels
    return Q.tally(Q.report([
        Q.duplicate_keys(labels), Q.class_domain(_classed(spark, sf), "y_class_1d"),
        Q.extreme_targets(labels, "primary_target"), Q.date_span(labels)]))


