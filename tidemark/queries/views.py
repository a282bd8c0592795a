"""Feature documents, dataset views and readable views over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalars import round_frame, to_int
from ..operators import datasets as V
from ..operators import feature_store as M
from ..operators.normalization import annotate_registry
from ..operators.sql_functions import register_functions
from ..plans.feature_build import build_features
from ..plans.staging import stored
from ..sources import market
from .base_sql import TECH_OUT, _MACRO_OUT, _R_OUT, _X_OUT, over, r, rs
from .context import inputs
from .registry import query
from .technical import DIGITS

C = F.col
KEY = ["symbol", "date"]
PLACES = {**DIGITS, **{c: 10 for c in _MACRO_OUT},
          "hy_oas_change_lag1": 10, "yield_curve_slope_lag1": 10}
LABEL_DOUBLES = ["y_1d_raw", "y_5d_raw", "y_1d_vol", "y_5d_vol", "y_1d_clipped",
                 "y_5d_clipped"]


def tables(spark, sf) -> V.Tables:
    return V.Tables.of(spark, stored(spark, sf))


def cols(names, alias: str = "") -> str:
    """Select list with integers as they are and doubles rounded."""
    out = []
    for n in names:
        if n in cfg.INTEGER_FEATURES:
            out.append(f"CAST({alias}{n} AS INTEGER) AS {n}")
        else:
            out.append(r(f"{alias}{n}", PLACES.get(n, 6), n))
    return ", ".join(out)


# --- feature documents ---------------------------------------------------------------
_DOC_KEYS = ([(c, c) for c in TECH_OUT] + [(c, c) for c in _MACRO_OUT]
             + [("liquidity_expanding", "liquidity_expanding")]
             + [(f"{k}_raw", k) for k in cfg.MACRO_KEYS]
             + [(c, c) for c in _X_OUT + _R_OUT]
             + [(f'"{s}_close"', f"{s}_close") for s in cfg.PROXY_SYMBOLS + ["SPY"]]
             + [(f"is_{t}", f"is_{t}") for t in cfg.ALLOWED_EVENTS]
             + [(c, c) for c in cfg.REGIME_FLAGS]
             + [(f"{f}_lag{n}", f"{f}_lag{n}") for f, ns in cfg.LAG_SPEC.items()
                for n in ns])


@query("packed_documents", "M1", " UNION ALL ".join(
    f"SELECT '{k}' AS feature, count(*) AS documents, count(*) - count({c}) AS nulls,"
    f" {r(f'min({c})', 4, 'low')}, {r(f'max({c})', 4, 'high')} FROM feats"
    for c, k in _DOC_KEYS))
def packed_documents(spark, sf):
    docs = M.pack_features(build_features(inputs(spark, sf)))
    entries = docs.select(F.explode(M.as_map()).alias("feature", "value"))
    return round_frame(entries.groupBy("feature").agg(
        F.count("*").alias("documents"),
        F.sum(C("value").isNull().cast("long")).alias("nulls"),
        F.min("value").alias("low"), F.max("value").alias("high")), 4)


@query("unpacked_documents", "M2", f"""
SELECT symbol, date, {cols(cfg.MODEL_FEATURES)} FROM dataset""")
def unpacked_documents(spark, sf):
    return round_frame(M.unpack_features(
        tables(spark, sf).features, cfg.MODEL_FEATURES), PLACES)


@query("extracted_keys", "M3 P8", f"""
SELECT symbol, date, {r('rsi_14', 6, 'rsi_14')}, dow, days_since_prev,
  {r('rrp_change_pct_5d', 6, 'rrp_chg_pct_5d')} FROM feats""")
def extracted_keys(spark, sf):
    doc = C("doc")
    parsed = tables(spark, sf).features.select(*KEY, M.as_map().alias("doc"))
    return round_frame(parsed.select(
        *KEY, doc["rsi_14"].alias("rsi_14"), to_int(doc["dow"]).alias("dow"),
        to_int(doc["days_since_prev"]).alias("days_since_prev"),
        doc["rrp_change_pct_5d"].alias("rrp_chg_pct_5d")))


def _clip_sql(c):
    column = next((k for k, source in cfg.SOURCE_KEYS.items() if source == c), c)
    lo, hi = cfg.default_clip_rules()[column]
    return r(f"CASE WHEN {c} IS NOT NULL THEN greatest({lo}, least({hi}, {c})) END", _CLIP_PLACES.get(c, 6), c)


_CLIPPED = [cfg.SOURCE_KEYS.get(c, c) for c in cfg.default_clip_rules()]
# macro values lie on a grid of 1e-7: compared beyond it, where no digit ties
_CLIP_PLACES = {**PLACES, **{s: PLACES[c] for c, s in cfg.SOURCE_KEYS.items() if c in PLACES}}


@query("clipped_documents", "M4", f"""
SELECT symbol, date, {', '.join(_clip_sql(c) for c in _CLIPPED)}, {r('sma_20', 7, 'sma_20')}
FROM feats""")
def clipped_documents(spark, sf):
    maps = tables(spark, sf).features.select(*KEY, M.as_map().alias("features"))
    f = C("features")
    return round_frame(M.clip_documents(maps).select(
        *KEY, *[f[c].alias(c) for c in _CLIPPED + ["sma_20"]]),
        _CLIP_PLACES)


@query("document_null_profile", "M5", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(*) - count({c}) AS nan_count, count(*) AS total_rows,
  {r(f'100.0 * (count(*) - count({c})) / count(*)', 2, 'nan_pct')} FROM feats"""
    for c in _CLIPPED))
def document_null_profile(spark, sf):
    return M.null_profile(tables(spark, sf).features, _CLIPPED)


# --- model datasets ---------------------------------------------------------------------
OHLCV = ["open", "high", "low", "close", "adj_close"]
_STAR = """FROM bars b LEFT JOIN dataset d USING (symbol, date)
LEFT JOIN lab l USING (symbol, date)"""


@query("model_dataset_documents", "V1 J5", f"""
SELECT b.symbol, b.date, {', '.join(r(f'b.{c}', 6, c) for c in OHLCV)}, b.volume,
  d.symbol IS NOT NULL AS has_features, l.y_1d, l.y_5d, l.y_thresh
FROM dbars b LEFT JOIN dataset d USING (symbol, date) LEFT JOIN lab l USING (symbol, date)""")
def model_dataset_documents(spark, sf):
    df = V.model_dataset_raw(tables(spark, sf))
    return round_frame(df.withColumn("has_features", C("feature_json").isNotNull())
                       .drop("feature_json"))


@query("model_dataset", "V1", f"""
SELECT b.symbol, b.date, {', '.join(r(f'b.{c}', 6, c) for c in OHLCV)}, b.volume,
  {cols(cfg.PRUNED_FEATURES, 'd.')}, l.y_1d, l.y_5d, l.y_thresh {_STAR}""")
def model_dataset(spark, sf):
    return round_frame(V.model_dataset(tables(spark, sf)), PLACES)


_EV = [("month_end", ""), ("quarter_end", ""), ("options_expiry_week", ""),
       ("fomc", "_day"), ("cpi_release", "_day"), ("nfp_release", "_day")]


@query("model_dataset_with_events", "V2 J6", f"""
SELECT b.symbol, b.date, {r('b.close', 6, 'close')}, l.y_1d, l.y_5d, l.y_thresh,
  {', '.join(f"EXISTS (SELECT 1 FROM evfull e WHERE e.date = b.date AND e.event_type = '{k}') AS is_{k}{t}" for k, t in _EV)}
FROM bars b LEFT JOIN lab l USING (symbol, date)""")
def model_dataset_with_events(spark, sf):
    df = V.model_dataset_enhanced(tables(spark, sf))
    return round_frame(df.drop("feature_json", "open", "high", "low", "adj_close", "volume"))


@query("features_pruned", "V3", f"""
SELECT symbol, date, {cols(cfg.PRUNED_FEATURES)} FROM dataset""")
def features_pruned(spark, sf):
    return round_frame(V.features_pruned(tables(spark, sf)), PLACES)


@query("regression_dataset", "V4", f"""
SELECT b.symbol, b.date, {', '.join(r(f'b.{c}', 6, c) for c in OHLCV)}, b.volume,
  {cols(cfg.REGRESSION_FEATURES, 'd.')}, {cols(LABEL_DOUBLES, 'l.')},
  l.y_1d AS y_1d_class, l.y_5d AS y_5d_class, l.y_thresh AS y_thresh_class {_STAR}""")
def regression_dataset(spark, sf):
    return round_frame(V.regression_dataset(tables(spark, sf)), PLACES)


@query("regression_dataset_optimized", "V5", f"""
SELECT b.symbol, b.date, {cols(['primary_target'], 'l.')}, {cols(cfg.MODEL_FEATURES, 'd.')}
{_STAR} WHERE l.primary_target IS NOT NULL""")
def regression_dataset_optimized(spark, sf):
    return round_frame(V.regression_dataset_optimized(tables(spark, sf)), PLACES)


_SD = "stddev_samp({}) " + over(frame="ROWS BETWEEN 252 PRECEDING AND CURRENT ROW")
_DIAG = LABEL_DOUBLES + ["y_1d_vol_clip", "y_5d_vol_clip", "primary_target"]


@query("regression_diagnostics", "V6 W23", f"""
SELECT symbol, date, {rs(_DIAG)}, y_1d AS y_1d_class, y_5d AS y_5d_class,
  y_thresh AS y_thresh_class,
  {', '.join(r(_SD.format(c), 6, c + '_std_252') for c in ('y_1d_raw', 'y_1d_vol', 'y_1d_vol_clip'))}
FROM lab""")
def regression_diagnostics(spark, sf):
    return round_frame(V.regression_diagnostics(tables(spark, sf)))


def _classification(h):
    name = f"classification_dataset_{h}d"

    @query(name, "V7", f"""
SELECT b.symbol, b.date, l.y_class_{h}d, {cols(cfg.MODEL_FEATURES, 'd.')}
{_STAR} WHERE l.y_class_{h}d IS NOT NULL""")
    def run(spark, sf):
        return round_frame(V.classification_dataset(tables(spark, sf), h), PLACES)


_classification(1)
_classification(5)

_STATS = ", ".join(["count(*) AS total_rows"] + [
    x for n, k in (("buy", 1), ("sell", -1), ("hold", 0)) for x in (
        f"CAST(sum(CASE WHEN y_class_1d = {k} THEN 1 ELSE 0 END) AS BIGINT) AS count_{n}",
        r(f"100.0 * sum(CASE WHEN y_class_1d = {k} THEN 1 ELSE 0 END) / count(*)", 2, f"pct_{n}"))])


@query("classification_stats", "V8 Q1", f"""
SELECT symbol, {_STATS} FROM lab3 WHERE y_class_1d IS NOT NULL GROUP BY symbol""")
def classification_stats(spark, sf):
    return V.classification_stats(tables(spark, sf))


@query("classification_stats_overall", "V9 Q1", f"""
SELECT 'ALL' AS symbol, {_STATS} FROM lab3 WHERE y_class_1d IS NOT NULL""")
def classification_stats_overall(spark, sf):
    return V.classification_stats_overall(tables(spark, sf))


@query("optimization_summary", "V11 Q6 Q11", f"""
SELECT 'Primary Target' AS category, 'y_1d_vol_clip' AS value,
  'Volatility-scaled 1d return clipped to ±3σ' AS description
UNION ALL SELECT 'Secondary Target', 'y_5d_vol_clip',
  'Volatility-scaled 5d return clipped to ±3σ'
UNION ALL SELECT 'Classification Target', 'y_class_1d',
  'Triple-barrier 1d class: 1 (Buy), 0 (Hold), -1 (Sell) using y_1d_vol ± 0.25'
UNION ALL SELECT 'Features Kept', '{len(cfg.MODEL_FEATURES)}',
  'Non-redundant features in optimized datasets'
UNION ALL SELECT 'Features Excluded', '{len(cfg.FEATURE_EXCLUSIONS)}',
  'Redundant features removed for collinearity reduction'
UNION ALL SELECT 'Total Symbols', CAST(count(DISTINCT symbol) AS VARCHAR), 'ETFs in dataset'
  FROM assets WHERE asset_type = 'ETF'
UNION ALL SELECT 'Date Range', min(date) || ' to ' || max(date), 'Coverage period'
  FROM lab3 WHERE y_class_1d IS NOT NULL
UNION ALL SELECT 'Classification Rows', CAST(count(*) AS VARCHAR),
  'Total rows with valid y_class_1d target' FROM lab3 WHERE y_class_1d IS NOT NULL""")
def optimization_summary(spark, sf):
    return V.optimization_summary(tables(spark, sf), market.feature_exclusions(spark))


# --- readable views ------------------------------------------------------------------------
@query("daily_bars_readable", "V12 P10 P11", f"""
SELECT b.symbol, a.description AS asset_description, a.asset_type, b.date,
  rpad(dayname(b.date), 9, ' ') AS day_of_week,
  {', '.join(r(f'b.{c}', 6, c) for c in OHLCV)}, b.volume,
  {r('(close - open) / open * 100', 2, 'intraday_pct')},
  {r('volume / 1000000e0', 2, 'volume_millions')}
FROM dbars b JOIN assets a USING (symbol)""")
def daily_bars_readable(spark, sf):
    return round_frame(V.daily_bars_readable(tables(spark, sf)))


@query("features_readable", "V13", f"""
SELECT symbol, description AS asset_description, date, {r('rsi_14', 6, 'rsi_14')},
  {r('vix_level', 6, 'vix_level')} FROM feats JOIN assets USING (symbol)""")
def features_readable(spark, sf):
    view = V.features_daily_readable(tables(spark, sf))
    return round_frame(M.unpack_features(view, ["rsi_14", "vix_level"]))


@query("labels_readable", "V14", f"""
SELECT symbol, description AS asset_description, date, {rs(LABEL_DOUBLES)}, y_1d, y_5d,
  y_thresh FROM lab JOIN assets USING (symbol)""")
def labels_readable(spark, sf):
    return round_frame(V.labels_daily_readable(tables(spark, sf)))


@query("macro_readable", "V15 J12", f"""
SELECT d.date, d.series_key AS code, c.name, c.description, {r('d.value', 10, 'value')},
  c.units FROM mdaily d LEFT JOIN mcat c USING (series_key)""")
def macro_readable(spark, sf):
    return round_frame(V.macro_daily_readable(
        tables(spark, sf), market.macro_catalogue(spark)), 10)


@query("events_readable", "V16 J12 P10", """
SELECT e.date, rpad(dayname(e.date), 9, ' ') || strftime(e.date, ', %b %d, %Y') AS date_formatted,
  e.event_type AS code, m.name AS event_name, m.description, m.typical_impact
FROM evfull e LEFT JOIN evmeta m USING (event_type)""")
def events_readable(spark, sf):
    return V.events_readable(tables(spark, sf), market.event_type_metadata(spark))


@query("wide_export_1d", "V17 J3 S7", f"""
SELECT l.symbol, l.date, l.y_class_1d, {cols(cfg.MODEL_FEATURES, 'd.')}
FROM lab l JOIN dataset d USING (symbol, date) WHERE l.y_class_1d IS NOT NULL""")
def wide_export_1d(spark, sf):
    return round_frame(V.wide_export(tables(spark, sf)), PLACES)


@query("wide_export_5d", "V18 J4", f"""
SELECT l.symbol, l.date, l.y_class_1d, l.y_class_5d, {cols(cfg.MODEL_FEATURES, 'd.')}
FROM lab l JOIN dataset d USING (symbol, date) WHERE l.y_class_5d IS NOT NULL""")
def wide_export_5d(spark, sf):
    return round_frame(V.wide_export(tables(spark, sf), ("y_class_1d", "y_class_5d"),
                                     etf_only=False), PLACES)


# --- manifest joined to observed coverage ---------------------------------------------------
_REG = cfg.FEATURE_REGISTRY


def _manifest_row(name, kind, text, window):
    binary = kind == "regime"
    bound = {"target": "3.0"}.get(kind, None if binary else "5.0")
    scale = {"target": "vol_scaled", "regime": "none"}.get(kind, "zscore")
    src = {"vix_change_lag1": "vix_change_1d_lag1", "vix_change_lag3": "vix_change_1d_lag3",
           "hy_oas_change_lag1": "hy_oas_change_1d_lag1"}.get(name, name)
    table = "lab" if kind == "target" else "feats"
    return f"""
SELECT '{name}' AS feature_name, '{kind}' AS feature_type, '{text}' AS description,
  CAST({window or 'NULL'} AS INTEGER) AS window_size, '{scale}' AS scaling_method,
  {str(binary).lower()} AS is_binary,
  CAST({'-' + bound if bound else 'NULL'} AS DOUBLE) AS clip_min,
  CAST({bound or 'NULL'} AS DOUBLE) AS clip_max, false AS is_excluded,
  CAST(NULL AS VARCHAR) AS exclusion_reason,
  (SELECT count({src}) FROM {table}) AS observed"""


@query("feature_manifest", "V10 J11 K16", " UNION ALL ".join(
    _manifest_row(*row) for row in _REG))
def feature_manifest(spark, sf):
    """Manifest with the number of stored values behind each entry."""
    t = tables(spark, sf)
    exclusions = market.feature_exclusions(spark)
    manifest = V.feature_manifest(annotate_registry(
        market.feature_registry(spark), exclusions), exclusions)
    names = [n for n, kind, _, _ in _REG if kind != "target"]
    wide = M.unpack_features(t.features, names)
    seen = wide.agg(*[F.count(n).alias(n) for n in names]).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature_name"), C(n).alias("observed")) for n in names])))
    goals = t.labels.agg(F.count("y_1d_vol").alias("a"), F.count("y_5d_vol").alias("b"))
    goals = goals.select(F.inline(F.array(
        F.struct(F.lit("y_1d_vol").alias("feature_name"), C("a").alias("observed")),
        F.struct(F.lit("y_5d_vol").alias("feature_name"), C("b").alias("observed")))))
    return manifest.join(seen.unionByName(goals), "feature_name", "left")


# --- functions of the session -----------------------------------------------------------
def _with_functions(spark, sf):
    """The session's functions over the stored labels and documents."""
    t = tables(spark, sf)
    t.labels.createOrReplaceTempView("labels_daily")
    t.features.createOrReplaceTempView("features_daily")
    register_functions(spark)
    return spark


@query("functions_on_labels", "P14 P6 P7", f"""
SELECT symbol, date, {r('CASE WHEN vol_20 > 0 THEN y_1d_raw / vol_20 END', 6, 'scaled')},
  {r('CASE WHEN y_1d_vol IS NOT NULL THEN greatest(-3e0, least(3e0, y_1d_vol)) END', 6, 'bounded')},
  CASE WHEN y_1d_raw > 0 THEN 1 WHEN y_1d_raw <= 0 THEN -1 END AS direction, b.y_class_1d AS barrier
FROM lab JOIN (SELECT symbol, date, y_class_1d FROM lab3) b USING (symbol, date)
JOIN (SELECT symbol, date, vol_20 FROM feats) f USING (symbol, date)""")
def functions_on_labels(spark, sf):
    """Scalar functions called by SQL over the stored tables."""
    return round_frame(_with_functions(spark, sf).sql("""
        SELECT symbol, date, scaled_by_volatility(y_1d_raw, document_value(feature_json, 'vol_20')) AS scaled,
          clipped(y_1d_vol, -3, 3) AS bounded, direction_class(y_1d_raw) AS direction, barrier_class(y_1d_vol) AS barrier
        FROM labels_daily JOIN features_daily USING (symbol, date)"""))


@query("functions_as_checks", "K1 K7 K8", f"""
SELECT 'duplicates:labels' AS check_name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  n || ' duplicate (symbol, date) pairs' AS details
FROM (SELECT count(*) AS n FROM (SELECT symbol, date FROM lab GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'no_null_targets', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END,
  n || ' rows with NULL primary_target of ' || total || ' after warm-up'
FROM (SELECT count(*) - count(primary_target) AS n, count(*) AS total FROM lab
      WHERE date > (SELECT min(date) FROM lab) + {cfg.WARMUP_DAYS})
UNION ALL SELECT 'valid_class_values', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END,
  n || ' rows with invalid class values'
FROM (SELECT count(*) FILTER (WHERE y_class_1d NOT IN (-1, 0, 1)) AS n FROM lab3)""")
def functions_as_checks(spark, sf):
    """Table functions called by SQL."""
    return _with_functions(spark, sf).sql(f"""
        SELECT * FROM duplicate_label_keys() UNION ALL SELECT * FROM missing_targets({cfg.WARMUP_DAYS})
        UNION ALL SELECT * FROM invalid_classes()""")


@query("functions_on_documents", "M5 M3", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(*) - count({c}) AS nan_count, count(*) AS total_rows FROM feats"""
    for c in ("sma_200", "vol_60")))
def functions_on_documents(spark, sf):
    return _with_functions(spark, sf).sql(
        "SELECT * FROM feature_nulls('sma_200') UNION ALL SELECT * FROM feature_nulls('vol_60')")
