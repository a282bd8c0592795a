"""Sinks, merge semantics, ETL runs and model runs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalars import round_frame
from ..operators import datasets as V
from ..operators import models as MD
from ..operators import preparation as P
from ..operators.calendars import next_trading_day
from ..operators.feature_store import unpack_features
from ..operators.targets import barrier_classes
from ..plans import training as TR
from ..plans.etl import OUTCOMES, Store, run_daily, run_etl
from ..plans.staging import build_store, feeds
from ..session import scratch_path
from ..sources import files, keyed, market
from .base_sql import r, rs
from .context import INT, OUT
from .registry import query
from .scoring import predictions, split_sql
from .technical import DIGITS
from .views import PLACES, cols, tables

C = F.col
KEY = ["symbol", "date"]
SPLIT_DAY = "2000-01-03"


# --- merge semantics ---------------------------------------------------------------
def _old_new(spark, sf):
    """Stored rows and a later batch that overlaps them."""
    bars = market.daily_bars(spark, sf).select(*KEY, "close", "volume")
    return (bars.where(C("date") < "2000-07-03"),
            bars.where(C("date") >= SPLIT_DAY).withColumn("volume", C("volume") + 1))


@query("upserted_rows", "S8", f"""
SELECT symbol, date, {r('close', 6, 'close')},
  volume + CASE WHEN date >= DATE '{SPLIT_DAY}' THEN 1 ELSE 0 END AS volume FROM dbars""")
def upserted_rows(spark, sf):
    old, new = _old_new(spark, sf)
    return round_frame(keyed.upsert(old, new, KEY))


@query("inserted_or_ignored_rows", "S10", f"""
SELECT symbol, date, {r('close', 6, 'close')},
  volume + CASE WHEN date >= DATE '2000-07-03' THEN 1 ELSE 0 END AS volume FROM dbars""")
def inserted_or_ignored_rows(spark, sf):
    old, new = _old_new(spark, sf)
    return round_frame(keyed.insert_ignore(old, new, KEY))


@query("refreshed_rows", "S11", f"""
SELECT symbol, date, volume + CASE WHEN date >= DATE '{SPLIT_DAY}' THEN 1 ELSE 0 END AS volume,
  CASE WHEN date >= DATE '{SPLIT_DAY}' THEN DATE '2001-12-31' END AS stamped FROM dbars""")
def refreshed_rows(spark, sf):
    old, new = _old_new(spark, sf)
    old = old.drop("close").withColumn("stamped", F.lit(None).cast("date"))
    return keyed.upsert_refresh(old, new.drop("close"), KEY,
                                {"stamped": F.lit(date(2001, 12, 31))})


@query("partially_upserted_outcomes", "S9", f"""
SELECT symbol, date, volume, {r(f"CASE WHEN date >= DATE '{SPLIT_DAY}' THEN c1 ELSE 0 END", 6, 'outcome_price_1d')}
FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS c1 FROM dbars)""")
def partially_upserted_outcomes(spark, sf):
    """Later outcomes replace a stored 0; an unknown one replaces it by NULL."""
    from ..operators.backtest import forward_closes

    bars = market.daily_bars(spark, sf)
    old = bars.select(*KEY, "volume", F.lit(0.0).alias("outcome_price_1d"))
    new = forward_closes(bars).where(C("date") >= SPLIT_DAY).select(
        *KEY, C("close_1d").alias("outcome_price_1d"))
    return round_frame(keyed.upsert_columns(old, new, KEY, ["outcome_price_1d"]))


@query("cleared_table", "S12", f"""
SELECT symbol, date, {r('close', 6, 'close')}, CAST(NULL AS BIGINT) AS volume FROM dbars
WHERE date >= DATE '{SPLIT_DAY}'""")
def cleared_table(spark, sf):
    """Nothing of a cleared table is left: a later batch lacks what was stored."""
    old, new = _old_new(spark, sf)
    t = keyed.KeyedTable(spark, scratch_path(spark, "cleared"), KEY)
    t.merge(old)
    t.clear()
    t.merge(new.drop("volume"))
    return round_frame(t.read().select(*KEY, "close", "volume"))


@query("merged_columns", "S8", f"""
SELECT symbol, date, {r("CASE WHEN date >= DATE '" + SPLIT_DAY + "' THEN close + 2 ELSE close END", 6, 'close')},
  CASE WHEN date < DATE '2000-07-03' THEN volume END AS volume FROM dbars""")
def merged_columns(spark, sf):
    """A batch without a stored column, with every key twice: the later row wins."""
    old, new = _old_new(spark, sf)
    batch = new.drop("volume").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "close", C("close") + C("at"))
    t = keyed.KeyedTable(spark, scratch_path(spark, "merged"), KEY)
    t.merge(old)
    t.merge(keyed.newest_per_key(batch, KEY, "at").drop("at"))
    return round_frame(t.read().select(*KEY, "close", "volume"))


@query("pruned_events", "S13", """
SELECT date, event_type, event_name, source FROM evfull
WHERE event_type NOT IN ('month_end', 'quarter_end', 'options_expiry_week')""")
def pruned_events(spark, sf):
    return keyed.delete_where(tables(spark, sf).events,
                              C("event_type").isin(cfg.CALENDAR_EVENTS)).select(
        "date", "event_type", "event_name", "source")


@query("keyed_table_merge", "S8 S9 S5", f"""
SELECT symbol, date, {r('close', 6, 'close')},
  volume + CASE WHEN date >= DATE '{SPLIT_DAY}' THEN 1 ELSE 0 END AS volume FROM dbars""")
def keyed_table_merge(spark, sf):
    """The stored form: first load, overlapping batch, the same batch again."""
    old, new = _old_new(spark, sf)
    t = keyed.KeyedTable(spark, scratch_path(spark, "bars"), KEY)
    for batch in (old, new, new):
        t.merge(batch)
    return round_frame(t.read())


# --- files -----------------------------------------------------------------------------
@query("dataset_csv_round_trip", "S4 S7", f"""
SELECT l.symbol, l.date, l.y_class_1d, {cols(cfg.MODEL_FEATURES, 'd.')}
FROM lab l JOIN dataset d USING (symbol, date) WHERE l.y_class_1d IS NOT NULL""")
def dataset_csv_round_trip(spark, sf):
    path = scratch_path(spark, "dataset-csv")
    files.write_csv(V.wide_export(tables(spark, sf)), path)
    return round_frame(files.read_dataset_csv(spark, path), PLACES)


@query("dataset_parquet_round_trip", "S5", f"""
SELECT symbol, date, {rs(['open', 'high', 'low', 'close', 'adj_close'])}, volume FROM dbars""")
def dataset_parquet_round_trip(spark, sf):
    path = scratch_path(spark, "bars-parquet")
    files.write_parquet(market.daily_bars(spark, sf), path)
    return round_frame(files.read_bars(spark, path))


# --- ETL runs ---------------------------------------------------------------------------
_BORDERS = (date(2001, 3, 14), date(2001, 6, 13))
_LABELS = ["outcome_price_1d", "outcome_price_5d", "y_1d_raw", "y_5d_raw", "y_1d_vol", "y_5d_vol",
           "y_1d_clipped", "y_5d_clipped", "y_1d_vol_clip", "y_5d_vol_clip"]
_CLASSES = ["y_class_1d", "y_class_5d", "y_1d", "y_5d", "y_thresh"]
_RUNS: dict[tuple[str, str], str] = {}


def _incremental(spark, sf) -> Store:
    """A backfill to mid-month, then one run after the other up to the last day."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _RUNS:
        return Store(spark, _RUNS[key])
    store = Store(spark, scratch_path(spark, "incremental"))
    source = feeds(spark, sf)
    first, last = source.calendar.agg(F.min("date"), F.max("date")).first()
    for i, end in enumerate([*_BORDERS, last]):
        run_etl(spark, store, source, end=end, start=None if i else first)
    if run_etl(spark, store, source, end=last) is not None:
        raise RuntimeError("a repeated run must find nothing to do")
    _RUNS[key] = store.root
    return store


@query("incremental_run", "F3 F4 Q13", f"""
SELECT symbol, date, {rs(OUT, 4)}, {', '.join(INT)} FROM feats""")
def incremental_run(spark, sf):
    """Features that runs after a mid-month backfill leave: those of one full build."""
    store = _incremental(spark, sf)
    return round_frame(unpack_features(store.features.read(), [*OUT, *INT]).select(
        *KEY, *OUT, *[C(c).cast("int").alias(c) for c in INT]), 4)


@query("incremental_labels", "F3 S9 L1-L9", f"""
SELECT symbol, date, {rs(_LABELS)}, {', '.join(_CLASSES)},
  {r('outcome_price_1d', 6, 'bar_outcome_1d')}, {r('outcome_price_5d', 6, 'bar_outcome_5d')} FROM lab""")
def incremental_labels(spark, sf):
    """Labels and outcomes after the same runs: late ones have been filled in."""
    store = _incremental(spark, sf)
    labels = store.labels.read()
    bars = store.bars.read().select(*KEY, *OUTCOMES)
    return round_frame(labels.join(bars, KEY).select(
        *KEY, *[C(c) for c in _LABELS if c not in OUTCOMES], *_CLASSES, *OUTCOMES,
        C("outcome_price_1d").alias("bar_outcome_1d"), C("outcome_price_5d").alias("bar_outcome_5d")))


@query("incremental_macro", "F3 A3", f"""
SELECT series_key, date, {r('value', 10, 'value')}, days_since_update FROM mdaily""")
def incremental_macro(spark, sf):
    return round_frame(_incremental(spark, sf).macro.read(), 10)


@query("incremental_events", "F3 E3 E4 E5", """
SELECT date, event_type, event_name, source FROM evfull""")
def incremental_events(spark, sf):
    return _incremental(spark, sf).events.read().select("date", "event_type", "event_name", "source")


@query("incremental_bars", "F3 S8", f"""
SELECT symbol, date, {rs(['open', 'high', 'low', 'close', 'adj_close'])}, volume FROM dbars""")
def incremental_bars(spark, sf):
    return round_frame(_incremental(spark, sf).bars.read().select(
        *KEY, "open", "high", "low", "close", "adj_close", "volume"))


@query("daily_run_outcomes", "F5 C11", f"""
SELECT * FROM (VALUES ('weekend'), ('forced'), ('trained'), ('untrained')) v(run)
CROSS JOIN (SELECT symbol, max(date) AS date FROM bars GROUP BY symbol) b
WHERE run <> 'weekend'""".replace("SELECT * FROM (VALUES", """SELECT run, symbol, date,
  CASE run WHEN 'trained' THEN 'rule' ELSE 'placeholder_xgb' END AS model_name,
  CASE run WHEN 'trained' THEN 'predicted' ELSE 'placeholder' END AS outcome FROM (VALUES"""))
def daily_run_outcomes(spark, sf):
    """Daily runs over copies of the stored tables, and what each leaves to predict with.

    A weekend run does nothing; a forced one and one without model leave
    placeholders; one with a model leaves that model's predictions.
    """
    source = feeds(spark, sf)
    weekday = source.calendar.agg(F.max("date")).first()[0]
    saturday = weekday + timedelta(days=5 - weekday.weekday())
    shared = _incremental(spark, sf)
    latest = shared.features.read().groupBy("symbol").agg(F.max("date").alias("date"))

    def rows(name: str, up: float):
        return latest.select(
            *KEY, F.lit("1d").alias("horizon"), F.lit(name).alias("model_name"),
            F.lit("production").alias("split"), F.lit(up).alias("p_up"))

    def untrained(_: Store):
        raise LookupError("no trained model")

    runs = {"weekend": (saturday, False, untrained), "forced": (saturday, True, untrained),
            "trained": (weekday, False, lambda _: rows("rule", 0.9)), "untrained": (weekday, False, untrained)}
    out = None
    for name, (day, force, predict) in runs.items():
        store = Store(spark, shared.root)
        store.predictions = keyed.KeyedTable(spark, scratch_path(spark, "predictions"), store.predictions.keys)
        outcome = run_daily(spark, store, source, day, predict, lambda _: rows("placeholder_xgb", 0.55), force)
        if not store.predictions.exists():
            continue
        left = store.predictions.read().select(
            F.lit(name).alias("run"), *KEY, "model_name", F.lit(outcome).alias("outcome"))
        out = left if out is None else out.unionByName(left)
    return out


@query("backfill_run", "F2", """
SELECT 'bars' AS name, count(*) AS n FROM dbars UNION ALL SELECT 'macro', count(*) FROM mdaily
UNION ALL SELECT 'features', count(*) FROM feats UNION ALL SELECT 'labels', count(*) FROM lab
UNION ALL SELECT 'events', count(*) FROM evfull""")
def backfill_run(spark, sf):
    store = build_store(spark, sf)
    out = None
    for name in ("bars", "macro", "features", "labels", "events"):
        row = getattr(store, name).read().agg(F.count("*").alias("n")).select(
            F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- model runs ---------------------------------------------------------------------------
def _fit(spark, sf, name, **overrides):
    data = V.classification_dataset(tables(spark, sf))
    parts = P.with_split(data, cfg.FIXTURE_SPLITS)
    model = MD.train(parts.where("split = 'train'"), P.feature_columns(data),
                     "y_class_1d", name, **overrides)
    return model, parts


def _probabilities(name):
    def run(spark, sf):
        model, parts = _fit(spark, sf, name, **_FEWER.get(name, {}))
        return round_frame(TR.score_rows(model, parts.where("split <> 'train'"), "1d"))
    return run


for _name, _ids in (("logistic_regression", "T1"), ("random_forest", "T2"),
                    ("lightgbm", "T3"), ("xgboost", "T4")):
    query(f"{_name}_probabilities", _ids)(_probabilities(_name))


@query("saved_model_round_trip", "T5")
def saved_model_round_trip(spark, sf):
    """Probabilities of a model that was stored and loaded again."""
    model, parts = _fit(spark, sf, "logistic_regression")
    path = scratch_path(spark, "model")
    model.save(path, {"target": model.target})
    loaded = MD.TrainedModel.load(spark, path)
    return round_frame(TR.score_rows(loaded, parts.where("split = 'test'"), "1d"))


@query("saved_model_equality", "T1 T5", f"""
SELECT {split_sql()} AS split, count(*) AS rows, count(*) AS equal_scores, count(*) AS sums_to_one
FROM dataset JOIN lab USING (symbol, date) WHERE y_class_1d IS NOT NULL AND split IS NOT NULL GROUP BY 1""")
def saved_model_equality(spark, sf):
    """Rows whose scores a stored and reloaded model repeats, and add up to one."""
    model, parts = _fit(spark, sf, "logistic_regression")
    path = scratch_path(spark, "model")
    model.save(path, {"target": model.target})
    loaded = MD.TrainedModel.load(spark, path)
    known = parts.where("split IS NOT NULL")
    both = model.probabilities(known).select(*KEY, "split", "p_down", "p_up").join(
        loaded.probabilities(known).select(*KEY, C("p_down").alias("d"), C("p_up").alias("u")), KEY)
    return both.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if((C("p_down") == C("d")) & (C("p_up") == C("u"))).alias("equal_scores"),
        F.count_if(F.abs(C("p_down") + C("p_up") - 1) < 1e-9).alias("sums_to_one"))


@query("three_class_boosting", "T3 T4", f"""
SELECT m.name AS model_name, {split_sql()} AS split, count(*) AS rows, count(*) AS valid
FROM dataset JOIN lab3 USING (symbol, date), (VALUES ('lightgbm'), ('xgboost')) AS m(name)
WHERE y_class_1d IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2""")
def three_class_boosting(spark, sf):
    """Boosted trees over sell, hold and buy: every row gets three shares of one."""
    t = tables(spark, sf)
    barrier = barrier_classes(t.labels).select(*KEY, C("y_class_1d").alias("barrier"))
    data = V.classification_dataset(t).join(barrier, KEY).withColumn("y_class_1d", C("barrier")).drop("barrier")
    parts = P.with_split(data, cfg.FIXTURE_SPLITS).where("split IS NOT NULL AND y_class_1d IS NOT NULL")
    out = None
    for name in ("lightgbm", "xgboost"):
        model = MD.train(parts.where("split = 'train'"), P.feature_columns(data), "y_class_1d", name,
                         classes=(-1, 0, 1), trees=5)
        p = model.probabilities(parts).select("split", "p_down", "p_hold", "p_up")
        low, total = F.least("p_down", "p_hold", "p_up"), C("p_down") + C("p_hold") + C("p_up")
        counts = p.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(
            (low >= 0) & (F.abs(total - 1) < 1e-9)).alias("valid")).select(
            F.lit(name).alias("model_name"), "split", "rows", "valid")
        out = counts if out is None else out.unionByName(counts)
    return out


#: Trees of the boosted entries that are fitted alone; the registry's runs grow the configured number.
_TREES = 25
_FEWER = {"lightgbm": {"trees": _TREES}, "xgboost": {"trees": _TREES}}
_REGISTRY_RUNS: dict[tuple[str, str], str] = {}


def _registry_run(spark, sf):
    """Every model on every horizon of the registry, its predictions stored once a session."""
    key = (spark.sparkContext.applicationId, sf)
    fresh = key not in _REGISTRY_RUNS
    path = scratch_path(spark, "registry") if fresh else _REGISTRY_RUNS[key]
    table = keyed.KeyedTable(spark, path, ["symbol", "date", "horizon", "model_name", "split"])
    if fresh:
        t = tables(spark, sf)
        TR.run_registry({"1d": V.classification_dataset(t), "5d": V.classification_dataset(t, 5)},
                        splits=cfg.FIXTURE_SPLITS, table=table)
        _REGISTRY_RUNS[key] = path
    return table.read()


@query("classification_run", "F6 T10 C1 C8 C9")
def classification_run(spark, sf):
    """Train, calibrate, decide, store and evaluate all models of the registry on both horizons."""
    from ..operators import evaluation as E
    from ..operators import reports as R

    stored = _registry_run(spark, sf)
    return round_frame(R.summary_by_horizon(E.gate_metrics(E.confusion_counts(stored, TR.BY), TR.BY)))


@query("registry_metrics", "T10 F6 T6 C8", f"""
SELECT h.horizon, m.model_name, h.split, h.rows, h.rows AS sums_to_one, true AS equal_metrics
FROM ({' UNION ALL '.join(f"""
  SELECT '{h}d' AS horizon, {split_sql()} AS split, count(*) AS rows FROM dataset JOIN lab USING (symbol, date)
  WHERE y_class_{h}d IS NOT NULL GROUP BY 2""" for h in (1, 5))}) h,
  (VALUES ('random_forest'), ('lightgbm'), ('xgboost')) AS m(model_name) WHERE h.split IN ('val', 'test')""")
def registry_metrics(spark, sf):
    """Metrics of the stored predictions, as operators and as plain SQL state them."""
    from ..operators import evaluation as E

    stored = _registry_run(spark, sf)
    own = E.gate_metrics(E.confusion_counts(stored, TR.BY), TR.BY)
    f1 = "coalesce(2 * sum(int(y_true = {k} AND pred_class_final = {k})) / nullif(sum(int(y_true = {k})) " \
         "+ sum(int(pred_class_final = {k})), 0), 0)"
    plain = spark.sql(f"""
      SELECT horizon, model_name, split, count(*) AS rows,
        count_if(abs(p_down + p_up - 1) < 1e-9 AND least(p_down, p_up) >= 0) AS sums_to_one,
        avg(int(y_true = pred_class_final)) AS a, ({f1.format(k=-1)} + {f1.format(k=1)}) / 2 AS f
      FROM {{stored}} WHERE y_true IS NOT NULL GROUP BY horizon, model_name, split""", stored=stored)
    return plain.join(own, TR.BY).select(
        *TR.BY, "rows", "sums_to_one",
        ((F.abs(C("a") - C("accuracy")) < 1e-9) & (F.abs(C("f") - C("f1_macro")) < 1e-9)).alias("equal_metrics"))


@query("next_day_predictions", "C10")
def next_day_predictions(spark, sf):
    """Newest features that a trading day follows, scored for that day."""
    model, parts = _fit(spark, sf, "logistic_regression")
    following = next_trading_day(market.trading_calendar(spark, sf)).where("next_date IS NOT NULL")
    known = parts.drop("split", "y_class_1d").join(following.select("date"), "date", "left_semi")
    return round_frame(TR.next_day_predictions(
        model, known, following, predictions(spark, sf), "1d"))
