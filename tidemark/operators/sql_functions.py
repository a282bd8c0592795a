"""Validation helpers as SQL functions of a session, next to the registered views.

Bodies are SQL, so Catalyst inlines them into the calling query: a call costs what
the expression or the subquery costs, and filters are pushed through it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import config as cfg

_CHECK = "TABLE (check_name STRING, status STRING, details STRING)"
_VERDICT = "CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END"

FUNCTIONS = {
    # name: (parameters, result, body)
    "scaled_by_volatility": ("ret DOUBLE, vol DOUBLE", "DOUBLE", "CASE WHEN vol > 0 THEN ret / vol END"),
    "clipped": ("value DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE",
                "CASE WHEN value IS NOT NULL THEN greatest(low, least(high, value)) END"),
    "direction_class": ("ret DOUBLE", "INT", "CASE WHEN ret > 0 THEN 1 WHEN ret <= 0 THEN -1 END"),
    "barrier_class": ("scaled DOUBLE", "INT",
                      f"CASE WHEN scaled > {cfg.BARRIER} THEN 1 WHEN scaled < -{cfg.BARRIER} THEN -1"
                      " WHEN scaled IS NOT NULL THEN 0 END"),
    "document_value": ("document STRING, key STRING", "DOUBLE",
                       "try_element_at(from_json(document, 'map<string,double>'), key)"),
    "duplicate_label_keys": ("", _CHECK, f"""
        SELECT 'duplicates:labels', {_VERDICT}, concat(n, ' duplicate (symbol, date) pairs')
        FROM (SELECT count(*) AS n FROM (SELECT symbol, date FROM labels_daily GROUP BY symbol, date
                                         HAVING count(*) > 1))"""),
    "missing_targets": ("warm_up INT", _CHECK, f"""
        SELECT 'no_null_targets', {_VERDICT}, concat(n, ' rows with NULL primary_target of ', total, ' after warm-up')
        FROM (SELECT count(*) - count(primary_target) AS n, count(*) AS total FROM labels_daily
              WHERE date > date_add((SELECT min(date) FROM labels_daily), warm_up))"""),
    "invalid_classes": ("", _CHECK, f"""
        SELECT 'valid_class_values', {_VERDICT}, concat(n, ' rows with invalid class values')
        FROM (SELECT count_if(barrier_class(y_1d_vol) NOT IN (-1, 0, 1)) AS n FROM labels_daily)"""),
    # an argument may only stand in a condition; packed documents hold every key
    "feature_nulls": ("key STRING", "TABLE (feature STRING, nan_count BIGINT, total_rows BIGINT)", """
        SELECT k, count(*) - count(v), count(*)
        FROM (SELECT explode(from_json(feature_json, 'map<string,double>')) AS (k, v) FROM features_daily)
        WHERE k = key GROUP BY k"""),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Creates all functions in the session; those over tables read ``labels_daily`` and ``features_daily``."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
