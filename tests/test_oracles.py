"""A cross-section of the registered queries against their SQL oracles."""

import pytest
from conftest import SF
from oracle_check import compare, duck

import __spark_entry__ as entry
from tidemark.queries.catalog import INVENTORY, QUERIES

NAMES = """technical_features on_balance_volume wide_universe_returns normalised_features
gap_limited_fill macro_features credit_vs_equity relative_strength_ratios
options_expiry_weeks regime_flags complete_labels_only full_feature_build
clipped_documents classification_dataset_1d model_dataset_with_events classification_stats
class_report tuned_thresholds backtest placeholder_predictions class_weights
check_null_pattern distribution_profile feature_manifest keyed_table_merge
merged_columns cleared_table averages_over_gaps incremental_run incremental_labels
incremental_macro incremental_events incremental_bars daily_run_outcomes
recommendations three_class_boosting saved_model_equality lag_leakage_check lagged_features
functions_on_labels functions_as_checks functions_on_documents
check_feature_count check_label_shift classification_quality_report regression_quality_report""".split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) == set(INVENTORY)
