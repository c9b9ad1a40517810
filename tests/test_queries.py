"""A cross-section of registered queries against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "tick_bars_minute", "indicators_live", "labels_time_offsets", "asof_nearest_with_tolerance", "news_window_means", "evaluation_overall",
    "ridge_fit", "walk_forward_expanding", "risk_screening", "pnl_allocated_alpha", "candle_feed_issues", "text_student_predictions",
    "derivative_payload_events", "stream_tumbling_bars", "fold_estimator_scores", "simulated_returns_by_regime", "path_labels", "pnl_component_totals",
    "experience_horizon_rewards", "schema_default_fill", "ensemble_decisions", "saturation_curve",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 150


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
