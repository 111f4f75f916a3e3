"""Catalogue queries against their SQL on DuckDB, at the smallest scale.

``RISKFRAME_ALL=1`` compares every query; by default a spread of families.
``python -m tests.oracle`` compares all of them at sf0.01.
"""

import os

import pytest

import __spark_entry__ as entry
from riskframe.plans import catalogue
from tests import oracle

ALL = os.environ.get("RISKFRAME_ALL") == "1"
CHOSEN = [
    "flagship_top_volatility", "src2_csv_round_trip", "src3_src4_keyed_json", "src7_normalise_wide_bars", "src8_weekly_bars",
    "src9_partition_overwrite", "src10_upsert_bars", "src11_upsert_scores", "src16_refresh_dimension", "src17_export_scores",
    "flt2_symbol_list", "flt10_minimum_history", "prj3_min_max_normalise", "prj4_prj5_weighted_score", "prj8_stock_comparison",
    "jn2_latest_row", "jn7_aligned_dates", "jn12_enriched_holdings", "jn15_entity_profile", "jn16_benchmark_fallback",
    "ag1_overview_stats", "ag7_return_statistics", "ag8_describe", "ag10_alert_counts", "ag18_quantile_per_date", "ag19_histogram",
    "wn6_window_max_drawdown", "wn8_lagged_beta", "wn14_macd", "wn22_cross_sectional_rank", "wn24_market_regime",
    "wn31_drawdown_episodes", "wn36_sentiment_trend", "wn37_sliding_tensor", "tk5_table_orders", "tk6_best_worst_days",
    "st2_dedup_by_url", "sf4_ticker_extraction", "sf15_forecast_calendar", "sf23_follow_ups", "qa1_correlation_matrix",
    "qa5_historical_var", "qa9_monte_carlo", "qa12_best_portfolios", "bt8_all_strategies", "pf1_holdings",
    "pf2_rejected_transactions", "al3_combined_alerts", "al6_recipient_digests", "tx1_article_extraction", "tx4_headline_content_blend",
    "tx6_fixed_chunks", "tx7_vector_top_k", "tx10_question_context", "tx11_conversation_tail", "ml18_garch_forecasts",
    "sm1_periodic_stats", "sm3_spike_alerts", "sm6_rolling_history", "sm9_score_changes", "ud6_strategy_plug_in",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(fn) for fn in entry.queries().values())
    assert len(entry.oracle_sql()) / len(entry.queries()) > 0.9


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES] if ALL else CHOSEN)
def test_matches_sql(spark, con, sf_dir, name):
    problems, rows = oracle.compare(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])
    assert not problems, problems


@pytest.mark.parametrize("name", ["ud7_separator_chunks"])
def test_queries_without_sql_run(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
