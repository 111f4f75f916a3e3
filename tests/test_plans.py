"""The shape of plans that must hold at scale."""

import datetime as dt
import re
from pathlib import Path

import pytest

import riskframe
from riskframe import session
from riskframe.operators import cross_section as xs
from riskframe.operators import rolling as rl
from riskframe.plans import catalogue
from riskframe.sources import domain as dom
from riskframe.sources import market

SOURCE = Path(riskframe.__file__).parent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text, key):
    return len(re.findall(rf"Exchange hashpartitioning\({key}#\d+, \d+\)", text))


def test_library_has_no_cross_joins_hints_or_driver_collects():
    for path in SOURCE.rglob("*.py"):
        code = path.read_text()
        for banned in ("crossJoin", "broadcast(", "localCheckpoint", ".rdd", "toPandas(", ".collect()"):
            assert banned not in code, f"{banned} in {path.name}"


def test_agent_features_share_one_exchange_on_symbol(spark, sf_dir):
    df = rl.agent_features(dom.daily_bars(spark, sf_dir), dom.market_benchmark(spark, sf_dir))
    assert exchanges(plan(df), "symbol") == 1


def test_feature_table_has_one_exchange_per_partitioning(spark, sf_dir):
    text = plan(xs.add_cross_ranks(rl.technical_features(dom.daily_bars(spark, sf_dir), dom.market_benchmark(spark, sf_dir))))
    assert exchanges(text, "symbol") == 1


def test_bars_use_hash_aggregation_and_push_the_date_down(spark, sf_dir):
    df = market.within(dom.daily_bars(spark, sf_dir), dt.date(2001, 11, 4), 90)
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "SortAggregate" not in text and "HashAggregate" in text
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "l_comment" not in text and "l_tax" not in text


@pytest.mark.parametrize(
    "name",
    ["qa1_correlation_matrix", "tx7_vector_top_k", "al6_recipient_digests", "prj3_min_max_normalise", "pf5_default_symbols", "bt8_all_strategies"],
)
def test_no_products_in_the_physical_plan(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = session.materialise(spark.range(5), "five")
    assert stored.count() == 5 and stored.inputFiles()[0].startswith(f"file://{session.shared_dir(spark)}")


def test_settings_follow_the_input_size():
    small, large = session.sized_conf(10 * 2**30, 8), session.sized_conf(100 * 2**40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 80
    assert int(large["spark.sql.shuffle.partitions"]) >= 400_000
