"""Time the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_RUNS`` (default 3, the median is reported),
``BENCH_QUERIES`` (comma separated names, ``all`` for the whole catalogue),
``BENCH_SHARED_DIR`` (the folder for written steps, a new one by default) and
``BENCH_RETRAIN`` (0 leaves out the full retrain, whose seconds are reported beside the queries).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from riskframe.operators import boosting
from riskframe.operators.cross_section import FEATURES
from riskframe.plans import catalogue, q_ml
from riskframe.session import build_session

HEADLINE = [
    "flagship_top_volatility",
    "src8_weekly_bars",
    "wn4_rolling_volatility",
    "wn6_window_max_drawdown",
    "wn14_macd",
    "wn22_cross_sectional_rank",
    "wn31_drawdown_episodes",
    "ml1_feature_table",
    "ag8_describe",
    "ag18_quantile_global",
    "qa1_correlation_matrix",
    "qa5_historical_var",
    "qa9_monte_carlo",
    "qa11_random_portfolios",
    "bt8_all_strategies",
    "pf1_holdings",
    "al3_combined_alerts",
    "src10_upsert_bars",
    "tx1_article_extraction",
    "tx4_headline_content_blend",
    "tx6_fixed_chunks",
    "tx7_vector_top_k",
    "ml18_garch_forecasts",
    "sm5_tick_to_bar",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalogue.QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-")
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=cpus, **{"spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    # start the executors and the code generator before the first measurement
    catalogue.QUERIES["src8_weekly_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        spent = []
        for _ in range(runs):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(spent), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    retrain = None
    if os.environ.get("BENCH_RETRAIN", "1") != "0" and not chosen:
        rows = q_ml.stored(spark, sf_dir)
        start = time.perf_counter()
        boosting.fit(rows, FEATURES)
        retrain = {"rows": rows.count(), "rounds": boosting.Parameters().rounds, "sec": round(time.perf_counter() - start, 3)}
        print(f"retrain {retrain}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, sum of medians",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "retrain": retrain,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
