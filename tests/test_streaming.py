import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.streaming import live, sinks
from riskframe.streaming.refresh import run_steps

T0 = dt.datetime(2024, 1, 1)


class Feed:
    """Writes event files and streams them one file per micro-batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, *events):
        rows = [(i, t, int(u), "view", float(v), "{}") for i, t, u, v in events]
        df = self.spark.createDataFrame(rows, live.EVENTS).coalesce(1)
        self.n += 1
        df.write.mode("append").parquet(self.path)
        return self

    def stream(self):
        return live.event_stream(self.spark, self.path, per_trigger=1)


@pytest.fixture()
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "events")


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_late_rows_are_dropped_beyond_the_watermark(feed, tmp_path):
    feed.add((1, at(1), 7, 10), (2, at(30), 7, 20))
    ticks = feed.stream().withColumn("symbol", F.col("user_id").cast("string"))
    run = lambda: sinks.drain_to_files(live.daily_bars(ticks, "6 hours"), str(tmp_path / "bars"), str(tmp_path / "ckpt"))
    first = run().collect()
    assert [(r["date"], r["open"], r["volume"]) for r in first] == [(T0.date(), 10.0, 1)]
    # after the restart: one row late by a day is dropped, one late within the watermark counts
    feed.add((3, at(2), 7, 99), (4, at(26), 7, 5), (5, at(60), 7, 30))
    rows = {r["date"]: (r["open"], r["low"], r["close"], r["volume"]) for r in run().collect()}
    assert rows == {T0.date(): (10.0, 10.0, 10.0, 1), (T0 + dt.timedelta(days=1)).date(): (5.0, 5.0, 20.0, 2)}


def test_restart_processes_nothing_twice(feed, tmp_path):
    feed.add((1, at(1), 1, 90), (2, at(2), 2, 10))
    run = lambda: sinks.drain_to_files(
        live.high_risk(live.score_updates(feed.stream())), str(tmp_path / "out"), str(tmp_path / "ckpt")
    ).count()
    assert run() == 1
    assert run() == 1
    feed.add((3, at(3), 1, 80))
    assert run() == 2


def test_spike_state_matches_brute_force(feed, tmp_path):
    scores = {1: [10, 12, 40, 41, 20, 60], 2: [50, 50, 50, 50, 50, 50]}
    events, i = [], 0
    for day in range(6):
        for user, values in scores.items():
            i += 1
            events.append((i, at(24 * day + 3), user, values[day]))
    events.append((99, at(24 * 7), 3, 1))
    for cut in range(0, len(events), 4):
        feed.add(*events[cut : cut + 4])
    daily = live.daily_scores(live.score_updates(feed.stream()))
    got = {
        (r["symbol"], (r["date"] - T0.date()).days): r["prev_risk_score"]
        for r in sinks.drain_to_files(live.spike_alerts(daily, days=3), str(tmp_path / "a"), str(tmp_path / "c")).collect()
    }
    want = {}
    for user, values in scores.items():
        v = [x / 100 for x in values]
        for day in range(1, 6):
            past = v[max(0, day - 3) : day]
            mean = sum(past) / len(past)
            if v[day] - mean > 0.15 or (v[day] - mean) / mean * 100 > 20:
                want[(str(user), day)] = pytest.approx(mean)
    assert got == want and len(want) >= 3


def held_scores(spark, checkpoint):
    """Symbols and days in the state of the spike alerts (the second operator, upstream of the sink, has number 0)."""
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "scores").load(checkpoint)
    return sorted((r["key"]["symbol"], r["user_map_key"]["day"]) for r in state.collect())


def test_state_of_a_silent_symbol_expires(spark, feed, tmp_path):
    day0 = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() // 86_400)
    checkpoint = str(tmp_path / "c")
    feed.add((1, at(1), 1, 10), (2, at(25), 1, 11)).add((3, at(24 * 3 + 2), 2, 1))
    daily = live.daily_scores(live.score_updates(feed.stream()))

    def run():
        sinks.drain_to_files(live.spike_alerts(daily, days=3), str(tmp_path / "a"), checkpoint)
        return held_scores(spark, checkpoint)

    assert run() == [("1", day0), ("1", day0 + 1)]
    feed.add((4, at(24 * 5 + 2), 2, 1))  # day 4 is over: the last score of symbol 1, of day 1, has had its three days
    assert run() == [("2", day0 + 3)]
    feed.add((5, at(24 * 5 + 3), 1, 90), (6, at(24 * 6 + 2), 2, 1))  # a return starts without a baseline
    assert [s for s, _ in run()] == ["1", "2", "2"]
    assert sinks.drain_to_files(live.spike_alerts(daily, days=3), str(tmp_path / "a"), checkpoint).count() == 0


def test_duplicate_urls_across_batches(feed, tmp_path):
    feed.add((1, at(1), 1, 1), (2, at(1), 2, 1)).add((3, at(2), 1, 1), (4, at(2), 3, 1))
    articles = feed.stream().withColumn("url", F.col("user_id").cast("string"))
    out = sinks.drain_to_files(live.new_urls(articles, "1 day"), str(tmp_path / "u"), str(tmp_path / "c"))
    assert sorted(r["url"] for r in out.collect()) == ["1", "2", "3"]


def test_upsert_sink_is_idempotent_and_compacts(spark, feed, tmp_path):
    feed.add((1, at(1), 1, 10), (2, at(2), 1, 20)).add((3, at(1.5), 1, 99), (4, at(1), 2, 30))
    stream = live.score_updates(feed.stream())
    sink = sinks.upsert_sink(str(tmp_path / "log"), ["symbol"], ["ts", "event_id"])
    seen = []

    def twice(batch, batch_id):
        seen.append(batch_id)
        sink(batch, batch_id)
        sink(batch, batch_id)  # a replayed batch

    sinks.drain_batches(stream, twice, checkpoint=str(tmp_path / "c"))
    assert len(seen) == 2
    read = lambda path: {
        r["symbol"]: r["event_id"]
        for r in sinks.read_upserted(spark, str(path), stream.schema, ["symbol"], ["ts", "event_id"]).collect()
    }
    assert read(tmp_path / "log") == {"1": 2, "2": 4}
    sinks.compact(spark, str(tmp_path / "log"), stream.schema, ["symbol"], ["ts", "event_id"], str(tmp_path / "new"))
    assert read(tmp_path / "new") == {"1": 2, "2": 4}


def test_change_feed_across_batches(spark, feed, tmp_path):
    feed.add((1, at(1), 1, 10), (2, at(2), 1, 20), (3, at(2), 2, 5)).add((4, at(3), 1, 40), (5, at(28), 1, 50))
    stream = live.score_updates(feed.stream())
    sink = sinks.change_feed_sink(str(tmp_path / "feed"), str(tmp_path / "state"), stream.schema)
    sinks.drain_batches(stream, sink, checkpoint=str(tmp_path / "c"))
    got = {r["event_id"]: r["prev_score"] for r in spark.read.parquet(str(tmp_path / "feed")).collect()}
    assert got == {1: None, 2: 0.1, 3: None, 4: 0.2, 5: 0.4}


def test_change_feed_reads_snapshots(spark, feed, tmp_path):
    for i in range(7):
        feed.add((i + 1, at(i), 1 + i % 2, 10 * (i + 1)))
    stream = live.score_updates(feed.stream())
    sink = sinks.change_feed_sink(str(tmp_path / "feed"), str(tmp_path / "state"), stream.schema, every=2)
    sinks.drain_batches(stream, sink, checkpoint=str(tmp_path / "c"))
    got = {r["event_id"]: r["prev_score"] for r in spark.read.parquet(str(tmp_path / "feed")).collect()}
    assert got == {1: None, 2: None, 3: 0.1, 4: 0.2, 5: 0.3, 6: 0.4, 7: 0.5}
    assert sinks.earlier_state(0, 2) == [] and sinks.earlier_state(4, 2) == [2, 3] and sinks.earlier_state(5, 2) == [4]


def test_dedup_against_the_store(spark, feed, tmp_path):
    feed.add((1, at(1), 1, 1), (2, at(1), 1, 1)).add((3, at(2), 1, 1), (4, at(900), 2, 1)).add((5, at(2000), 2, 1))
    stream = feed.stream().select("event_id", F.col("user_id").cast("string").alias("url"))
    sinks.drain_batches(
        stream, sinks.dedup_sink(str(tmp_path / "u"), stream.schema, "url", ["event_id"]), checkpoint=str(tmp_path / "c")
    )
    assert {(r["url"], r["event_id"]) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {("1", 1), ("2", 4)}


def test_interval_statistics_and_breach(feed, tmp_path):
    feed.add(*[(i, T0 + dt.timedelta(seconds=i), i, 90 if i < 12 else 10) for i in range(40)], (99, at(1), 1, 1))
    stats = live.periodic_stats(live.score_updates(feed.stream()))
    rows = sinks.drain_to_files(stats, str(tmp_path / "s"), str(tmp_path / "c")).orderBy("start").collect()
    assert [(r["updates"], r["high_risk"]) for r in rows] == [(30, 12), (10, 0)]
    assert live.universe_breach(feed.spark.createDataFrame([(11,), (10,)], "high_risk bigint")).count() == 1


def test_rolling_history_counts_each_event_once_per_span(feed, tmp_path):
    feed.add((1, at(1), 1, 10), (2, at(25), 1, 30), (3, at(24 * 9), 2, 1))
    out = live.rolling_history(live.score_updates(feed.stream()), days=3)
    rows = sinks.drain_to_files(out, str(tmp_path / "h"), str(tmp_path / "c")).where("symbol = '1'").toPandas()
    by_end = {(e - T0.date()).days: (n, m) for e, n, m in zip(rows["end"], rows["updates"], rows["mean_score"])}
    assert by_end == {1: (1, 0.1), 2: (2, 0.2), 3: (2, 0.2), 4: (1, 0.3)}


def test_failed_step_does_not_stop_the_refresh(spark):
    def broken():
        raise ValueError("no feed")

    report = run_steps(spark, [("bars", lambda: spark.range(3)), ("news", broken), ("scores", lambda: None)]).toPandas()
    assert report["ok"].tolist() == [True, False, True] and report["rows"].tolist() == [3, 0, 0]
    assert report["error"][1] == "ValueError: no feed"
    assert isinstance(report, pd.DataFrame)
