"""Structured Streaming forms of the live features.

Transformations take and return streaming (or batch) frames of score updates
(event_id, symbol, ts, risk_score, risk_level). Keys are reduced before any
per-key state: stateful operators see at most one row per symbol and interval,
so a symbol with a large share of the events does not tie up its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskframe.functions.numeric import risk_level
from riskframe.operators.alerts import SPIKE_ABSOLUTE, SPIKE_PERCENT

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, path: str, files: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Event files as a stream; event time becomes a zoned timestamp, as watermarks require."""
    return (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(path)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def score_updates(events: DataFrame) -> DataFrame:
    score = F.least(F.col("value") / 100, F.lit(1.0))
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("symbol"),
        "ts",
        score.alias("risk_score"),
        risk_level(score).alias("risk_level"),
    )


# ---- interval statistics --------------------------------------------------------------


def periodic_stats(updates: DataFrame, every: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Updates and high-risk updates per interval."""
    return (
        updates.withWatermark("ts", late)
        .groupBy(F.window("ts", every))
        .agg(
            F.count(F.lit(1)).alias("updates"),
            F.count_if(F.col("risk_score") > 0.6).alias("high_risk"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "updates", "high_risk")
    )


def universe_breach(stats: DataFrame, limit: int = 10) -> DataFrame:
    """Intervals with more than ``limit`` high-risk updates."""
    return stats.where(F.col("high_risk") > limit)


def subscribed(updates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Updates of symbols that anyone follows."""
    return updates.join(subscriptions.select("symbol").distinct(), "symbol", "left_semi")


def high_risk(updates: DataFrame) -> DataFrame:
    return updates.where(F.col("risk_level") == "High").withColumns(
        {"alert_type": F.lit("high_risk"), "severity": F.lit("HIGH")}
    )


def daily_bars(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Daily bars from ticks (symbol, ts, event_id, value); later rows than ``late`` are dropped."""
    first = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", "1 day"))
        .agg(
            F.min_by("value", first).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", first).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("symbol", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")
    )


def rolling_history(updates: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """Mean score and count per symbol over the last ``days`` days, sliding by one day.

    Days are summed first, so an event enters one daily sum instead of ``days``
    sliding windows.
    """
    daily = (
        updates.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", "1 day"))
        .agg(F.sum("risk_score").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    return (
        daily.groupBy("symbol", F.window(F.window_time("window"), f"{days} days", "1 day").alias("span"))
        .agg((F.sum("s") / F.sum("n")).alias("mean_score"), F.sum("n").alias("updates"))
        .select("symbol", F.to_date("span.start").alias("start"), F.to_date("span.end").alias("end"), "mean_score", "updates")
    )


def new_urls(articles: DataFrame, late: str = "1 day") -> DataFrame:
    """Each url once within the watermark."""
    return articles.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])


def latest_values(updates: DataFrame) -> DataFrame:
    """Newest score per symbol (update mode)."""
    newest = F.struct("ts", "event_id", "risk_score", "risk_level")
    return updates.groupBy("symbol").agg(F.max(newest).alias("_r")).select("symbol", "_r.*")


# ---- spikes against a moving baseline ----------------------------------------------------


def daily_scores(updates: DataFrame, late: str = "1 hour") -> DataFrame:
    """The last score of each symbol and closed day."""
    return (
        updates.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", "1 day"))
        .agg(F.max_by("risk_score", F.struct("ts", "event_id")).alias("risk_score"))
        .select("symbol", F.window_time("window").alias("day_end"), "risk_score")
    )


DAY_MS = 86_400_000
SPIKE_SCHEMA = "symbol string, date date, risk_score double, prev_risk_score double, risk_change double, risk_change_pct double"


class SpikeProcessor(StatefulProcessor):
    """Compares a symbol's daily score with the mean of its last ``days`` days, kept as map state.

    A timer on event time empties the state of a symbol once the watermark is ``days`` days past its last day: every
    score that could still arrive would find those held too old. So silent symbols leave nothing behind.
    """

    def __init__(self, days: int = 30) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getMapState("scores", "day int", "score double")

    def expire_after(self, day: int) -> None:
        """One timer per symbol, at the end of the last day whose baseline reads ``day``."""
        at = (day + self.days + 1) * DAY_MS
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        new = pd.concat(list(rows)).sort_values("day_end")
        for end, score in zip(new["day_end"], new["risk_score"]):
            day = int(pd.Timestamp(end).timestamp() // 86_400)
            held = {k[0]: v[0] for k, v in self.scores.iterator()}
            for old in [d for d in held if d < day - self.days]:
                self.scores.removeKey((old,))
                del held[old]
            if held:
                mean = sum(held.values()) / len(held)
                change = score - mean
                pct = change / mean * 100 if mean > 0 else 0.0
                if change > SPIKE_ABSOLUTE or pct > SPIKE_PERCENT:
                    out.append((key[0], pd.Timestamp(day, unit="D").date(), score, mean, change, pct))
            self.scores.updateValue((day,), (score,))
        self.expire_after(day)
        if out:
            yield pd.DataFrame(
                out, columns=["symbol", "date", "risk_score", "prev_risk_score", "risk_change", "risk_change_pct"]
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.scores.clear()
        return iter(())

    def close(self) -> None:
        pass


def spike_alerts(daily: DataFrame, days: int = 30) -> DataFrame:
    """Spike alerts from a stream of daily scores: one row per symbol and day reaches the state."""
    return daily.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=SpikeProcessor(days),
        outputStructType=SPIKE_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
