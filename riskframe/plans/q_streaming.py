"""Structured Streaming queries (SM), each drained over the event files and compared with its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import news as nw
from riskframe.plans import q_text as _shared  # noqa: F401 - defines shared tables
from riskframe.plans.sqlkit import cte, query, rounded, sql_cols, using
from riskframe.session import prepare, scratch_path
from riskframe.sources import domain as dom
from riskframe.streaming import live, sinks
from riskframe.streaming.refresh import run_steps

LAST = "(SELECT max(ts) FROM events)"


def events(spark, d):
    return live.event_stream(prepare(spark), d, "events.parquet")


def updates(spark, d):
    return live.score_updates(events(spark, d))


cte(
    "intervals",
    """SELECT epoch(time_bucket(INTERVAL 30 SECOND, ts))::BIGINT AS start_epoch, count(*) AS updates, count(*) FILTER (WHERE risk_score > 0.6) AS high_risk
       FROM history GROUP BY 1""",
    "history",
)


@query(
    "sm1_periodic_stats",
    using("intervals", f"SELECT * FROM intervals WHERE start_epoch + 30 <= epoch({LAST} - INTERVAL 1 MINUTE)"),
)
def sm1(spark, d):
    out = sinks.drain_to_files(live.periodic_stats(updates(spark, d)))
    return out.select(F.unix_timestamp("start").alias("start_epoch"), "updates", "high_risk")


@query(
    "sm2_subscription",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS symbol FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def sm2(spark, d):
    rooms = dom.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("symbol")
    )
    return sinks.drain_to_files(live.subscribed(updates(spark, d), rooms)).select("event_id", "symbol")


cte(
    "dayscores",
    f"""SELECT symbol, date, last(risk_score ORDER BY ts, event_id) AS risk_score FROM history
        WHERE CAST(date + 1 AS TIMESTAMP) <= {LAST} - INTERVAL 1 HOUR GROUP BY symbol, date""",
    "history",
)


@query(
    "sm3_spike_alerts",
    using(
        "dayscores",
        f"""SELECT symbol, date, {sql_cols('risk_score; prev_risk_score=p; risk_change=risk_score - p; risk_change_pct=CASE WHEN p > 0 THEN (risk_score - p) / p * 100 ELSE 0 END')} FROM (
        SELECT symbol, date, risk_score, avg(risk_score) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS p FROM dayscores)
        WHERE risk_score - p > 0.15 OR CASE WHEN p > 0 THEN (risk_score - p) / p * 100 ELSE 0 END > 20""",
    ),
)
def sm3(spark, d):
    return rounded(sinks.drain_to_files(live.spike_alerts(live.daily_scores(updates(spark, d)))))


@query("sm4_high_risk_alerts", using("history", f"SELECT event_id, symbol, {sql_cols('risk_score')}, 'HIGH' AS severity FROM history WHERE risk_level = 'High'"))
def sm4(spark, d):
    return rounded(sinks.drain_to_files(live.high_risk(updates(spark, d))).select("event_id", "symbol", "risk_score", "severity"))


@query(
    "sm5_tick_to_bar",
    f"""SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events WHERE CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= {LAST} - INTERVAL 1 HOUR GROUP BY 1, 2""",
)
def sm5(spark, d):
    ticks = events(spark, d).withColumn("symbol", F.col("user_id").cast("string"))
    return sinks.drain_to_files(live.daily_bars(ticks))


@query(
    "sm6_rolling_history",
    using(
        "history",
        f"""SELECT symbol, CAST(e - 30 AS DATE) AS "start", CAST(e AS DATE) AS "end", {sql_cols('mean_score=avg(risk_score)')}, count(*) AS updates FROM (
          SELECT symbol, date, risk_score, date + CAST(k AS INTEGER) AS e FROM history, (SELECT unnest(range(1, 31)) AS k)
          WHERE CAST(date + 1 AS TIMESTAMP) <= {LAST} - INTERVAL 1 HOUR)
        WHERE CAST(e AS TIMESTAMP) <= {LAST} - INTERVAL 1 HOUR GROUP BY symbol, e""",
    ),
)
def sm6(spark, d):
    return rounded(sinks.drain_to_files(live.rolling_history(updates(spark, d))))


@query("sm7_url_dedup", "SELECT DISTINCT event_type || '/' || user_id AS url FROM events")
def sm7(spark, d):
    articles = events(spark, d).select(
        "ts", F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url")
    )
    return sinks.drain_to_files(live.new_urls(articles, "40 days")).select("url")


@query(
    "sm7_url_dedup_against_store",
    "SELECT event_type || '/' || user_id AS url, min(event_id) AS event_id FROM events GROUP BY 1",
)
def sm7_store(spark, d):
    articles = events(spark, d).select("event_id", F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"))
    path = scratch_path(spark, "urls")
    sinks.drain_batches(articles, sinks.dedup_sink(path, articles.schema, "url", ["event_id"]))
    return spark.read.schema(articles.schema).parquet(f"{path}/batch_id=*").select("url", "event_id")


@query("sm8_upsert_sink", using("scores", f"SELECT symbol, {sql_cols('risk_score')}, risk_level FROM scores"))
def sm8(spark, d):
    stream = updates(spark, d)
    path = scratch_path(spark, "upserts")
    sinks.drain_batches(stream, sinks.upsert_sink(path, ["symbol"], ["ts", "event_id"]))
    merged = sinks.read_upserted(spark, path, stream.schema, ["symbol"], ["ts", "event_id"])
    return rounded(merged.select("symbol", "risk_score", "risk_level"))


@query(
    "sm9_score_changes",
    using(
        "history",
        f"""SELECT event_id, symbol, {sql_cols('risk_score; prev_score=lag(risk_score) OVER (PARTITION BY symbol ORDER BY ts, event_id)')} FROM history""",
    ),
)
def sm9(spark, d):
    stream = updates(spark, d)
    path, state = scratch_path(spark, "changes"), scratch_path(spark, "last-rows")
    sinks.drain_batches(stream, sinks.change_feed_sink(path, state, stream.schema))
    fed = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    return rounded(fed.select("event_id", "symbol", "risk_score", "prev_score"))


@query(
    "sm10_scheduled_refresh",
    using(
        "bars dsent docs6 bscores balerts history",
        """SELECT CAST(position AS BIGINT) AS position, step, true AS ok, n AS "rows" FROM (
        SELECT 0 AS position, 'ingest' AS step, (SELECT count(*) FROM history) AS n UNION ALL SELECT 1, 'bars', (SELECT count(*) FROM bars)
        UNION ALL SELECT 2, 'sentiment', (SELECT count(*) FROM dsent) UNION ALL SELECT 3, 'documents', (SELECT count(*) FROM docs6)
        UNION ALL SELECT 4, 'scores', (SELECT count(*) FROM bscores) UNION ALL SELECT 5, 'alerts', (SELECT count(*) FROM balerts))""",
    ),
)
def sm10(spark, d):
    base = scratch_path(spark, "refresh")

    def written(name, make):
        def step():
            make().write.mode("overwrite").parquet(f"{base}/{name}")
            return spark.read.parquet(f"{base}/{name}")

        return name, step

    report = run_steps(
        spark,
        [
            ("ingest", lambda: sinks.drain_to_files(updates(spark, d), f"{base}/ingest", f"{base}/ingest-checkpoint")),
            written("bars", lambda: dom.daily_bars(spark, d)),
            written("sentiment", lambda: dom.daily_news_sentiment(spark, d)),
            written("documents", lambda: nw.build_documents(dom.news(spark, d))),
            written("scores", lambda: dom.brand_scores(spark, d)),
            written("alerts", lambda: dom.brand_alerts(spark, d)),
        ],
    )
    return report.select(F.col("position").cast("bigint").alias("position"), "step", "ok", "rows")


@query("sm11_latest_per_symbol", using("scores", f"SELECT symbol, {sql_cols('risk_score')}, risk_level, epoch(ts)::BIGINT AS seen FROM scores".replace("epoch(ts)::BIGINT", "CAST(floor(epoch(ts)) AS BIGINT)")))
def sm11(spark, d):
    stream = live.latest_values(updates(spark, d))
    path = scratch_path(spark, "latest")
    sinks.drain_batches(stream, sinks.upsert_sink(path, ["symbol"], ["ts", "event_id"]), mode="update")
    merged = sinks.read_upserted(spark, path, stream.schema, ["symbol"], ["ts", "event_id"])
    return rounded(merged.select("symbol", "risk_score", "risk_level", F.unix_timestamp("ts").alias("seen")))


cte(
    "hours",
    f"""SELECT CAST(epoch(time_bucket(INTERVAL 3 HOUR, ts)) AS BIGINT) AS start_epoch, count(*) AS updates, count(*) FILTER (WHERE risk_score > 0.6) AS high_risk FROM history
        GROUP BY 1 HAVING epoch(time_bucket(INTERVAL 3 HOUR, max(ts)) + INTERVAL 3 HOUR) <= epoch({LAST} - INTERVAL 1 MINUTE)""",
    "history",
)


@query("sm12_universe_breach", using("hours", "SELECT * FROM hours WHERE high_risk > 10"))
def sm12(spark, d):
    stats = live.periodic_stats(updates(spark, d), every="3 hours")
    out = sinks.drain_to_files(live.universe_breach(stats))
    return out.select(F.unix_timestamp("start").alias("start_epoch"), "updates", "high_risk")
