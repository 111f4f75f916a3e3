"""Sources and sinks (SRC), filters (FLT) and projections (PRJ)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskframe.functions import numeric as num
from riskframe.functions import text as tx
from riskframe.operators import entities as ent
from riskframe.operators import filters as flt
from riskframe.operators import rolling as rl
from riskframe.operators import scoring
from riskframe.plans.q_windows import W
from riskframe.plans.sqlkit import cte, query, rnd, rounded, sql_cols, sql_rnd, using
from riskframe.session import materialise, scratch_path
from riskframe.sources import domain as dom
from riskframe.sources import export, files, market
from riskframe.sources import upserts as up
from riskframe.sources.domain import AS_OF

BAR_COLS = "symbol, date, open, high, low, close, volume"
BAR_SELECT = f"symbol, date, {sql_cols('open; high; low; close', 4)}, volume"


def bar_out(df):
    return df.select(
        "symbol", "date", *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume"
    )


# ---- shared tables ---------------------------------------------------------------

cte(
    "bscores",
    """SELECT symbol, date, risk_score, CASE WHEN risk_score > 0.6 THEN 'High' WHEN risk_score > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level,
              CASE WHEN risk_score > 0.7 THEN 'High volatility' ELSE 'Stable metrics' END AS risk_drivers, volatility_21d
       FROM (SELECT symbol, date, volatility_21d,
               (CAST(rank() OVER (PARTITION BY date ORDER BY volatility_21d NULLS LAST) AS DOUBLE)
                + (CAST(count(volatility_21d) OVER (PARTITION BY date, volatility_21d) AS DOUBLE) - 1) / 2.0::DOUBLE)
               / CAST(count(volatility_21d) OVER (PARTITION BY date) AS DOUBLE) AS risk_score FROM vol21)
       WHERE volatility_21d IS NOT NULL""",
    "vol21",
)
cte(
    "balerts",
    f"""SELECT 'high_risk/' || symbol || '/' || CAST(date AS VARCHAR) AS alert_id, symbol, 'high_risk' AS alert_type, 'HIGH' AS severity,
              risk_score, risk_level, risk_drivers, date AS created_at FROM bscores WHERE risk_level = 'High'
       UNION ALL
       SELECT 'sudden_spike/' || symbol || '/' || CAST(date AS VARCHAR), symbol, 'sudden_spike', 'MEDIUM', risk_score, risk_level, risk_drivers, date
       FROM (SELECT *, risk_score - lag(risk_score) {W} AS rise FROM bscores) WHERE rise > 0.15""",
    "bscores",
)
POS = ", ".join(f"'{w}'" for w in tx.POSITIVE_WORDS)
NEG = ", ".join(f"'{w}'" for w in tx.NEGATIVE_WORDS)


def sql_hits(expr: str, words: str) -> str:
    return f"len(list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}]+'), lambda t: t IN ({words})))"


cte(
    "lex",
    f"""SELECT *, CASE WHEN hp + hn > 0 AND length(trim(headline)) >= 10 THEN (hp - hn) / CAST(hp + hn AS DOUBLE) ELSE 0 END AS hs,
               CASE WHEN hp + hn > 0 AND length(trim(headline)) >= 10 THEN (hp + hn) / CAST(hp + hn + 1 AS DOUBLE) ELSE 0 END AS hc,
               CASE WHEN cp + cn > 0 AND length(trim(content)) >= 10 THEN (cp - cn) / CAST(cp + cn AS DOUBLE) ELSE 0 END AS cs,
               CASE WHEN cp + cn > 0 AND length(trim(content)) >= 10 THEN (cp + cn) / CAST(cp + cn + 1 AS DOUBLE) ELSE 0 END AS cc
       FROM (SELECT *, {sql_hits('headline', POS)} AS hp, {sql_hits('headline', NEG)} AS hn,
                    {sql_hits('content', POS)} AS cp, {sql_hits('content', NEG)} AS cn FROM news)""",
    "news",
    materialised=True,
)
cte(
    "snews",
    """SELECT * EXCLUDE (score), score AS sentiment_score,
              CASE WHEN length(content) > 100 THEN CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END
                   ELSE CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END END AS sentiment_label
       FROM (SELECT doc_id, symbol, source, headline, content, description, url, published,
                    CASE WHEN length(content) > 100 THEN hs * 0.4::DOUBLE + cs * 0.6::DOUBLE ELSE hs END AS score,
                    CASE WHEN length(content) > 100 THEN hc * 0.4::DOUBLE + cc * 0.6::DOUBLE ELSE hc END AS sentiment_confidence FROM lex)""",
    "lex",
)
cte(
    "dsent",
    """SELECT symbol, published AS date, round(avg(sentiment_score), 12) + CAST(0 AS DOUBLE) AS avg_sentiment, stddev_samp(sentiment_score) AS sentiment_std,
              count(*) AS article_count, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
              count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count,
              count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count
       FROM snews GROUP BY symbol, published""",
    "snews",
)
cte(
    "mood",
    "SELECT symbol, round(avg(avg_sentiment), 12) + CAST(0 AS DOUBLE) AS avg_sentiment FROM dsent WHERE date >= DATE '2001-11-04' - 30 GROUP BY symbol",
    "dsent",
)
cte(
    "blatest",
    """SELECT symbol, max(date) AS date, last(risk_score ORDER BY date) AS risk_score, last(risk_level ORDER BY date) AS risk_level,
              last(risk_drivers ORDER BY date) AS risk_drivers, last(volatility_21d ORDER BY date) AS volatility_21d
       FROM bscores GROUP BY symbol""",
    "bscores",
)
cte(
    "universe",
    "SELECT b.*, coalesce(m.avg_sentiment, 0) AS avg_sentiment FROM blatest b LEFT JOIN mood m USING (symbol)",
    "blatest",
    "mood",
)

# ---- sources and sinks --------------------------------------------------------------


@query("src1_parquet_round_trip", using("bars", f"SELECT {BAR_SELECT} FROM bars"))
def src1(spark, d):
    path = scratch_path(spark, "bars-parquet")
    files.save(dom.daily_bars(spark, d), path)
    return bar_out(files.load(spark, path))


@query("src2_csv_round_trip", using("bars", f"SELECT {BAR_SELECT} FROM bars"))
def src2(spark, d):
    bars = dom.daily_bars(spark, d)
    path = scratch_path(spark, "bars-csv")
    files.save(bars, path, "csv")
    return bar_out(files.load(spark, path, "csv", bars.schema))


@query(
    "src3_src4_keyed_json",
    using("blatest", f"SELECT symbol, {sql_cols('risk_score')}, risk_level, risk_drivers FROM blatest"),
)
def src34(spark, d):
    path = scratch_path(spark, "scores-json")
    files.write_keyed_json(
        ent.latest_rows(dom.brand_scores(spark, d)).select("symbol", "risk_score", "risk_level", "risk_drivers"), path
    )
    return rounded(files.read_keyed_json(spark, path, "risk_score double, risk_level string, risk_drivers string"))


@query("src6_scan_with_lookback", using("bars", f"SELECT {BAR_SELECT} FROM bars WHERE date >= DATE '2001-11-04' - 365"))
def src6(spark, d):
    return bar_out(market.scan_bars(dom.daily_bars(spark, d), AS_OF, 365))


@query("src7_normalise_wide_bars", using("wbars", f"SELECT {BAR_SELECT} FROM wbars"))
def src7(spark, d):
    weekly = materialise(dom.weekly_bars(spark, d), "weekly")
    # a wide frame has columns for each symbol, so their names are few enough to list
    symbols = sorted(r["symbol"] for r in weekly.select("symbol").distinct().toLocalIterator())
    wide = (
        weekly
        .groupBy(F.col("date").cast("timestamp").alias("Date"))
        .pivot("symbol", symbols)
        .agg(
            F.max("open").alias("Open"), F.max("high").alias("High"), F.max("low").alias("Low"),
            F.max("close").alias("Close"), F.max("volume").alias("Volume"),
        )
    )
    return bar_out(market.normalise_bars(wide, symbols, "Date"))


@query("src8_weekly_bars", using("wbars", f"SELECT {BAR_SELECT} FROM wbars"))
def src8(spark, d):
    return bar_out(dom.weekly_bars(spark, d))


@query(
    "src8_monthly_bars",
    using(
        "bars",
        f"""SELECT {BAR_SELECT} FROM (
        SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS date, first(open ORDER BY date) AS open, max(high) AS high,
               min(low) AS low, last(close ORDER BY date) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2)""",
    ),
)
def src8m(spark, d):
    return bar_out(market.resample_bars(dom.daily_bars(spark, d), "1mo"))


# Stored and incoming tables of the merge queries: the batch restates the year 2001
# for active symbols, twice for busy weeks, and brings symbols the dimension lacks.
cte("stored", f"SELECT {BAR_COLS} FROM wbars WHERE date < DATE '2001-06-01'", "wbars")
cte(
    "batch",
    f"""SELECT symbol, date, open, high, low, close * 1.01 AS close, volume, 1 AS seq FROM wbars JOIN stocks USING (symbol)
        WHERE date >= DATE '2001-01-01' AND is_active
        UNION ALL SELECT symbol, date, open, high, low, close * 1.02, volume, 2 FROM wbars JOIN stocks USING (symbol)
        WHERE date >= DATE '2001-01-01' AND is_active AND volume >= 100
        UNION ALL SELECT 'New ' || symbol, date, open, high, low, close, volume, 1 FROM wbars WHERE date >= DATE '2001-09-01'""",
    "wbars",
    "stocks",
)
cte("batch1", f"SELECT {BAR_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1", "batch")


def _stored_and_batch(spark, d):
    weekly = dom.weekly_bars(spark, d)
    stocks = dom.stocks(spark, d)
    stored = weekly.where(F.col("date") < dt.date(2001, 6, 1))
    active = weekly.join(flt.active_only(stocks).select("symbol"), "symbol").where(F.col("date") >= dt.date(2001, 1, 1))
    first = active.withColumns({"close": F.col("close") * 1.01, "seq": F.lit(1)})
    second = active.where("volume >= 100").withColumns({"close": F.col("close") * 1.02, "seq": F.lit(2)})
    unknown = weekly.where(F.col("date") >= dt.date(2001, 9, 1)).withColumns(
        {"symbol": F.concat(F.lit("New "), "symbol"), "seq": F.lit(1)}
    )
    return stored, first.unionByName(second).unionByName(unknown), stocks


@query(
    "src9_refresh_symbols",
    using(
        "stored batch1",
        f"""SELECT {BAR_SELECT} FROM (SELECT {BAR_COLS} FROM stored WHERE symbol NOT IN (SELECT symbol FROM batch1)
        UNION ALL SELECT {BAR_COLS} FROM batch1)""",
    ),
)
def src9(spark, d):
    stored, batch, _ = _stored_and_batch(spark, d)
    batch = up.latest_by(batch, ["symbol", "date"], ["seq"]).drop("seq")
    return bar_out(up.refresh_symbols(stored, batch))


@query(
    "src9_partition_overwrite",
    using(
        "stored batch1",
        f"""SELECT {BAR_SELECT} FROM (SELECT {BAR_COLS} FROM stored WHERE symbol NOT IN (SELECT symbol FROM batch1)
        UNION ALL SELECT {BAR_COLS} FROM batch1)""",
    ),
)
def src9_files(spark, d):
    stored, batch, _ = _stored_and_batch(spark, d)
    path = scratch_path(spark, "bars-by-symbol")
    up.write_refresh(stored, path)
    up.write_refresh(up.latest_by(batch, ["symbol", "date"], ["seq"]).drop("seq"), path)
    return bar_out(spark.read.schema(stored.schema).parquet(path))


@query(
    "src10_upsert_bars",
    using(
        "stored batch1",
        f"""SELECT {BAR_SELECT} FROM (
        SELECT * FROM batch1 WHERE symbol IN (SELECT symbol FROM stocks)
        UNION ALL SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch1 b WHERE b.symbol = s.symbol AND b.date = s.date))""",
    ),
)
def src10(spark, d):
    stored, batch, stocks = _stored_and_batch(spark, d)
    return bar_out(up.upsert(stored, batch, ["symbol", "date"], known=stocks, order=["seq"]))


cte(
    "sc_old",
    """SELECT symbol, date, risk_score, risk_level, CAST(NULL AS BIGINT) AS risk_rank, volatility_21d, drawdown AS max_drawdown,
              risk_drivers, peak AS beta FROM bscores JOIN ddc USING (symbol, date) WHERE date < DATE '2001-08-01'""",
    "bscores",
    "ddc",
)
cte(
    "sc_new",
    """SELECT symbol, date, risk_score / 2 AS risk_score, 'Low' AS risk_level, CAST(1 AS BIGINT) AS risk_rank,
              CASE WHEN risk_level = 'High' THEN volatility_21d END AS volatility_21d, drawdown * 2 AS max_drawdown,
              'Restated' AS risk_drivers, close AS beta FROM bscores JOIN ddc USING (symbol, date) WHERE date >= DATE '2001-06-01'""",
    "bscores",
    "ddc",
)


@query(
    "src11_upsert_scores",
    using(
        "sc_old sc_new",
        f"""SELECT symbol, date, {sql_cols('risk_score; volatility_21d; max_drawdown; beta')}, risk_level, risk_rank, risk_drivers FROM (
        SELECT n.symbol, n.date, n.risk_score, n.risk_level, n.risk_rank, n.volatility_21d, n.max_drawdown, n.risk_drivers,
               CASE WHEN o.symbol IS NULL THEN n.beta ELSE o.beta END AS beta
        FROM sc_new n LEFT JOIN sc_old o ON o.symbol = n.symbol AND o.date = n.date
        UNION ALL SELECT o.* FROM sc_old o WHERE NOT EXISTS (SELECT 1 FROM sc_new n WHERE n.symbol = o.symbol AND n.date = o.date))""",
    ),
)
def src11(spark, d):
    curve = rl.add_drawdown_curve(dom.daily_bars(spark, d)).select("symbol", "date", "close", "peak", "drawdown")
    base = dom.brand_scores(spark, d).join(curve, ["symbol", "date"])
    cols = [
        "symbol", "date", "risk_score", "risk_level", "risk_rank", "volatility_21d", "max_drawdown", "risk_drivers", "beta",
    ]
    old = base.where(F.col("date") < dt.date(2001, 8, 1)).withColumns(
        {"risk_rank": F.lit(None).cast("bigint"), "max_drawdown": F.col("drawdown"), "beta": F.col("peak")}
    )
    new = base.where(F.col("date") >= dt.date(2001, 6, 1)).withColumns(
        {
            "risk_score": F.col("risk_score") / 2,
            "volatility_21d": F.when(F.col("risk_level") == "High", F.col("volatility_21d")),
            "risk_rank": F.lit(1).cast("bigint"),
            "max_drawdown": F.col("drawdown") * 2,
            "risk_drivers": F.lit("Restated"),
            "beta": F.col("close"),
        }
    ).withColumn("risk_level", F.lit("Low"))
    return rounded(up.upsert_scores(old.select(cols), new.select(cols)))


@query(
    "src12_upsert_sentiment",
    using(
        "dsent",
        f"""SELECT symbol, date, {sql_cols('avg_sentiment')}, article_count FROM (
        SELECT symbol, date, avg_sentiment / 2 AS avg_sentiment, article_count + 1 AS article_count FROM dsent WHERE date >= DATE '2001-10-20'
        UNION ALL SELECT symbol, date, avg_sentiment, article_count FROM dsent WHERE date < DATE '2001-10-20')""",
    ),
)
def src12(spark, d):
    daily = dom.daily_news_sentiment(spark, d).select("symbol", "date", "avg_sentiment", "article_count")
    batch = daily.where(F.col("date") >= dt.date(2001, 10, 20)).withColumns(
        {"avg_sentiment": F.col("avg_sentiment") / 2, "article_count": F.col("article_count") + 1}
    )
    stored = daily.where(F.col("date") < dt.date(2001, 10, 25))
    return rounded(up.upsert(stored, batch, ["symbol", "date"], known=dom.stocks(spark, d)))


@query(
    "src13_insert_if_absent",
    using(
        "stored batch1",
        f"""SELECT {BAR_SELECT} FROM (SELECT * FROM stored UNION ALL SELECT b.* FROM batch1 b
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE b.symbol = s.symbol AND b.date = s.date))""",
    ),
)
def src13(spark, d):
    stored, batch, _ = _stored_and_batch(spark, d)
    return bar_out(up.upsert(stored, batch, ["symbol", "date"], order=["seq"], update=False))


@query(
    "src14_append_history",
    using("history", f"SELECT event_id, symbol, date, {sql_cols('risk_score')}, risk_level FROM history"),
)
def src14(spark, d):
    rows = dom.risk_history(spark, d).drop("ts")
    path = scratch_path(spark, "history")
    for part in (F.col("risk_level") == "High", F.col("risk_level") != "High"):
        files.append_history(rows.where(part), path)
    return rounded(spark.read.schema(rows.schema).parquet(path))


@query(
    "src15_missing_dimension_rows",
    using(
        "stocks batch1",
        """SELECT symbol, name, sector, is_active FROM stocks UNION ALL
        SELECT DISTINCT symbol, symbol, 'Unknown', true FROM batch1 WHERE symbol NOT IN (SELECT symbol FROM stocks)""",
    ),
)
def src15(spark, d):
    _, batch, stocks = _stored_and_batch(spark, d)
    return up.missing_stocks(stocks, batch)


@query(
    "src16_refresh_dimension",
    using(
        "stocks",
        """SELECT symbol, CASE WHEN sector = 'S1' THEN symbol || ' Inc' ELSE name END AS name,
                  CASE WHEN sector IN ('S0', 'S2') THEN 'Tech' ELSE sector END AS sector, is_active FROM stocks""",
    ),
)
def src16(spark, d):
    stocks = dom.stocks(spark, d)
    fresh = stocks.select(
        "symbol",
        F.when(F.col("sector") == "S1", F.concat("symbol", F.lit(" Inc"))).when(F.col("sector") == "S2", "").otherwise(
            F.col("symbol")
        ).alias("name"),
        F.when(F.col("sector").isin("S0", "S2"), "Tech").otherwise("Unknown").alias("sector"),
    )
    return up.refresh_stocks(stocks, fresh)


def sql_pct(expr: str) -> str:
    return f"CASE WHEN ({expr}) IS NULL THEN 'N/A' ELSE printf('%.2f%%', ({expr}) * 100 + 1e-9::DOUBLE) END"


@query(
    "src17_export_scores",
    using(
        "universe",
        f"""SELECT symbol AS "Symbol", {sql_pct('risk_score')} AS "Risk Score", risk_level AS "Risk Level",
        CASE WHEN avg_sentiment > 0 THEN 'Positive' WHEN avg_sentiment < 0 THEN 'Negative' ELSE 'Neutral' END AS "Sentiment",
        printf('%.2f', avg_sentiment + 1e-9::DOUBLE) AS "Sentiment Score", '2001-11-04' AS "Date" FROM universe""",
    ),
)
def src17(spark, d):
    return export.export_scores(dom.scored_universe(spark, d), AS_OF)


@query(
    "src17_export_watchlist",
    using(
        "blatest stocks",
        f"""SELECT w.symbol AS "Symbol", s.name AS "Name", s.sector AS "Sector", {sql_pct('b.risk_score')} AS "Risk Score",
        coalesce(b.risk_level, 'N/A') AS "Risk Level", coalesce(w.notes, '') AS "Notes"
        FROM (SELECT c_custkey AS user_id, 'Brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS symbol, c_mktsegment AS notes FROM customer) w
        JOIN stocks s USING (symbol) LEFT JOIN blatest b USING (symbol)""",
    ),
)
def src17_watchlist(spark, d):
    return export.export_watchlist(
        ent.watchlist_scores(dom.watchlist(spark, d), dom.stocks(spark, d), dom.brand_scores(spark, d))
    )


@query(
    "src17_export_alerts",
    using(
        "balerts",
        f"""SELECT symbol AS "Symbol", alert_type AS "Alert Type", {sql_pct('nullif(risk_score, 0) / 100')} AS "Risk Score",
        risk_level AS "Risk Level", 'Alert for ' || symbol || ': ' || risk_drivers AS "Message", CAST(created_at AS VARCHAR) AS "Date" FROM balerts""",
    ),
)
def src17_alerts(spark, d):
    from riskframe.operators.alerts import basic_explanations

    return export.export_alerts(basic_explanations(dom.brand_alerts(spark, d)))


@query(
    "src18_data_presence",
    using("bars", "SELECT EXISTS (SELECT 1 FROM bars WHERE date >= DATE '2001-11-04' - 30) AS has_recent"),
)
def src18(spark, d):
    recent = market.within(dom.daily_bars(spark, d), AS_OF, 30)
    return spark.range(1).select(recent.exists().alias("has_recent"))


# ---- filters --------------------------------------------------------------------------


@query("flt1_symbol_equality", using("bars", f"SELECT upper(symbol) AS symbol, date, {sql_cols('close', 4)} FROM bars WHERE upper(symbol) = 'BRAND#7'"))
def flt1(spark, d):
    df = flt.only_symbol(flt.normalise_symbol(dom.daily_bars(spark, d)), "brand#7")
    return df.select("symbol", "date", rnd("close", 4).alias("close"))


@query(
    "flt2_symbol_list",
    using("bars", f"SELECT upper(symbol) AS symbol, date, {sql_cols('close', 4)} FROM bars WHERE upper(symbol) IN ('BRAND#1', 'BRAND#12', 'BRAND#3')"),
)
def flt2(spark, d):
    df = flt.only_symbols(flt.normalise_symbol(dom.daily_bars(spark, d)), " brand#1, Brand#12,, BRAND#3 ")
    return df.select("symbol", "date", rnd("close", 4).alias("close"))


@query("flt3_lookback_cutoff", using("history", f"SELECT event_id, symbol, {sql_cols('risk_score')} FROM history WHERE date >= DATE '2024-01-30' - 7"))
def flt3(spark, d):
    df = market.within(dom.risk_history(spark, d), dt.date(2024, 1, 30), 7)
    return rounded(df.select("event_id", "symbol", "risk_score"))


@query("flt4_risk_level", using("scores", f"SELECT symbol, {sql_cols('risk_score')}, risk_level FROM scores WHERE lower(risk_level) = 'high'"))
def flt4(spark, d):
    return rounded(flt.only_level(dom.current_scores(spark, d), "HIGH").select("symbol", "risk_score", "risk_level"))


@query("flt5_severity", using("balerts", f"SELECT alert_id, symbol, {sql_cols('risk_score')} FROM balerts WHERE severity = 'MEDIUM'"))
def flt5(spark, d):
    return rounded(flt.only_severity(dom.brand_alerts(spark, d), "MEDIUM").select("alert_id", "symbol", "risk_score"))


@query("flt6_symbol_search", using("bars", f"SELECT symbol, date, {sql_cols('close', 4)} FROM bars WHERE contains(lower(symbol), 'd#2')"))
def flt6(spark, d):
    return flt.search_symbol(dom.daily_bars(spark, d), "D#2").select("symbol", "date", rnd("close", 4).alias("close"))


@query("flt7_active_stocks", using("stocks", "SELECT symbol, sector FROM stocks WHERE is_active"))
def flt7(spark, d):
    return flt.active_only(dom.stocks(spark, d)).select("symbol", "sector")


@query(
    "flt8_unscored_articles",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL",
)
def flt8(spark, d):
    labels = dom.table(spark, d, "labels").select("doc_id", F.col("quality").alias("sentiment_label"))
    return flt.unscored(dom.news(spark, d).join(labels, "doc_id", "left")).select("doc_id")


@query("flt9_purge_articles", using("news", "SELECT doc_id, url FROM news WHERE NOT (source = 'src0' OR contains(url, 'src1/'))"))
def flt9(spark, d):
    news = dom.news(spark, d)
    kept, _ = flt.purge(news, dom.stocks(spark, d), flt.synthetic_article("src0", "src1/"))
    return kept.select("doc_id", "url")


@query(
    "flt9_purge_clears_aggregate",
    using(
        "dsent",
        f"""SELECT symbol, date, {sql_cols('avg_sentiment')} FROM dsent
        WHERE NOT EXISTS (SELECT 1 FROM news WHERE source = 'Synthetic' OR contains(url, 'example.com'))""",
    ),
)
def flt9_aggregate(spark, d):
    daily = dom.daily_news_sentiment(spark, d).select("symbol", "date", "avg_sentiment")
    _, left = flt.purge(dom.news(spark, d), daily, flt.synthetic_article())
    return rounded(left)


@query(
    "flt10_minimum_history",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('close', 4)} FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 1530)""",
    ),
)
def flt10(spark, d):
    return flt.min_history(dom.daily_bars(spark, d), 1530).select("symbol", "date", rnd("close", 4).alias("close"))


@query(
    "flt11_complete_rows",
    using("vol21full", f"SELECT symbol, date, {sql_cols('volatility_21d')} FROM vol21full WHERE volatility_21d IS NOT NULL AND ret IS NOT NULL"),
)
def flt11(spark, d):
    df = rl.add_volatility(rl.add_returns(dom.daily_bars(spark, d)), {"volatility_21d": (21, None)})
    return rounded(flt.complete_rows(df, ["ret", "volatility_21d"]).select("symbol", "date", "volatility_21d"))


@query(
    "flt12_invalid_prices",
    "SELECT count(*) FILTER (WHERE c_acctbal <= 0) AS invalid, count(*) FILTER (WHERE c_acctbal > 0) AS valid FROM customer",
)
def flt12(spark, d):
    rows = dom.table(spark, d, "customer").select(F.col("c_acctbal").alias("close"))
    valid = flt.valid_price(rows).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.count_if(F.col("close") <= 0).alias("invalid")).withColumn("valid", valid.scalar())


# ---- projections ----------------------------------------------------------------------


@query("prj1_risk_bands", using("history", f"SELECT event_id, {sql_cols('risk_score')}, risk_level FROM history"))
def prj1(spark, d):
    return rounded(dom.risk_history(spark, d).select("event_id", "risk_score", num.risk_level("risk_score").alias("risk_level")))


@query(
    "prj2_right_closed_cut",
    using(
        "history",
        """SELECT event_id, CASE WHEN s > 0 AND s <= 0.3 THEN 'Low' WHEN s > 0.3 AND s <= 0.6 THEN 'Medium' WHEN s > 0.6 AND s <= 1 THEN 'High' END AS band
        FROM (SELECT event_id, round(risk_score, 1) AS s FROM history)""",
    ),
)
def prj2(spark, d):
    return dom.risk_history(spark, d).select("event_id", num.risk_cut(F.round("risk_score", 1)).alias("band"))


cte(
    "latest_feats",
    """SELECT v.symbol, v.volatility_21d, m.max_drawdown * 100 AS max_drawdown, u.avg_sentiment, l.liquidity_risk
       FROM (SELECT symbol, last(volatility_21d ORDER BY date) AS volatility_21d FROM vol21 GROUP BY symbol) v
       JOIN maxdd m USING (symbol) LEFT JOIN mood u USING (symbol)
       JOIN (SELECT symbol, last(x ORDER BY date) AS liquidity_risk FROM (
               SELECT symbol, date, CASE WHEN count(volume) OVER w >= 10 THEN stddev_samp(volume) OVER w / (avg(volume) OVER w + 1e-9) END AS x
               FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY symbol) l USING (symbol)""",
    "vol21",
    "maxdd",
    "mood",
    "bars",
)
cte(
    "normed",
    """SELECT symbol,
       coalesce(CASE WHEN max(volatility_21d) OVER () = min(volatility_21d) OVER () THEN 0.5 ELSE (volatility_21d - min(volatility_21d) OVER ()) / nullif(max(volatility_21d) OVER () - min(volatility_21d) OVER (), 0) END, 0.5) AS norm_volatility,
       coalesce((abs(max_drawdown) - min(abs(max_drawdown)) OVER ()) / nullif(max(abs(max_drawdown)) OVER () - min(abs(max_drawdown)) OVER (), 0), 0.5) AS norm_drawdown,
       coalesce(1 - (avg_sentiment - min(avg_sentiment) OVER ()) / nullif(max(avg_sentiment) OVER () - min(avg_sentiment) OVER (), 0), 0.5) AS norm_sentiment,
       coalesce((liquidity_risk - min(liquidity_risk) OVER ()) / nullif(max(liquidity_risk) OVER () - min(liquidity_risk) OVER (), 0), 0.5) AS norm_liquidity
       FROM latest_feats""",
    "latest_feats",
)
cte(
    "weighted",
    """SELECT *, CASE WHEN risk_score > 0 AND risk_score <= 0.3 THEN 'Low' WHEN risk_score > 0.3 AND risk_score <= 0.6 THEN 'Medium'
                      WHEN risk_score > 0.6 AND risk_score <= 1 THEN 'High' END AS risk_level,
         coalesce(nullif(concat_ws(' | ', CASE WHEN norm_volatility > 0.7 THEN 'High volatility' END, CASE WHEN norm_drawdown > 0.7 THEN 'Significant drawdown' END,
           CASE WHEN norm_sentiment > 0.6 THEN 'Negative news sentiment' END, CASE WHEN norm_liquidity > 0.6 THEN 'Liquidity concerns' END), ''), 'Stable metrics') AS risk_drivers,
         rank() OVER (ORDER BY risk_score DESC) AS risk_rank
       FROM (SELECT *, norm_volatility * 0.4::DOUBLE + norm_drawdown * 0.3::DOUBLE + norm_sentiment * 0.2::DOUBLE + norm_liquidity * 0.1::DOUBLE AS risk_score FROM normed)""",
    "normed",
)


def latest_features(spark, d):
    bars = dom.daily_bars(spark, d)
    df = rl.add_liquidity(rl.add_volatility(rl.add_returns(bars), {"volatility_21d": (21, 10)}))
    last = ent.latest_rows(df.select("symbol", "date", "volatility_21d", "liquidity_risk")).drop("date")
    from riskframe.operators.drawdown import max_drawdowns
    from riskframe.operators.news import mean_sentiment

    worst = max_drawdowns(bars).withColumn("max_drawdown", F.col("max_drawdown") * 100)
    mood = mean_sentiment(dom.daily_news_sentiment(spark, d), AS_OF)
    # scoring reads its input several times: extremes, scores, ranks
    return materialise(last.join(worst, "symbol").join(mood, "symbol", "left"), "latest")


@query(
    "prj3_min_max_normalise",
    using("normed", f"SELECT symbol, {sql_cols('norm_volatility; norm_drawdown; norm_sentiment; norm_liquidity')} FROM normed"),
)
def prj3(spark, d):
    df = scoring.weighted_scores(latest_features(spark, d))
    return rounded(df.select("symbol", "norm_volatility", "norm_drawdown", "norm_sentiment", "norm_liquidity"))


@query(
    "prj4_prj5_weighted_score",
    using("weighted", f"SELECT symbol, {sql_cols('risk_score')}, risk_level, risk_drivers, risk_rank FROM weighted"),
)
def prj45(spark, d):
    df = scoring.scorer(None)(latest_features(spark, d))
    return rounded(df.select("symbol", "risk_score", "risk_level", "risk_drivers", "risk_rank"))


@query(
    "prj6_forecast_signal",
    using(
        "vol21full",
        f"""SELECT symbol, date, CASE WHEN c > 0.02 THEN 'INCREASING' WHEN c < -0.02 THEN 'DECREASING' ELSE 'STABLE' END AS signal
        FROM (SELECT symbol, date, volatility_21d - lag(volatility_21d) {W} AS c FROM vol21full)""",
    ),
)
def prj6(spark, d):
    df = rl.add_volatility(rl.add_returns(dom.daily_bars(spark, d)), {"volatility_21d": (21, None)})
    change = F.col("volatility_21d") - F.lag("volatility_21d").over(rl.by_symbol())
    return df.select("symbol", "date", num.forecast_signal(change).alias("signal"))


@query(
    "prj7_sentiment_label",
    using(
        "snews",
        f"""SELECT doc_id, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM snews""",
    ),
)
def prj7(spark, d):
    return dom.scored_news(spark, d).select("doc_id", num.sentiment_label("sentiment_score").alias("label"))


@query(
    "prj8_stock_comparison",
    using(
        "universe",
        f"""SELECT metric, {', '.join(f"{sql_rnd(f'''max(CASE WHEN symbol = 'Brand#{i}' THEN value END)''')} AS \"Brand#{i}\"" for i in (3, 8, 11, 21))}
        FROM (UNPIVOT (SELECT symbol, risk_score, volatility_21d, avg_sentiment FROM universe) ON risk_score, volatility_21d, avg_sentiment INTO NAME metric VALUE value)
        GROUP BY metric""",
    ),
)
def prj8(spark, d):
    df = flt.compare_symbols(
        dom.scored_universe(spark, d),
        ["Brand#3", "Brand#8", "Brand#11", "Brand#21"],
        ["risk_score", "volatility_21d", "avg_sentiment"],
    )
    return rounded(df)


@query(
    "prj9_fixed_columns",
    using(
        "vol21full",
        f"""SELECT {sql_cols('close=coalesce(close, 0)', 4)}, {sql_cols('ret=coalesce(ret, 0); volatility_21d=coalesce(volatility_21d, 0); sentiment_30d=0')} FROM vol21full""",
    ),
)
def prj9(spark, d):
    df = rl.add_volatility(rl.add_returns(dom.daily_bars(spark, d)), {"volatility_21d": (21, None)})
    out = flt.fixed_columns(df, ["close", "ret", "volatility_21d", "sentiment_30d"])
    return out.select(rnd("close", 4).alias("close"), *[rnd(c).alias(c) for c in out.columns[1:]])
