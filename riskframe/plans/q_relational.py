"""Joins (JN), aggregates (AG), top-k (TK) and set operations (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import aggregates as agg
from riskframe.operators import alerts as al
from riskframe.operators import cross_section as xs
from riskframe.operators import drawdown as dd
from riskframe.operators import entities as ent
from riskframe.operators import news as nw
from riskframe.operators import rolling as rl
from riskframe.operators import selection as sel
from riskframe.plans.q_core import bar_out
from riskframe.plans.q_windows import _ahead_vol
from riskframe.plans.sqlkit import cte, query, rnd, rounded, sql_cols, sql_rnd, using
from riskframe.scale import exact_quantiles, top_per_key
from riskframe.sources import domain as dom
from riskframe.sources import market
from riskframe.sources.domain import AS_OF


def returns(spark, d):
    return rl.add_returns(dom.daily_bars(spark, d))


def vol21(spark, d):
    return rl.add_volatility(returns(spark, d), {"volatility_21d": (21, 10)})


# ---- joins ---------------------------------------------------------------------------


@query(
    "jn1_bars_with_dimension",
    using("bars stocks", f"SELECT symbol, date, {sql_cols('close', 4)}, sector, is_active FROM bars JOIN stocks USING (symbol)"),
)
def jn1(spark, d):
    df = ent.with_stock(dom.daily_bars(spark, d), dom.stocks(spark, d))
    return df.select("symbol", "date", rnd("close", 4).alias("close"), "sector", "is_active")


@query(
    "jn2_latest_row",
    using(
        "bars",
        f"""SELECT b.symbol, b.date, {sql_cols('open; high; low; close', 4)}, volume FROM bars b
        JOIN (SELECT symbol, max(date) AS date FROM bars GROUP BY symbol) m ON m.symbol = b.symbol AND m.date = b.date""",
    ),
)
def jn2(spark, d):
    return bar_out(ent.latest_rows(dom.daily_bars(spark, d)))


@query(
    "jn3_scores_with_recent_sentiment",
    using("universe", f"SELECT symbol, date, {sql_cols('risk_score; volatility_21d; avg_sentiment')}, risk_level, risk_drivers FROM universe"),
)
def jn3(spark, d):
    return rounded(dom.scored_universe(spark, d))


@query(
    "jn4_benchmark_join",
    using("withbench", f"SELECT symbol, date, {sql_cols('ret; bench_ret')} FROM withbench"),
)
def jn4(spark, d):
    df = rl.with_benchmark_return(returns(spark, d), dom.market_benchmark(spark, d))
    return rounded(df.select("symbol", "date", "ret", "bench_ret"))


@query(
    "jn5_regime_join",
    using("ret regime", f"SELECT symbol, date, {sql_cols('ret; spy_vol_21d; spy_return_21d; high_vol_regime')} FROM ret LEFT JOIN regime USING (date)"),
)
def jn5(spark, d):
    df = xs.with_regime(returns(spark, d), xs.market_regime(dom.market_benchmark(spark, d)))
    return rounded(df.select("symbol", "date", "ret", "spy_vol_21d", "spy_return_21d", "high_vol_regime"))


@query(
    "jn6_sentiment_replaced",
    using(
        "blatest dsent",
        f"""SELECT symbol, {sql_cols('risk_score; avg_sentiment=coalesce(m, 0)')} FROM blatest
        LEFT JOIN (SELECT symbol, avg(avg_sentiment) AS m FROM dsent WHERE date >= DATE '2001-11-04' - 7 GROUP BY symbol) USING (symbol)""",
    ),
)
def jn6(spark, d):
    mood = nw.mean_sentiment(dom.daily_news_sentiment(spark, d), AS_OF, 7)
    scores = dom.scored_universe(spark, d).select("symbol", "risk_score", "avg_sentiment")
    return rounded(ent.replace_sentiment(scores, mood))


cte(
    "aligned",
    "SELECT * FROM wbars WHERE date IN (SELECT date FROM wbars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM wbars))",
    "wbars",
)


@query("jn7_aligned_dates", using("aligned", f"SELECT symbol, date, {sql_cols('close', 4)} FROM aligned"))
def jn7(spark, d):
    df = ent.aligned_dates(dom.weekly_bars(spark, d))
    return df.select("symbol", "date", rnd("close", 4).alias("close"))


@query(
    "jn9_score_on_exact_date",
    using("bars bscores", f"SELECT symbol, date, {sql_cols('risk_score=coalesce(risk_score, 0.5)')} FROM bars LEFT JOIN bscores USING (symbol, date)"),
)
def jn9(spark, d):
    df = ent.score_on_date(dom.daily_bars(spark, d), dom.brand_scores(spark, d))
    return rounded(df.select("symbol", "date", "risk_score"))


@query(
    "jn10_current_vs_baseline",
    using(
        "scores history",
        f"""SELECT symbol, {sql_cols('risk_score; prev_risk_score=p')} FROM scores JOIN
        (SELECT symbol, avg(risk_score) AS p FROM history WHERE date >= DATE '2024-01-31' - 30 GROUP BY symbol) USING (symbol)""",
    ),
)
def jn10(spark, d):
    df = dom.current_scores(spark, d).join(al.baseline(dom.risk_history(spark, d), dom.SCORED_UNTIL), "symbol")
    return rounded(df.select("symbol", "risk_score", "prev_risk_score"))


@query(
    "jn11_new_urls",
    """WITH u AS (SELECT page_id AS doc_id, url FROM pages), stored AS (SELECT url FROM u WHERE contains(url, '/en/'))
    SELECT min(doc_id) AS doc_id, url FROM u WHERE url NOT IN (SELECT url FROM stored) GROUP BY url""",
)
def jn11(spark, d):
    pages = dom.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return ent.new_articles(pages, pages.where(F.contains("url", F.lit("/en/"))))


cte(
    "holdings0",
    """SELECT o_custkey AS user_id, p_brand AS symbol, sum(l_quantity) AS quantity, sum(l_extendedprice) / sum(l_quantity) AS avg_price
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' GROUP BY 1, 2""",
)
cte(
    "valued",
    """SELECT user_id, symbol, quantity, avg_price, stock_name, sector, risk_score, risk_level, price AS current_price,
              quantity * price AS current_value, quantity * avg_price AS cost_basis
       FROM (SELECT h.*, s.name AS stock_name, s.sector, b.risk_score, b.risk_level, coalesce(nullif(c.close, 0), h.avg_price) AS price
             FROM holdings0 h LEFT JOIN stocks s USING (symbol) LEFT JOIN (SELECT symbol, last(close ORDER BY date) AS close FROM bars GROUP BY symbol) c USING (symbol)
             LEFT JOIN blatest b USING (symbol))""",
    "holdings0",
    "stocks",
    "bars",
    "blatest",
)


@query(
    "jn12_enriched_holdings",
    using(
        "valued",
        f"""SELECT user_id, symbol, quantity, {sql_cols('avg_price; current_price', 4)}, {sql_cols('current_value; cost_basis; gain_loss=current_value - cost_basis', 2)},
        {sql_cols('gain_loss_pct=CASE WHEN cost_basis > 0 THEN (current_value - cost_basis) / cost_basis * 100 ELSE 0 END; risk_score')},
        risk_level, stock_name, sector FROM valued""",
    ),
)
def jn12(spark, d):
    bought = dom.transactions(spark, d).where("action = 'BUY'")
    holdings = bought.groupBy("user_id", "symbol").agg(
        F.sum("quantity").alias("quantity"),
        (F.sum(F.col("price") * F.col("quantity")) / F.sum("quantity")).alias("avg_price"),
    )
    v = ent.value_holdings(holdings, dom.stocks(spark, d), dom.daily_bars(spark, d), dom.brand_scores(spark, d))
    return v.select(
        "user_id", "symbol", "quantity", rnd("avg_price", 4).alias("avg_price"), rnd("current_price", 4).alias("current_price"),
        rnd("current_value", 2).alias("current_value"), rnd("cost_basis", 2).alias("cost_basis"),
        rnd("gain_loss", 2).alias("gain_loss"), rnd("gain_loss_pct").alias("gain_loss_pct"),
        rnd("risk_score").alias("risk_score"), "risk_level", "stock_name", "sector",
    )


cte(
    "wlist",
    "SELECT c_custkey AS user_id, 'Brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS symbol, c_mktsegment AS notes FROM customer",
)


@query(
    "jn13_watchlist_scores",
    using("wlist stocks blatest", f"SELECT user_id, symbol, notes, name, sector, {sql_cols('risk_score')}, risk_level FROM wlist JOIN stocks USING (symbol) LEFT JOIN blatest USING (symbol)"),
)
def jn13(spark, d):
    return rounded(ent.watchlist_scores(dom.watchlist(spark, d), dom.stocks(spark, d), dom.brand_scores(spark, d)))


@query(
    "jn14_in_watchlist",
    using(
        "wlist holdings0",
        "SELECT user_id, symbol, EXISTS (SELECT 1 FROM wlist w WHERE w.user_id = h.user_id AND w.symbol = h.symbol) AS in_watchlist FROM holdings0 h",
    ),
)
def jn14(spark, d):
    held = dom.transactions(spark, d).where("action = 'BUY'").select("user_id", "symbol").distinct()
    return ent.in_watchlist(held, dom.watchlist(spark, d))


@query(
    "jn15_entity_profile",
    using(
        "bscores bars dsent balerts blatest",
        f"""SELECT symbol, section, stamp, {sql_rnd('value')} AS value, detail FROM (
        SELECT symbol, 'score' AS section, CAST(date AS VARCHAR) AS stamp, risk_score AS value, risk_level AS detail FROM blatest
        UNION ALL SELECT symbol, 'bar', CAST(max(date) AS VARCHAR), last(close ORDER BY date), CAST(last(volume ORDER BY date) AS VARCHAR) FROM bars GROUP BY symbol
        UNION ALL SELECT symbol, 'sentiment', CAST(date AS VARCHAR), avg_sentiment, CAST(article_count AS VARCHAR) FROM dsent WHERE date >= DATE '2001-11-04' - 30
        UNION ALL SELECT symbol, 'history', CAST(date AS VARCHAR), risk_score, risk_level FROM bscores WHERE date >= DATE '2001-11-04' - 30
        UNION ALL SELECT symbol, 'alert', CAST(created_at AS VARCHAR), risk_score, alert_type FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC, alert_id) AS rn FROM balerts) WHERE rn <= 10)
        WHERE symbol IN (SELECT symbol FROM bscores)""",
    ),
)
def jn15(spark, d):
    scores = dom.brand_scores(spark, d)
    return rounded(
        ent.entity_profile(
            scores, dom.daily_bars(spark, d), dom.daily_news_sentiment(spark, d), scores, dom.brand_alerts(spark, d), AS_OF
        )
    )


@query("jn16_benchmark_fallback", using("bench", f"SELECT date, {sql_cols('close', 4)}, volume FROM bench"))
def jn16(spark, d):
    df = market.benchmark_series(dom.daily_bars(spark, d), "SPY")
    return df.select("date", rnd("close", 4).alias("close"), "volume")


@query("jn16_benchmark_own_bars", using("bars", f"SELECT date, {sql_cols('close', 4)}, volume FROM bars WHERE symbol = 'Brand#1'"))
def jn16_own(spark, d):
    df = market.benchmark_series(dom.daily_bars(spark, d), "Brand#1")
    return df.select("date", rnd("close", 4).alias("close"), "volume")


# ---- aggregates ------------------------------------------------------------------------

_LEVELS = "; ".join(f"{lv.lower()}" for lv in ("High", "Medium", "Low"))


def sql_levels(suffix: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE risk_level = '{lv}') AS {lv.lower()}{suffix}" for lv in ("High", "Medium", "Low"))


@query(
    "ag1_overview_stats",
    using(
        "universe balerts",
        f"""SELECT count(*) AS total_stocks, {sql_levels('_risk_stocks')}, {sql_cols('avg_risk_score=avg(risk_score); avg_sentiment=avg(avg_sentiment)')},
        (SELECT count(*) FROM balerts) AS total_alerts FROM universe""",
    ),
)
def ag1(spark, d):
    return rounded(agg.overview_stats(dom.scored_universe(spark, d), dom.brand_alerts(spark, d)))


@query(
    "ag2_live_stats",
    using(
        "scores balerts",
        """SELECT count(*) AS total_stocks, count(*) FILTER (WHERE risk_score > 0.6) AS high_risk_stocks,
        (SELECT count(*) FROM balerts) AS total_alerts,
        (SELECT least(count(*), 5) FROM balerts) AS recent_alerts_count FROM scores""",
    ),
)
def ag2(spark, d):
    return agg.live_stats(dom.current_scores(spark, d), dom.brand_alerts(spark, d))


@query("ag3_daily_sentiment", using("dsent", f"SELECT symbol, date, {sql_cols('avg_sentiment')}, article_count FROM dsent"))
def ag3(spark, d):
    df = dom.daily_news_sentiment(spark, d)
    return rounded(nw.sentiment_trends(df, AS_OF, 30).select("symbol", "date", "avg_sentiment", "article_count"))


@query(
    "ag4_sentiment_spread",
    using("dsent", f"SELECT symbol, date, {sql_cols('sentiment_std')}, positive_count, negative_count, neutral_count FROM dsent"),
)
def ag4(spark, d):
    df = dom.daily_news_sentiment(spark, d)
    return rounded(df.select("symbol", "date", "sentiment_std", "positive_count", "negative_count", "neutral_count"))


@query(
    "ag5_recent_mean_sentiment",
    using(
        "dsent",
        f"""SELECT symbol, {sql_cols("week=avg(avg_sentiment) FILTER (WHERE date >= DATE '2001-11-04' - 7); month=avg(avg_sentiment) FILTER (WHERE date >= DATE '2001-11-04' - 30)")}
        FROM dsent GROUP BY symbol""",
    ),
)
def ag5(spark, d):
    daily = dom.daily_news_sentiment(spark, d)
    week = nw.mean_sentiment(daily, AS_OF, 7).withColumnRenamed("avg_sentiment", "week")
    month = nw.mean_sentiment(daily, AS_OF, 30).withColumnRenamed("avg_sentiment", "month")
    return rounded(month.join(week, "symbol", "left"))


def _baseline_sql(days: int) -> str:
    cut = f"FROM history WHERE date >= DATE '2024-01-31' - {days} GROUP BY symbol"
    return using("history", f"SELECT symbol, {sql_cols('prev_risk_score=avg(risk_score)')} {cut}")


@query("ag6_historical_baseline", _baseline_sql(30))
def ag6(spark, d):
    return rounded(al.baseline(dom.risk_history(spark, d), dom.SCORED_UNTIL))


@query("ag6_baseline_of_a_week", _baseline_sql(7))
def ag6_week(spark, d):
    return rounded(al.baseline(dom.risk_history(spark, d), dom.SCORED_UNTIL, 7))


cte(
    "rstats",
    """SELECT symbol, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, skewness(ret) AS skew, kurtosis(ret) AS kurtosis,
              min(ret) AS min, max(ret) AS max, avg(ret) * 252 AS annualized_return, stddev_samp(ret) * sqrt(252.0) AS annualized_vol,
              avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252.0), 0) AS sharpe FROM ret GROUP BY symbol""",
    "ret",
)


@query(
    "ag7_return_statistics",
    using("rstats", f"SELECT symbol, {sql_cols('mean; std; skew; kurtosis; min; max; annualized_return; annualized_vol; sharpe', 5)} FROM rstats"),
)
def ag7(spark, d):
    return rounded(agg.return_statistics(returns(spark, d)), 5)


def _describe_sql(table: str, columns: list[str]) -> str:
    one = []
    for c in columns:
        one.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, {sql_cols(f'mean=avg({c}); std=stddev_samp({c}); min=min({c}); max=max({c}); '
            f'p25=quantile_cont({c}, 0.25); p50=quantile_cont({c}, 0.5); p75=quantile_cont({c}, 0.75)', 4)} FROM {table}"""
        )
    return " UNION ALL ".join(one)


@query("ag8_describe", using("vol21", _describe_sql("vol21", ["close", "ret", "volatility_21d"])))
def ag8(spark, d):
    return rounded(agg.describe(vol21(spark, d), ["close", "ret", "volatility_21d"]), 4)


@query(
    "ag9_level_distribution",
    using("history", f"SELECT risk_level, count(*) AS n, {sql_cols('pct=count(*) * 100.0 / (SELECT count(*) FROM history)')} FROM history GROUP BY risk_level"),
)
def ag9(spark, d):
    return rounded(agg.value_counts(dom.risk_history(spark, d), "risk_level"))


@query(
    "ag10_alert_counts",
    using("balerts", "SELECT alert_type, severity, count(*) AS n FROM balerts GROUP BY GROUPING SETS ((alert_type), (severity), ())"),
)
def ag10(spark, d):
    return al.alert_counts(dom.brand_alerts(spark, d))


@query(
    "ag11_coverage",
    using("bars", "SELECT symbol, strftime(date, '%Y-%m') AS month, count(close) AS closes FROM bars GROUP BY ALL"),
)
def ag11(spark, d):
    return agg.coverage(dom.daily_bars(spark, d))


@query(
    "ag11_coverage_of_a_year",
    using(
        "bars",
        "SELECT symbol, "
        + ", ".join(f"count(close) FILTER (WHERE strftime(date, '%Y-%m') = '2000-{m:02d}') AS \"2000-{m:02d}\"" for m in range(1, 13))
        + " FROM bars GROUP BY symbol",
    ),
)
def ag11_year(spark, d):
    return agg.coverage_table(dom.daily_bars(spark, d), [f"2000-{m:02d}" for m in range(1, 13)])


cte("ndays", "SELECT symbol, count(*) AS n, min(date) AS first_date FROM bars GROUP BY symbol", "bars")


@query(
    "ag12_history_lengths",
    using(
        "ndays",
        f"""SELECT min(n) AS min_days, first(symbol ORDER BY n, symbol) AS min_symbol, max(n) AS max_days,
        last(symbol ORDER BY n, symbol) AS max_symbol, {sql_cols('mean_days=avg(n)')} FROM ndays""",
    ),
)
def ag12(spark, d):
    return rounded(agg.history_lengths(dom.daily_bars(spark, d)))


@query(
    "ag12_short_histories",
    using("ndays", "SELECT symbol, n AS days, first_date FROM ndays WHERE n < (SELECT quantile_cont(n, 0.25) FROM ndays)"),
)
def ag12_short(spark, d):
    return agg.short_histories(dom.daily_bars(spark, d))


@query(
    "ag13_null_audit",
    using(
        "vol21",
        "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in ("symbol", "date", "close", "ret", "volatility_21d")) + " FROM vol21",
    ),
)
def ag13(spark, d):
    return agg.null_audit(vol21(spark, d).select("symbol", "date", "close", "ret", "volatility_21d"))


@query(
    "ag14_sector_volatility",
    using("vol21full stocks", f"SELECT sector, date, {sql_cols('sector_vol=avg(volatility_21d)')} FROM vol21full JOIN stocks USING (symbol) GROUP BY sector, date"),
)
def ag14(spark, d):
    df = rl.add_volatility(returns(spark, d), {"volatility_21d": (21, None)})
    return rounded(agg.sector_mean(df, dom.stocks(spark, d), "volatility_21d", "sector_vol"))


@query(
    "ag15_average_volatility",
    using("vol21full", f"SELECT symbol, {sql_cols('avg_volatility=avg(volatility_21d)')} FROM vol21full GROUP BY symbol"),
)
def ag15(spark, d):
    df = rl.add_volatility(returns(spark, d), {"volatility_21d": (21, None)})
    return rounded(df.groupBy("symbol").agg(F.avg("volatility_21d").alias("avg_volatility")).orderBy("avg_volatility"))


_RATE = """SELECT '{kind}' AS kind, {key} AS bucket, {rate}, count(*) AS n FROM fwd_dd2 GROUP BY 2"""
cte("fwd_dd2", "SELECT *, CASE WHEN forward_drawdown <= CAST(-0.1 AS DOUBLE) THEN 1 ELSE 0 END AS target FROM fwd_dd", "fwd_dd")


@query(
    "ag16_positive_rate",
    using(
        "fwd_dd2",
        " UNION ALL ".join(
            _RATE.format(kind=kind, key=key, rate=sql_cols("positive_rate=avg(target)"))
            for kind, key in (
                ("month", "strftime(date, '%Y-%m')"), ("symbol", "symbol"), ("year", "strftime(date, '%Y')"),
            )
        ),
    ),
)
def ag16(spark, d):
    df = rl.add_forward_drawdown(dom.daily_bars(spark, d))
    keys = {"month": F.date_format("date", "yyyy-MM"), "symbol": F.col("symbol"), "year": F.date_format("date", "yyyy")}
    out = None
    for kind, key in keys.items():
        part = agg.positive_rate(df, key.alias("bucket")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


cte("fwdvol", f"SELECT symbol, date, {_ahead_vol(1, 21, 'stddev_samp')} AS fwd FROM retv", "retv")


@query(
    "ag18_quantile_per_date",
    using("fwdvol", f"SELECT date, {sql_cols('edge=quantile_cont(fwd, 0.7)')} FROM fwdvol WHERE fwd IS NOT NULL GROUP BY date"),
)
def ag18(spark, d):
    df = dom.daily_bars(spark, d).withColumn("log_ret", rl.log_return()).withColumn("fwd", rl.forward_vol_sample())
    return rounded(exact_quantiles(df.select("date", "fwd"), "fwd", {"edge": 0.70}, ["date"]))


@query(
    "ag18_quantile_global",
    using(
        "fwdvol",
        f"""SELECT {sql_cols("q70=quantile_cont(fwd, 0.7); q50=quantile_cont(fwd, 0.5); day78=(SELECT quantile_cont(date - DATE '1970-01-01', 0.78) FROM fwdvol)")} FROM fwdvol""",
    ),
)
def ag18_global(spark, d):
    df = dom.daily_bars(spark, d).withColumn("log_ret", rl.log_return()).withColumn("fwd", rl.forward_vol_sample())
    df = df.select("fwd", F.datediff("date", F.lit("1970-01-01")).alias("day"))
    day = exact_quantiles(df, "day", {"day78": 0.78})
    return rounded(exact_quantiles(df, "fwd", {"q70": 0.70, "q50": 0.50}, ranged=True).withColumn("day78", day.scalar()))


_HIST = f"""SELECT symbol, bin_no, {{center}}, count(ret) AS count FROM (
    SELECT g.symbol, g.bin_no, g.lo, g.w, r.ret FROM (
      SELECT symbol, lo, w, unnest(range(40)) AS bin_no FROM (SELECT symbol, min(ret) * 100 AS lo, (max(ret) * 100 - min(ret) * 100) / 40 AS w FROM ret GROUP BY symbol)) g
    LEFT JOIN (SELECT r.symbol, ret, CAST(least(floor((ret * 100 - lo) / w), 39) AS BIGINT) AS bin_no FROM ret r
               JOIN (SELECT symbol, min(ret) * 100 AS lo, (max(ret) * 100 - min(ret) * 100) / 40 AS w FROM ret GROUP BY symbol) USING (symbol)
               WHERE ret IS NOT NULL) r USING (symbol, bin_no)) GROUP BY symbol, bin_no, lo, w"""


@query("ag19_histogram", using("ret", _HIST.format(center=sql_cols("center=lo + (bin_no + 0.5) * w", 5))))
def ag19(spark, d):
    df = returns(spark, d).withColumn("pct", F.col("ret") * 100)
    return rounded(agg.histogram(df, "pct"), 5)


@query(
    "ag20_distinct_symbols",
    using("bars", "SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates FROM bars"),
)
def ag20(spark, d):
    bars = dom.daily_bars(spark, d)
    return bars.agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("dates"))


@query(
    "ag21_digest_summary",
    using(
        "scores",
        f"""SELECT count(*) AS total_stocks, {sql_levels('_risk')}, {sql_cols('avg_risk_score=avg(risk_score)')},
        (SELECT string_agg(symbol || ':' || risk_level, ',' ORDER BY r, symbol) FROM (
           SELECT symbol, risk_level, rank() OVER (ORDER BY risk_score DESC) AS r FROM scores ORDER BY r, symbol LIMIT 10)) AS top_risks FROM scores""",
    ),
)
def ag21(spark, d):
    from riskframe.scale import rank_column

    scores = rank_column(dom.current_scores(spark, d), "risk_score", "risk_rank", descending=True)
    return rounded(agg.digest_summary(scores))


@query(
    "ag23_component_means",
    using("normed", f"SELECT {sql_cols('norm_volatility=avg(norm_volatility); norm_drawdown=avg(norm_drawdown); norm_sentiment=avg(norm_sentiment); norm_liquidity=avg(norm_liquidity)')} FROM normed"),
)
def ag23(spark, d):
    from riskframe.operators.scoring import weighted_scores
    from riskframe.plans.q_core import latest_features

    df = weighted_scores(latest_features(spark, d))
    parts = ["norm_volatility", "norm_drawdown", "norm_sentiment", "norm_liquidity"]
    return rounded(df.agg(*[F.avg(c).alias(c) for c in parts]))


# ---- top-k ------------------------------------------------------------------------------

cte("ranked", "SELECT *, rank() OVER (ORDER BY risk_score DESC) AS risk_rank FROM scores", "scores")


def ranked_scores(spark, d):
    from riskframe.scale import rank_column

    return rank_column(dom.current_scores(spark, d), "risk_score", "risk_rank", descending=True)


@query("tk1_top_risks", using("ranked", f"SELECT symbol, {sql_cols('risk_score')}, risk_rank FROM ranked ORDER BY risk_rank, symbol LIMIT 10"))
def tk1(spark, d):
    return rounded(sel.top_risks(ranked_scores(spark, d)).select("symbol", "risk_score", "risk_rank"))


@query(
    "tk2_largest_and_smallest",
    using(
        "scores",
        f"""SELECT 'top' AS side, * FROM (SELECT symbol, {sql_cols('risk_score')} FROM scores ORDER BY scores.risk_score DESC, symbol LIMIT 10)
        UNION ALL SELECT 'bottom', * FROM (SELECT symbol, {sql_cols('risk_score')} FROM scores ORDER BY scores.risk_score, symbol LIMIT 5)""",
    ),
)
def tk2(spark, d):
    s = dom.current_scores(spark, d).select("symbol", "risk_score")
    high = sel.largest(s, "risk_score", 10).withColumn("side", F.lit("top"))
    return rounded(high.unionByName(sel.smallest(s, "risk_score", 5).withColumn("side", F.lit("bottom"))))


@query(
    "tk3_recent_alerts",
    using("balerts", f"SELECT alert_id, symbol, severity, {sql_cols('risk_score')}, created_at FROM balerts ORDER BY created_at DESC, alert_id LIMIT 100"),
)
def tk3(spark, d):
    return rounded(al.recent_alerts(dom.brand_alerts(spark, d)).select("alert_id", "symbol", "severity", "risk_score", "created_at"))


@query(
    "tk4_filter_after_limit",
    using("balerts", "SELECT alert_id, symbol FROM (SELECT * FROM balerts ORDER BY created_at DESC, alert_id LIMIT 100) WHERE severity = 'MEDIUM'"),
)
def tk4(spark, d):
    return al.recent_alerts(dom.brand_alerts(spark, d), "MEDIUM").select("alert_id", "symbol")


_ORDERS = {
    "risk_desc": "risk_score DESC", "risk_asc": "risk_score", "symbol_asc": "symbol", "symbol_desc": "symbol DESC",
    "sentiment_desc": "coalesce(avg_sentiment, 0) DESC", "sentiment_asc": "coalesce(avg_sentiment, 0)",
}


@query(
    "tk5_table_orders",
    using(
        "universe",
        " UNION ALL ".join(
            f"SELECT '{n}' AS ordering, symbol, row_number() OVER (ORDER BY {o}, symbol) AS position FROM universe QUALIFY position <= 12"
            for n, o in _ORDERS.items()
        ),
    ),
)
def tk5(spark, d):
    u = dom.scored_universe(spark, d)
    out = None
    for name in sel.SCORE_ORDERS:
        part = sel.sorted_scores(u, name, 12).select(F.lit(name).alias("ordering"), "symbol", "position")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "tk6_best_worst_days",
    using(
        "ret",
        f"""SELECT symbol, date, {sql_rnd('p')} AS return_pct, side FROM (
        SELECT symbol, date, p, 'worst' AS side, row_number() OVER (PARTITION BY symbol ORDER BY p, date) AS rn FROM (SELECT symbol, date, round(ret * 100, 2) AS p FROM ret WHERE ret IS NOT NULL)
        UNION ALL SELECT symbol, date, p, 'best', row_number() OVER (PARTITION BY symbol ORDER BY p DESC, date DESC) FROM (SELECT symbol, date, round(ret * 100, 2) AS p FROM ret WHERE ret IS NOT NULL))
        WHERE rn <= 5""",
    ),
)
def tk6(spark, d):
    return rounded(sel.best_worst_days(returns(spark, d)).drop("rn"))


@query(
    "tk7_strongest_features",
    using(
        "normed",
        f"""SELECT symbol, name, {sql_rnd('value')} AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(value) DESC, name) AS rn FROM (
          UNPIVOT (SELECT symbol, norm_volatility - 0.5 AS a_vol, norm_drawdown - 0.5 AS b_dd, norm_sentiment - 0.5 AS c_sent, norm_liquidity - 0.5 AS d_liq FROM normed)
          ON a_vol, b_dd, c_sent, d_liq INTO NAME name VALUE value)) WHERE rn <= 3""",
    ),
)
def tk7(spark, d):
    from riskframe.operators.scoring import weighted_scores
    from riskframe.plans.q_core import latest_features

    df = weighted_scores(latest_features(spark, d))
    parts = {"a_vol": "norm_volatility", "b_dd": "norm_drawdown", "c_sent": "norm_sentiment", "d_liq": "norm_liquidity"}
    entries = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(c) - 0.5).alias("value")) for n, c in parts.items()])
    top = df.select("symbol", F.explode(sel.strongest(entries, 3)).alias("e"))
    return rounded(top.select("symbol", "e.name", "e.value"))


@query(
    "tk8_worst_drawdowns",
    using(
        "episodes",
        f"""SELECT symbol, start, {sql_cols('depth')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, start) AS rn FROM episodes) WHERE rn <= 10""",
    ),
)
def tk8(spark, d):
    eps = dd.drawdown_episodes(dom.daily_bars(spark, d))
    return rounded(top_per_key(eps, ["symbol"], [F.asc("depth"), F.asc("start")], 10).select("symbol", "start", "depth"))


@query(
    "tk9_alerts_per_symbol",
    using(
        "balerts",
        """SELECT symbol, alert_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC, alert_id) AS rn
        FROM (SELECT * FROM balerts ORDER BY created_at DESC, alert_id LIMIT 100)) WHERE rn <= 10""",
    ),
)
def tk9(spark, d):
    newest = al.recent_alerts(dom.brand_alerts(spark, d))
    return top_per_key(newest, ["symbol"], [F.desc("created_at"), F.asc("alert_id")], 10).select("symbol", "alert_id")


@query(
    "tk10_transaction_history",
    """SELECT o_custkey AS user_id, p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS ord, l_quantity AS quantity
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""",
)
def tk10(spark, d):
    tx = dom.transactions(spark, d).select("user_id", "symbol", "date", "ord", "quantity")
    return tx.orderBy("user_id", F.desc("date"), F.desc("ord"))


# ---- set operations ------------------------------------------------------------------------


@query(
    "st1_union_of_frames",
    using("balerts scores", f"SELECT alert_id, symbol, {sql_cols('risk_score')} FROM balerts UNION ALL SELECT 'feed/' || symbol, symbol, {sql_cols('risk_score')} FROM scores"),
)
def st1(spark, d):
    feed = dom.current_scores(spark, d).select(F.concat(F.lit("feed/"), "symbol").alias("alert_id"), "symbol", "risk_score")
    return rounded(dom.brand_alerts(spark, d).select("alert_id", "symbol", "risk_score").unionByName(feed))


@query("st2_dedup_by_url", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def st2(spark, d):
    return sel.dedup_first(dom.table(spark, d, "pages").select("page_id", "url"), "url", ["page_id"])


@query(
    "st3_dedup_ranked_sources",
    """WITH hits AS (SELECT lang AS query_id, source AS url, doc_id AS rank FROM documents)
    SELECT query_id, url, min(rank) AS rank FROM hits GROUP BY 1, 2""",
)
def st3(spark, d):
    hits = dom.table(spark, d, "documents").select(
        F.col("lang").alias("query_id"), F.col("source").alias("url"), F.col("doc_id").alias("rank")
    )
    return sel.dedup_ranked(hits)


@query("st4_symbol_difference", using("bars stocks", "SELECT symbol FROM stocks EXCEPT SELECT symbol FROM bars WHERE close > 100000"))
def st4(spark, d):
    bars = dom.daily_bars(spark, d).where("close > 100000").select("symbol")
    return dom.stocks(spark, d).select("symbol").exceptAll(bars.distinct())


@query(
    "st5_date_intersection",
    using("bars", "SELECT date FROM bars INTERSECT SELECT CAST(o_orderdate AS DATE) AS date FROM orders"),
)
def st5(spark, d):
    ordered = dom.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return dom.daily_bars(spark, d).select("date").intersect(ordered)


@query(
    "st6_last_wins",
    "SELECT CAST(user_id AS VARCHAR) AS symbol, last(event_type ORDER BY ts, event_id) AS event_type, last(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY user_id",
)
def st6(spark, d):
    events = dom.table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts", "event_id", "event_type")
    return sel.last_wins(events, "symbol", ["ts", "event_id"]).select("symbol", "event_type", "event_id")
