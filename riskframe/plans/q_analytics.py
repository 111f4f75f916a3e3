"""Risk and portfolio analytics (QA) and the pair join behind them (JN8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import analytics as qa
from riskframe.operators import rolling as rl
from riskframe.operators import selection as sel
from riskframe.operators.pairs import covariances, pair_moments
from riskframe.plans import q_relational as _shared  # noqa: F401 - defines shared tables
from riskframe.plans.sqlkit import cte, query, rnd, rounded, sql_cols, sql_rnd, using
from riskframe.session import materialise
from riskframe.sources import domain as dom
from riskframe.sources.domain import AS_OF

cte(
    "aret",
    """SELECT symbol, date, ret FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM aligned)
       WHERE ret IS NOT NULL""",
    "aligned",
    materialised=True,
)
cte(
    "apairs",
    """SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, corr(a.ret, b.ret) AS corr, covar_samp(a.ret, b.ret) AS cov
       FROM aret a JOIN aret b USING (date) GROUP BY 1, 2""",
    "aret",
    materialised=True,
)
cte("wr", "SELECT symbol, date, ret FROM wret WHERE ret IS NOT NULL", "wret", materialised=True)
cte("dr", "SELECT symbol, date, ret FROM ret WHERE ret IS NOT NULL", "ret", materialised=True)
cte(
    "dr90",
    """SELECT symbol, date, ret FROM (
         SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars WHERE date >= DATE '2001-11-04' - 90)
       WHERE ret IS NOT NULL""",
    "bars",
    materialised=True,
)
#: Bars of the portfolio queries are weekly: no day has a trade of every brand.
WEEKS = 52


@query(
    "jn8_symbol_pairs",
    using("dr", f"SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, {sql_cols('cov=covar_samp(a.ret, b.ret)', 5)} FROM dr a JOIN dr b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2"),
)
def jn8(spark, d):
    rets = rl.add_returns(dom.daily_bars(spark, d))
    return rounded(covariances(pair_moments(rets, block=8, span_days=365)).select("a", "b", "n", "cov"), 5)


@query("qa1_correlation_matrix", using("apairs", f"SELECT a, b, n, {sql_cols('corr', 5)} FROM apairs"))
def qa1(spark, d):
    return rounded(qa.correlation_matrix(dom.weekly_bars(spark, d)), 5)


@query(
    "qa2_pairwise_correlation",
    using("dr", f"SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, {sql_cols('corr=corr(a.ret, b.ret)', 5)} FROM dr a JOIN dr b USING (date) GROUP BY 1, 2"),
)
def qa2(spark, d):
    return rounded(qa.correlation_matrix(dom.daily_bars(spark, d), complete=False), 5)


@query(
    "qa2_correlation_of_90_days",
    using("dr90", f"SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, {sql_cols('corr=corr(a.ret, b.ret)', 5)} FROM dr90 a JOIN dr90 b USING (date) GROUP BY 1, 2"),
)
def qa2_recent(spark, d):
    return rounded(qa.correlation_matrix(dom.daily_bars(spark, d), complete=False, as_of=AS_OF), 5)


@query(
    "qa2_mean_correlation",
    using("dr", f"SELECT a AS symbol, {sql_cols('mean_corr=avg(c)', 5)} FROM (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS c FROM dr a JOIN dr b USING (date) GROUP BY 1, 2) GROUP BY 1"),
)
def qa2_mean(spark, d):
    return rounded(qa.mean_correlation(qa.correlation_matrix(dom.daily_bars(spark, d), complete=False)), 5)


cte("sret", "SELECT sector, date, avg(ret) AS ret FROM dr JOIN stocks USING (symbol) GROUP BY 1, 2", "dr", "stocks")


@query(
    "qa3_sector_correlation",
    using("sret", f"SELECT a.sector AS a, b.sector AS b, count(*) AS n, {sql_cols('corr=corr(a.ret, b.ret)', 5)} FROM sret a JOIN sret b USING (date) GROUP BY 1, 2"),
)
def qa3(spark, d):
    return rounded(qa.sector_correlation(dom.daily_bars(spark, d), dom.stocks(spark, d)), 5)


cte(
    "vars",
    """SELECT symbol, max(ret) FILTER (WHERE rn = k) AS v, avg(ret) FILTER (WHERE rn <= k) AS es, stddev_pop(ret) AS s, avg(ret) AS m,
              count(*) OVER () AS nsym
       FROM (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret, date) - 1 AS rn,
                    floor(CAST(count(*) OVER (PARTITION BY symbol) AS DOUBLE) * (1 - 0.95::DOUBLE)) AS k FROM ret WHERE ret IS NOT NULL)
       GROUP BY symbol""",
    "ret",
)


@query("qa5_historical_var", using("vars", f"SELECT symbol, {sql_cols('var_pct=v * sqrt(10.0); var_dollar=v * sqrt(10.0) * 100000.0 / nsym', 5)} FROM vars"))
def qa5(spark, d):
    return rounded(qa.value_at_risk(dom.daily_bars(spark, d), horizon=10).select("symbol", "var_pct", "var_dollar"), 5)


@query("qa6_expected_shortfall", using("vars", f"SELECT symbol, {sql_cols('es_pct=es; es_dollar=es * 100000.0 / nsym', 5)} FROM vars"))
def qa6(spark, d):
    return rounded(qa.value_at_risk(dom.daily_bars(spark, d)).select("symbol", "es_pct", "es_dollar"), 5)


@query(
    "qa7_risk_measures",
    using("vars", f"SELECT symbol, {sql_cols('annual_volatility=s * sqrt(252.0); daily_volatility=s; sharpe_ratio=m * 252 / (s * sqrt(252.0)); mean_daily_return=m', 5)} FROM vars"),
)
def qa7(spark, d):
    df = qa.value_at_risk(dom.daily_bars(spark, d), requested=25)
    return rounded(df.select("symbol", "annual_volatility", "daily_volatility", "sharpe_ratio", "mean_daily_return"), 5)


cte(
    "wvars",
    """SELECT symbol, max(ret) FILTER (WHERE rn = k) AS v
       FROM (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret, date) - 1 AS rn,
                    floor(CAST(count(*) OVER (PARTITION BY symbol) AS DOUBLE) * (1 - 0.95::DOUBLE)) AS k FROM wr) GROUP BY symbol""",
    "wr",
)


@query(
    "qa8_portfolio_var",
    using(
        "aret wvars",
        f"""SELECT {sql_cols('var_pct=v; var_dollar=v * 100000; es_pct=es; es_dollar=es * 100000; diversification_benefit=1 - abs(v) / (SELECT avg(abs(v)) FROM wvars)', 5)} FROM (
        SELECT max(ret) FILTER (WHERE rn = k) AS v, avg(ret) FILTER (WHERE rn <= k) AS es FROM (
          SELECT ret, row_number() OVER (ORDER BY ret, date) - 1 AS rn, floor(CAST(count(*) OVER () AS DOUBLE) * (1 - 0.95::DOUBLE)) AS k
          FROM (SELECT date, avg(ret) AS ret FROM aret GROUP BY date)))""",
    ),
)
def qa8(spark, d):
    return rounded(qa.portfolio_var(dom.weekly_bars(spark, d)), 5)


def sql_uniform(*parts: str) -> str:
    key = " || ':' || ".join(parts)
    return f"((CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_normal(*parts: str) -> str:
    return (
        f"(sqrt(-2.0::DOUBLE * ln({sql_uniform(chr(39) + 'r' + chr(39), *parts)}))"
        f" * cos(2.0::DOUBLE * pi() * {sql_uniform(chr(39) + 'a' + chr(39), *parts)}))"
    )


cte(
    "paths",
    f"""SELECT symbol, sim, step, mu, sigma, last_date, last_close * exp(sum(move) OVER (PARTITION BY symbol, sim ORDER BY step)) AS price FROM (
          SELECT *, CASE WHEN step = 0 THEN 0 ELSE mu - sigma * sigma * 0.5::DOUBLE + sigma * z END AS move FROM (
            SELECT symbol, avg(log_ret) AS mu, stddev_pop(log_ret) AS sigma, last(close ORDER BY date) AS last_close, max(date) AS last_date
            FROM retv GROUP BY symbol)
          CROSS JOIN (SELECT sim, step, {sql_normal("'42'", "CAST(sim AS VARCHAR)", "CAST(step AS VARCHAR)")} AS z
                      FROM (SELECT unnest(range(500)) AS sim), (SELECT unnest(range(31)) AS step)))""",
    "retv",
)


_BANDS = "; ".join(f"{n}=quantile_cont(price, {q})" for n, q in qa.BANDS.items())
_BANDS += "; min_price=min(price); max_price=max(price); mean_price=avg(price)"


@query(
    "qa9_monte_carlo",
    using(
        "paths",
        f"""SELECT p.symbol, p.step, c.day AS date, {sql_cols(_BANDS, 2)},
            {sql_cols('daily_drift=max(mu); annual_volatility=max(sigma) * sqrt(252.0)')}
        FROM paths p JOIN (
          SELECT last, CAST(0 AS BIGINT) AS step, last AS day FROM (SELECT DISTINCT last_date AS last FROM paths)
          UNION ALL SELECT last, row_number() OVER (PARTITION BY last ORDER BY day), day FROM (
            SELECT last, CAST(last + CAST(k AS INTEGER) AS DATE) AS day FROM (SELECT DISTINCT last_date AS last FROM paths), (SELECT unnest(range(1, 60)) AS k))
          WHERE isodow(day) < 6) c ON c.last = p.last_date AND c.step = p.step
        GROUP BY p.symbol, p.step, c.day""",
    ),
)
def qa9(spark, d):
    df = qa.monte_carlo(dom.daily_bars(spark, d))
    prices = [*qa.BANDS, "min_price", "max_price", "mean_price"]
    return df.select(
        "symbol", "step", "date", *[rnd(c, 2).alias(c) for c in prices],
        rnd("daily_drift").alias("daily_drift"), rnd("annual_volatility").alias("annual_volatility"),
    )


@query("qa10_annual_covariance", using("apairs", f"SELECT a, b, {sql_cols('cov=cov * 52', 5)} FROM apairs"))
def qa10(spark, d):
    return rounded(qa.annual_covariance(dom.weekly_bars(spark, d), WEEKS), 5)


cte(
    "folios",
    f"""SELECT portfolio, symbol, u / sum(u) OVER (PARTITION BY portfolio) AS w FROM (
        SELECT portfolio, symbol, {sql_uniform("'42'", "CAST(portfolio AS VARCHAR)", "symbol")} AS u
        FROM (SELECT unnest(range(5000)) AS portfolio), (SELECT DISTINCT symbol FROM aret))""",
    "aret",
    materialised=True,
)
cte(
    "perf",
    """SELECT portfolio, r AS annual_return, sqrt(v) AS annual_volatility, CASE WHEN v > 0 THEN (r - 0.05::DOUBLE) / sqrt(v) ELSE 0 END AS sharpe_ratio FROM (
         SELECT portfolio, sum(w * mean) AS r FROM folios JOIN (SELECT symbol, avg(ret) * 52 AS mean FROM aret GROUP BY symbol) USING (symbol) GROUP BY portfolio)
       JOIN (SELECT x.portfolio, sum(x.w * y.w * p.cov * 52) AS v FROM folios x JOIN apairs p ON p.a = x.symbol
             JOIN folios y ON y.portfolio = x.portfolio AND y.symbol = p.b GROUP BY x.portfolio) USING (portfolio)""",
    "folios",
    "apairs",
    materialised=True,
)
PERF = "annual_return; annual_volatility; sharpe_ratio"


def folios(spark, d):
    return qa.random_portfolios(dom.weekly_bars(spark, d), periods_per_year=WEEKS)


@query("qa11_random_portfolios", using("perf", f"SELECT portfolio, {sql_cols(PERF, 5)} FROM perf"))
def qa11(spark, d):
    return rounded(folios(spark, d), 5)


@query(
    "qa12_best_portfolios",
    using(
        "perf",
        f"""SELECT pick, portfolio, {sql_cols(PERF, 5)}, symbol, {sql_rnd('w', 5)} AS weight FROM (
        (SELECT 'min_variance' AS pick, * FROM perf ORDER BY annual_volatility, portfolio LIMIT 1)
        UNION ALL (SELECT 'max_sharpe', * FROM perf ORDER BY sharpe_ratio DESC, portfolio LIMIT 1)) JOIN folios USING (portfolio)""",
    ),
)
def qa12(spark, d):
    picks = materialise(qa.best_portfolios(folios(spark, d)), "picks")
    return rounded(picks.join(qa.portfolio_weights(picks, dom.weekly_bars(spark, d)), "portfolio"), 5)


@query(
    "qa13_equal_weight",
    using(
        "apairs aret",
        f"""SELECT {sql_cols('annual_return=r; annual_volatility=sqrt(v); sharpe_ratio=(r - 0.05) / sqrt(v)', 5)} FROM
        (SELECT avg(mean) AS r FROM (SELECT avg(ret) * 52 AS mean FROM aret GROUP BY symbol)),
        (SELECT sum(cov * 52) / ((SELECT count(DISTINCT symbol) FROM aret) ** 2) AS v FROM apairs)""",
    ),
)
def qa13(spark, d):
    return rounded(qa.equal_weight(dom.weekly_bars(spark, d), periods_per_year=WEEKS), 5)


@query(
    "qa14_tk11_efficient_frontier",
    using(
        "perf",
        f"""SELECT portfolio, {sql_cols('annual_return; annual_volatility', 5)}, position FROM (
        SELECT *, row_number() OVER (ORDER BY annual_volatility, portfolio) - 1 AS position FROM perf) WHERE position % greatest(1, (SELECT count(*) FROM perf) // 50) = 0""",
    ),
)
def qa14(spark, d):
    return rounded(qa.efficient_frontier(materialise(folios(spark, d), "portfolios")), 5)


@query(
    "qa15_period_returns",
    using(
        "bars",
        f"""SELECT symbol, {sql_cols('; '.join(f"return_{n}=max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn = {k + 1}) - 1" for n, k in qa.PERIODS.items()))}
        FROM (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) GROUP BY symbol""",
    ),
)
def qa15(spark, d):
    return rounded(qa.period_returns(dom.daily_bars(spark, d)))


@query(
    "qa16_return_distribution",
    using(
        "ret",
        f"""SELECT symbol, {sql_cols('mean=avg(ret * 100); std=stddev_pop(ret * 100); skew=skewness(ret); kurtosis=kurtosis(ret); min=min(ret * 100); max=max(ret * 100)', 5)},
        count(*) FILTER (WHERE ret > 0) AS positive_days, count(*) FILTER (WHERE ret < 0) AS negative_days, count(ret) AS total_days FROM ret GROUP BY symbol""",
    ),
)
def qa16(spark, d):
    return rounded(qa.return_distribution(dom.daily_bars(spark, d)), 5)


@query(
    "qa17_risk_return",
    using("rstats stocks", f"SELECT symbol, {sql_cols('annualized_return; annualized_vol; sharpe', 5)}, sector FROM rstats LEFT JOIN stocks USING (symbol)"),
)
def qa17(spark, d):
    return rounded(qa.risk_return_table(dom.daily_bars(spark, d), dom.stocks(spark, d)), 5)


@query(
    "qa18_best_and_worst_sharpe",
    using(
        "rstats",
        f"""(SELECT 'best' AS side, symbol, {sql_cols('sharpe', 5)} FROM rstats ORDER BY rstats.sharpe DESC, symbol LIMIT 10)
        UNION ALL (SELECT 'worst', symbol, {sql_cols('sharpe', 5)} FROM rstats ORDER BY rstats.sharpe, symbol LIMIT 10)""",
    ),
)
def qa18(spark, d):
    table = qa.risk_return_table(dom.daily_bars(spark, d), dom.stocks(spark, d)).select("symbol", "sharpe")
    best = sel.largest(table, "sharpe", 10).withColumn("side", F.lit("best"))
    return rounded(best.unionByName(sel.smallest(table, "sharpe", 10).withColumn("side", F.lit("worst"))), 5)
