"""Portfolios (PF), their totals (AG22) and alerts (AL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import aggregates as agg
from riskframe.operators import alerts as al
from riskframe.operators import entities as ent
from riskframe.operators import portfolio as pf
from riskframe.plans import q_relational as _shared  # noqa: F401 - defines shared tables
from riskframe.plans.sqlkit import cte, query, rnd, rounded, sql_cols, using
from riskframe.sources import domain as dom

cte(
    "ledger",
    """SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY date, ord, price, quantity) AS rn FROM (
         SELECT o_custkey AS user_id, p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS ord,
                l_returnflag <> 'R' AS buy, l_quantity AS quantity, l_extendedprice / l_quantity AS price
         FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 0)""",
    materialised=True,
)
cte(
    "folded",
    """SELECT user_id, symbol, rn, date, ord, quantity, price, buy AS ok,
              CASE WHEN buy THEN quantity ELSE CAST(0 AS DOUBLE) END AS held, CASE WHEN buy THEN price ELSE CAST(0 AS DOUBLE) END AS avg_price,
              CASE WHEN buy THEN date END AS opened
       FROM ledger WHERE rn = 1
       UNION ALL
       SELECT l.user_id, l.symbol, l.rn, l.date, l.ord, l.quantity, l.price, l.buy OR l.quantity <= f.held,
              CASE WHEN l.buy THEN f.held + l.quantity WHEN l.quantity <= f.held THEN f.held - l.quantity ELSE f.held END,
              CASE WHEN l.buy THEN (f.held * f.avg_price + l.quantity * l.price) / (f.held + l.quantity) ELSE f.avg_price END,
              CASE WHEN l.buy AND f.held = 0 THEN l.date ELSE f.opened END
       FROM folded f JOIN ledger l ON l.user_id = f.user_id AND l.symbol = f.symbol AND l.rn = f.rn + 1""",
    "ledger",
    columns="user_id, symbol, rn, date, ord, quantity, price, ok, held, avg_price, opened",
)
cte(
    "held",
    """SELECT user_id, symbol, held AS quantity, avg_price, opened FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY rn DESC) AS back FROM folded) WHERE back = 1 AND held > 0""",
    "folded",
    materialised=True,
)
cte(
    "value_held",
    """SELECT h.*, coalesce(nullif(c.close, 0), h.avg_price) AS current_price, h.quantity * coalesce(nullif(c.close, 0), h.avg_price) AS current_value,
              h.quantity * h.avg_price AS cost_basis
       FROM held h LEFT JOIN (SELECT symbol, last(close ORDER BY date) AS close FROM bars GROUP BY symbol) c USING (symbol)""",
    "held",
    "bars",
)


@query("pf1_holdings", using("held", f"SELECT user_id, symbol, {sql_cols('quantity; avg_price', 4)}, opened FROM held"))
def pf1(spark, d):
    return rounded(pf.holdings_from_transactions(dom.transactions(spark, d)), 4)


@query(
    "pf2_rejected_transactions",
    using("folded", f"SELECT user_id, symbol, date, ord, quantity, {sql_cols('price', 4)}, 'sale exceeds holding' AS reason FROM folded WHERE NOT ok"),
)
def pf2(spark, d):
    return pf.rejected_transactions(dom.transactions(spark, d)).withColumn("price", rnd("price", 4))


def valued(spark, d):
    holdings = pf.holdings_from_transactions(dom.transactions(spark, d))
    return ent.value_holdings(holdings, dom.stocks(spark, d), dom.daily_bars(spark, d), dom.brand_scores(spark, d))


@query(
    "pf3_valuation",
    using(
        "value_held blatest stocks",
        f"""SELECT user_id, symbol, {sql_cols('quantity')}, {sql_cols('current_price; current_value; cost_basis; gain_loss=current_value - cost_basis;'
        'gain_loss_pct=CASE WHEN cost_basis > 0 THEN (current_value - cost_basis) / cost_basis * 100 ELSE 0 END', 3)}, risk_level, sector
        FROM value_held LEFT JOIN blatest USING (symbol) LEFT JOIN stocks USING (symbol)""",
    ),
)
def pf3(spark, d):
    v = valued(spark, d)
    money = ["current_price", "current_value", "cost_basis", "gain_loss", "gain_loss_pct"]
    return v.select("user_id", "symbol", rnd("quantity").alias("quantity"), *[rnd(c, 3).alias(c) for c in money], "risk_level", "sector")


_TOTALS = """total_value=sum(current_value); total_cost=sum(cost_basis); total_gain_loss=sum(current_value) - sum(cost_basis);
    total_gain_loss_pct=CASE WHEN sum(cost_basis) > 0 THEN (sum(current_value) - sum(cost_basis)) / sum(cost_basis) * 100 ELSE 0 END"""


@query(
    "pf4_ag22_portfolio_summary",
    using("value_held", f"SELECT user_id, {sql_cols(_TOTALS, 3)}, count(*) AS holdings_count FROM value_held GROUP BY user_id"),
)
def pf4(spark, d):
    return rounded(pf.portfolio_summary(valued(spark, d)), 3)


@query(
    "pf5_default_symbols",
    using(
        "held stocks",
        """, asked AS (SELECT c_custkey AS user_id, 'Brand#7' AS symbol FROM customer WHERE c_mktsegment = 'BUILDING'),
        own AS (SELECT DISTINCT user_id, symbol FROM held WHERE user_id NOT IN (SELECT user_id FROM asked))
        SELECT * FROM asked UNION ALL SELECT * FROM own UNION ALL
        SELECT c_custkey, s.symbol FROM customer, (SELECT symbol FROM stocks WHERE is_active ORDER BY symbol LIMIT 10) s
        WHERE c_custkey NOT IN (SELECT user_id FROM asked) AND c_custkey NOT IN (SELECT user_id FROM own)""",
    ),
)
def pf5(spark, d):
    customers = dom.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    asked = customers.where("c_mktsegment = 'BUILDING'").select("user_id", F.lit("Brand#7").alias("symbol"))
    holdings = pf.holdings_from_transactions(dom.transactions(spark, d))
    return pf.default_symbols(customers, asked, holdings, dom.stocks(spark, d))


# ---- alerts ---------------------------------------------------------------------------

cte("cur", "SELECT symbol, risk_score, risk_level, 'Feed' AS risk_drivers FROM scores", "scores")
cte("basel", "SELECT symbol, avg(risk_score) AS p FROM history WHERE date >= DATE '2024-01-31' - 30 GROUP BY symbol", "history")
cte(
    "alerts0",
    """SELECT symbol, 'high_risk' AS alert_type, 'HIGH' AS severity, risk_score, CAST(NULL AS DOUBLE) AS prev_risk_score, CAST(NULL AS DOUBLE) AS risk_change,
              CAST(NULL AS DOUBLE) AS risk_change_pct, risk_level, risk_drivers FROM cur WHERE risk_level = 'High'
       UNION ALL
       SELECT symbol, 'sudden_spike', 'MEDIUM', risk_score, p, risk_score - p, CASE WHEN p > 0 THEN (risk_score - p) / p * 100 ELSE 0 END, risk_level, risk_drivers
       FROM cur JOIN basel USING (symbol) WHERE risk_score - p > 0.15 OR CASE WHEN p > 0 THEN (risk_score - p) / p * 100 ELSE 0 END > 20""",
    "cur",
    "basel",
)
ALERT_SELECT = f"symbol, alert_type, severity, {sql_cols('risk_score; prev_risk_score; risk_change; risk_change_pct')}, risk_level, risk_drivers"


def current(spark, d):
    return dom.current_scores(spark, d).withColumn("risk_drivers", F.lit("Feed"))


def alerts(spark, d):
    return al.all_alerts(current(spark, d), dom.risk_history(spark, d), dom.SCORED_UNTIL)


@query("al1_high_risk_alerts", using("alerts0", f"SELECT {ALERT_SELECT} FROM alerts0 WHERE alert_type = 'high_risk'"))
def al1(spark, d):
    return rounded(al.high_risk_alerts(current(spark, d)))


@query("al2_spike_alerts", using("alerts0", f"SELECT {ALERT_SELECT} FROM alerts0 WHERE alert_type = 'sudden_spike'"))
def al2(spark, d):
    return rounded(al.spike_alerts(current(spark, d), dom.risk_history(spark, d), dom.SCORED_UNTIL))


@query(
    "al2_spikes_against_two_weeks",
    using(
        "cur history",
        """SELECT symbol, risk_score > p + CAST(0.15 AS DOUBLE) AS absolute FROM cur JOIN
        (SELECT symbol, avg(risk_score) AS p FROM history WHERE date >= DATE '2024-01-31' - 14 GROUP BY symbol) USING (symbol)
        WHERE risk_score - p > 0.15 OR CASE WHEN p > 0 THEN (risk_score - p) / p * 100 ELSE 0 END > 20""",
    ),
)
def al2_two_weeks(spark, d):
    spikes = al.spike_alerts(current(spark, d), dom.risk_history(spark, d), dom.SCORED_UNTIL, 14)
    return spikes.select("symbol", (F.col("risk_score") > F.col("prev_risk_score") + 0.15).alias("absolute"))


@query("al3_combined_alerts", using("alerts0", f"SELECT {ALERT_SELECT} FROM alerts0"))
def al3(spark, d):
    return rounded(alerts(spark, d))


@query(
    "al4_basic_explanation",
    using("alerts0", "SELECT symbol, alert_type, 'Alert for ' || symbol || ': ' || risk_drivers AS explanation FROM alerts0"),
)
def al4(spark, d):
    return al.basic_explanations(alerts(spark, d)).select("symbol", "alert_type", "explanation")


cte(
    "prefs",
    """SELECT c_custkey AS user_id, c_custkey % 2 = 0 AS alerts_enabled, c_custkey % 3 <> 0 AS high_risk_alerts, c_custkey % 5 = 0 AS medium_risk_alerts,
              c_custkey % 4 = 0 AS watchlist_only, c_custkey % 3 = 1 AS daily_digest FROM customer""",
)


@query(
    "al6_recipient_digests",
    using(
        "prefs wlist balerts",
        """SELECT user_id, CAST(n AS BIGINT) AS alerts, CAST(h AS BIGINT) AS high, CAST(n AS BIGINT) || CASE WHEN n = 1 THEN ' Risk Alert' ELSE ' Risk Alerts' END
             || CASE WHEN h > 0 THEN ' (' || CAST(h AS BIGINT) || ' High Risk)' ELSE '' END AS subject FROM (
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE severity = 'HIGH') AS h FROM prefs p JOIN balerts a
          ON ((a.severity = 'HIGH' AND p.high_risk_alerts) OR (a.severity = 'MEDIUM' AND p.medium_risk_alerts))
          AND (NOT p.watchlist_only OR EXISTS (SELECT 1 FROM wlist w WHERE w.user_id = p.user_id AND w.symbol = a.symbol))
        WHERE p.alerts_enabled GROUP BY user_id)""",
    ),
)
def al6(spark, d):
    return al.recipient_digests(dom.brand_alerts(spark, d), dom.preferences(spark, d), dom.watchlist(spark, d))


@query(
    "al7_digest_recipients",
    using(
        "scores prefs",
        f"""SELECT user_id, total_stocks, high_risk, {sql_cols('avg_risk_score')} FROM prefs, (
        SELECT count(*) AS total_stocks, count(*) FILTER (WHERE risk_level = 'High') AS high_risk, avg(risk_score) AS avg_risk_score FROM scores)
        WHERE daily_digest""",
    ),
)
def al7(spark, d):
    from riskframe.scale import rank_column

    ranked = rank_column(dom.current_scores(spark, d), "risk_score", "risk_rank", descending=True)
    digest = agg.digest_summary(ranked).select(F.struct("total_stocks", "high_risk", "avg_risk_score").alias("s"))
    out = dom.preferences(spark, d).where("daily_digest").withColumn("_s", digest.scalar())
    return rounded(out.select("user_id", "_s.*"))


@query(
    "al8_user_rules",
    using(
        "universe wlist",
        f"""SELECT user_id, symbol, condition, {sql_cols('risk_score')} FROM (
        SELECT user_id, symbol, CASE notes WHEN 'BUILDING' THEN 'risk_above' WHEN 'MACHINERY' THEN 'risk_below' WHEN 'AUTOMOBILE' THEN 'sentiment_negative' ELSE 'other' END AS condition,
               CASE notes WHEN 'AUTOMOBILE' THEN 0.0 ELSE 0.5 END AS threshold FROM wlist)
        JOIN universe USING (symbol) WHERE CASE condition WHEN 'risk_above' THEN risk_score > threshold WHEN 'risk_below' THEN risk_score < threshold
          WHEN 'sentiment_negative' THEN avg_sentiment < threshold ELSE false END""",
    ),
)
def al8(spark, d):
    kind = (
        F.when(F.col("notes") == "BUILDING", "risk_above").when(F.col("notes") == "MACHINERY", "risk_below")
        .when(F.col("notes") == "AUTOMOBILE", "sentiment_negative").otherwise("other")
    )
    rules = dom.watchlist(spark, d).select(
        "user_id", "symbol", kind.alias("condition"), F.when(F.col("notes") == "AUTOMOBILE", 0.0).otherwise(0.5).alias("threshold"),
        F.lit(True).alias("is_active"),
    )
    return rounded(al.rule_hits(rules, dom.scored_universe(spark, d)).select("user_id", "symbol", "condition", "risk_score"))


@query(
    "al9_unread_counts",
    "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'view') AS unread, count(*) FILTER (WHERE event_type <> 'click') AS unacknowledged FROM events GROUP BY user_id",
)
def al9(spark, d):
    feed = dom.table(spark, d, "events").select(
        "user_id", (F.col("event_type") == "view").alias("is_read"), (F.col("event_type") == "click").alias("is_acknowledged")
    )
    return al.unread_counts(feed)


@query(
    "al10_severity_counts",
    using("alerts0", "SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium FROM alerts0"),
)
def al10(spark, d):
    return al.severity_counts(alerts(spark, d))
