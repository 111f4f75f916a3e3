"""Scalar functions (SF) and the user-function surface (UD)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from riskframe.functions import dates as dts
from riskframe.functions import formatting as fmt
from riskframe.functions import numeric as num
from riskframe.functions import text as tx
from riskframe.operators import news as nw
from riskframe.operators import rolling as rl
from riskframe.operators import scoring
from riskframe.plans.q_core import latest_features
from riskframe.plans.q_windows import frame
from riskframe.plans.sqlkit import query, rnd, rounded, sql_cols, sql_rnd, using
from riskframe.sources import domain as dom
from riskframe.sources.domain import AS_OF


def docs(spark, d):
    return dom.table(spark, d, "documents")


@query(
    "sf1_parse_symbol_list",
    "SELECT doc_id, s AS symbol FROM (SELECT doc_id, unnest(string_split(lang || ' , ' || source || ',,' || lang || 'x', ',')) AS r FROM documents), LATERAL (SELECT upper(trim(r)) AS s) WHERE s <> ''",
)
def sf1(spark, d):
    listed = F.concat("lang", F.lit(" , "), "source", F.lit(",,"), "lang", F.lit("x"))
    return docs(spark, d).select("doc_id", F.explode(tx.parse_symbols(listed)).alias("symbol"))


@query(
    "sf2_collapse_spaces",
    r"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
)
def sf2(spark, d):
    clean = tx.collapse_spaces("text")
    return docs(spark, d).select("doc_id", F.length(clean).cast("bigint").alias("n"), F.md5(clean).alias("digest"))


@query(
    "sf3_truncate_with_marker",
    """SELECT doc_id, length(t) AS n, right(t, 3) AS tail, length(s) AS short_n FROM (
    SELECT doc_id, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...' ELSE text END AS t, substr(text, 1, 500) AS s FROM documents)""",
)
def sf3(spark, d):
    return docs(spark, d).withColumns({"t": tx.truncate("text", 5000), "s": tx.truncate("text", 500, "")}).select(
        "doc_id", F.length("t").cast("bigint").alias("n"), F.right("t", F.lit(3)).alias("tail"),
        F.length("s").cast("bigint").alias("short_n"),
    )


@query(
    "sf4_ticker_extraction",
    """SELECT DISTINCT doc_id, t AS symbol FROM (SELECT doc_id, unnest(string_split_regex(text, '[^\\p{L}\\p{N}_]+')) AS t FROM documents)
    WHERE regexp_full_match(t, '[A-Z]{2,5}') AND t IN (SELECT DISTINCT upper(lang) FROM documents)""",
)
def sf4(spark, d):
    known = docs(spark, d).select(F.upper("lang").alias("symbol")).distinct()
    found = docs(spark, d).select("doc_id", F.explode(tx.ticker_tokens("text")).alias("symbol"))
    return found.join(known, "symbol", "left_semi").select("doc_id", "symbol")


_NAMES = ", ".join(f"('{n}', '{s}')" for n, s in tx.COMPANY_NAMES.items())


@query(
    "sf5_company_names",
    f"""WITH names(name, symbol) AS (VALUES {_NAMES})
    SELECT DISTINCT doc_id, symbol FROM documents JOIN names ON contains(lower(text), name)""",
)
def sf5(spark, d):
    return docs(spark, d).select("doc_id", F.explode(tx.company_symbols("text")).alias("symbol"))


_PHRASES = " OR ".join(f"contains(lower(t), '{p}')" for p in tx.INTENT_PHRASES)


@query(
    "sf6_intent_flag",
    f"SELECT conv_id, turn, {_PHRASES} AS asks_data FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'Show my Portfolio: ' || text ELSE text END AS t FROM conversations)",
)
def sf6(spark, d):
    asked = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Show my Portfolio: "), "text")).otherwise(F.col("text"))
    return dom.table(spark, d, "conversations").select(
        "conv_id", "turn", tx.mentions(asked, tx.INTENT_PHRASES).alias("asks_data")
    )


@query(
    "sf7_driver_strings",
    using(
        "normed",
        """SELECT symbol, '↑ ' || coalesce(up, 'none') || ' | ↓ ' || coalesce(down, 'none') AS drivers FROM (
        SELECT symbol, string_agg(printf('%s (+%.3f)', name, value + 1e-9::DOUBLE), ', ' ORDER BY o) FILTER (WHERE value > 0) AS up,
               string_agg(printf('%s (%.3f)', name, value + 1e-9::DOUBLE), ', ' ORDER BY o) FILTER (WHERE value < 0) AS down FROM (
          SELECT symbol, 'vol' AS name, norm_volatility - 0.5 AS value, 1 AS o FROM normed
          UNION ALL SELECT symbol, 'dd', norm_drawdown - 0.5, 2 FROM normed UNION ALL SELECT symbol, 'sent', norm_sentiment - 0.5, 3 FROM normed
          UNION ALL SELECT symbol, 'liq', norm_liquidity - 0.5, 4 FROM normed) GROUP BY symbol)""",
    ),
)
def sf7(spark, d):
    df = scoring.weighted_scores(latest_features(spark, d))
    parts = {"vol": "norm_volatility", "dd": "norm_drawdown", "sent": "norm_sentiment", "liq": "norm_liquidity"}
    entries = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(c) - 0.5).alias("value")) for n, c in parts.items()])
    df = df.withColumn("e", entries)
    up = fmt.signed_list(F.filter("e", lambda x: x["value"] > 0), True)
    down = fmt.signed_list(F.filter("e", lambda x: x["value"] < 0), False)
    return df.select("symbol", fmt.up_down_drivers(up, down).alias("drivers"))


@query("sf8_headline", "SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 150) AS headline FROM documents")
def sf8(spark, d):
    return docs(spark, d).select("doc_id", tx.headline_of("text").alias("headline"))


@query(
    "sf9_title_case",
    using(
        "balerts",
        "SELECT alert_id, CASE alert_type WHEN 'high_risk' THEN 'High Risk' ELSE 'Sudden Spike' END AS alert_title, upper(risk_level) AS level FROM balerts",
    ),
)
def sf9(spark, d):
    return dom.brand_alerts(spark, d).select(
        "alert_id", tx.title_case("alert_type").alias("alert_title"), F.upper("risk_level").alias("level")
    )


@query("sf10_strip_tags", "SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)")
def sf10(spark, d):
    t = tx.strip_tags("html")
    return dom.table(spark, d, "pages").select("page_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("digest"))


@query(
    "sf11_humanise_volume",
    using(
        "wbars",
        """SELECT symbol, date, CASE WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9 + 1e-9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6 + 1e-9)
        WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3 + 1e-9) ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS shown
        FROM (SELECT symbol, date, CAST(volume * volume * volume AS DOUBLE) AS v FROM wbars)""",
    ),
)
def sf11(spark, d):
    cubed = F.col("volume") * F.col("volume") * F.col("volume")
    return dom.weekly_bars(spark, d).select("symbol", "date", fmt.humanise_volume(cubed).alias("shown"))


@query(
    "sf12_published_time",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(epoch(ts)) AS BIGINT) ELSE 1004832000 END AS published_epoch FROM events""",
)
def sf12(spark, d):
    stamp = F.col("ts").cast("timestamp")
    raw = (
        F.when(F.col("event_type") == "view", F.unix_timestamp(stamp).cast("string"))
        .when(F.col("event_type") == "click", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_type") == "error", "not a time")
    )
    parsed = dts.parse_published(raw, F.lit(AS_OF).cast("timestamp"))
    return dom.table(spark, d, "events").select("event_id", F.unix_timestamp(parsed).alias("published_epoch"))


@query(
    "sf13_coercing_dates",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END AS parsed FROM events",
)
def sf13(spark, d):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    raw = (
        F.when(F.col("event_type") == "view", day)
        .when(F.col("event_type") == "click", F.concat(F.substring(day, 1, 5), F.lit("13-45")))
        .otherwise("soon")
    )
    return dom.table(spark, d, "events").select("event_id", F.to_date(dts.coerce_timestamp(raw)).alias("parsed"))


@query(
    "sf14_date_arithmetic",
    using("episodes", "SELECT symbol, start, recovery, CAST(recovery - 90 AS DATE) AS cutoff, CAST(recovery - start AS BIGINT) AS days FROM episodes"),
)
def sf14(spark, d):
    from riskframe.operators.drawdown import drawdown_episodes

    eps = drawdown_episodes(dom.daily_bars(spark, d))
    return eps.select(
        "symbol", "start", "recovery", F.date_sub("recovery", 90).alias("cutoff"),
        F.datediff("recovery", "start").cast("bigint").alias("days"),
    )


@query(
    "sf15_forecast_calendar",
    using(
        "bars",
        """SELECT symbol, step, day FROM (
        SELECT symbol, CAST(0 AS BIGINT) AS step, last AS day FROM (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol)
        UNION ALL SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day), day FROM (
          SELECT symbol, CAST(last + CAST(k AS INTEGER) AS DATE) AS day FROM (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol), (SELECT unnest(range(1, 60)) AS k))
        WHERE isodow(day) < 6) WHERE step <= 30""",
    ),
)
def sf15(spark, d):
    last = dom.daily_bars(spark, d).groupBy("symbol").agg(F.max("date").alias("last"))
    out = last.select("symbol", F.posexplode(dts.forecast_dates("last", 30)).alias("step", "day"))
    return out.withColumn("step", F.col("step").cast("bigint"))


@query(
    "sf16_month_year_buckets",
    using("bars", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(year(date) AS BIGINT) AS year, count(*) AS n FROM bars GROUP BY 1, 2"),
)
def sf16(spark, d):
    return (
        dom.daily_bars(spark, d)
        .groupBy(F.to_date(F.date_trunc("month", "date")).alias("month"), F.year("date").cast("bigint").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "sf17_math",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('root=sqrt(close); log=ln(close); power=pow(close / 1000, 1.5); away=abs(close - open); clipped=least(greatest(close, 1000), 5000); growth=exp(close / 100000)', 5)} FROM bars""",
    ),
)
def sf17(spark, d):
    c = F.col("close")
    return rounded(
        dom.daily_bars(spark, d).select(
            "symbol", "date", F.sqrt(c).alias("root"), F.ln(c).alias("log"), F.pow(c / 1000, F.lit(1.5)).alias("power"),
            F.abs(c - F.col("open")).alias("away"), F.least(F.greatest(c, F.lit(1000.0)), F.lit(5000.0)).alias("clipped"),
            F.exp(c / 100000).alias("growth"),
        ),
        5,
    )


@query(
    "sf18_safe_ratios",
    "SELECT c_custkey, " + sql_cols("eps=c_nationkey / (c_acctbal + 1e-10); or_zero=CASE WHEN c_acctbal > 0 THEN c_nationkey / c_acctbal ELSE 0 END; or_null=c_acctbal / nullif(c_nationkey, 0)") + " FROM customer",
)
def sf18(spark, d):
    n, b = F.col("c_nationkey"), F.col("c_acctbal")
    return rounded(
        dom.table(spark, d, "customer").select(
            "c_custkey", num.eps_ratio(n, b).alias("eps"), num.ratio_or_zero(n, b).alias("or_zero"), F.try_divide(b, n).alias("or_null")
        )
    )


@query(
    "sf19_null_family",
    using(
        "ret",
        f"""SELECT symbol, date, {sql_cols('filled=coalesce(ret, 0); zero_null=nullif(CASE WHEN volume > 50 THEN CAST(volume AS DOUBLE) ELSE 0 END, 0); finite=CASE WHEN volume > 50 THEN ret END')} FROM ret""",
    ),
)
def sf19(spark, d):
    df = rl.add_returns(dom.daily_bars(spark, d))
    busy = F.col("volume") > 50
    odd = F.when(busy, F.col("ret")).when(F.col("volume") > 20, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return rounded(
        df.select(
            "symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("filled"),
            num.zero_to_null(F.when(busy, F.col("volume").cast("double")).otherwise(F.lit(0.0))).alias("zero_null"),
            num.finite_or_null(odd).alias("finite"),
        ).na.drop("all")
    )


@query(
    "sf20_array_ranking",
    using(
        "normed",
        """SELECT symbol, string_agg(name, '>' ORDER BY value DESC, name) AS ranking FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY value DESC, name) AS rn FROM (
          UNPIVOT (SELECT symbol, norm_volatility AS vol, norm_drawdown AS dd, norm_sentiment AS sent, norm_liquidity AS liq FROM normed)
          ON vol, dd, sent, liq INTO NAME name VALUE value) WHERE value > 0.2) WHERE rn <= 3 GROUP BY symbol""",
    ),
)
def sf20(spark, d):
    df = scoring.weighted_scores(latest_features(spark, d))
    names = F.array(*[F.lit(n) for n in ("vol", "dd", "sent", "liq")]).alias("name")
    values = F.array("norm_volatility", "norm_drawdown", "norm_sentiment", "norm_liquidity").alias("value")
    zipped = F.arrays_zip(names, values)
    kept = F.filter(zipped, lambda e: e["value"] > 0.2)
    keyed = F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("m"), e["name"].alias("name"))))
    ranking = F.array_join(F.transform(F.slice(keyed, 1, 3), lambda e: e["name"]), ">")
    return df.select("symbol", ranking.alias("ranking")).where("ranking <> ''")


@query("sf21_map_lookup", using("bars", """SELECT symbol, date, CASE dayofweek(date) WHEN 0 THEN 'weekend' WHEN 6 THEN 'weekend' ELSE 'weekday' END AS kind FROM bars"""))
def sf21(spark, d):
    kinds = F.map_from_entries(
        F.array(*[F.struct(F.lit(i), F.lit("weekend" if i in (1, 7) else "weekday")) for i in range(1, 8)])
    )
    return dom.daily_bars(spark, d).select("symbol", "date", F.element_at(kinds, F.dayofweek("date")).alias("kind"))


@query(
    "sf22_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS encoded FROM events""",
)
def sf22(spark, d):
    parsed = F.from_json("props", "k bigint")
    return dom.table(spark, d, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(F.struct("event_type", parsed["k"].alias("k"))).alias("encoded")
    )


@query(
    "sf23_follow_ups",
    """SELECT conv_id, turn, idx, s FROM (
      SELECT conv_id, turn, idx, s, row_number() OVER (PARTITION BY conv_id, turn ORDER BY idx) AS rn FROM (
        SELECT conv_id, turn, unnest(range(1, len(p) + 1)) AS idx, trim(unnest(p)) AS s FROM (
          SELECT conv_id, turn, string_split(trim(' ' || role || ' | Why? |  | Compare ' || role || ' | More | Extra '), '|') AS p FROM conversations WHERE role <> 'system'))
      WHERE s <> '') WHERE rn <= 3""",
)
def sf23(spark, d):
    conv = dom.table(spark, d, "conversations")
    answer = F.concat(
        "text", F.lit("\nFOLLOW_UP: "), "role", F.lit(" | Why? |  | Compare "), "role", F.lit(" | More | Extra ")
    )
    answer = F.when(F.col("role") == "system", F.col("text")).otherwise(answer)
    out = conv.select("conv_id", "turn", F.posexplode(tx.follow_ups(answer)).alias("i", "s"))
    # the empty third item is dropped, so positions after it shift by one
    return out.select(
        "conv_id", "turn", F.when(F.col("i") >= 2, F.col("i") + 2).otherwise(F.col("i") + 1).cast("bigint").alias("idx"), "s"
    )


@query(
    "sf24_linear_rescale",
    "SELECT event_id, " + sql_cols("scaled=(value - 10) / 40; degenerate=0.5") + " FROM events",
)
def sf24(spark, d):
    return rounded(
        dom.table(spark, d, "events").select(
            "event_id", num.rescale("value", 10, 50).alias("scaled"), num.rescale("value", 7, 7).alias("degenerate")
        )
    )


# ---- user functions ------------------------------------------------------------------------


@query("ud1_row_function", using("normed", "SELECT symbol, " + sql_rnd("greatest(norm_volatility, norm_drawdown) * 2 - norm_sentiment") + " AS custom FROM normed"))
def ud1(spark, d):
    @F.pandas_udf("double")
    def custom(vol: pd.Series, dd: pd.Series, sent: pd.Series) -> pd.Series:
        return vol.where(vol >= dd, dd) * 2 - sent

    df = scoring.weighted_scores(latest_features(spark, d))
    return df.select("symbol", rnd(custom("norm_volatility", "norm_drawdown", "norm_sentiment")).alias("custom"))


@query(
    "ud2_group_transform",
    using("ret", f"SELECT symbol, date, {sql_cols('centred=ret - avg(ret) OVER (PARTITION BY symbol)')} FROM ret"),
)
def ud2(spark, d):
    df = rl.add_returns(dom.daily_bars(spark, d))
    means = df.groupBy("symbol").agg(F.avg("ret").alias("m"))
    return df.join(means, "symbol").select("symbol", "date", rnd(F.col("ret") - F.col("m")).alias("centred"))


@query(
    "ud3_rolling_custom_aggregate",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('weighted=s / nullif(v, 0)', 4)} FROM (
        SELECT symbol, date, sum(close * volume) OVER w AS s, sum(volume) OVER w AS v FROM bars {frame(10)})""",
    ),
)
def ud3(spark, d):
    pairs = F.collect_list(F.struct("close", "volume")).over(rl.trailing(10))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("v"))
    fold = F.aggregate(
        pairs,
        start,
        lambda a, x: F.struct((a["s"] + x["close"] * x["volume"]).alias("s"), (a["v"] + x["volume"]).alias("v")),
        lambda a: F.try_divide(a["s"], a["v"]),
    )
    return rounded(dom.daily_bars(spark, d).select("symbol", "date", fold.alias("weighted")), 4)


@query(
    "ud4_group_map",
    using(
        "ret",
        f"""SELECT symbol, date, {sql_cols('z=(ret - avg(ret) OVER (PARTITION BY symbol)) / stddev_samp(ret) OVER (PARTITION BY symbol)', 5)} FROM ret""",
    ),
)
def ud4(spark, d):
    def standardise(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(z=(g["ret"] - g["ret"].mean()) / g["ret"].std())[["symbol", "date", "z"]]

    # A group is one symbol's calendar of bars.
    df = rl.add_returns(dom.daily_bars(spark, d)).select("symbol", "date", "ret")
    out = df.groupBy("symbol").applyInPandas(standardise, "symbol string, date date, z double")
    return rounded(out.withColumn("z", num.finite_or_null("z")), 5)


@query(
    "ud5_group_aggregate_struct",
    using("ret", f"SELECT symbol, {sql_cols('mae=avg(abs(ret)); hit=avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')}, count(*) AS n FROM ret WHERE ret IS NOT NULL GROUP BY symbol"),
)
def ud5(spark, d):
    df = rl.add_returns(dom.daily_bars(spark, d)).where("ret IS NOT NULL")
    stats = df.groupBy("symbol").agg(
        F.struct(
            F.avg(F.abs("ret")).alias("mae"),
            F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit"),
            F.count(F.lit(1)).alias("n"),
        ).alias("s")
    )
    return rounded(stats.select("symbol", "s.*"))


@query(
    "ud7_separator_chunks",
)
def ud7(spark, d):
    return nw.separator_chunks(nw.build_documents(dom.news(spark, d)))


@query(
    "ud8_scorer_fallback",
    using("vol21", f"SELECT symbol, {sql_cols('risk_score=last(volatility_21d ORDER BY date)')} FROM vol21 GROUP BY symbol"),
)
def ud8(spark, d):
    model = scoring.scorer(lambda df: df.withColumn("risk_score", F.col("volatility_21d")))
    return rounded(model(latest_features(spark, d)).select("symbol", "risk_score"))
