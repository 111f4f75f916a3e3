"""News text, sentiment, retrieval and question contexts (TX), with WN36 and AL5."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import text as tx
from riskframe.operators import alerts as al
from riskframe.operators import news as nw
from riskframe.operators import retrieval as rt
from riskframe.plans import q_relational as _shared  # noqa: F401 - defines shared tables
from riskframe.plans.sqlkit import cte, query, rounded, sql_cols, using
from riskframe.sources import domain as dom
from riskframe.sources.domain import AS_OF
from riskframe.sources.market import within


def sql_drop(expr: str) -> str:
    out = f"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')"
    for tag in tx.DROPPED_TAGS:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    return out


def sql_text(expr: str) -> str:
    out = f"regexp_replace(regexp_replace({expr}, '\\s+', ' ', 'g'), ' ?<[^<>]+> ?', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sql_paragraphs(expr: str, longer_than: int) -> str:
    marked = f"regexp_replace(regexp_replace({expr}, '(?i)<p(\\s[^>]*)?>', chr(1), 'g'), '(?i)</p>', chr(2), 'g')"
    each = sql_text("split_part(p, chr(2), 1)")
    return f"list_filter(list_transform(string_split({marked}, chr(1))[2:], lambda p: {each}), lambda t: length(t) > {longer_than})"


cte("pclean", f"SELECT page_id, html, {sql_drop('html')} AS clean FROM pages", materialised=True)


@query(
    "tx1_article_extraction",
    using(
        "pclean",
        f"""SELECT page_id, length(c) AS n, md5(c) AS digest FROM (
        SELECT page_id, t AS c FROM (
          SELECT page_id, trim(regexp_replace(CASE WHEN length(a) >= 100 THEN a ELSE b END, '\\s+', ' ', 'g')) AS t FROM (
            SELECT page_id, array_to_string({sql_paragraphs("regexp_extract(clean, '(?is)<article[^>]*>(.*?)</article>', 1)", 0)}, ' ') AS a,
                   array_to_string({sql_paragraphs("regexp_extract(clean, '(?is)<body[^>]*>(.*?)</body>', 1)", 40)}, ' ') AS b FROM pclean)))""",
    ),
)
def tx1(spark, d):
    out = nw.extract_articles(dom.table(spark, d, "pages"))
    return out.select("page_id", F.length("content").cast("bigint").alias("n"), F.md5("content").alias("digest"))


@query(
    "tx2_quality_articles",
    using(
        "pclean",
        f"""SELECT page_id, headline, length(content) AS n, md5(content) AS digest, length(substr(content, 1, 500)) AS description_n FROM (
        SELECT page_id, coalesce(nullif({sql_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), nullif({sql_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), 'No Title') AS headline,
               trim(regexp_replace(array_to_string({sql_paragraphs("html", 50)}, ' '), '\\s+', ' ', 'g')) AS content FROM pclean) WHERE length(content) >= 100""",
    ),
)
def tx2(spark, d):
    out = nw.quality_articles(dom.table(spark, d, "pages"))
    return out.select(
        "page_id", "headline", F.length("content").cast("bigint").alias("n"), F.md5("content").alias("digest"),
        F.length("description").cast("bigint").alias("description_n"),
    )


@query(
    "tx3_text_sentiment",
    using("lex", f"SELECT doc_id, {sql_cols('headline_score=hs; headline_confidence=hc; content_score=cs; content_confidence=cc')} FROM lex"),
)
def tx3(spark, d):
    df = dom.news(spark, d).withColumns({"h": tx.lexicon_sentiment("headline"), "c": tx.lexicon_sentiment("content")})
    return rounded(
        df.select(
            "doc_id", F.col("h.score").alias("headline_score"), F.col("h.confidence").alias("headline_confidence"),
            F.col("c.score").alias("content_score"), F.col("c.confidence").alias("content_confidence"),
        )
    )


@query(
    "tx3_model_scorer",
    "SELECT doc_id, " + sql_cols("sentiment_score=CASE WHEN length(text) > 100 THEN 0.4 * h + 0.6 * c ELSE h END")
    + " FROM (SELECT doc_id, text, (length(substr(split_part(text, chr(10), 1), 1, 150)) % 7 - 3) / 3.0::DOUBLE AS h, (length(text) % 7 - 3) / 3.0::DOUBLE AS c FROM documents)",
)
def tx3_model(spark, d):
    import pandas as pd

    def predict(texts):
        score = (texts.str.len() % 7 - 3) / 3.0
        label = score.map(lambda s: "positive" if s > 0 else "negative" if s < 0 else "neutral")
        return pd.DataFrame({"score": score, "confidence": score.abs(), "label": label})

    scored = nw.score_articles(dom.news(spark, d), nw.model_scorer(predict))
    return rounded(scored.select("doc_id", "sentiment_score"))


@query(
    "tx4_headline_content_blend",
    using("snews", f"SELECT doc_id, {sql_cols('sentiment_score; sentiment_confidence')}, sentiment_label FROM snews"),
)
def tx4(spark, d):
    return rounded(dom.scored_news(spark, d).select("doc_id", "sentiment_score", "sentiment_confidence", "sentiment_label"))


@query(
    "tx5_incremental_scoring",
    using(
        "snews",
        f"""SELECT symbol, date, {sql_cols('avg_sentiment=avg(s)')}, count(*) AS article_count FROM (
        SELECT symbol, published AS date, CASE WHEN l.quality IS NULL THEN n.sentiment_score ELSE l.quality * 2.0 - 1 END AS s
        FROM snews n LEFT JOIN labels l USING (doc_id)) GROUP BY 1, 2""",
    ),
)
def tx5(spark, d):
    labels = dom.table(spark, d, "labels")
    stored = dom.news(spark, d).join(labels, "doc_id", "left").select(
        *dom.news(spark, d).columns,
        (F.col("quality") * 2.0 - 1).alias("sentiment_score"),
        F.when(F.col("quality").isNotNull(), F.lit(1.0)).alias("sentiment_confidence"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("sentiment_label"),
    )
    daily = nw.daily_sentiment(nw.score_new_articles(stored))
    return rounded(daily.select("symbol", "date", "avg_sentiment", "article_count"))


cte(
    "docs6",
    """SELECT doc_id, headline || chr(10) || CASE WHEN length(content) > 100 THEN content ELSE description END AS text FROM news""",
    "news",
)


@query(
    "tx6_fixed_chunks",
    using(
        "docs6",
        """SELECT doc_id, i AS chunk_no, length(substr(text, i * 462 + 1, 512)) AS n, md5(substr(text, i * 462 + 1, 512)) AS digest FROM (
        SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 50) / 462.0) AS BIGINT), 1))) AS i FROM docs6)""",
    ),
)
def tx6(spark, d):
    chunks = nw.fixed_chunks(nw.build_documents(dom.news(spark, d)))
    return chunks.select("doc_id", "chunk_no", F.length("chunk").cast("bigint").alias("n"), F.md5("chunk").alias("digest"))


cte(
    "dims",
    "SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    materialised=True,
)
cte(
    "cents",
    """SELECT label AS query_id, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS q FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY label, i)""",
    "dims",
    materialised=True,
)
cte(
    "sims",
    """SELECT c.query_id, d.vec_id, d.label, sum(c.q * d.x) / sqrt(sum(d.x * d.x)) AS score FROM dims d JOIN cents c ON c.i = d.i GROUP BY 1, 2, 3""",
    "dims",
    "cents",
    materialised=True,
)


def vectors(spark, d):
    """Corpus with the label as symbol, and one query per label: its mean vector."""
    v = dom.table(spark, d, "embeddings")
    corpus = v.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("symbol"), "embedding")
    queries = rt.centroids(v, "label").select(
        F.col("label").cast("bigint").alias("query_id"), F.col("label").cast("string").alias("wanted"), "embedding"
    )
    return corpus, queries


@query(
    "tx7_vector_top_k",
    using(
        "sims",
        f"""SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS doc_id, CAST(label AS VARCHAR) AS symbol, {sql_cols('score')}, row_number() OVER (PARTITION BY query_id ORDER BY sims.score DESC, vec_id) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS near FROM sims) sims WHERE near <= 10 AND label = query_id QUALIFY rank <= 5""",
    ),
)
def tx7(spark, d):
    corpus, queries = vectors(spark, d)
    return rounded(rt.vector_top_k(corpus, queries, shard_rows=200, query_block=4))


@query(
    "tx7_vector_top_k_within_symbol",
    using(
        "sims",
        f"""SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS doc_id, CAST(label AS VARCHAR) AS symbol, {sql_cols('score')}, row_number() OVER (PARTITION BY query_id ORDER BY sims.score DESC, vec_id) AS rank
        FROM sims WHERE label = query_id QUALIFY rank <= 5""",
    ),
)
def tx7_within(spark, d):
    corpus, queries = vectors(spark, d)
    return rounded(rt.vector_top_k(corpus, queries, filter_first=True))


cte(
    "recent",
    "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, doc_id) AS rank FROM snews QUALIFY rank <= 5",
    "snews",
    materialised=True,
)
cte(
    "templates",
    """SELECT symbol, count(*) AS num_docs, least(count(*) / 5.0::DOUBLE, 1.0::DOUBLE) AS confidence,
         'Based on ' || count(*) || ' recent news articles for ' || symbol || ':' || chr(10) || chr(10) ||
         CASE WHEN count(*) FILTER (WHERE sentiment_label = 'negative') > count(*) FILTER (WHERE sentiment_label = 'positive')
                THEN 'Negative sentiment detected (' || count(*) FILTER (WHERE sentiment_label = 'negative') || ' negative articles)'
              WHEN count(*) FILTER (WHERE sentiment_label = 'positive') > count(*) FILTER (WHERE sentiment_label = 'negative')
                THEN 'Positive sentiment detected (' || count(*) FILTER (WHERE sentiment_label = 'positive') || ' positive articles)'
              ELSE 'Mixed sentiment (' || count(*) FILTER (WHERE sentiment_label = 'positive') || ' positive, ' || count(*) FILTER (WHERE sentiment_label = 'negative')
                || ' negative, ' || count(*) FILTER (WHERE sentiment_label = 'neutral') || ' neutral)' END
         || ':' || chr(10) || chr(10) || 'Key headlines:' || chr(10) ||
         string_agg(rank || '. [' || upper(sentiment_label) || '] ' || headline, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS explanation
       FROM recent GROUP BY symbol""",
    "recent",
)


def templates(spark, d):
    return rt.template_explanations(rt.recent_news(dom.scored_news(spark, d)))


@query("tx8_tx9_template_explanation", using("templates", f"SELECT symbol, num_docs, {sql_cols('confidence')}, explanation FROM templates"))
def tx8(spark, d):
    return rounded(templates(spark, d))


@query(
    "al5_evidence_explanation",
    using(
        "balerts templates",
        """SELECT a.alert_id, coalesce(t.explanation, a.risk_drivers) AS explanation FROM balerts a
        LEFT JOIN templates t USING (symbol)""",
    ),
)
def al5(spark, d):
    return al.evidence_explanations(dom.brand_alerts(spark, d), templates(spark, d)).select("alert_id", "explanation")


@query(
    "wn36_sentiment_trend",
    using(
        "dsent",
        """SELECT symbol, CASE WHEN coalesce(bool_and(up), true) THEN 'improving' WHEN bool_and(down) THEN 'declining' ELSE 'mixed' END AS trend FROM (
        SELECT symbol, rn, avg_sentiment >= newer AS up, avg_sentiment <= newer AS down FROM (
          SELECT symbol, avg_sentiment, lag(avg_sentiment) OVER (PARTITION BY symbol ORDER BY date DESC) AS newer, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM dsent)
        WHERE rn <= 3) GROUP BY symbol""",
    ),
)
def wn36(spark, d):
    return nw.recent_trend(dom.daily_news_sentiment(spark, d))


# Questions: every message, extended so that some name symbols (by ticker or company) or ask for rankings.
cte(
    "uni",
    """SELECT *, CASE symbol WHEN 'Brand#11' THEN 'INTC' WHEN 'Brand#12' THEN 'UBER' ELSE 'T' || chr(64 + CAST(split_part(symbol, '#', 2) AS INTEGER)) END AS ticker,
              rank() OVER (ORDER BY risk_score DESC) AS risk_rank FROM universe""",
    "universe",
)
cte(
    "qs",
    """SELECT conv_id * 1000 + turn AS question_id, text || CASE role WHEN 'user' THEN ' Is T' || chr(CAST(65 + conv_id % 25 AS INTEGER)) || ' like TC, TB or Intel?'
              WHEN 'system' THEN ' Which is the riskiest?' ELSE '' END AS text FROM conversations""",
)


def questions(spark, d):
    extra = (
        F.when(F.col("role") == "user", F.concat(F.lit(" Is T"), F.chr(F.col("conv_id") % 25 + 65), F.lit(" like TC, TB or Intel?")))
        .when(F.col("role") == "system", " Which is the riskiest?")
        .otherwise("")
    )
    return dom.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", extra).alias("text")
    )


def universe(spark, d):
    from riskframe.scale import rank_column

    number = F.element_at(F.split("symbol", "#"), 2).cast("int")
    scored = rank_column(dom.scored_universe(spark, d), "risk_score", "risk_rank", descending=True)
    return scored.withColumn(
        "ticker",
        F.when(F.col("symbol") == "Brand#11", "INTC").when(F.col("symbol") == "Brand#12", "UBER")
        .otherwise(F.concat(F.lit("T"), F.chr(number + 64))),
    )


_NAME_LIST = ", ".join(f"({i}, '{n}', '{s}')" for i, (n, s) in enumerate(tx.COMPANY_NAMES.items()))
_ASKS = " OR ".join(f"contains(lower(text), '{p}')" for p in tx.INTENT_PHRASES)
_RANKS = " OR ".join(f"contains(lower(text), '{p}')" for p in tx.RANKING_PHRASES)
cte(
    "named",
    f"""SELECT question_id, symbol, row_number() OVER (PARTITION BY question_id ORDER BY kind, place, symbol) - 1 AS position FROM (
          SELECT question_id, symbol, min(kind) AS kind, min(place) FILTER (WHERE kind = k0) AS place FROM (
            SELECT *, min(kind) OVER (PARTITION BY question_id, symbol) AS k0 FROM (
              SELECT DISTINCT question_id, symbol, 0 AS kind, risk_rank AS place FROM (
                SELECT question_id, unnest(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM qs) JOIN uni ON ticker = t
              UNION ALL SELECT question_id, symbol, 1, i FROM qs JOIN (VALUES {_NAME_LIST}) AS n(i, name, t) ON contains(lower(text), name) JOIN uni ON ticker = t))
          GROUP BY question_id, symbol)""",
    "qs",
    "uni",
    materialised=True,
)
cte(
    "picks",
    f"""SELECT question_id, CAST(position AS BIGINT) AS position, rank, doc_id, headline FROM named JOIN recent USING (symbol) WHERE position < 3 AND rank <= 3
        UNION ALL
        SELECT question_id, -1, rank, doc_id, headline FROM qs, (SELECT doc_id, headline, row_number() OVER (ORDER BY published DESC, doc_id) AS rank FROM news QUALIFY rank <= 5)
        WHERE ({_ASKS}) AND question_id NOT IN (SELECT question_id FROM named)""",
    "named",
    "recent",
    "qs",
)


@query("tx12_news_picks", using("picks", "SELECT question_id, position, rank, doc_id FROM picks"))
def tx12(spark, d):
    asked = questions(spark, d)
    uni = universe(spark, d)
    named = rt.detect_symbols(asked, uni)
    # the general list serves questions that are about the data but name no symbol
    general = asked.where(tx.mentions("text", tx.INTENT_PHRASES))
    picks = rt.news_picks(named, dom.scored_news(spark, d), general)
    return picks.select("question_id", F.col("position").cast("bigint").alias("position"), "rank", "doc_id")


@query(
    "tx10_question_context",
    using(
        "qs named uni picks",
        f""", facts AS (SELECT symbol, '[Portfolio Data for ' || symbol || ']' || chr(10) || '  Risk Score: ' || printf('%.3f', risk_score + 1e-9::DOUBLE) || ' (' || risk_level || ')' || chr(10)
            || '  Risk Rank: ' || risk_rank || ' out of ' || (SELECT count(*) FROM uni) || chr(10) || '  Drivers: ' || risk_drivers || chr(10)
            || '  21d Volatility: ' || printf('%.3f', volatility_21d + 1e-9::DOUBLE) || chr(10) || '  Avg Sentiment: ' || printf('%.3f', avg_sentiment + 1e-9::DOUBLE) AS facts FROM uni),
        ranking AS (SELECT 'Highest: ' || (SELECT string_agg(t, '; ' ORDER BY risk_score DESC, symbol) FROM (SELECT symbol, risk_score, symbol || ': ' || printf('%.3f', risk_score + 1e-9::DOUBLE) AS t FROM uni ORDER BY risk_score DESC, symbol LIMIT 10))
            || chr(10) || 'Lowest: ' || (SELECT string_agg(t, '; ' ORDER BY risk_score, symbol) FROM (SELECT symbol, risk_score, symbol || ': ' || printf('%.3f', risk_score + 1e-9::DOUBLE) AS t FROM uni ORDER BY risk_score, symbol LIMIT 5))
            || chr(10) || 'Total: ' || count(*) || ' | High: ' || count(*) FILTER (WHERE risk_level = 'High') || ' | Medium: ' || count(*) FILTER (WHERE risk_level = 'Medium') || ' | Low: ' || count(*) FILTER (WHERE risk_level = 'Low') AS r FROM uni),
        data AS (SELECT question_id, string_agg(symbol, ',' ORDER BY position) AS symbols, string_agg(facts, chr(10) ORDER BY position) AS data FROM named JOIN facts USING (symbol) GROUP BY 1),
        nws AS (SELECT question_id, count(*) AS sources, string_agg(headline, chr(10) ORDER BY position, rank, headline) AS news FROM picks GROUP BY 1),
        base AS (SELECT q.*, coalesce(symbols, '') AS symbols, ({_ASKS}) OR symbols IS NOT NULL AS asks_data, concat_ws(chr(10), data, CASE WHEN {_RANKS} THEN (SELECT r FROM ranking) END) AS data_context
                 FROM qs q LEFT JOIN data USING (question_id))
        SELECT question_id, symbols, asks_data, data_context, CASE WHEN asks_data THEN coalesce(news, '') ELSE '' END AS news_context,
               CASE WHEN asks_data THEN coalesce(sources, 0) ELSE 0 END AS num_sources,
               CASE WHEN data_context <> '' THEN 0.9::DOUBLE WHEN asks_data AND coalesce(sources, 0) > 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence
        FROM base LEFT JOIN nws USING (question_id)""",
    ),
)
def tx10(spark, d):
    return rt.question_context(questions(spark, d), universe(spark, d), dom.scored_news(spark, d))


@query(
    "tx10_sentiment_facts",
    using(
        "dsent",
        """SELECT symbol, '  Sentiment: avg=' || printf('%.3f', m + 1e-9::DOUBLE) || ' (' || CASE WHEN m > 0.1 THEN 'positive' WHEN m < -0.1 THEN 'negative' ELSE 'neutral' END || '), trend=' || trend
             || ', articles=' || CAST(n AS BIGINT) AS mood FROM (SELECT symbol, round(avg(avg_sentiment), 12) AS m, sum(article_count) AS n FROM dsent WHERE date >= DATE '2001-11-04' - 14 GROUP BY symbol)
        JOIN (SELECT symbol, CASE WHEN coalesce(bool_and(up), true) THEN 'improving' WHEN bool_and(down) THEN 'declining' ELSE 'mixed' END AS trend FROM (
          SELECT symbol, avg_sentiment >= newer AS up, avg_sentiment <= newer AS down FROM (
            SELECT symbol, avg_sentiment, lag(avg_sentiment) OVER (PARTITION BY symbol ORDER BY date DESC) AS newer, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn
            FROM dsent WHERE date >= DATE '2001-11-04' - 14) WHERE rn <= 3) GROUP BY symbol) USING (symbol)""",
    ),
)
def tx10_moods(spark, d):
    daily = within(dom.daily_news_sentiment(spark, d), AS_OF, 14)
    return rt.sentiment_facts(daily, nw.recent_trend(daily))


cte(
    "tail",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END AS speaker, substr(text, 1, 300) AS content FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations)
       WHERE a > 1 AND z > 1 AND z <= 9""",
)


@query("tx11_conversation_tail", using("tail", "SELECT * FROM tail"))
def tx11(spark, d):
    return rt.conversation_tail(dom.table(spark, d, "conversations"))


@query(
    "tx11_history_text",
    using("tail", "SELECT conv_id, string_agg(speaker || ': ' || content, chr(10) ORDER BY turn) AS history FROM tail GROUP BY conv_id"),
)
def tx11_text(spark, d):
    return rt.history_text(rt.conversation_tail(dom.table(spark, d, "conversations")))
