"""Exact vector retrieval, template explanations and question contexts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import text as tx
from riskframe.functions.formatting import HALF
from riskframe.functions.numeric import let, sentiment_label
from riskframe.operators.news import stable_mean
from riskframe.scale import top_per_key

TOP_K = 5


def unit(vector: Column) -> Column:
    """The vector scaled to length one, as doubles."""
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: x / F.nullif(n, F.lit(0.0))))

    return let(F.transform(vector, lambda x: x.cast("double")), scaled)


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """The normalised mean vector per group, averaged per dimension."""
    dims = vectors.select(by, F.posexplode(vector).alias("_d", "_x"))
    means = dims.groupBy(by, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    packed = means.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda e: e["_m"]).alias("_v")
    )
    return packed.select(by, unit(F.col("_v")).alias(vector))


def _cell_top(n: int, filter_first: bool):
    """Best ``n`` corpus rows for each query of one cell."""

    def best(corpus: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "wanted", "doc_id", "symbol", "score"]
        if corpus.empty or queries.empty:
            return pd.DataFrame(columns=columns)
        docs = np.stack(corpus["vector"].to_numpy())
        asks = np.stack(queries["vector"].to_numpy())
        ids, symbols = corpus["doc_id"].to_numpy(), corpus["symbol"].to_numpy()
        scores = asks @ docs.T
        found = []
        for query_id, wanted, row in zip(queries["query_id"], queries["wanted"], scores):
            pool = np.arange(len(ids))
            if filter_first and wanted is not None:
                pool = np.flatnonzero(symbols == wanted)
            if len(pool) == 0:
                continue
            if len(pool) > n:
                # every row tied with the n-th best stays, so the order below is exact
                edge = np.partition(row[pool], len(pool) - n)[len(pool) - n]
                pool = pool[row[pool] >= edge]
            order = np.lexsort((ids[pool], -row[pool]))[:n]
            pick = pool[order]
            found.append(
                pd.DataFrame(
                    {"query_id": query_id, "wanted": wanted, "doc_id": ids[pick], "symbol": symbols[pick], "score": row[pick]}
                )
            )
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    return best


def vector_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    filter_first: bool = False,
    shard_rows: int = 50_000,
    query_block: int = 1_000,
) -> DataFrame:
    """The ``k`` nearest documents per query by dot product of unit vectors.

    ``corpus(doc_id, symbol, embedding)``, ``queries(query_id, wanted,
    embedding)``; ``wanted`` is a symbol or null. As the feature defines it, the
    2k nearest are found first and filtered by symbol afterwards, which may
    leave fewer than k; ``filter_first`` searches within the symbol instead.

    Corpus and queries are hashed into shards and blocks. One task multiplies
    one shard with one block and returns 2k rows per query, so neither side is
    broadcast or collected and no query-document pairs are written.
    """
    sizes = {
        "_shards": corpus.agg(F.ceil(F.greatest(F.count(F.lit(1)), F.lit(1)) / F.lit(float(shard_rows))).cast("int").alias("n")),
        "_blocks": queries.agg(F.ceil(F.greatest(F.count(F.lit(1)), F.lit(1)) / F.lit(float(query_block))).cast("int").alias("n")),
    }
    docs = corpus.select("doc_id", F.col("symbol").cast("string").alias("symbol"), unit(F.col("embedding")).alias("vector"))
    asks = queries.select("query_id", F.col("wanted").cast("string").alias("wanted"), unit(F.col("embedding")).alias("vector"))

    def placed(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64(key), sizes[own_n].scalar()).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), sizes[other_n].scalar() - 1)))

    docs = placed(docs, "doc_id", "_s", "_shards", "_q", "_blocks")
    asks = placed(asks, "query_id", "_q", "_blocks", "_s", "_shards")
    types = {**dict(queries.dtypes), **dict(corpus.dtypes)}
    n = k if filter_first else 2 * k
    cells = docs.groupBy("_s", "_q").cogroup(asks.groupBy("_s", "_q")).applyInPandas(
        _cell_top(n, filter_first),
        f"query_id {types['query_id']}, wanted string, doc_id {types['doc_id']}, symbol string, score double",
    )
    near = top_per_key(cells, ["query_id"], [F.desc("score"), F.asc("doc_id")], n, out="_near")
    kept = near.where(F.col("wanted").isNull() | (F.col("symbol") == F.col("wanted"))).drop("_near")
    ranked = top_per_key(kept, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, out="rank")
    return ranked.select("query_id", "doc_id", "symbol", "score", F.col("rank").cast("bigint").alias("rank"))


def confidence(found: Column, k: int = TOP_K) -> Column:
    return F.least(found.cast("double") / k, F.lit(1.0))


def question_confidence(has_data: Column, has_sources: Column) -> Column:
    return F.when(has_data, F.lit(0.9)).when(has_sources, F.lit(0.7)).otherwise(F.lit(0.5))


def recent_news(articles: DataFrame, k: int = TOP_K) -> DataFrame:
    """The newest ``k`` articles per symbol, ranked."""
    ranked = top_per_key(articles, ["symbol"], [F.desc("published"), F.asc("doc_id")], k, out="rank")
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def template_explanations(docs: DataFrame) -> DataFrame:
    """Explanation per symbol from its retrieved documents (symbol, rank, headline, sentiment_label)."""
    label = F.coalesce("sentiment_label", F.lit("neutral"))
    heads = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", label.alias("l"), "headline"))))
    counted = docs.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(label == "positive").alias("pos"),
        F.count_if(label == "negative").alias("neg"),
        F.count_if(label == "neutral").alias("neu"),
        heads.alias("h"),
    )
    n = {c: F.col(c).cast("string") for c in ("docs", "pos", "neg", "neu")}
    verdict = (
        F.when(F.col("neg") > F.col("pos"), F.concat(F.lit("Negative sentiment detected ("), n["neg"], F.lit(" negative articles)")))
        .when(F.col("pos") > F.col("neg"), F.concat(F.lit("Positive sentiment detected ("), n["pos"], F.lit(" positive articles)")))
        .otherwise(F.concat(F.lit("Mixed sentiment ("), n["pos"], F.lit(" positive, "), n["neg"], F.lit(" negative, "), n["neu"], F.lit(" neutral)")))
    )
    lines = F.array_join(
        F.transform("h", lambda e: F.concat(e["rank"].cast("string"), F.lit(". ["), F.upper(e["l"]), F.lit("] "), e["headline"])), "\n"
    )
    return counted.select(
        "symbol",
        F.col("docs").alias("num_docs"),
        confidence(F.col("docs")).alias("confidence"),
        F.concat(
            F.lit("Based on "), n["docs"], F.lit(" recent news articles for "), "symbol", F.lit(":\n\n"), verdict,
            F.lit(":\n\nKey headlines:\n"), lines,
        ).alias("explanation"),
    )


# ---- questions ------------------------------------------------------------------------


def detect_symbols(questions: DataFrame, universe: DataFrame) -> DataFrame:
    """(question_id, symbol, position) of the known symbols a question names.

    ``universe`` has symbol, ticker and risk_rank. Tickers come first in rank
    order, then company names in list order.
    """
    by_ticker = questions.select("question_id", F.explode(tx.ticker_tokens("text")).alias("ticker"), F.lit(0).alias("_kind"), F.lit(0).alias("_at"))
    by_name = questions.select("question_id", F.posexplode(tx.company_symbols("text")).alias("_at", "ticker")).select(
        "question_id", "ticker", F.lit(1).alias("_kind"), "_at"
    )
    found = by_ticker.unionByName(by_name).join(universe.select("ticker", "symbol", "risk_rank"), "ticker")
    place = F.when(F.col("_kind") == 0, F.struct(F.lit(0), F.col("risk_rank").cast("bigint"), F.col("symbol"))).otherwise(
        F.struct(F.lit(1), F.col("_at").cast("bigint"), F.col("symbol"))
    )
    first = found.groupBy("question_id", "symbol").agg(F.min(place).alias("_p"))
    # a question names few symbols: at most the distinct words of its own text
    listed = first.groupBy("question_id").agg(F.array_sort(F.collect_list("_p")).alias("_l"))
    return listed.select("question_id", F.posexplode(F.transform("_l", lambda p: p["symbol"])).alias("position", "symbol"))


def symbol_facts(scores: DataFrame) -> DataFrame:
    """The fact block of each symbol."""
    total = scores.agg(F.count(F.lit(1)).cast("string").alias("n"))

    def number(c: str) -> Column:
        return F.coalesce(F.format_string("%.3f", F.col(c) + HALF), F.lit("N/A"))

    return scores.select(
        "symbol",
        F.concat(
            F.lit("[Portfolio Data for "), "symbol", F.lit("]\n  Risk Score: "), number("risk_score"), F.lit(" ("),
            F.coalesce("risk_level", F.lit("N/A")), F.lit(")\n  Risk Rank: "), F.col("risk_rank").cast("string"),
            F.lit(" out of "), total.scalar(), F.lit("\n  Drivers: "), F.coalesce("risk_drivers", F.lit("N/A")),
            F.lit("\n  21d Volatility: "), number("volatility_21d"), F.lit("\n  Avg Sentiment: "), number("avg_sentiment"),
        ).alias("facts"),
    )


def sentiment_facts(daily: DataFrame, trends: DataFrame) -> DataFrame:
    """One line per symbol on its recent sentiment (``daily`` already cut to the look-back)."""
    mean = daily.groupBy("symbol").agg(stable_mean("avg_sentiment").alias("m"), F.sum("article_count").alias("n"))
    return mean.join(trends, "symbol").select(
        "symbol",
        F.concat(
            F.lit("  Sentiment: avg="), F.format_string("%.3f", F.col("m") + HALF), F.lit(" ("), sentiment_label("m"),
            F.lit("), trend="), "trend", F.lit(", articles="), F.col("n").cast("string"),
        ).alias("mood"),
    )


def ranking_text(scores: DataFrame, top: int = 10, bottom: int = 5) -> DataFrame:
    """One row: the riskiest and safest symbols and the level counts."""

    def lines(sign: int, k: int) -> DataFrame:
        keyed = scores.select("symbol", "risk_score", (F.col("risk_score") * sign).alias("_o"))
        shown = F.concat("symbol", F.lit(": "), F.format_string("%.3f", F.col("risk_score") + HALF))
        entry = F.struct("_o", "symbol", shown.alias("t"))
        return keyed.orderBy("_o", "symbol").limit(k).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "; ").alias("s")
        )

    counts = scores.agg(
        F.concat(
            F.lit("Total: "), F.count(F.lit(1)).cast("string"),
            *[
                F.concat(F.lit(f" | {lv}: "), F.count_if(F.col("risk_level") == lv).cast("string"))
                for lv in ("High", "Medium", "Low")
            ],
        ).alias("c")
    )
    return counts.select(
        F.concat(
            F.lit("Highest: "), lines(-1, top).scalar(), F.lit("\nLowest: "), lines(1, bottom).scalar(), F.lit("\n"), "c"
        ).alias("ranking")
    )


def news_picks(named: DataFrame, articles: DataFrame, questions: DataFrame, symbols: int = 3, per_symbol: int = 3, general: int = 5) -> DataFrame:
    """Articles for each question: the newest of its first symbols, else the newest overall.

    ``named`` is (question_id, symbol, position). The general list is one short
    array, attached only to questions without a pick of their own.
    """
    latest = recent_news(articles, per_symbol).select("symbol", "rank", "doc_id", "headline")
    own = (
        named.where(F.col("position") < symbols)
        .join(latest, "symbol")
        .select("question_id", "position", "rank", "doc_id", "headline")
    )
    newest = articles.orderBy(F.desc("published"), "doc_id").limit(general)
    age = F.datediff(F.lit("9999-01-01"), "published")
    listed = newest.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(age.alias("age"), "doc_id", "headline"))),
            lambda e, i: F.struct(
                (i + 1).cast("bigint").alias("rank"), e["doc_id"].alias("doc_id"), e["headline"].alias("headline")
            ),
        ).alias("l")
    )
    rest = (
        questions.select("question_id")
        .join(own.select("question_id").distinct(), "question_id", "left_anti")
        .withColumn("_e", F.explode(listed.scalar()))
        .select("question_id", F.lit(-1).alias("position"), "_e.rank", "_e.doc_id", "_e.headline")
    )
    return own.unionByName(rest)


def question_context(
    questions: DataFrame, universe: DataFrame, articles: DataFrame, moods: DataFrame | None = None
) -> DataFrame:
    """Data and news context of each question (question_id, text) in one row, without calling a model.

    ``universe`` is the scored universe with ticker and risk_rank.
    """
    named = detect_symbols(questions, universe)
    facts = symbol_facts(universe)
    if moods is not None:
        facts = facts.join(moods, "symbol", "left").select(
            "symbol", F.concat_ws("\n", "facts", "mood").alias("facts")
        )
    data = (
        named.join(facts, "symbol")
        .groupBy("question_id")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda e: e["symbol"]), ",").alias("symbols"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "facts"))), lambda e: e["facts"]), "\n").alias("data"),
        )
    )
    base = questions.join(data, "question_id", "left")
    asks = tx.mentions("text", tx.INTENT_PHRASES) | F.col("symbols").isNotNull()
    ranks = tx.mentions("text", tx.RANKING_PHRASES)
    base = base.withColumns({"asks_data": asks, "_ranks": ranks}).withColumn(
        "data_context",
        F.concat_ws("\n", "data", F.when(F.col("asks_data") & F.col("_ranks"), ranking_text(universe).scalar())),
    )
    picks = news_picks(named, articles, base.where("asks_data"))
    news = picks.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "rank", "headline"))), lambda e: e["headline"]), "\n"
        ).alias("news_context"),
    )
    out = base.join(news, "question_id", "left")
    sources = F.when(F.col("asks_data"), F.coalesce("sources", F.lit(0))).otherwise(F.lit(0))
    return out.select(
        "question_id",
        F.coalesce("symbols", F.lit("")).alias("symbols"),
        "asks_data",
        "data_context",
        F.when(F.col("asks_data"), F.coalesce("news_context", F.lit(""))).otherwise(F.lit("")).alias("news_context"),
        sources.alias("num_sources"),
        question_confidence(F.col("data_context") != "", sources > 0).alias("confidence"),
    )


def conversation_tail(turns: DataFrame, keep: int = 8, max_chars: int = 300) -> DataFrame:
    """The last ``keep`` messages of each conversation without its first and its last one.

    The newest ``keep + 1`` turns are taken by a group limit and the ends by
    an aggregate, so a very long conversation is never sorted as a whole in one task.
    """
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("_first"), F.max("turn").alias("_last"))
    recent = top_per_key(turns, ["conv_id"], [F.desc("turn")], keep + 1)
    kept = recent.join(ends, "conv_id").where((F.col("turn") > F.col("_first")) & (F.col("turn") < F.col("_last")))
    return kept.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "User").otherwise("Assistant").alias("speaker"),
        F.substring("text", 1, max_chars).alias("content"),
    )


def history_text(tail: DataFrame) -> DataFrame:
    """The tail of each conversation as one text (at most ``keep`` short lines)."""
    line = F.struct("turn", F.concat("speaker", F.lit(": "), "content").alias("l"))
    return tail.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda e: e["l"]), "\n").alias("history")
    )
