"""News: article extraction, sentiment, daily aggregates, documents and chunks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import text as tx
from riskframe.functions.numeric import sentiment_label
from riskframe.scale import computed_once
from riskframe.sources.market import within


def extract_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the article text of each raw page."""
    return computed_once(pages, "content", tx.article_body(html))


def quality_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages whose long paragraphs give at least 100 characters, with headline and description."""
    page = F.col(html)
    h1 = tx.element_text(tx.first_element(page, "h1", "h1"))
    title = tx.element_text(tx.first_element(page, "title", "title"))
    content = tx.collapse_spaces(F.array_join(tx.paragraphs(page, 50), " "))
    named = F.coalesce(F.nullif(h1, F.lit("")), F.nullif(title, F.lit("")), F.lit("No Title"))
    return (
        computed_once(pages.withColumn("headline", named), "content", content)
        .where(F.length("content") >= 100)
        .withColumn("description", F.substring("content", 1, 500))
    )


# ---- sentiment --------------------------------------------------------------------


def blend(headline: Column, content: Column, content_text: Column) -> Column:
    """Headline 40 %, content 60 % where the content exceeds 100 characters, else the headline alone."""
    both = content_text.isNotNull() & (F.length(content_text) > 100)
    score = headline["score"] * 0.4 + content["score"] * 0.6
    confidence = headline["confidence"] * 0.4 + content["confidence"] * 0.6
    mixed = F.struct(score.alias("score"), confidence.alias("confidence"), sentiment_label(score).alias("label"))
    return F.when(both, mixed).otherwise(headline)


def score_articles(articles: DataFrame, scorer: Callable[[Column], Column] = tx.lexicon_sentiment) -> DataFrame:
    """Add sentiment_score, sentiment_confidence and sentiment_label.

    ``scorer`` maps a text column to struct(score, confidence, label): a column
    expression, or a pandas UDF around a model.
    """
    scored = articles.withColumns({"_h": scorer(F.col("headline")), "_c": scorer(F.col("content"))})
    scored = computed_once(scored, "_s", blend(F.col("_h"), F.col("_c"), F.col("content")))
    return scored.withColumns(
        {
            "sentiment_score": F.col("_s.score"),
            "sentiment_confidence": F.col("_s.confidence"),
            "sentiment_label": F.col("_s.label"),
        }
    ).drop("_h", "_c", "_s")


def model_scorer(predict: Callable[[pd.Series], pd.DataFrame]):
    """Wrap ``predict(texts) -> frame(score, confidence, label)`` as a scorer over Arrow batches."""

    @F.pandas_udf("score double, confidence double, label string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(texts)[["score", "confidence", "label"]]

    return score


def score_new_articles(articles: DataFrame, scorer=tx.lexicon_sentiment) -> DataFrame:
    """Score only the articles without a label and keep the others as they are."""
    made = ["sentiment_score", "sentiment_confidence", "sentiment_label"]
    new = articles.where(F.col("sentiment_label").isNull())
    done = articles.where(F.col("sentiment_label").isNotNull())
    return done.unionByName(score_articles(new.drop(*made), scorer).select(*articles.columns))


def stable_mean(value: str) -> Column:
    """A mean without the noise of the order in which doubles were added.

    Signs and ties of means are compared, and a retried task adds in another order.
    """
    return F.round(F.avg(value), 12) + F.lit(0.0)


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Mean, deviation and label counts per symbol and publication date."""
    label = F.col("sentiment_label")
    return scored.where(label.isNotNull()).groupBy("symbol", F.col("published").alias("date")).agg(
        stable_mean("sentiment_score").alias("avg_sentiment"),
        F.stddev_samp("sentiment_score").alias("sentiment_std"),
        F.count(F.lit(1)).alias("article_count"),
        F.count_if(label == "positive").alias("positive_count"),
        F.count_if(label == "negative").alias("negative_count"),
        F.count_if(label == "neutral").alias("neutral_count"),
    )


def sentiment_trends(daily: DataFrame, as_of: dt.date, days: int = 30, symbol: str | None = None) -> DataFrame:
    out = within(daily, as_of, days)
    return out if symbol is None else out.where(F.col("symbol") == symbol)


def mean_sentiment(daily: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    return within(daily, as_of, days).groupBy("symbol").agg(stable_mean("avg_sentiment").alias("avg_sentiment"))


def recent_trend(daily: DataFrame, n: int = 3) -> DataFrame:
    """Direction of the last ``n`` daily means, read newest first.

    Rising from newest to oldest counts as improving, as the feature defines it.
    """
    from riskframe.scale import top_per_key

    recent = top_per_key(daily.select("symbol", "date", "avg_sentiment"), ["symbol"], [F.desc("date")], n)
    series = F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "avg_sentiment"))), lambda x: x["avg_sentiment"]
    )
    vals = recent.groupBy("symbol").agg(series.alias("_v"))
    pairs = F.arrays_zip(
        F.slice("_v", 1, F.greatest(F.size("_v") - 1, F.lit(0))).alias("a"),
        F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))).alias("b"),
    )
    return vals.withColumn("_p", pairs).select(
        "symbol",
        F.when(F.forall("_p", lambda p: p["b"] >= p["a"]), "improving")
        .when(F.forall("_p", lambda p: p["b"] <= p["a"]), "declining")
        .otherwise("mixed")
        .alias("trend"),
    )


# ---- documents ----------------------------------------------------------------------


def build_documents(articles: DataFrame) -> DataFrame:
    """Headline and content, or description where the content is short, with metadata."""
    long_content = F.col("content").isNotNull() & (F.length("content") > 100)
    body = F.when(long_content, F.col("content")).otherwise(F.coalesce(F.col("description"), F.lit("")))
    return articles.select(
        "doc_id",
        F.concat(F.coalesce("headline", F.lit("")), F.lit("\n"), body).alias("text"),
        F.struct(
            F.coalesce("source", F.lit("Unknown")).alias("source"),
            F.coalesce("symbol", F.lit("GENERAL")).alias("stock_symbol"),
            F.col("published").cast("string").alias("date"),
            F.coalesce("url", F.lit("")).alias("url"),
        ).alias("metadata"),
    )


def fixed_chunks(documents: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``, covering the whole text."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(float(step))), F.lit(1)).cast("int")
    # chunks are cut before the explode, so the whole text is not copied to every row
    chunks = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(size))
    )
    out = documents.select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk"))
    return out.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


# Fixed values, tried in this order.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_text(text: str, size: int = 512, overlap: int = 50) -> list[str]:
    """Split at the coarsest separator that fits, then merge pieces up to ``size`` with overlap."""

    def pieces(part: str, level: int) -> Iterator[str]:
        if len(part) <= size:
            yield part
            return
        sep = SEPARATORS[level]
        if sep == "":
            for i in range(0, len(part), size):
                yield part[i : i + size]
            return
        bits = part.split(sep)
        for i, bit in enumerate(bits):
            whole = bit + sep if i < len(bits) - 1 else bit
            if whole:
                yield from pieces(whole, level + 1)

    chunks, held, length = [], [], 0
    for piece in pieces(text, 0):
        if held and length + len(piece) > size:
            chunks.append("".join(held).strip())
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def splitter_udtf(size: int = 512, overlap: int = 50):
    """A table function ``text -> (chunk_no, chunk)`` for lateral joins."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_no int, chunk string")
    class TextSplitter:
        def eval(self, text: str):
            for i, chunk in enumerate(split_text(text or "", size, overlap)):
                yield i, chunk

    return TextSplitter


def separator_chunks(documents: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks that end at paragraph, line, sentence or word boundaries."""
    split = splitter_udtf(size, overlap)
    docs = documents.select("doc_id", "text")
    return docs.lateralJoin(split(F.col("text").outer())).select("doc_id", "chunk_no", "chunk")
