import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskframe.functions import dates as dts
from riskframe.functions import formatting as fmt
from riskframe.functions import text as tx
from riskframe.operators import news as nw
from riskframe.operators import retrieval as rt
from riskframe.sources import market


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


LONG = "This paragraph has clearly more than forty characters of text. " * 3


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<body><article><p>{LONG}</p><script>var x='</p>'</script><p> a <b>b</b> c</p></article><p>no</p></body>", f"{LONG.strip()} abc"),
        (f"<body><article><p>short</p></article><div class='x'></div><div class=\"story-body wide\"><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><main><p>{LONG}</p></main></body>", LONG.strip()),
        (f"<body><p>tiny</p><p>{LONG}</p><nav><p>{LONG}</p></nav></body>", LONG.strip()),
        (f"<body><article><p>one<p>{LONG}<P class='q'>two &amp; three</article></body>", f"one {LONG.strip()} two & three"),
        ("<body><article><p>short</p></article></body>", ""),
    ],
)
def test_article_body(spark, html, want):
    assert one(spark, html, tx.article_body) == want


def test_article_cap(spark):
    page = f"<article><p>{'x' * 6000}</p></article>"
    assert one(spark, page, tx.article_body) == "x" * 6000
    assert one(spark, page, lambda c: tx.article_body(c, 5000)) == "x" * 5000 + "..."


def test_containers_end_where_they_close(spark):
    page = f"<body><div class=\"story-body\"><div>in</div><p>{LONG}</p><div><div>x</div></div><p>after</p></div><p>{LONG}out</p></body>"
    assert one(spark, page, tx.article_body) == f"{LONG.strip()} after"
    assert one(spark, "<article>a<article>b</article>c", lambda c: tx.first_element(c, "article", "article")) == ""
    assert one(spark, "<ARTICLE x='1'>a<article>b</article>c</article>d", lambda c: tx.first_element(c, "article", "article")) == "a<article>b</article>c"


def test_class_names_match_whole(spark):
    page = f"<body><div class='x'></div><div class=\"article-body-ads\"><p>{LONG}ad</p></div><div class=\"wide article-body\"><p>{LONG}</p></div></body>"
    assert one(spark, page, tx.article_body) == LONG.strip()


@pytest.mark.parametrize(
    "text,score,label",
    [
        ("strong profit growth", 1.0, "positive"),
        ("a bad loss, but great gains", 0.0, "neutral"),
        ("fraud and lawsuit", -1.0, "negative"),
        ("good", 0.0, "neutral"),  # under ten characters
        ("goodness gracious", 0.0, "neutral"),  # whole words only
        (None, 0.0, "neutral"),
    ],
)
def test_lexicon(spark, text, score, label):
    got = one(spark, text, tx.lexicon_sentiment)
    assert (got["score"], got["label"]) == (score, label)


def test_lexicon_reads_the_whole_text(spark):
    assert one(spark, "word " * 30_000 + "fraud", tx.lexicon_sentiment)["score"] == -1.0


@pytest.mark.parametrize("n,both", [(100, False), (101, True)])
def test_blend_needs_more_than_100_characters(spark, n, both):
    content = ("fraud " * 20)[:n - 1] + "."
    df = spark.createDataFrame([("strong profit", content)], "headline string, content string")
    got = nw.score_articles(df).first()
    assert got["sentiment_score"] == pytest.approx(1.0 * 0.4 - 0.6 if both else 1.0)


def test_tickers_and_names(spark):
    assert one(spark, "AAPL, éAB MSFT_X A TOOLONG (UBER)", tx.ticker_tokens) == ["AAPL", "UBER"]
    assert one(spark, "Google and Alphabet beat Palo Alto", tx.company_symbols) == ["GOOGL", "PANW"]


@pytest.mark.parametrize(
    "text,want",
    [("x FOLLOW_UP: a | b || c | d", ["a", "b", "c"]), ("no marker", []), ("FOLLOW_UP: old FOLLOW_UP: new", ["new"])],
)
def test_follow_ups(spark, text, want):
    assert one(spark, text, tx.follow_ups) == want


def test_symbol_list(spark):
    assert one(spark, " aapl, ,msft,,Ibm ", tx.parse_symbols) == ["AAPL", "MSFT", "IBM"]


@pytest.mark.parametrize("size,overlap", [(512, 50), (40, 10), (7, 3)])
def test_fixed_chunks_cover_the_text(spark, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "abc")], "doc_id bigint, text string")
    got = nw.fixed_chunks(df, size, overlap).orderBy("doc_id", "chunk_no").collect()
    chunks = [r["chunk"] for r in got if r["doc_id"] == 1]
    assert chunks[0] + "".join(c[overlap:] for c in chunks[1:]) == text
    assert all(len(c) <= size for c in chunks)
    assert [r["chunk"] for r in got if r["doc_id"] == 3] == ["abc"]


@pytest.mark.parametrize("size,overlap", [(60, 15), (512, 50)])
def test_separator_chunks(spark, size, overlap):
    text = "First part. Second sentence here.\nA new line with words\n\n" + "word " * 200 + "x" * 130
    chunks = nw.split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    joined = " ".join(chunks)
    assert all(word in joined for word in ("First", "sentence", "line"))
    assert "".join(chunks).count("x") >= 130
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r["chunk"] for r in nw.separator_chunks(df, size, overlap).orderBy("chunk_no").collect()] == chunks


def test_dates(spark):
    default = F.lit("2000-01-01").cast("timestamp")
    for text, want in [
        ("1700000000", "2023-11-14"), ("2024-02-03T04:05:06Z", "2024-02-03"), ("2024-13-99", "2000-01-01"),
        ("soon", "2000-01-01"), (None, "2000-01-01"),
    ]:
        assert one(spark, text, lambda c: dts.parse_published(c, default).cast("date").cast("string")) == want
    assert one(spark, "x", dts.coerce_timestamp) is None


def test_forecast_calendar_skips_weekends(spark):
    friday = dt.date(2024, 3, 1)
    got = one(spark, friday, lambda c: dts.forecast_dates(c, 6), "date")
    assert got == [friday] + [dt.date(2024, 3, d) for d in (4, 5, 6, 7, 8, 11)]


def test_formats(spark):
    assert one(spark, 0.12345, fmt.percent, "double") == "12.35%"
    assert one(spark, None, fmt.percent, "double") == "N/A"
    assert [one(spark, v, fmt.humanise_volume, "bigint") for v in (999, 1500, 2_500_000, 3_000_000_000, None)] == [
        "999", "1.5K", "2.5M", "3.0B", "",
    ]


# ---- retrieval ------------------------------------------------------------------------------


def test_top_k_filters_after_the_nearest(spark):
    corpus = spark.createDataFrame(
        [(i, "A" if i % 2 else "B", [1.0, i / 100.0]) for i in range(40)], "doc_id bigint, symbol string, embedding array<double>"
    )
    queries = spark.createDataFrame([(1, "A", [1.0, 0.0]), (2, None, [0.0, 1.0])], "query_id bigint, wanted string, embedding array<double>")
    got = rt.vector_top_k(corpus, queries, k=3, shard_rows=7, query_block=1).orderBy("query_id", "rank").collect()
    # the six nearest to query 1 are 0..5, of which three are A
    assert [r["doc_id"] for r in got if r["query_id"] == 1] == [1, 3, 5]
    assert [r["doc_id"] for r in got if r["query_id"] == 2] == [39, 38, 37]


def test_top_k_may_return_fewer_but_not_when_filtered_first(spark):
    corpus = spark.createDataFrame(
        [(i, "A" if i > 30 else "B", [1.0, i / 100.0]) for i in range(40)], "doc_id bigint, symbol string, embedding array<double>"
    )
    queries = spark.createDataFrame([(1, "A", [1.0, 0.0])], "query_id bigint, wanted string, embedding array<double>")
    assert rt.vector_top_k(corpus, queries, k=3).count() == 0
    first = rt.vector_top_k(corpus, queries, k=3, filter_first=True, shard_rows=9).orderBy("rank").collect()
    assert [r["doc_id"] for r in first] == [31, 32, 33]


def test_top_k_orders_ties_by_id(spark):
    corpus = spark.createDataFrame([(i, "A", [1.0, 0.0]) for i in range(30)], "doc_id bigint, symbol string, embedding array<double>")
    queries = spark.createDataFrame([(1, None, [1.0, 0.0])], "query_id bigint, wanted string, embedding array<double>")
    got = rt.vector_top_k(corpus, queries, k=2, shard_rows=5).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 1]


@pytest.mark.parametrize("n,want", [(1, []), (2, []), (3, [1]), (10, list(range(1, 9))), (12, list(range(3, 11)))])
def test_conversation_tail(spark, n, want):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", "x" * 400) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = rt.conversation_tail(df).orderBy("turn").collect()
    assert [r["turn"] for r in got] == want
    assert all(len(r["content"]) == 300 for r in got)


@pytest.mark.parametrize(
    "newest_first,want",
    [([1.0, 2.0, 3.0], "improving"), ([3.0, 2.0, 1.0], "declining"), ([1.0, 3.0, 2.0], "mixed"), ([1.0], "improving"), ([2.0, 2.0], "improving")],
)
def test_trend_is_read_newest_first(spark, newest_first, want):
    rows = [("A", dt.date(2024, 1, 31) - dt.timedelta(days=i), v) for i, v in enumerate(newest_first)]
    rows.append(("A", dt.date(2023, 1, 1), 99.0)) if len(newest_first) == 3 else None
    df = spark.createDataFrame(rows, "symbol string, date date, avg_sentiment double")
    assert nw.recent_trend(df).first()["trend"] == want


def test_incremental_scoring_keeps_stored_labels(spark):
    rows = [(1, "strong profit", "", 0.7, 0.9, "positive"), (2, "fraud and loss", "", None, None, None)]
    df = spark.createDataFrame(
        rows, "doc_id bigint, headline string, content string, sentiment_score double, sentiment_confidence double, sentiment_label string"
    )
    got = {r["doc_id"]: (r["sentiment_score"], r["sentiment_label"]) for r in nw.score_new_articles(df).collect()}
    assert got == {1: (0.7, "positive"), 2: (-1.0, "negative")}


def test_normalise_wide_bars(spark):
    df = spark.createDataFrame(
        [("2024-01-02 00:00:00", 1.0, 2.0, 0.5, 1.5, 10, None), ("2024-01-03 00:00:00", 1.0, 2.0, 0.5, None, 10, 3.0)],
        "Date string, AAA_Open double, aaa_HIGH double, AAA_low double, AAA_Close double, AAA_Volume bigint, BBB_Close double",
    )
    got = {(r["symbol"], str(r["date"]), r["close"]) for r in market.normalise_bars(df, ["AAA", "BBB"], "Date").collect()}
    assert got == {("AAA", "2024-01-02", 1.5), ("BBB", "2024-01-03", 3.0)}
