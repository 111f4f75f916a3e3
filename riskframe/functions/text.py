"""Text column expressions: cleaning, extraction from HTML, tokens, intents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.numeric import as_col, let

# Fixed values ---------------------------------------------------------------

DROPPED_TAGS = ["script", "style", "nav", "footer", "header", "aside", "iframe", "form"]

BODY_CLASSES = [
    "caas-body", "article-body", "story-body", "article-content", "entry-content", "post-content",
]
CONTENT_BODY_CLASS = "content-body"

COMPANY_NAMES = {
    "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "amazon": "AMZN",
    "meta": "META", "facebook": "META", "tesla": "TSLA", "nvidia": "NVDA", "netflix": "NFLX",
    "adobe": "ADBE", "salesforce": "CRM", "paypal": "PYPL", "shopify": "SHOP", "spotify": "SPOT",
    "uber": "UBER", "zoom": "ZM", "snowflake": "SNOW", "palantir": "PLTR", "coinbase": "COIN",
    "intel": "INTC", "amd": "AMD", "micron": "MU", "oracle": "ORCL", "ibm": "IBM", "cisco": "CSCO",
    "qualcomm": "QCOM", "workday": "WDAY", "crowdstrike": "CRWD", "datadog": "DDOG",
    "palo alto": "PANW", "servicenow": "NOW", "intuit": "INTU",
}

INTENT_PHRASES = [
    "highest risk", "lowest risk", "riskiest", "safest", "risk score", "risk rank", "alert",
    "watchlist", "our stocks", "my stocks", "my portfolio", "portfolio risk", "risk summary",
    "dashboard",
]

RANKING_PHRASES = [
    "highest risk", "riskiest", "lowest risk", "safest", "risk summary", "risk overview",
    "all stocks risk",
]

# This library's own scoring words; callers with a model pass their scores instead.
POSITIVE_WORDS = [
    "best", "beat", "beats", "excellent", "gain", "gains", "good", "great", "growth", "profit",
    "profits", "rally", "record", "strong", "surge", "upgrade", "upgraded",
]
NEGATIVE_WORDS = [
    "bad", "crash", "decline", "downgrade", "downgraded", "drop", "fall", "falls", "fraud", "hate",
    "idiot", "lawsuit", "loss", "losses", "miss", "missed", "risk", "stupid", "weak", "worst",
    "worthless",
]

# ----------------------------------------------------------------------------


def parse_symbols(text: Column | str) -> Column:
    """Comma separated symbols: trimmed, upper case, empties dropped."""
    parts = F.transform(F.split(as_col(text), ","), lambda s: F.upper(F.trim(s)))
    return F.filter(parts, lambda s: s != "")


def collapse_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(text), r"\s+", " "))


def truncate(text: Column | str, n: int, marker: str = "...") -> Column:
    """The first ``n`` characters and the marker, only for longer text."""
    t = as_col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(marker))).otherwise(t)


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), "<[^>]+>", "")


def word_tokens(text: Column | str) -> Column:
    return F.split(as_col(text), r"[^\p{L}\p{N}_]+")


def ticker_tokens(text: Column | str) -> Column:
    """Distinct words of two to five capital letters."""
    return F.array_distinct(F.filter(word_tokens(text), lambda w: w.rlike("^[A-Z]{2,5}$")))


def company_symbols(text: Column | str) -> Column:
    """Symbols of the company names that occur anywhere in the text, in list order."""
    low = F.lower(as_col(text))
    hits = [F.when(F.contains(low, F.lit(name)), F.lit(sym)) for name, sym in COMPANY_NAMES.items()]
    return F.array_distinct(F.filter(F.array(*hits), lambda s: s.isNotNull()))


def mentions(text: Column | str, phrases: Sequence[str]) -> Column:
    return F.lower(as_col(text)).rlike("|".join(phrases))


def headline_of(text: Column | str, n: int = 150) -> Column:
    return F.substring(F.substring_index(as_col(text), "\n", 1), 1, n)


def follow_ups(text: Column | str, n: int = 3) -> Column:
    """Up to ``n`` suggestions after the last ``FOLLOW_UP:`` marker, empty without one."""
    t = as_col(text)
    tail = F.substring_index(t, "FOLLOW_UP:", -1)
    items = F.filter(F.transform(F.split(F.trim(tail), r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.contains(t, F.lit("FOLLOW_UP:")), F.slice(items, 1, n)).otherwise(
        F.array().cast("array<string>")
    )


def title_case(text: Column | str) -> Column:
    return F.initcap(F.replace(as_col(text), F.lit("_"), F.lit(" ")))


# ---- HTML ---------------------------------------------------------------------


def drop_elements(html: Column, tags: Sequence[str] = DROPPED_TAGS) -> Column:
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return out


def element_text(fragment: Column) -> Column:
    """Text of a fragment: each text run trimmed, runs joined, common entities decoded.

    Spaces are collapsed first and a tag never spans another, so the patterns
    stay linear on pages with long blank runs or stray brackets.
    """
    out = F.regexp_replace(F.regexp_replace(fragment, r"\s+", " "), " ?<[^<>]+> ?", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def paragraphs(fragment: Column, longer_than: int = 0) -> Column:
    """Texts of the paragraphs of a fragment; an unclosed paragraph ends where the next begins."""
    marked = F.regexp_replace(F.regexp_replace(fragment, r"(?i)<p(\s[^>]*)?>", "\x01"), r"(?i)</p>", "\x02")
    pieces = F.split(marked, "\x01")
    bodies = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: element_text(F.substring_index(p, "\x02", 1)),
    )
    return F.filter(bodies, lambda t: F.length(t) > longer_than)


def up_to_close(rest: Column, tag: str) -> Column:
    """The text up to the tag that closes an element opened just before it, else empty."""
    pattern = rf"(?i)</?{tag}\b[^>]*>"

    def inner(tags: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            depth = acc["depth"] + F.when(acc["depth"] == 0, 0).when(F.startswith(t, F.lit("</")), -1).otherwise(1)
            return F.struct(depth.alias("depth"), (acc["n"] + F.when(acc["depth"] > 0, 1).otherwise(0)).alias("n"))

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        end = F.aggregate(tags, start, step)
        # the pieces between the tags, with the tags inside the element back in their places
        pieces = F.split(rest, pattern, -1)

        def body(e: Column) -> Column:
            within = F.zip_with(F.slice(pieces, 1, e["n"] - 1), F.slice(tags, 1, e["n"] - 1), lambda p, t: F.concat(p, t))
            return F.concat(F.array_join(within, ""), F.get(pieces, e["n"] - 1))

        return let(end, lambda e: F.when(e["depth"] == 0, body(e)).otherwise(""))

    return let(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), inner)


def first_element(html: Column, open_tag: str, tag: str) -> Column:
    """Inner HTML of the first element whose opening tag matches, elements of its own kind inside it included."""
    opened = F.split(html, rf"(?is)<{open_tag}(?=[\s>])[^>]*>", 2)
    return let(opened, lambda two: F.when(F.size(two) > 1, up_to_close(F.get(two, F.lit(1)), tag)).otherwise(""))


def class_token(name: str) -> str:
    """Pattern of a class attribute's value that holds ``name`` as a whole class."""
    return rf'(?:[^"]*\s)?{name}(?:\s[^"]*)?'


def article_body(html: Column | str, cap: int | None = None) -> Column:
    """Article text: ``<article>`` paragraphs, then known containers, then long body paragraphs."""

    def joined(fragment: Column, longer_than: int = 0) -> Column:
        return F.array_join(paragraphs(fragment, longer_than), " ")

    containers = [
        *[(rf'div\b[^>]*class="{class_token(c)}"', "div") for c in BODY_CLASSES],
        (r'div\b[^>]*itemprop="articleBody"', "div"),
        (rf'div\b[^>]*class="{class_token(CONTENT_BODY_CLASS)}"', "div"),
        ("main", "main"),
    ]

    def from_containers(page: Column, best: Column) -> Column:
        found = F.array(best, *[joined(first_element(page, open_tag, tag)) for open_tag, tag in containers])
        return F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))

    def fallback(page: Column, best: Column) -> Column:
        return let(
            from_containers(page, best),
            lambda t: F.when(F.length(t) >= 100, t).otherwise(joined(first_element(page, "body", "body"), 40)),
        )

    def choose(page: Column) -> Column:
        return let(
            joined(first_element(page, "article", "article")),
            lambda best: F.when(F.length(best) >= 100, best).otherwise(fallback(page, best)),
        )

    text = let(drop_elements(as_col(html)), choose)
    return let(collapse_spaces(text), lambda t: truncate(t, cap)) if cap else collapse_spaces(text)


# ---- sentiment -------------------------------------------------------------------


def whole_words(text: Column, words: Sequence[str]) -> Column:
    """Every occurrence of the words as a whole word, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})"), 0)


def lexicon_sentiment(text: Column | str, max_chars: int | None = None) -> Column:
    """struct(score, confidence, label) from word counts; under 10 characters neutral 0.

    The whole text is read; a model with a length limit can set ``max_chars``.
    """
    t = as_col(text)

    def verdict(c: Column) -> Column:
        hits = c["good"] + c["bad"]
        score = F.when(hits > 0, (c["good"] - c["bad"]) / F.nullif(hits, F.lit(0.0))).otherwise(F.lit(0.0))
        label = F.when(c["good"] > c["bad"], "positive").when(c["good"] < c["bad"], "negative").otherwise("neutral")
        return F.struct(score.alias("score"), (hits / (hits + F.lit(1.0))).alias("confidence"), label.alias("label"))

    def counts(low: Column) -> Column:
        none = F.array().cast("array<string>")
        hits = F.when(F.length(F.trim(low)) >= 10, whole_words(low, POSITIVE_WORDS + NEGATIVE_WORDS)).otherwise(none)
        return let(
            hits,
            lambda found: let(
                F.size(F.filter(found, lambda w: w.isin(POSITIVE_WORDS))).cast("double"),
                lambda good: F.struct(good.alias("good"), (F.size(found) - good).alias("bad")),
            ),
        )

    seen = F.coalesce(F.substring(t, 1, max_chars) if max_chars else t, F.lit(""))
    return let(let(F.lower(seen), counts), verdict)
