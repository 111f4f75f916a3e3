"""Quality rules with cutoffs learned per language and source from mergeable quantile sketches.

Every document is measured once. A sketch of a metric is a histogram over buckets that keep the six leading bits of
the value (3 % wide), held as rows (lang, source, metric, bucket, count): sketches merge by adding counts, in map
tasks, in reducers and between groups, in any order and with the same result. A cutoff is a quartile widened by
``REACH`` times the distance of the quartiles and by the metric's ``SLACK``, so a group in which up to a quarter of the
documents is junk keeps its clean ones. Groups of fewer than ``LEAST`` documents use the sketch merged over the sources
of their language. Documents then join the cutoffs of their group.

A sketch has at most 64 + 32 * 57 buckets whatever the data, and a source with a third of all rows sends one row per
task, metric and bucket.

Defined cases: null or empty text has no words and fails; null ``lang`` or ``source`` is a group like any other; rows
that repeat, also by ``doc_id``, are rated one by one; an empty table gives an empty result. Other columns are never
read. Three-word windows are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tables import written

SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
#: Slack of each metric, in its unit. word_length has a lower cutoff too.
SLACK = {"symbols": 100, "dup_lines": 250, "repeats": 250, "word_length": 1000}
REACH = 3
LEAST = 40


def words_of(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    base = docs.select(
        "doc_id",
        "lang",
        "source",
        words_of(F.col("text")).alias("words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(lines).alias("lines"),
    )
    hashed = base.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "n_lines": F.size("lines").cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            "windows": F.when(
                F.size("words") >= 3,
                F.transform(
                    F.slice("words", 1, F.size("words") - 2),
                    lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("words", "lines")
    # Only texts in which a window comes back need the places of the windows: sorted by hash, equal ones are neighbours.
    ordered = hashed.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    places = ordered.withColumn(
        "twice",
        F.sort_array(
            F.transform(
                F.filter(
                    "placed",
                    lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]).eqNullSafe(F.lit(True))
                    | (x["h"] == F.get("placed", i + 1)["h"]).eqNullSafe(F.lit(True)),
                ),
                lambda x: x["i"],
            )
        ),
    ).drop("placed")
    # Each window covers its three words up to the start of the next one.
    covered = F.aggregate(
        F.transform("twice", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("twice", i + 1) - x, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("twice")


def per_mille(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN 1000 * {part} DIV {whole} ELSE 0 END")


METRICS = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def rated(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumns({**{m: per_mille(*parts) for m, parts in METRICS.items()}, "base_failed": failed})


def bucket(value: Column) -> Column:
    """The value with all but its six leading bits zero."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(ratings: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, count) over the documents that pass the base rules."""
    return (
        ratings.where("not base_failed")
        .select("lang", "source", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
        .groupBy("lang", "source", "metric", bucket(F.col("value")).alias("bucket"))
        .agg(F.count("*").alias("count"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("count").alias("count"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, docs, q1 and q3: the smallest bucket that a quarter or three quarters of the values reach."""
    group = Window.partitionBy(*keys, "metric")
    up_to = F.sum("count").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return (
        sketch.withColumns({"up_to": up_to, "docs": F.sum("count").over(group)})
        .groupBy(*keys, "metric")
        .agg(
            F.max("docs").alias("docs"),
            F.min(F.when(4 * F.col("up_to") >= F.col("docs"), F.col("bucket"))).alias("q1"),
            F.min(F.when(4 * F.col("up_to") >= 3 * F.col("docs"), F.col("bucket"))).alias("q3"),
        )
    )


def cutoffs(sketch: DataFrame) -> DataFrame:
    """lang, source and, for each metric, its highest and lowest value that stays."""
    own = quartiles(sketch, "lang", "source")
    wide = quartiles(merged(sketch, "lang"), "lang").select(
        F.col("lang").alias("lang_all"), F.col("metric").alias("metric_all"), F.col("q1").alias("q1_all"), F.col("q3").alias("q3_all")
    )
    small = F.col("docs") < LEAST
    both = own.join(wide, own["lang"].eqNullSafe(wide["lang_all"]) & (own["metric"] == wide["metric_all"])).select(
        "lang",
        "source",
        "metric",
        F.when(small, F.col("q1_all")).otherwise(F.col("q1")).alias("q1"),
        F.when(small, F.col("q3_all")).otherwise(F.col("q3")).alias("q3"),
    )
    slack = F.create_map(*[F.lit(x) for item in SLACK.items() for x in item])
    reach = REACH * (F.col("q3") - F.col("q1")) + slack[F.col("metric")]
    limits = both.select("lang", "source", "metric", (F.col("q3") + reach).alias("high"), (F.col("q1") - reach).alias("low"))
    pick = lambda metric, side: F.max(F.when(F.col("metric") == metric, F.col(side)))
    return limits.groupBy("lang", "source").agg(
        *[pick(m, "high").alias(f"{m}_high") for m in METRICS], pick("word_length", "low").alias("word_length_low")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, metrics, cutoffs of its group, base_failed and kept."""
    ratings = rated(written(measured(docs), "measured"))
    limits = cutoffs(written(sketches(ratings), "sketches"))
    limits = limits.withColumnsRenamed({"lang": "lang_of", "source": "source_of"})
    found = ratings.join(
        limits, ratings["lang"].eqNullSafe(limits["lang_of"]) & ratings["source"].eqNullSafe(limits["source_of"]), "left"
    )
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.col(m) <= F.col(f"{m}_high")
    inside &= F.col("word_length") >= F.col("word_length_low")
    # A group has no cutoffs only when all of its documents fail the base rules.
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("lang_of", "source_of")
