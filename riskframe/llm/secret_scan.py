"""Secrets in texts: patterns, and corpus-wide ownership of what they find.

Three patterns give the base spans; their values, and other long strings that look like credentials, are candidates.
Each candidate hash is aggregated over the corpus by distinct owner (``source``) and repository (document): a value that
``COPIED`` or more owners have is an example that was copied around, any other belongs to its owners and may be live.
Candidates beyond the base spans become spans of the kind ``live`` when they belong to their owners.

Candidates are made distinct by (hash, owner, document) before they are counted, with sums combined in the map tasks, so
that an example in a third of all documents costs one row per document; the join back has one row per hash on one side.

Defined cases: null text counts as empty; a null ``source`` is one owner; a null ``doc_id`` is one repository; rows that
repeat are scanned one by one and count once; an empty table gives an empty result. Other columns are never read.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import written

# Kind, pattern, group whose length counts, least length, and a cheap test that all matches pass.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [
    ("assign", ASSIGN, 2, 12, "(?i)passw|secret|token|api"),
    ("access", "AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    ("hex", "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
]
LIVE = ("live", "[A-Za-z0-9+/_=-]{20,}", 0, 20, "[A-Za-z0-9+/_=-]{20}")
ORDER = [k[0] for k in (*KINDS, LIVE)]
COPIED = 3
MASK = "<secret>"
BLOCK = 256


def running_sum(values: Column) -> Column:
    """Sums of an array of numbers up to each place, in blocks, so that long arrays take linear time."""
    none = F.array().cast("array<int>")

    def along(total: Column, x: Column) -> Column:
        return F.concat(total, F.array(F.coalesce(F.get(total, F.size(total) - 1), F.lit(0)) + x))

    last = F.greatest(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1)
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), none, along))
    joined = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("sums")),
        lambda acc, block: F.struct(
            (acc["total"] + F.coalesce(F.get(block, F.size(block) - 1), F.lit(0))).alias("total"),
            F.concat(acc["sums"], F.array(F.transform(block, lambda x: acc["total"] + x))).alias("sums"),
        ),
    )
    return F.flatten(joined["sums"])


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def with_spans(rows: DataFrame, name: str, number: int, pattern: str, group: int, least: int, test: str) -> DataFrame:
    """Adds the matches of a pattern in the column t as an array of (start, kind, end, value)."""
    hit = F.col("t").rlike(test)
    empty = F.array().cast("array<string>")
    matched = rows.withColumns(
        {
            "whole": F.when(hit, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(empty),
            "part": F.when(hit, F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).otherwise(empty),
            "gaps": F.when(hit, F.split("t", pattern, -1)).otherwise(empty),
        }
    )
    steps = F.when(
        F.size("whole") > 0,
        F.transform("whole", lambda m, i: F.length(m) + F.length(F.get("gaps", i))),
    ).otherwise(F.array().cast("array<int>"))
    ends = matched.withColumn("steps", steps).withColumn("ends", running_sum(F.col("steps")))
    spans = F.transform(
        "part",
        lambda v, i: F.struct(
            (F.get("ends", i) - F.length(F.get("whole", i))).alias("start"),
            F.lit(number).alias("kind"),
            F.get("ends", i).alias("end"),
            v.alias("value"),
        ),
    )
    return ends.withColumn(name, F.filter(spans, lambda s: F.length(s["value"]) >= least).cast(SPAN)).drop(
        "whole", "part", "gaps", "steps", "ends"
    )


def looks_live(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, row_hash, base, more): the base spans and the other candidates of each text, without the text."""
    rows = docs.select(
        "doc_id", F.col("source").alias("owner"), F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("text").alias("row_hash")
    )
    for number, (name, *rule) in enumerate((*KINDS, LIVE)):
        rows = with_spans(rows, name, number, *rule)
    base = rows.withColumn("base", F.sort_array(F.concat(*[name for name, *_ in KINDS])))
    more = F.filter(
        "live",
        lambda s: looks_live(s["value"]) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return base.select("doc_id", "owner", "row_hash", "base", more.alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """(candidate, owners, repositories) of each candidate hash."""
    one = found.select("owner", "doc_id", F.explode(F.concat("base", "more")).alias("s"))
    once = one.select(F.xxhash64("s.value").alias("candidate"), "owner", "doc_id").distinct()
    by_owner = once.groupBy("candidate", "owner").agg(F.count("*").alias("documents"))
    return by_owner.groupBy("candidate").agg(F.count("*").alias("owners"), F.sum("documents").alias("repositories"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_hash, base, spans (base and live ones), owned (the spans that may be live)."""
    found = written(found_spans(docs), "spans")
    owners = ownership(found)
    each = found.where(F.size("base") + F.size("more") > 0).select(
        "doc_id", "row_hash", F.explode(F.concat("base", "more")).alias("s")
    )
    rated = each.withColumn("candidate", F.xxhash64("s.value")).join(owners, "candidate").where(F.col("owners") < COPIED)
    owned = rated.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("s")).alias("owned"))
    owned = owned.withColumnsRenamed({"doc_id": "owned_id", "row_hash": "owned_hash"})
    joined = found.join(
        owned, found["doc_id"].eqNullSafe(owned["owned_id"]) & (found["row_hash"] == owned["owned_hash"]), "left"
    ).withColumn("owned", F.coalesce("owned", F.array().cast(SPAN)))
    live = F.filter("owned", lambda s: s["kind"] == len(KINDS))
    return joined.select("doc_id", "row_hash", "base", F.sort_array(F.concat("base", live)).alias("spans"), "owned")


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans, given in order, replaced by ``MASK``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.lit(MASK))).alias("parts"))
        )

    return F.aggregate(
        spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their owned spans masked; n_chars, where it exists, follows the new text."""
    owned = secret_scan(docs).where(F.size("owned") > 0).select("doc_id", "row_hash", "owned").dropDuplicates(["doc_id", "row_hash"])
    owned = owned.withColumnsRenamed({"doc_id": "masked_id", "row_hash": "masked_hash", "owned": "masked_spans"})
    joined = docs.join(owned, docs["doc_id"].eqNullSafe(owned["masked_id"]) & (F.xxhash64(docs["text"]) == owned["masked_hash"]), "left")
    text = F.when(owned["masked_spans"].isNotNull(), masked(docs["text"], owned["masked_spans"])).otherwise(docs["text"])
    out = joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], owned["masked_spans"].isNotNull().alias("masked_row"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("masked_row"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("masked_row")
