"""Exact duplicates by progressive refinement: length, then a hash of the head, then a hash of the whole text.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` has become one space. Rows whose
length no other row has leave first; the rest are compared by the hash of their first ``HEAD`` characters, and only rows
that also share that are hashed whole. White space has to be folded before a text has a length, so length and head come
from the same pass over the texts.

Every shuffle of keys carries counts or hashes that were combined in the map tasks, so that a text with a third of all
rows costs one row per task.

Defined cases: null text counts as empty, all empty texts are one group. Of equal rows the smallest ``doc_id`` stays; a
null ``doc_id`` stays only if the group has no other. Equal rows that repeat a ``doc_id`` get the same verdict, so repeated
rows of the smallest id all stay; different texts of one ``doc_id``, or without any, each get their own. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import row_hash, without_rows, written

HEAD = 256
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def survivors(docs: DataFrame) -> DataFrame:
    """(n, head) of the texts that share both with another row: the groups that need their full content.

    One pass over the texts leaves 16 bytes a row in a written table, so that the refinement moves no text: lengths
    that occur once go first, then heads that occur once among the rows that are left.
    """
    keys = docs.select(normalised(F.col("text")).alias("t")).select(
        F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, HEAD)).alias("head")
    )
    keys = written(keys, "exact_keys")
    lengths = keys.groupBy("n").agg(F.count("*").alias("rows")).where("rows > 1").select("n")
    heads = keys.join(lengths, "n", "left_semi").groupBy("n", "head").agg(F.count("*").alias("rows"))
    return heads.where("rows > 1").select("n", "head")


def whole_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n, full) of the rows in surviving groups; ``full`` is the SHA-256 of the text."""
    return (
        docs.select("doc_id", row_hash(F.col("text")).alias("row_hash"), normalised(F.col("text")).alias("t"))
        .select("doc_id", "row_hash", "t", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, HEAD)).alias("head"))
        .join(survivors(docs), ["n", "head"], "left_semi")
        .select("doc_id", "row_hash", "n", sha256(F.col("t")).alias("full"))
    )


def equal_groups(hashes: DataFrame) -> DataFrame:
    """(n, full, keep_id, group_size) of every text that has an equal one."""
    groups = hashes.groupBy("n", "full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.where("group_size > 1")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The column with the SHA-256 is of every text, so here, and only here, texts without a copy are hashed whole as well.
    """
    hashed = docs.select("doc_id", normalised(F.col("text")).alias("t")).select(
        "doc_id", F.length("t").alias("n"), sha256(F.col("t")).alias("full")
    )
    found = hashed.join(equal_groups(whole_hashes(docs)), ["n", "full"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns they came with; only surviving groups are hashed whole."""
    hashes = written(whole_hashes(docs), "exact_hashes")
    copies = hashes.join(equal_groups(hashes), ["n", "full"]).where(~F.col("keep_id").eqNullSafe(F.col("doc_id")))
    return without_rows(docs, copies)
