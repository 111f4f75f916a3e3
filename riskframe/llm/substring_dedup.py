"""Removal of word passages that an earlier document has, by anchors on a difference cover.

A window is ``size`` consecutive words. Positions whose remainder modulo ``PERIOD`` = 7 is 0, 1 or 3 are a difference
cover: any two positions reach the cover together after the same 0 to 6 steps. So when two documents share a window,
they share an anchor of ``size - 6`` words that starts at cover positions of both. The work is done in four steps:

1. hash the anchors at cover positions (3 of 7) and keep the hashes that two documents have,
2. find the positions of those anchors in each document,
3. extend: hash the whole windows around them, which are the only ones that can repeat, and find for each hash the
   smallest document,
4. drop the words of the windows that a smaller document has.

Equal anchors and windows meet in sums (smallest and largest document per hash, combined in the map tasks) and in joins
with one row per hash on one side, which Spark splits when a hash is hot. No pairs of documents are made, and what one
task collects is the positions of one document.

Defined cases: null text has no words; documents shorter than a window lose nothing; rows that repeat a ``doc_id`` are
not smaller than each other, each loses what a smaller id has; rows without ``doc_id`` neither lose nor remove words; an
empty table gives an empty result. Other columns are never read. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing
from riskframe.llm.tables import written

PERIOD = 7
COVER = np.isin(np.arange(PERIOD), (0, 1, 3))


def places(words: hashing.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, document and position in it of each window of ``size`` words."""
    at = hashing.window_starts(words, size)
    doc = words.doc()[at]
    return at, doc, at - words.first[doc]


def anchors(size: int):
    """Rows (h, doc_id, row_hash, pos) of the anchors at cover positions."""

    def run(batches):
        for batch in hashing.slices(batches):
            words = hashing.split_words(batch.column("text"))
            at, doc, pos = places(words, size - PERIOD + 1)
            keep = COVER[pos % PERIOD]
            at, doc, pos = at[keep], doc[keep], pos[keep]
            h = hashing.windows(words.hashes(), size - PERIOD + 1)[at] if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    batch.column("doc_id").take(pa.array(doc)),
                    batch.column("row_hash").take(pa.array(doc)),
                    pa.array(pos.astype(np.int32)),
                ],
                names=["h", "doc_id", "row_hash", "pos"],
            )

    return run


def extended(size: int):
    """Rows (h, doc_id, row_hash, pos) of the windows that hold one of the document's shared anchors."""

    def run(batches):
        for batch in hashing.slices(batches):
            words = hashing.split_words(batch.column("text"))
            shared = batch.column("shared")
            begin = words.first[np.repeat(np.arange(len(shared)), shared.value_lengths().to_numpy())]
            found = np.zeros(len(words.starts) + 1, np.int64)
            mark = begin + shared.flatten().to_numpy()
            low = np.maximum(mark - PERIOD + 1, begin)
            np.add.at(found, low, 1)
            np.add.at(found, mark + 1, -1)
            at, doc, pos = places(words, size)
            keep = np.cumsum(found)[at] > 0
            at, doc, pos = at[keep], doc[keep], pos[keep]
            h = hashing.windows(words.hashes(), size)[at] if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    batch.column("doc_id").take(pa.array(doc)),
                    batch.column("row_hash").take(pa.array(doc)),
                    pa.array(pos.astype(np.int32)),
                ],
                names=["h", "doc_id", "row_hash", "pos"],
            )

    return run


def without(size: int):
    """Rows (doc_id, n_words, n_removed, spans, kept_text) of the documents with their repeated windows."""

    def run(batches):
        for batch in hashing.slices(batches):
            out = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "kept_text": []}
            for doc_id, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts"))):
                words = (text or "").encode().split()  # splits at the same six bytes
                removed = np.zeros(len(words) + 1, np.int8)
                for start in starts or ():
                    removed[start : start + size] = 1
                steps = np.diff(removed, prepend=0)
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(removed.sum()))
                out["spans"].append(
                    [{"first": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1))]
                )
                out["kept_text"].append(b" ".join(compress(words, removed[:-1] == 0) if starts else words).decode())
            yield pa.RecordBatch.from_pydict(out, schema=RESULT)

    return run


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
        ("kept_text", pa.string()),
    ]
)
PLACED = "h bigint, doc_id bigint, row_hash bigint, pos int"


def shared_hashes(rows: DataFrame) -> DataFrame:
    """(h, first_doc) of the hashes that at least two documents have."""
    spread = rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return spread.where("first_doc < last_doc").select("h", "first_doc")


def per_document(rows: DataFrame, name: str) -> DataFrame:
    """The distinct places of each text, which rows that repeat do not lengthen."""
    return rows.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias(name))


def repeated_windows(rows: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, row_hash, starts): the windows of each document that a smaller document has."""
    known = rows.where("doc_id IS NOT NULL")
    anchored = known.mapInArrow(anchors(size), PLACED)
    shared = written(shared_hashes(anchored).select("h"), "shared_anchors")
    around = written(per_document(anchored.join(shared, "h", "left_semi"), "shared"), "anchor_places")
    whole = known.join(around, ["doc_id", "row_hash"]).select("doc_id", "row_hash", "text", "shared")
    windows = written(whole.mapInArrow(extended(size), PLACED), "windows")
    first = written(shared_hashes(windows), "shared_windows")
    return written(per_document(windows.join(first, "h").where("doc_id > first_doc"), "starts"), "repeats")


def substring_dedup(docs: DataFrame, size: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans of removed words and kept_text."""
    if size <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("row_hash"))
    repeats = repeated_windows(rows, size)
    joined = rows.join(repeats, ["doc_id", "row_hash"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(
        without(size), "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<first:int,end:int>>, kept_text string"
    )
