"""Packing of tokenised documents into few sequences of bounded length: minimum bin slack over the histogram of lengths.

Which document has a length does not matter for the packing, so the plan is made from the number of pieces of each
length, at most ``capacity`` numbers however large the corpus is. A bin starts with the largest length left; a subset
sum over the other lengths, with a whole number as the bit set of reachable sums, finds the fullest bin. The same
combination is then used as often as the numbers allow, and removed. A combination leaves some length with fewer pieces
than it needs, so there are at most about ``capacity`` * ln(``capacity``) of them: the plan is small whatever the data.

Pieces of one length are then numbered by hash chunks of about ``CHUNK`` rows, so a length that a third of all pieces
have is spread over many tasks, and each takes its place in the plan by its number.

Defined cases: null and empty texts are one piece that holds the end token; rows that repeat, also by ``doc_id``, are
packed one by one; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import hashing
from riskframe.llm.tables import written
from riskframe.llm.units import Encoder

CHUNK = 10_000
END = 0


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return Encoder(lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def pieces(docs: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents, ended by ``END``, in pieces of at most ``capacity`` tokens.

    Only longer documents are cut; their first piece is the shorter one.
    """

    def run(batches):
        for batch in hashing.slices(batches):
            ids, at = encoder(vocabulary).ids(batch.column("text"))
            rows: dict[str, list] = {name: [] for name in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], END).astype("<u4")
                first = (len(own) - 1) % capacity + 1
                for k, end in enumerate(range(first, len(own) + 1, capacity)):
                    start = max(0, end - capacity)
                    start = 0 if k == 0 else start
                    for name, value in zip(
                        rows, (i, k, start, end - start, zlib.crc32(own[start:end].tobytes()), own[start:end] if with_ids else None)
                    ):
                        rows[name].append(value)
            columns = [
                batch.column("doc_id").take(pa.array(rows["row"], pa.int64())),
                pa.array(rows["piece"], pa.int32()),
                *(pa.array(rows[name], pa.int64()) for name in ("start", "length", "ids_crc32")),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """{length: pieces} with the largest sum up to ``room``, by subset sums over the lengths that are left."""
    reach, steps = 1, []
    within = (1 << room + 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, share = min(int(counts[length]), room // length), 1
        while left:  # 1, 2, 4, ... pieces at once reach every number of them
            share = min(share, left)
            steps.append((length, share, reach))
            reach |= reach << length * share & within
            left -= share
            share *= 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {}
    for length, share, before in reversed(steps):
        if not before >> total & 1:
            total -= length * share
            found[length] = found.get(length, 0) + share
    return found


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first number, pieces per bin, first bin, offset in the bin), by length and number."""
    counts = counts.copy()
    rows, used, bins = [], np.zeros_like(counts), 0
    largest = capacity
    while True:
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            return np.array(sorted(rows), np.int64).reshape(-1, 5)
        counts[largest] -= 1
        chosen = fullest(counts, capacity - largest)
        counts[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(int(counts[length]) // n for length, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, int(used[length]), n, bins, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += n * length
        bins += times


def placed(numbered: DataFrame, steps: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to rows with a length and a number among the rows of that length."""
    keys = steps[:, 0] << 44 | steps[:, 1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
                step = steps[np.searchsorted(keys, length << 44 | number, "right") - 1]
                along = number - step[:, 1]
                out = [pa.array(step[:, 3] + along // step[:, 2]), pa.array(step[:, 4] + along % step[:, 2] * length)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"{numbered._jdf.schema().toDDL()}, sequence_id bigint, offset bigint").drop("number")


def numbered_by_length(cut: DataFrame, histogram: DataFrame) -> DataFrame:
    """Adds number: 0, 1, ... within each length. histogram has length and pieces.

    Rows that are equal in all columns differ in ``salt``, which goes, so they spread over the chunks like any others.
    """
    chunks = F.ceil(F.col("pieces") / CHUNK)
    rows = cut.join(histogram, "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), chunks)).drop("pieces")
    sizes = rows.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(F.col("length"), F.col("chunk"), F.coalesce(before, F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "salt")) - 1
    return rows.join(begins, ["length", "chunk"]).withColumn("number", F.col("begin") + within).drop("chunk", "begin", "salt")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids if asked for, sequence_id and offset."""
    cut = written(pieces(docs, vocabulary, capacity, with_ids).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    histogram = written(cut.groupBy("length").agg(F.count("*").alias("pieces")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram.toLocalIterator():  # at most ``capacity`` rows
        counts[row["length"]] = row["pieces"]
    return placed(numbered_by_length(cut, histogram), plan(counts, capacity))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence, at most ``capacity``, of pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
