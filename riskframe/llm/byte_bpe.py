"""Byte-level BPE through a sentencepiece model that is written directly from a vocabulary of ranks.

Every byte becomes one character, every token one piece with the score minus its rank, and normalisation is the
identity: merging the best scored pair first is then the merge order of the ranks. Texts are split by the public
pattern, each match is encoded by itself; decoding is the inverse of the byte mapping.

Defined cases: null and empty texts have no ids and decode to nothing; rows that repeat are encoded one by one; an empty
table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskframe.llm import hashing
from riskframe.llm.units import Encoder, spread

FIRST = 0x100  # byte b is written as the character FIRST + b
TO_TEXT = {b: chr(FIRST + b) for b in range(256)}
UNKNOWN, BPE = 2, 2


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def tokens_of(ranks: bytes) -> list[bytes]:
    """The bytes of each token by its rank."""
    pairs = [line.split() for line in ranks.splitlines() if line]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [found[i] for i in range(len(found))]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes and nested messages by length, floats in four bytes, whole numbers as varints."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3) + varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is token i; the unknown piece that it must have comes last."""
    pieces = [
        field(1, field(1, token.decode("latin-1").translate(TO_TEXT).encode()) + field(2, float(-rank)))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, UNKNOWN)))
    trainer = field(2, field(3, BPE))
    identity = field(3, field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0))
    return b"".join(pieces) + trainer + identity


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    import regex
    import sentencepiece

    tokens = tokens_of(ranks)
    model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
    split = regex.compile(pattern)
    whole = {token: rank for rank, token in enumerate(tokens)}

    def encode(texts: list[str]) -> list[list[int]]:
        matches = [[part.encode() for part in split.findall(text)] for text in texts]
        # a match that is a token needs no merges
        rest = list({part for parts in matches for part in parts if part not in whole})
        merged = dict(zip(rest, model.encode([part.decode("latin-1").translate(TO_TEXT) for part in rest], num_threads=1)))
        ids = lambda part: (whole[part],) if part in whole else merged[part]
        return [[i for part in parts for i in ids(part)] for parts in matches]

    return Encoder(encode)


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids) of each text, without special tokens."""

    def run(batches):
        for batch in hashing.slices(batches):
            ids, at = encoder(ranks, pattern).ids(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


@lru_cache(maxsize=2)
def byte_table(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, one after the other, with the start and the length of each."""
    tokens = tokens_of(ranks)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the bytes of its ids."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, start, length = byte_table(ranks)
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = data[spread(start[ids], length[ids])]
            counts = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length[ids])])
            at = ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]
            column = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(texts))]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{encoded._jdf.schema().toDDL()}, decoded binary")
