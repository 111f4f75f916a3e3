"""Byte-level BPE against another library, and packing against brute force."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import byte_bpe, hashing, near_dedup, packing, substring_dedup, units

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
JSON = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
RNG = random.Random(3)
ALPHABET = " \n\t\r\x0b'sdtlm ab1é９  　\x85\x1c漢.,!\U0001f600"
ODD = [
    "", " ", "  ", "\n", "don't  we'll\n\n x", "<|endoftext|> a", "x" * 3000, " " * 500 + "a", "a  b", "a  \n b", "漢字 かな " * 50,
    *("".join(RNG.choices(ALPHABET, k=RNG.randint(0, 40))) for _ in range(800)),
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in RANKS.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_str(JSON)
    found.encode_special_tokens = True
    return found


def test_every_token_is_one_piece():
    import sentencepiece

    tokens = byte_bpe.tokens_of(RANKS)
    model = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.model_proto(tokens))
    assert model.encode([t.decode("latin-1").translate(byte_bpe.TO_TEXT) for t in tokens]) == [[i] for i in range(len(tokens))]
    assert model.get_score(7) == -7


def test_encoding_and_round_trip(make_docs, reference, sample_texts):
    rows = list(sample_texts.items()) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (1, sample_texts[1]), (5000, None)]
    encoded = byte_bpe.encode(make_docs(rows), RANKS, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in byte_bpe.decode(encoded, RANKS).collect()), key=repr)
    assert got == sorted(((i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)


def test_decoding_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id bigint, ids array<int>")
    tokens = byte_bpe.tokens_of(RANKS)
    assert [bytes(r.decoded) for r in byte_bpe.decode(df, RANKS).orderBy("doc_id").collect()] == [b"", b"", tokens[0] + tokens[1]]


def test_units_survive_a_full_cache(tokenizer):
    small = units.Encoder(lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)], most=50)
    for begin in range(0, len(ODD), 20):
        part = ODD[begin : begin + 20]
        ids, at = small.ids(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def checked(rows, got, tokenizer, capacity):
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    places, have = defaultdict(list), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        have[r.doc_id].append(r)
    total = 0
    for doc_id, lists in want.items():
        cut = []
        for ids in lists:
            total += len(ids)
            first = (len(ids) - 1) % capacity + 1
            edges = [0, *range(first, len(ids) + 1, capacity)]
            cut += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in have[doc_id]) == sorted(cut)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), total / capacity


def test_packing(make_docs, tokenizer, sample_texts):
    rows = list(sample_texts.items()) + [(1000, None), (1001, ""), (1002, "a b " * 6000), (3, sample_texts[3]), (None, "x y"), (None, None)]
    rows += [(2000 + i, "same text") for i in range(300)]
    bins, least = checked(rows, packing.pack(make_docs(rows), JSON).collect(), tokenizer, 2048)
    assert bins <= np.ceil(least) + 1


def test_packing_in_chunks_and_sequences(make_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 7)
    rows = [(i, "word " * RNG.randint(0, 60)) for i in range(200)] + [(500 + i, "hot") for i in range(100)]
    got = packing.pack(make_docs(rows), JSON, 64, with_ids=True)
    bins, least = checked(rows, got.collect(), tokenizer, 64)
    assert bins <= 1.1 * least + 1
    whole = packing.sequences(got).collect()
    assert len(whole) == bins and sum(len(r.ids) for r in whole) == round(least * 64) and max(len(r.ids) for r in whole) <= 64


def test_fullest_finds_the_largest_sum():
    for seed in range(30):
        rng = random.Random(seed)
        counts = np.zeros(41, np.int64)
        for _ in range(rng.randint(0, 6)):
            counts[rng.randint(3, 40)] += rng.randint(1, 3)
        sums = {0}
        for length, n in enumerate(counts.tolist()):
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= 37}
        found = packing.fullest(counts, 37)
        assert sum(k * n for k, n in found.items()) == max(sums)
        assert all(n <= counts[k] for k, n in found.items())


def test_plan_is_bounded_by_the_capacity():
    counts = np.zeros(2049, np.int64)
    counts[1:] = np.random.default_rng(0).integers(0, 10**9, 2048)
    steps = packing.plan(counts, 2048)
    assert len(steps) < 40_000
    assert steps[:, 3].max() > 10**9


def test_empty_table(make_docs):
    empty = make_docs([(1, "x")]).limit(0)
    assert packing.pack(empty, JSON).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def thue_morse(letters: str, doublings: int = 10) -> str:
    word = letters[0]
    for _ in range(doublings):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_words_that_polynomial_hashes_confuse(spark, make_docs, reference, tokenizer):
    """Pairs of long words that agree in every polynomial hash modulo 2**64."""
    pairs = [(thue_morse("ab", k), thue_morse("ba", k)) for k in (10, 11)] + [(thue_morse("xy") + "z", thue_morse("yx") + "z")]
    for a, b in pairs:
        got = hashing.split_words(pa.array([f"{a} {b} {a[:8]} {a[:8]}\x00 {a}"])).hashes().tolist()
        assert got[0] != got[1] and got[2] != got[3] and got[0] == got[4]
    texts = [(i, w) for i, w in enumerate(w for pair in pairs for w in pair)]
    encoded = byte_bpe.encode(make_docs(texts).coalesce(1), RANKS, public_tokenizers.PATTERN)
    for r in byte_bpe.decode(encoded, RANKS).collect():
        text = dict(texts)[r["doc_id"]]
        assert bytes(r["decoded"]).decode() == text and list(r["ids"]) == reference.encode_ordinary(text)
    whole = {i: tokenizer.encode(w, add_special_tokens=False).ids for i, w in texts}
    for r in packing.pack(make_docs(texts).coalesce(1), JSON).collect():
        ids = whole[r["doc_id"]] + [0]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    near = near_dedup.near_dedup(make_docs(texts)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in near)
    spaced = [(i, " ".join([w] * 14)) for i, w in texts]
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(make_docs(spaced)).collect()} == {0}


def test_units_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(hashing.Words, "hashes", lambda self, table=None: np.zeros(len(self.starts), np.uint64))
    encoder = units.Encoder(lambda texts: [list(t.encode()) for t in texts])
    texts = ["one two, one twice", "", "one two\n", "a" * 40 + " " + "a" * 39 + "b"]
    for _ in range(2):
        ids, offsets = encoder.ids(pa.array(texts))
        assert [bytes(ids[a:b].tolist()).decode() for a, b in zip(offsets, offsets[1:])] == texts


def test_equal_pieces_spread_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 10)
    same = spark.range(1000).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).cast("bigint").alias("length"),
        F.lit(5).cast("bigint").alias("ids_crc32"), F.col("id").alias("salt"),
    )
    histogram = same.groupBy("length").agg(F.count("*").alias("pieces"))
    got = packing.numbered_by_length(same, histogram)
    assert set(got.columns) == {"length", "doc_id", "piece", "ids_crc32", "number"}
    assert sorted(r.number for r in got.collect()) == list(range(1000))
    chunks = same.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(100)).alias("c")).groupBy("c").count()
    assert chunks.agg(F.max("count")).first()[0] < 40
