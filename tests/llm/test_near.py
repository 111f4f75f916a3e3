"""Substring dedup and near dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskframe.llm import components, hashing, near_dedup, substring_dedup

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def brute_substring(rows, size=13):
    first = {}
    for doc_id, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            if doc_id is not None:
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, t in rows:
        w = (t or "").encode().split()
        gone = {i + k for i in range(len(w) - size + 1) if doc_id is not None and first[tuple(w[i : i + size])] < doc_id for k in range(size)}
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def passages():
    shared, long = text(30), text(13)
    rows = [(i, f"{text(RNG.randint(0, 40))} {shared[: RNG.randint(0, 90)]} {text(5)}") for i in range(40)]
    rows += [(50 + i, f"{text(i)} {shared} {text(3)}") for i in range(9)]
    rows += [(70, long), (71, long), (72, long + " x"), (73, long[:-4]), (75, "a " * 50), (74, "a " * 30), (76, "A " * 50)]
    rows += [(80, None), (81, ""), (82, text(6000) + " " + shared), (70, long), (71, long), (None, long), (None, shared)]
    rows += [(90, "é ü " * 20), (91, "x " + "é ü " * 20), (-5, shared)]
    return rows


def test_substring_dedup(make_docs):
    rows = passages()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == brute_substring(rows)


def test_substring_spans_and_other_sizes(make_docs):
    rows = [(1, text(30)), (2, text(4))]
    rows.append((3, rows[1][1] + " " + rows[0][1] + " tail"))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(make_docs(rows), 9).collect()}
    assert [tuple(s) for s in got[3].spans] == [(4, 34)] and got[3].kept_text == rows[1][1] + " tail"
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(make_docs(rows), 7)


def test_cover_meets_every_shift():
    inside = set(np.flatnonzero(substring_dedup.COVER))
    for a in range(7):
        for b in range(7):
            assert any((a + k) % 7 in inside and (b + k) % 7 in inside for k in range(7))


def shingles(t, size):
    w = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute_near(rows, size=5, percent=80):
    sets = {d: shingles(t, size) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((d, len(shingles(t, size)), None if d is None else find(d)) for d, t in rows), key=repr)


def changed(t, share):
    w = t.split()
    for i in RNG.sample(range(len(w)), int(share * len(w))):
        w[i] = RNG.choice(VOCABULARY)
    return " ".join(w)


def families():
    rows, n = [], 0
    for size, copies in ((60, 25), (200, 60), (400, 8)):
        base = text(size)
        for _ in range(copies):
            rows.append((n := n + 1, changed(base, RNG.choice((0, 0.02, 0.04, 0.06, 0.09, 0.12)))))
    chain = text(150).split()
    for k in range(12):  # each links with the next one only
        rows.append((n := n + 1, " ".join(chain[8 * k : 8 * k + 80])))
    rows += [(n + 1, "One"), (n + 2, "one"), (n + 3, "two"), (n + 4, None), (n + 5, ""), (n + 6, " \n"), (n + 7, "a b"), (n + 8, "A\tB")]
    rows += [(1, rows[0][1]), (None, rows[0][1]), (None, None), (n + 20, text(9000)), (n + 4, None)]
    return rows


@pytest.mark.parametrize("size,percent", [(2, 80), (5, 80)])
def test_near_dedup(make_docs, size, percent):
    rows = families()
    got = near_dedup.near_dedup(make_docs(rows), size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_near(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_the_sample(make_docs, sample_texts):
    rows = sorted(sample_texts.items())
    got = near_dedup.near_dedup(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_near(rows)


def test_dropping_near_copies_keeps_the_columns(make_docs):
    base = text(200)
    docs = make_docs([(3, base), (1, changed(base, 0.01)), (4, None), (None, base)])
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 4, None], key=repr)


@pytest.mark.parametrize("run", [substring_dedup.substring_dedup, near_dedup.near_dedup, near_dedup.drop_near_duplicates])
def test_empty_table(make_docs, run):
    assert run(make_docs([(1, "x")]).limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 8), (8, 7), (200, 100), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 100 for i in (*range(100, 141), 200)}, 7: 7, 8: 7, 9: 7}


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (800, 100, 100))

    def sketch(value):
        return near_dedup.registers(np.array([(value * m).min() for m in near_dedup.MULTIPLIERS], np.uint64))

    x, y = sketch(np.concatenate([common, a])), sketch(np.concatenate([common, b]))
    assert (np.maximum(x, y) == sketch(np.concatenate([common, a, b]))).all()  # sketches merge
    signs = [(x > y).sum(), (x < y).sum(), (x == y).sum()]
    grid = np.linspace(0.01, 1, 100)
    best = grid[np.argmax([near_dedup.log_likelihood(g, 900.0, 900.0, *signs) for g in grid])]
    assert abs(best - 0.8) < 0.06
    low = (x & 255 == y & 255).sum(keepdims=True)
    size = np.array([900.0])
    assert near_dedup.plausible_bytes(low, size, size, 0.8).all() and not near_dedup.plausible_bytes(low, size, size, 0.9).any()


def test_words_and_hashes_do_not_depend_on_the_batch(sample_texts):
    texts = [t for _, t in sorted(sample_texts.items())] + [None, "", "  ", "a", "é ü"]
    whole = hashing.split_words(pa.array(texts))
    assert [whole.data[a:b].tobytes() for a, b in zip(whole.starts, whole.ends)] == [w for t in texts for w in (t or "").encode().split()]
    parts = [hashing.split_words(pa.array(texts)[i : i + 7]).hashes() for i in range(0, len(texts), 7)]
    assert (np.concatenate(parts) == whole.hashes()).all()
    assert hashlib.sha256(whole.hashes().tobytes()).hexdigest() == hashlib.sha256(np.concatenate(parts).tobytes()).hexdigest()


def test_repeated_rows_do_not_lengthen_lists(make_docs):
    text = " ".join(f"w{i}" for i in range(100))
    docs = make_docs([(1, text), *[(2, text)] * 30, *[(2, "other " + text)] * 3])
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("row_hash"))
    starts = {r.row_hash: r.starts for r in substring_dedup.repeated_windows(rows).collect()}
    assert sorted(len(x) for x in starts.values()) == [88, 88] and all(len(set(x)) == len(x) for x in starts.values())
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got) == [(1, 0), *[(2, 100)] * 33]
