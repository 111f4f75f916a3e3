"""Spelling variants against all pairs of words and against SQL."""

import random
import zlib
from collections import Counter

import pytest

from riskframe.llm import queries, spelling_variants as sv
from tests import oracle

LETTERS = "[A-Za-zÀ-ÿ]"


def near(a, b):
    """Exactly one insert, delete or replacement, by its definition."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, least=5, length=6):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in [*(text or ""), " "]:
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= least and len(w) >= length}


def brute(words):
    forms, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = [forms[w], None, n, len(others), words[forms[w]] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(rng, n=250):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(5, 10)))
        words.add(w)
        for _ in range(3):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            words.add(w[:i] + (rng.choice("abé") if kind else "") + w[i + (kind < 2) :])
    return words


@pytest.mark.parametrize("dictionary", [1, 40, 100_000])
def test_pairs_against_all_pairs(spark, dictionary):
    rng = random.Random(dictionary)
    words = {w: rng.choice([5, 6, 30, 200, 6000]) for w in vocabulary(rng) if len(w) >= 6}
    words |= {"a" * k: 5**k for k in range(6, 12)} | {"abababab": 7, "babababa": 7, "ababab" * 300: 9, "ababab" * 300 + "a": 90}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = [(r["word"], r["near"]) for r in sv.near_pairs(df, dictionary=dictionary).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}
    formed = sv.forms(df, sv.near_pairs(df, dictionary=dictionary))
    assert rows(sv.roots(formed)) == brute(words)


def test_bound_on_affected_grams():
    """Of the grams of a word, no single edit touches more than the bound, and at least one is left."""
    rng = random.Random(2)
    for _ in range(400):
        word = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 12)))
        frequent = {g: 9 for g in (("^" + word + "$")[p : p + q] for p in range(12) for q in range(2, 7)) if rng.random() < 0.8}
        found = sv.grams(word, frequent, 6)
        bound = sv.affected([len(g) for g in found])
        assert bound < len(found)
        i = rng.randrange(len(word) + 1)
        edits = [word[:i] + "x" + word[i:]] + ([word[:i] + word[i + 1 :], word[:i] + "x" + word[i + 1 :]] if i < len(word) else [])
        for other in edits:
            left, right = Counter(found), Counter(sv.grams(other, frequent, 6))
            assert sum((left - right).values()) <= bound


def test_documents(spark, make_docs):
    rng = random.Random(4)
    some = sorted(vocabulary(rng, 60))
    texts = [(i, " ".join(rng.choice(some).upper() if rng.random() < 0.2 else rng.choice(some) for _ in range(120)) + ".x9?") for i in range(40)]
    texts += [(50, None), (51, ""), (None, "Étrange×nôtre " * 9), (7, "ÀÉÎabcD" * 5000), (53, "abcdef ABCDEF abcdef Abcdef abcdef1"), (3, texts[3][1])]
    assert rows(sv.spelling_variants(make_docs(texts))) == brute(brute_words(texts))
    assert sv.spelling_variants(make_docs(texts).limit(0)).count() == 0


def test_long_runs_of_equal_words_and_one_hot_form(spark):
    words = {"keyword": 10_000} | {"keyword"[:i] + c + "keyword"[i:]: 5 for i in range(8) for c in "abcdfghijlm"}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert rows(sv.roots(sv.forms(df, sv.near_pairs(df)))) == brute(words)


def test_whole_table_and_sql(spark, sf_dir, sample_texts):
    name = next(n for n in queries.QUERIES if n.startswith("op12_"))
    assert rows(queries.QUERIES[name](spark, sf_dir)) == brute(brute_words(sample_texts.items()))
    problems, n = oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name])
    assert not problems and n, problems
