"""The pipeline against its stages' rules in plain Python."""

import re

import public_tokenizers
import pytest

import corpus_pipeline
from riskframe.llm import exact_dedup, language_id, near_dedup, packing
from riskframe.llm.tables import written
from tests.llm.test_near import brute_near
from tests.llm.test_native import ASSIGN


@pytest.fixture(scope="module")
def steps(spark, sample_docs, sf_dir):
    docs, found = sample_docs, [sample_docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        found.append(docs)
    return found


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_decisions(steps):
    documents, spoken, distinct, different, masked, packed = ({r.doc_id: r for r in s.collect()} for s in steps)
    found = {r.doc_id: r for r in language_id.predict(steps[0], language_id.fitted(steps[0])).collect()}
    assert set(spoken) == {i for i, r in found.items() if r.lang_pred != "und" and r.score >= 0.3}
    first = {}
    for i in sorted(spoken):
        first.setdefault(re.sub("[\\x20\\x09-\\x0D]+", " ", spoken[i].text or ""), i)
    assert set(distinct) == set(first.values())
    near = brute_near([(i, r.text) for i, r in distinct.items()])
    assert set(different) == {i for i, _, root in near if i == root}
    owners = {}
    for r in different.values():
        for m in ASSIGN.finditer(r.text):
            if len(m[2]) >= 12:
                owners.setdefault(m[2], set()).add(r.source)
    assert set(masked) == set(different)
    for i, r in masked.items():
        assert r.n_chars == len(r.text)
        owned = [m[2] for m in ASSIGN.finditer(different[i].text) if len(m[2]) >= 12 and len(owners[m[2]]) < 3]
        assert not any(value in r.text for value in owned)
        if not owned and not re.search("[0-9a-f]{16}", different[i].text):
            assert r.text == different[i].text
    assert set(packed) == set(masked)


def test_packing_of_what_is_left(steps):
    again = packing.pack(steps[4], packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(steps[5]) == key(again)


def test_odd_tables_pass_through(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "12"), (4, "some words of a text " * 9), (4, "some words of a text " * 9), (None, "null id and a few words")]
    docs = make_docs(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rows_of_one_id_or_none_are_judged_by_their_own_text(make_docs):
    base = [f"word{i}" for i in range(200)]
    near = " ".join([*base[:199], "other"])
    base = " ".join(base)
    rows = [(3, "a"), (None, "a"), (None, "unique"), (5, "a"), (5, "b"), (6, "a  b"), (6, "a b"), (7, "a b"), (None, None), (None, "")]
    out = exact_dedup.drop_duplicates(make_docs(rows))
    assert kept_rows(out) == sorted([(3, "a"), (None, "unique"), (5, "b"), (6, "a  b"), (6, "a b"), (None, None), (None, "")], key=repr)
    for repeat in ("a text of its own", base.upper()):  # the second has the set of a smaller id
        rows = [(1, base), (5, near), (5, repeat), (None, near), (9, near + " end")]
        want = [(1, base), (None, near)] + [(5, repeat)] * (repeat != base.upper())
        assert kept_rows(near_dedup.drop_near_duplicates(make_docs(rows))) == sorted(want, key=repr)


def test_rows_without_a_language_go_alone(spark, make_docs, sample_docs):
    spoken = [r for r in sample_docs.where("lang IS NOT NULL").orderBy("doc_id").collect() if len(r.text) > 400]
    rows = [(r.doc_id, r.text, r.lang) for r in spoken[:120]]
    text = rows[0][1]
    odd = [(None, "12 34", None), (None, text, None), (7001, "", None), (7001, text, None), (None, None, None)]
    out = language_id.keep_identified(make_docs(rows + odd))
    assert {(None, text), (7001, text)} == {x for x in kept_rows(out) if x[0] in (None, 7001)}
