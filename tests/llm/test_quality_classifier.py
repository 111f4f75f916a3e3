"""Quality scores from positive and unlabelled texts: risks by definition, the prior, held-out accuracy, odd tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import quality_classifier as qc
from riskframe.llm import queries


def local(z, positive):
    return lambda w: qc.Risk.of(qc.risk_sums(z, positive, w), z.shape[1])


def mixture(rng, n=4000, prior=0.7):
    good = rng.random(n) < prior
    x = np.where(good[:, None], rng.normal(1.2, 1, (n, 3)), rng.normal(-1.2, 1, (n, 3)))
    return np.column_stack([x, np.ones(n)]), good, good & (rng.random(n) < 0.3)


def test_risk_by_definition_and_gradient_by_differences():
    rng = np.random.default_rng(1)
    z, _, positive = mixture(rng, 200)
    w = rng.normal(0, 1, 4)
    r = local(z, positive)(w)
    loss = lambda g: np.log(1 + np.exp(-g)).mean()
    assert r.unlabelled == pytest.approx(loss(-z @ w)) and r.positive == pytest.approx(loss(z[positive] @ w))
    assert r.positive_as_bad == pytest.approx(loss(-z[positive] @ w))
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        up, down = (local(z, positive)(w + s * step) for s in (1, -1))
        for loss, slope in (("unlabelled", r.d_unlabelled), ("positive", r.d_positive), ("positive_as_bad", r.d_positive_as_bad)):
            assert (getattr(up, loss) - getattr(down, loss)) / 2e-5 == pytest.approx(slope[k], abs=1e-6)


def test_fit_without_negatives_finds_both_classes_and_the_prior():
    rng = np.random.default_rng(2)
    z, good, positive = mixture(rng)
    first = qc.separating_fit(local(z, positive), 4, 0.1, 6)
    place = np.minimum((qc.sigmoid(z @ first) * qc.BINS).astype(int), qc.BINS - 1)
    prior = qc.prior_of(np.bincount(place, minlength=qc.BINS), np.bincount(place[positive], minlength=qc.BINS))
    assert prior == pytest.approx(0.7, abs=0.06)
    weights, risk = qc.non_negative_fit(local(z, positive), prior, 4, 0.001, 30)
    assert ((z @ weights >= 0) == good).mean() > 0.96
    assert risk > 0


def test_negative_risk_is_raised():
    """With few rows and many columns the plain risk falls below zero; the fit keeps weights where it is not far below."""
    rng = np.random.default_rng(3)
    z = np.column_stack([rng.normal(0, 1, (60, 40)), np.ones(60)])
    positive = np.arange(60) < 12
    weights, _ = qc.non_negative_fit(local(z, positive), 0.6, 41, 0.001, 40)
    r = local(z, positive)(weights)
    plain = np.zeros(41)
    for _ in range(40):
        s = local(z, positive)(plain)
        plain -= 0.5 * np.linalg.solve(s.curvature + 0.011 * np.eye(41), 0.6 * s.d_positive + s.d_unlabelled - 0.6 * s.d_positive_as_bad + 0.001 * plain)
    s = local(z, positive)(plain)
    assert s.unlabelled - 0.6 * s.positive_as_bad < -0.5
    assert r.unlabelled - 0.6 * r.positive_as_bad > s.unlabelled - 0.6 * s.positive_as_bad


def test_features_by_hand():
    text = "Go go go. ###x\nEnd| é"
    row = qc.text_features(pa.array(["", text, None, "go go"]))
    assert row.shape == (4, qc.WIDTH) and np.isfinite(row).all()
    assert (row[0] == row[2]).all() and not row[0][:99].any()
    data = text.encode()
    assert row[1][ord("#") - 32] == pytest.approx((3 / len(data)) ** 0.5)
    assert row[1][98] == pytest.approx((2 / len(data)) ** 0.5)
    # of Go, go, go., ###x, End|, é none repeats the one before; of go, go the second does
    assert row[1][99] == 0 and row[3][99] == pytest.approx(0.5)
    assert row[1][101] == 1 and row[3][101] == pytest.approx(0.5)
    assert row[1][106] == pytest.approx(1 / 6) and row[1][107] == pytest.approx(2 / 6)
    long = "word next " * 200_000
    assert qc.text_features(pa.array([long]))[0][:99] == pytest.approx(qc.text_features(pa.array(["word next " * 20]))[0][:99], abs=1e-6)


def test_scores_of_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    name = next(n for n in queries.QUERIES if n.startswith("op13_"))
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for doc_id, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [d for d in truth if got[d]["held_out"]]
    good, bad = ([got[d]["score"] for d in held if truth[d] == k] for k in (1, 0))
    area = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert area > 0.98
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.95


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, make_docs, sample_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in sample_docs.collect()]
    extra = [(None, None), (None, rows[3][1]), (9001, ""), (9002, rows[5][1] * 30), rows[0], (9003, "\x00 é")]
    docs = make_docs(rows + extra, extra=("kept", "features", "held_out_", "positive", "half", "score", "label_id"))
    marks = [(r[0], int("|" not in r[1] and "$" not in r[1])) for r in rows if r[1]]
    schema = "doc_id bigint, quality int, toxic int, features int"
    base = spark.createDataFrame([(d, q, 0, 1) for d, q in marks], schema)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, 1, 2) for d, q in marks]
    other = spark.createDataFrame([*turned, (None, 1, 0, 0), (9001, None, 0, 0), *turned[:5]], schema)
    a, b = (sorted((str(r.doc_id), r.held_out, round(r.score, 6)) for r in qc.quality_scores(docs, x, rounds=6).collect()) for x in (base, other))
    assert len(a) == len(rows) + len(extra) and a == b
    empty = {r.score for r in qc.quality_scores(docs, base.limit(0)).collect()}
    assert empty == {0.5}
    assert qc.quality_scores(docs.limit(0), base).count() == 0
