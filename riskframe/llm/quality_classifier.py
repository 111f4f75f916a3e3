"""Quality of texts from positive and unlabelled examples.

Trusted positives and unlabelled text, no negatives, fit a linear score g of features of the text. With the share pi of good
texts (the class prior) the risk of g over both classes is pi * E_p[l(g)] + (E_u[l(-g)] - pi * E_p[l(-g)]); the second part
stands for the risk on bad texts, which cannot be below zero. While it is, the fit takes a step that raises it instead.
The prior is estimated too: a first model separates positives from unlabelled texts on one half of the documents; on the
other half, the ratio of unlabelled to positive texts above a threshold is nowhere below the prior, and the threshold with
the least upper bound of that ratio gives it.

Every round adds up a few sums over all documents in the tasks: a gradient and a matrix, as large as the features squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing
from riskframe.llm.tables import written

PARTS = 3
HELD_OUT = 1

#: Bytes counted together: printable ASCII one by one, line breaks, other white space, other controls, the rest of UTF-8.
KINDS = np.full(256, 98, np.intp)
KINDS[:128] = 97
KINDS[32:127] = np.arange(95)
KINDS[9:14] = 96
KINDS[10] = 95
BYTE_KINDS = np.zeros((256, 99))
BYTE_KINDS[np.arange(256), KINDS] = 1
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
WIDTH = 99 + 12
BINS = 1000


def text_features(column: pa.Array) -> np.ndarray:
    """One row of numbers per text: shares of bytes, and of words that repeat, differ, start or end with a mark."""
    n = len(column)
    data, at = hashing.text_bytes(column)
    counts = np.zeros((n, 256))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        counts[i] = np.bincount(data[a:b], minlength=256)
    shares = np.sqrt(counts @ BYTE_KINDS / np.maximum(np.diff(at), 1)[:, None])
    words = hashing.split_words(column)
    number, doc = words.counts(), words.doc()
    each = np.maximum(number, 1)
    hashes = words.hashes() if len(words.starts) else np.zeros(0, np.uint64)

    def share(of: np.ndarray) -> np.ndarray:
        return np.bincount(doc, of, minlength=n) / each

    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    _, sample = np.unique(hashing.mix(hashes + doc.astype(np.uint64) * np.uint64(hashing.BASE)), return_index=True)
    distinct = np.bincount(doc[sample], minlength=n) / each
    length = (words.ends - words.starts).astype(float)
    mean = share(length)
    spread = np.sqrt(np.maximum(share(length * length) - mean * mean, 0))
    first, last = data[words.starts], data[words.ends - 1]
    upper, opened, closed = share((first >= 65) & (first <= 90)), share(~LETTER[first]), share(~LETTER[last])
    size = np.log1p(number) / 10
    repeated = share(again)
    rest = [repeated, np.sqrt(repeated), distinct, np.log1p(mean), np.log1p(spread), upper, upper * upper, opened, closed, np.sqrt(closed)]
    return np.column_stack([shares, *rest, size, size * size]).astype(np.float32)


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_remainder(doc_id) % PARTS == HELD_OUT, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, half, features) of each row; ``half`` splits the rows for the estimate of the prior."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    half = F.coalesce((F.floor(_remainder(F.col("doc_id")) / PARTS) % 2).cast("int"), F.lit(0))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), half.alias("half"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in hashing.slices(batches):
            values = text_features(batch.column("text"))
            arrays = [batch.column(c) for c in ("doc_id", "held_out", "half")]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * WIDTH), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*arrays, lists], names=["doc_id", "held_out", "half", "features"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, half int, features array<float>")


def trusted(labels: DataFrame) -> DataFrame:
    """(label_id): rows of ``labels`` marked 1 and never 0, outside the held-out part."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    marked = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    return marked.where("least = 1 AND most = 1").select("label_id")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("features")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(float)


#: Tasks that add up the sums of all other tasks, before one adds up theirs.
ADDERS = 4


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of the ``size`` numbers that ``part`` makes of each; each task passes on one row."""

    def added(one: Callable[[pa.RecordBatch], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]):
            total, any_row = np.zeros(size), False
            for batch in batches:
                if batch.num_rows:
                    total, any_row = total + one(batch), True
            if any_row:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return run

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.frombuffer(v) for v in batch.column("sums").to_pylist())

    sums = rows.mapInArrow(added(part), "sums binary")
    for tasks in (ADDERS, 1):
        sums = sums.repartition(tasks).mapInArrow(added(rows_of), "sums binary")
    found = next(iter(sums.toLocalIterator()), None)
    return np.frombuffer(found["sums"]) if found else np.zeros(size)


@dataclass
class Model:
    """The logit of a text is the dot product of ``weights`` with its scaled features and 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) * self.scale, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(x) @ self.weights)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def scaling(rows: DataFrame) -> Model:
    """A model without weights, scaled by the unlabelled rows."""
    part = lambda batch: (lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))(matrix(batch))
    total = summed(rows, part, 2 * WIDTH + 1)
    n = max(total[0], 1)
    mean = total[1 : WIDTH + 1] / n
    deviation = np.sqrt(np.maximum(total[WIDTH + 1 :] / n - mean * mean, 0))
    return Model(mean, np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0), np.zeros(WIDTH + 1))


def _upper(square: np.ndarray) -> np.ndarray:
    """The upper triangle of a symmetric matrix."""
    return square[np.triu_indices(len(square))]


def _symmetric(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return out + np.triu(out, 1).T


def risk_sums(z: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Numbers of rows, losses, gradients and curvature of the unlabelled rows ``z`` and the positives among them."""
    g = z @ weights
    p = sigmoid(g)
    good, q = z[positive], p[positive]
    return np.concatenate(
        [
            [len(z), positive.sum(), np.logaddexp(0, g).sum(), np.logaddexp(0, g[positive]).sum(), np.logaddexp(0, -g[positive]).sum()],
            z.T @ p,
            good.T @ q,
            good.T @ (1 - q),
            _upper((z * (p * (1 - p))[:, None]).T @ z),
            _upper((good * (q * (1 - q))[:, None]).T @ good),
        ]
    )


@dataclass
class Risk:
    """Means of ``risk_sums``: losses l(-g) of unlabelled and positive rows, l(g) of positives, and their gradients."""

    unlabelled: float
    positive_as_bad: float
    positive: float
    d_unlabelled: np.ndarray
    d_positive_as_bad: np.ndarray
    d_positive: np.ndarray
    curvature: np.ndarray
    curvature_positive: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, d: int) -> "Risk":
        n, m = max(sums[0], 1), max(sums[1], 1)
        v = sums[5 : 5 + 3 * d].reshape(3, d)
        h = sums[5 + 3 * d :].reshape(2, -1)
        curvature, curvature_positive = _symmetric(h[0], d) / n, _symmetric(h[1], d) / m
        return Risk(sums[2] / n, sums[3] / m, sums[4] / m, v[0] / n, v[1] / m, -v[2] / m, curvature, curvature_positive)


def non_negative_fit(risk: Callable[[np.ndarray], Risk], prior: float, d: int, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """The weights of least non-negative risk seen in ``rounds`` damped Newton steps, and that risk."""
    weights, best = np.zeros(d), None
    for _ in range(rounds):
        r = risk(weights)
        bad = r.unlabelled - prior * r.positive_as_bad
        total = prior * r.positive + max(bad, 0.0) + ridge / 2 * weights @ weights
        if best is None or total < best[1]:
            best = (weights, total)
        d_bad = r.d_unlabelled - prior * r.d_positive_as_bad
        curvature = r.curvature + (ridge + 0.01) * np.eye(d)
        if bad >= 0:
            step = np.linalg.solve(curvature, prior * r.d_positive + d_bad + ridge * weights)
            weights = weights - 0.5 * step
        else:
            # the risk on bad texts fell below zero: the step raises it
            weights = weights + 0.15 * np.linalg.solve(curvature, d_bad)
        if np.abs(0.5 * step if bad >= 0 else 1).max() < 1e-4:
            break
    return best


def separating_fit(risk: Callable[[np.ndarray], Risk], d: int, ridge: float, rounds: int) -> np.ndarray:
    """Weights that tell positives from unlabelled rows, both counted alike, by Newton steps."""
    weights = np.zeros(d)
    for _ in range(rounds):
        r = risk(weights)
        slope = r.d_positive + r.d_unlabelled + ridge * weights
        weights = weights - np.linalg.solve(r.curvature + r.curvature_positive + ridge * np.eye(d), slope)
    return weights


def prior_of(unlabelled: np.ndarray, positive: np.ndarray, doubt: float = 0.1) -> float:
    """The prior from numbers of rows per score bin, lowest first: the ratio above the threshold of least upper bound."""
    n, m = unlabelled.sum(), positive.sum()
    if not n or not m:
        return 0.5
    above = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()
    u, p = above(unlabelled), above(positive)
    seen = p > 0
    error = math.sqrt(math.log(4 / doubt) / 2 / n) + math.sqrt(math.log(4 / doubt) / 2 / m)
    k = np.argmin((u[seen] + error) / p[seen])
    return float(np.clip(u[seen][k] / p[seen][k], 0.02, 0.98))


def fitted(rows: DataFrame, ridge: float = 0.03, rounds: int = 30) -> tuple[Model, float] | None:
    """The model and the estimated prior from rows (half, positive, features) outside the held-out part; None without positives."""
    model, d = scaling(rows), WIDTH + 1
    size = 5 + 3 * d + d * (d + 1)

    def risk_on(part: DataFrame) -> Callable[[np.ndarray], Risk]:
        def risk(weights: np.ndarray) -> Risk:
            sums = summed(part, lambda b: risk_sums(model.inputs(matrix(b)), flags(b), weights), size)
            return Risk.of(sums, d)

        return risk

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        place = np.minimum((first.score(matrix(batch)) * BINS).astype(np.intp), BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place[flags(batch)], minlength=BINS)])

    if rows.where("positive").isEmpty():
        return None
    first = Model(model.mean, model.scale, separating_fit(risk_on(rows.where("half = 0")), d, 0.1, 6))
    seen = summed(rows.where("half = 1"), bins, 2 * BINS)
    prior = prior_of(seen[:BINS], seen[BINS:])
    model.weights, _ = non_negative_fit(risk_on(rows), prior, d, ridge, rounds)
    return model, prior


def flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)


def quality_scores(docs: DataFrame, labels: DataFrame, ridge: float = 0.03, rounds: int = 30) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5 on).

    A score depends on the text alone; null and empty texts share one, and so do equal texts. Labels count for rows
    outside the held-out part only, and only as trusted positives; all texts outside it, labelled or not, are the unlabelled
    ones. A ``doc_id`` marked both 0 and 1, a null label and a label without ``doc_id`` count for nothing. Without positives
    each score is 0.5. Empty tables give no rows; extra columns are ignored.
    """
    texts = written(features(docs), "features")
    marked = texts.where("NOT held_out").join(trusted(labels), F.col("doc_id") == F.col("label_id"), "left")
    rows = written(marked.select("half", F.col("label_id").isNotNull().alias("positive"), "features"), "learned_from")
    found = fitted(rows, ridge, rounds)
    if found is None:
        scored = texts.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        model = found[0]

        def run(batches):
            for batch in batches:
                score = np.round(model.score(matrix(batch)), 9) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"]
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        scored = texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
