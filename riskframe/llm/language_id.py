"""Language of texts by a bidirectional gated recurrent network over their bytes.

The network reads runs of ``RUN`` bytes in both directions, labels every byte position, and the probabilities of all
positions of a document are averaged. Its gates and states are piecewise linear, so that inference is additions,
products and limits of float32 arrays with one column per run. It is trained in numpy by backpropagation through time
on a bounded sample: ``per_language`` documents of each language, chosen by a hash of their id, and ``RUNS`` runs of
each from places chosen by a hash. The sample, its bound and the weights (some kB) are all that passes the driver.

Defined cases: null text, text without a letter and any text when there is nothing to learn from are ``und`` with score
0; rows without ``lang``, text or ``doc_id`` are not learned from, and without ``doc_id`` are not held out; rows that
repeat are labelled one by one; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing
from riskframe.llm.tables import row_hash, without_rows

RUN = 64
HIDDEN = 8
RUNS = 4
BLOCK = 4096
NONE = 256  # the input after the end of a text
UNKNOWN = "und"


@dataclass
class Direction:
    """Weights of one direction: inputs (3H, 257) and recurrence (3H, H) for update, reset and candidate."""

    inputs: np.ndarray
    states: np.ndarray

    def step(self, byte: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        size = h.shape[0]
        a = np.take(self.inputs, byte, axis=1, mode="clip")
        g = self.states @ h
        gates = a[: 2 * size]
        gates += g[: 2 * size]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        reset = gates[size:]
        new = a[2 * size :]
        new += reset * g[2 * size :]
        np.maximum(new, -1, out=new)
        np.minimum(new, 1, out=new)
        out = h - new
        out *= gates[:size]
        out += new
        if keep is not None:
            keep.append((byte, h, gates, g[2 * size :], new))
        return out

    def back(self, dh: np.ndarray, kept: tuple, grad: "Direction", seen: list) -> np.ndarray:
        """The gradient of the state before a step from that of the state after it."""
        _, h, gates, g, new = kept
        size = h.shape[0]
        update, reset = gates[:size], gates[size:]
        d_new = dh * (1 - update) * (np.abs(new) < 1)
        d_gates = np.concatenate([dh * (h - new), d_new * g])
        d_gates *= (gates > 0) & (gates < 1)
        d_g = np.concatenate([d_gates, d_new * reset])
        grad.states += d_g @ h.T
        seen.append(np.concatenate([d_gates, d_new]))
        return dh * update + self.states.T @ d_g


@dataclass
class Network:
    forward: Direction
    backward: Direction
    out: np.ndarray  # (languages, 2H + 1)
    languages: list[str]

    @staticmethod
    def start(languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)

        def direction() -> Direction:
            inputs = rng.normal(0, 0.3, (3 * hidden, NONE + 1))
            inputs[: 2 * hidden] += 0.5
            return Direction(inputs.astype(np.float32), rng.normal(0, 0.25, (3 * hidden, hidden)).astype(np.float32))

        return Network(direction(), direction(), rng.normal(0, 0.3, (len(languages), 2 * hidden + 1)).astype(np.float32), languages)

    def weights(self) -> list[np.ndarray]:
        return [self.forward.inputs, self.forward.states, self.backward.inputs, self.backward.states, self.out]

    def positions(self, runs: np.ndarray) -> np.ndarray:
        """(RUN, languages, n) probabilities of the language at each position of (RUN, n) bytes."""
        size, n = self.out.shape[1] // 2, runs.shape[1]
        score = np.empty((len(runs), len(self.languages), n), np.float32)
        ahead, behind, bias = (np.ascontiguousarray(x) for x in (self.out[:, :size], self.out[:, size : 2 * size], self.out[:, -1:]))
        h = np.zeros((size, n), np.float32)
        for t in range(len(runs)):
            h = self.forward.step(runs[t], h)
            score[t] = ahead @ h + bias
        h = np.zeros((size, n), np.float32)
        for t in range(len(runs) - 1, -1, -1):
            h = self.backward.step(runs[t], h)
            score[t] += behind @ h
        score -= score.max(1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(1, keepdims=True)
        return score

    def gradient(self, runs: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean loss of all positions of (RUN, n) bytes, by backpropagation through time."""
        size, (steps, n) = self.out.shape[1] // 2, runs.shape
        kept: dict[str, list] = {"f": [], "b": []}
        ahead, behind = np.zeros((steps, size, n), np.float32), np.zeros((steps, size, n), np.float32)
        h = np.zeros((size, n), np.float32)
        for t in range(steps):
            ahead[t] = h = self.forward.step(runs[t], h, kept["f"])
        h = np.zeros((size, n), np.float32)
        for t in range(steps - 1, -1, -1):
            behind[t] = h = self.backward.step(runs[t], h, kept["b"])
        top = np.concatenate([ahead, behind, np.ones((steps, 1, n), np.float32)], axis=1)
        score = self.out @ top
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        real = runs != NONE
        loss = -np.log(np.take_along_axis(p, np.broadcast_to(label, (steps, 1, n)), 1)[:, 0] + 1e-9)[real].mean()
        d = p
        np.put_along_axis(d, np.broadcast_to(label, (steps, 1, n)), np.take_along_axis(p, np.broadcast_to(label, (steps, 1, n)), 1) - 1, 1)
        d *= (real / real.sum()).astype(np.float32)[:, None]
        d_out = np.einsum("tln,tsn->ls", d, top, optimize=True)
        d_top = self.out.T @ d
        grads = []
        for key, weights, part, order in (
            ("f", self.forward, slice(0, size), range(steps - 1, -1, -1)),
            ("b", self.backward, slice(size, 2 * size), range(steps)),
        ):
            grad, seen, dh = Direction(np.zeros_like(weights.inputs), np.zeros_like(weights.states)), [], np.zeros((size, n), np.float32)
            states = kept[key]
            for i, t in enumerate(order):
                dh = weights.back(dh + d_top[t, part], states[len(states) - 1 - i], grad, seen)
            byte = np.concatenate([k[0] for k in reversed(states)])
            for row, values in enumerate(np.concatenate(seen, axis=1)):
                grad.inputs[row] = np.bincount(byte, values, NONE + 1)
            grads += [grad.inputs, grad.states]
        return [*grads, d_out.astype(np.float32)], float(loss)


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(RUN, n) bytes of all runs, filled up with ``NONE``, and the text of each run."""
    runs = (np.diff(at) + RUN - 1) // RUN
    owner = np.repeat(np.arange(len(runs)), runs)
    begin = np.repeat(at[:-1] - (np.cumsum(runs) - runs) * RUN, runs) + np.arange(runs.sum()) * RUN
    place = begin + np.arange(RUN)[:, None]
    inside = place < at[1:][owner]
    out = np.full(place.shape, NONE, np.int16)
    out[inside] = data[place[inside]]
    return out, owner


def train(texts: list[str], labels: list[str], total: int = 400, batch: int = 256, rate: float = 0.01) -> Network:
    """The network after ``total`` steps of Adam over shuffled batches of runs, as many for any size of the sample."""
    languages = sorted(set(labels))
    network = Network.start(languages)
    column = pa.array(texts, pa.string())
    runs, owner = cut(*hashing.text_bytes(column))
    target = np.searchsorted(languages, np.array(labels))[owner]
    rng = np.random.default_rng(5)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    steps = 0
    while steps < total:
        order = rng.permutation(len(target))
        for begin in range(0, min(len(order), batch * (total - steps)), batch):
            pick = order[begin : begin + batch]
            grads, _ = network.gradient(runs[:, pick].astype(np.intp), target[pick][None, None])
            steps += 1
            speed = rate * (1 - steps / (total + 1))
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            for w, g, (m, v) in zip(network.weights(), grads, moments):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (speed * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return network


def held_out(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, run): ``RUNS`` runs of about ``per_language`` documents of each language; never of held-out ones."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), 5))
    # one number per language, so that no text moves to be sampled
    share = {row["lang"]: float(per_language) / row["count"] for row in known.groupBy("lang").count().toLocalIterator()}
    shares = F.create_map(*[F.lit(x) for item in share.items() for x in item]) if share else F.create_map().cast("map<string,double>")
    rows = known.select("lang", "text", F.xxhash64("doc_id").alias("place"))
    picked = rows.where(F.pmod("place", F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))
    runs = picked.select("lang", "text", F.explode(F.array(*[F.xxhash64("place", F.lit(i)) for i in range(RUNS)])).alias("place"))
    begin = F.pmod("place", F.greatest(F.length("text") - RUN, F.lit(0)) + 1) + 1
    return runs.select("lang", "place", F.substring(F.col("text"), begin.cast("int"), F.lit(RUN)).alias("run")).where("run <> ''")


def fitted(docs: DataFrame, per_language: int = 1200) -> Network | None:
    """The network learned from the sample, None without any; labels are what ``lang`` holds."""
    rows = [(r["lang"], r["run"]) for r in sample(docs, per_language).orderBy("lang", "place", "run").toLocalIterator()]
    return train([run for _, run in rows], [lang for lang, _ in rows]) if rows else None


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, row_hash, lang_pred, score) of each whole text, from its text alone."""

    def run(batches):
        for batch in hashing.slices(batches):
            names = np.array([*network.languages, UNKNOWN], object)
            data, at = hashing.text_bytes(batch.column("text"))
            runs, owner = cut(data, at)
            pooled = np.zeros((batch.num_rows, len(network.languages)))
            for begin in range(0, runs.shape[1], BLOCK):
                part = runs[:, begin : begin + BLOCK].astype(np.intp)
                p = network.positions(part)
                p *= (part != NONE)[:, None]
                own, total = owner[begin : begin + BLOCK], p.sum(0).T
                first = np.flatnonzero(np.diff(own, prepend=-1))
                pooled[own[first]] += np.add.reduceat(total, first)
            pooled /= np.maximum(pooled.sum(1, keepdims=True), 1e-9)
            best = pooled.argmax(1)
            score = pooled.max(1)
            empty = ~batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            best[empty], score[empty] = len(network.languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))],
                names=["doc_id", "row_hash", "lang_pred", "score"],
            )

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select("doc_id", row_hash(F.col("text")).alias("row_hash"), "text", lettered)
    if network is None:
        return rows.select("doc_id", "row_hash", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row_hash bigint, lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = 1200) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = predict(docs, fitted(docs, per_language))
    return found.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, per_language: int = 1200) -> DataFrame:
    """The documents whose language was found with a score of ``least`` or more, with the columns they came with."""
    found = predict(docs, fitted(docs, per_language))
    return without_rows(docs, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)))
