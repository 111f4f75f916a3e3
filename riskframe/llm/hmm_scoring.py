"""Likelihood of texts under a hidden Markov model of their words, and under smoothed word counts.

Words are counted over all training documents. Baum-Welch first looks for the states with tied emissions: the
``VOCABULARY`` most frequent words are symbols of their own, any other word shares the symbol of its length. The texts
are written once as symbols, which every round reads. Each task sums its expected counts, Spark adds up the sums of the
tasks, and rounds go on until one gains less than ``TOLERANCE`` per token. A last pass then sums the expected state counts of every single word, a table with one row per training word,
so that each word has emission probabilities of its own, however many there are. A word seen n times has its own state
shares with weight n and those of its length with weight ``PRIOR``; words never seen have those of their length.

The likelihood is exact: texts are cut into segments of ``SEGMENT`` words, computed side by side: the first one of a text
by forward steps from its start, later ones as matrix products by such steps from each state, and then chained. Both are
scaled every ``SCALED`` steps.

Counts and emissions reach the texts in two ways: those of the ``HEAD`` most frequent words, a table of fixed size, go
to all tasks; those of all others are joined to (text, word) rows, made distinct there, and come back to the text as a
list, no longer than the text itself. A frequent word is thus never a hot key, and copies of a text share their list.

Defined cases: null and empty texts are their end token alone; rows without ``doc_id`` are neither held out nor learned
from; rows that repeat are scored alike (and each counts in training); an empty table gives an empty result, and with no
training documents the model is uniform. Other columns are never read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing
from riskframe.llm.language_id import held_out
from riskframe.llm.tables import written

STATES = 6
VOCABULARY = 4096
HEAD = 262_144
LENGTHS = 16
SEGMENT = 256
#: Steps after which probabilities are scaled; a step keeps more than 1e-30 of them.
SCALED = 8
#: Least gain of a round, in log10 per token, after which there is another one.
TOLERANCE = 0.01
#: How sticky the states are before the first round; most texts keep to one kind of words, so this saves rounds.
STAY = 0.95
SMOOTH = 0.1
PRIOR = 1.0
#: Tokens of texts, written as symbols, that are computed at once.
RUN = 1 << 18
#: Rows that a task adds up by token before it hands them on.
PENDING = 1 << 18
#: Expected counts of single words are summed as integers, in these parts, so that no order of adding matters.
PARTS = 1 << 20
#: The end token, by a hash like that of any word (no word has a space).
END = int(hashing.mix(np.frombuffer(b"the end ", np.uint64)).view(np.int64)[0])


def token_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte length of the tokens of all texts, each text closed by ``END`` with length 0, and the n + 1 offsets."""
    words = hashing.split_words(column)
    ends = words.first[1:]
    tokens = np.insert(words.hashes(hashing.LOWER).view(np.int64), ends, END)
    lengths = np.insert(words.ends - words.starts, ends, 0)
    return tokens, lengths, words.first + np.arange(len(words.first))


def summed(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (token, length, sums): those of one token added up, ``PENDING`` rows at a time."""

    def together(pieces):
        token, length, *sums = (np.concatenate(x) for x in zip(*pieces))
        order = np.argsort(token, kind="stable")
        token = token[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
        columns = [token[first], length[order[first]].astype(np.int32), *(np.add.reduceat(x[order], first) if len(x) else x for x in sums)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    pending, size = [], 0
    for piece in rows:
        pending.append(piece)
        size += len(piece[0])
        if size >= PENDING:
            yield together(pending)
            pending, size = [], 0
    if pending:
        yield together(pending)


def counted(batches):
    """Rows (token, length, n): the tokens of some texts."""

    def rows():
        for batch in hashing.slices(batches):
            tokens, lengths, _ = token_arrays(batch.column("text"))
            known, sample, n = np.unique(tokens, return_index=True, return_counts=True)
            yield [known, np.minimum(lengths[sample], LENGTHS), n]

    yield from summed(rows(), ["token", "length", "n"])


@dataclass
class Counts:
    """N and V, the words that are symbols of their own, and what is left per word length."""

    total: int
    distinct: int
    tokens: np.ndarray  # the symbols' words, sorted
    counts: np.ndarray
    symbol: np.ndarray  # of each of these words
    vocabulary: int  # number of words that are symbols, 0 .. vocabulary - 1
    rest: np.ndarray  # log10 of the smoothed total of the words of each length that are not symbols

    @property
    def symbols(self) -> int:
        return self.vocabulary + LENGTHS + 1

    @property
    def kind(self) -> np.dtype:
        """The smallest type of number that holds any symbol."""
        return np.min_scalar_type(self.symbols)

    def base_log(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    @cached_property
    def lookup(self) -> "Lookup":
        return Lookup(self.tokens[np.argsort(self.symbol)])  # frequent words first, each at the place of its symbol

    def symbols_of(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        inside, at = self.lookup.find(tokens)
        return np.where(inside, at, self.vocabulary + np.minimum(lengths, LENGTHS))


def found_in(known: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token is in the sorted array, and where."""
    if not len(known):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return known[at] == tokens, at


class Lookup:
    """Finds tokens among some distinct ones by their highest bits, which are as good as random.

    Of known tokens with the same bits the first is in the table, so frequent words should come first; the others are
    searched for in a sorted array.
    """

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(1, (2 * len(known)).bit_length())
        self.shift = np.uint64(64 - bits)
        slots, first = np.unique(self.slot(known), return_index=True)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[slots] = first
        other = np.ones(len(known), bool)
        other[first] = False
        other = np.flatnonzero(other)
        self.place = other[np.argsort(known[other], kind="stable")]
        self.rest = known[self.place]
        self.several = np.zeros(1 << bits, bool)
        self.several[self.slot(self.rest)] = True

    def slot(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens.view(np.uint64) >> self.shift).view(np.int64)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each token is known, and its place, which says nothing where it is not."""
        if not len(self.known):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        slot = self.slot(tokens)
        at = self.table[slot].astype(np.int64)
        inside = self.known[at] == tokens
        left = np.flatnonzero(~inside)
        left = left[self.several[slot[left]]]
        hit, place = found_in(self.rest, tokens[left])
        left = left[hit]
        at[left], inside[left] = self.place[place[hit]], True
        return inside, at


def symbols_from(counts: DataFrame) -> Counts:
    """counts has token, length and n. The symbols' words and one row per length reach the driver: a fixed size."""
    total, distinct = next(iter(counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).toLocalIterator()))
    head = list(counts.orderBy(F.desc("n"), "token").limit(VOCABULARY).toLocalIterator())
    symbols = {row["token"]: i for i, row in enumerate(head)}
    by_token = sorted(head, key=lambda row: row["token"])
    n_of, v_of = np.zeros(LENGTHS + 1), np.zeros(LENGTHS + 1)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toLocalIterator():
        n_of[row["length"]], v_of[row["length"]] = row["n"], row["v"]
    for row in head:
        n_of[row["length"]] -= row["n"]
        v_of[row["length"]] -= 1
    return Counts(
        total,
        distinct,
        np.array([row["token"] for row in by_token], np.int64),
        np.array([row["n"] for row in by_token], np.int64),
        np.array([symbols[row["token"]] for row in by_token], np.int64),
        VOCABULARY,
        np.log10(n_of + SMOOTH * (v_of + 1)),
    )


@dataclass
class Model:
    """start (K), move (K, K) and emit (symbols, K) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(shares: np.ndarray, states: int = STATES) -> "Model":
        """Sticky states, each of which prefers the symbols that a hash gives it."""
        own = hashing.mix(np.arange(1, len(shares) + 1, dtype=np.uint64)) % np.uint64(states)
        emit = shares[:, None] * (1 + 2.0 * (own[:, None] == np.arange(states)))
        move = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    @staticmethod
    def from_counts(values: np.ndarray, shares: np.ndarray, states: int = STATES) -> "Model":
        start, move, emit = np.split(values, [states, states + states * states])
        move, emit = move.reshape(states, states) + 0.1, emit.reshape(-1, states) + shares[:, None]
        return Model((start + 0.1) / (start + 0.1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Segments:
    """The symbols of some texts in segments side by side, the longest first: step t has the first ``active[t]`` ones.

    Arrays have one column per segment.
    """

    def __init__(self, symbols: np.ndarray, at: np.ndarray):
        pieces = (np.diff(at) + SEGMENT - 1) // SEGMENT
        text = np.repeat(np.arange(len(pieces)), pieces)
        place = np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]
        begin = at[:-1][text] + place * SEGMENT
        length = np.minimum(SEGMENT, at[1:][text] - begin)
        by_length = np.argsort(-length, kind="stable")
        self.text, self.place, self.texts = text[by_length], place[by_length], len(pieces)
        begin, length = begin[by_length], length[by_length]
        self.active = np.searchsorted(-length, -np.arange(SEGMENT), "left")
        self.active = self.active[self.active > 0]
        self.at = [begin[:n] + t for t, n in enumerate(self.active)]
        self.steps = [symbols[at] for at in self.at]
        self.head = self.place == 0
        self.heads, self.later = np.flatnonzero(self.head), np.flatnonzero(~self.head)
        self.product = np.cumsum(~self.head) - 1  # which of the later segments a segment is
        # where each segment of a text stands, by (text, place)
        self.column = np.empty(len(text), np.int64)
        self.column[by_length] = np.arange(len(text))
        self.first = np.cumsum(pieces) - pieces

    def at_place(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The columns of the segments that are number k > 0 of their text, and those of the segments before them."""
        now = np.flatnonzero(self.place == k)
        return now, self.column[self.first[self.text[now]] + k - 1]

    def openings(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(K, texts) state probabilities after the first segment of each text, and its log10 likelihood.

        Where a text begins is known, so one forward pass does. The first symbol is emitted without a move.
        """
        active = np.searchsorted(self.heads, self.active)
        state, logs = np.repeat(model.start[:, None], len(self.heads), axis=1), np.zeros(len(self.heads))
        buffer = np.empty_like(state)
        move, emit = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
        for t, (symbols, m) in enumerate(zip(self.steps, active)):
            if not m:
                break
            now = state[:, :m]
            new = np.matmul(move, now, out=buffer[:, :m]) if t else now
            np.multiply(new, np.take(emit, symbols[self.heads[:m]], axis=1), out=now)
            if t % SCALED == SCALED - 1:
                scale = now.sum(0)
                now /= scale
                logs[:m] += np.log10(scale)
        scale = state.sum(0)
        return state / scale, logs + np.log10(scale)

    def products(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(K before, K after, n) products of the steps of each later segment, scaled, and the log10 of the scales."""
        active = np.searchsorted(self.later, self.active)
        k, n = len(model.start), len(self.later)
        state = np.repeat(np.eye(k)[:, :, None], n, axis=2)
        buffer = np.empty_like(state)
        logs = np.zeros(n)
        move, emit = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
        for t, (symbols, m) in enumerate(zip(self.steps, active)):
            if not m:
                break
            now = state[:, :, :m]
            new = np.matmul(move, now, out=buffer[:, :, :m])
            np.multiply(new, np.take(emit, symbols[self.later[:m]], axis=1), out=now)
            if t % SCALED == SCALED - 1:
                scale = now.max((0, 1))
                now /= scale
                logs[:m] += np.log10(scale)
        if n:
            scale = state.max((0, 1))
            state /= scale
            logs += np.log10(scale)
        return state, logs

    def entering(self, model: Model, products: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(K, n) state probabilities before each segment's first step, and the log10 likelihood of each text."""
        before = np.zeros((len(model.start), len(self.text)))
        score = np.zeros(self.texts)
        before[:, self.head] = model.start[:, None]  # of the first symbol, which has no move before it
        after = np.zeros_like(before)
        after[:, self.heads], score[self.text[self.heads]] = self.openings(model)
        for k in range(1, int(self.place.max(initial=-1)) + 1):
            now, last = self.at_place(k)
            before[:, now] = after[:, last]
            out = np.einsum("kn,kjn->jn", before[:, now], products[:, :, self.product[now]])
            total = out.sum(0)
            after[:, now] = out / total
            score[self.text[now]] += np.log10(total) + logs[self.product[now]]
        return before, score

    def leaving(self, products: np.ndarray) -> np.ndarray:
        """(K, n) likelihood, up to scale, of what follows each segment, by the state at its end."""
        after = np.ones((len(products), len(self.text)))
        for k in range(int(self.place.max(initial=-1)), 0, -1):
            now, last = self.at_place(k)
            back = np.einsum("kjn,jn->kn", products[:, :, self.product[now]], after[:, now])
            after[:, last] = back / back.max(0)
        return after

    def expected(self, model: Model) -> np.ndarray:
        """Expected counts (start, move, emit) of all texts."""
        start, moves, weights, _ = self.passes(model)
        seen = np.concatenate(self.steps)
        shares = np.stack([np.bincount(seen, w, len(model.emit)) for w in weights], axis=1)
        return np.concatenate([start, moves.ravel(), shares.ravel()])

    def passes(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts and moves, the state shares (K, tokens) of the tokens in the order of ``at``, and the log10
        likelihood of each text, by a forward and a backward pass through the segments.

        The backward pass divides by the scales of the forward one, so that a product of both is a probability as it is.
        """
        k = len(model.start)
        products, logs = self.products(model)
        state, score = self.entering(model, products, logs)
        beta = self.leaving(products)
        move, emit = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
        begin = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        shares = np.empty((k, begin[-1]))  # after each step, first by the symbols so far, then by all
        kept = []
        before = state
        for t, symbols in enumerate(self.steps):
            m = len(symbols)
            before = before[:, :m]
            new = np.matmul(move, before, out=shares[:, begin[t] : begin[t + 1]])
            if t == 0:
                new[:, self.head] = before[:, self.head]
            shown = np.take(emit, symbols, axis=1)
            new *= shown
            scale = new.sum(0)
            new /= scale
            shown /= scale
            kept.append(shown)
            before = new
        start, moves = np.zeros(k), np.zeros((k, k))
        for t in range(len(self.steps) - 1, -1, -1):
            m = self.active[t]
            new, back = shares[:, begin[t] : begin[t + 1]], beta[:, :m]
            ended = self.active[t + 1] if t + 1 < len(self.active) else 0
            if ended < m:  # what follows the segments that end here, so that the shares add up to 1
                back[:, ended:] /= (new[:, ended:] * back[:, ended:]).sum(0)
            ahead = kept.pop()
            ahead *= back
            new *= back
            if t == 0:
                start += new[:, self.head].sum(1)
                state[:, self.head] = 0
                before = state
            else:
                before = shares[:, begin[t - 1] : begin[t - 1] + m]
                np.matmul(model.move, ahead, out=back)
            moves += before @ ahead.T
        return start, moves * model.move, shares, score


LIKELIHOOD = -1


def encoded(counts: Counts):
    """Rows (symbols): those of each text, as bytes."""

    def run(batches):
        for batch in hashing.slices(batches):
            tokens, lengths, at = token_arrays(batch.column("text"))
            symbols = counts.symbols_of(tokens, lengths).astype(counts.kind)
            buffers = [None, pa.py_buffer((at * counts.kind.itemsize).astype(np.int32)), pa.py_buffer(symbols)]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers)], names=["symbols"])

    return run


def symbol_runs(batches, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The symbols of about ``RUN`` tokens of whole texts at a time, and the n + 1 offsets of the texts."""
    for batch in batches:
        column = batch.column("symbols").cast(pa.large_binary())
        if not len(column):
            continue
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // kind.itemsize
        symbols, begin = np.frombuffer(data, kind, at[-1]), 0
        while begin < len(column):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + RUN, "right")) - 1)
            yield symbols[at[begin] : at[end]].astype(np.int64), at[begin : end + 1] - at[begin]
            begin = end


def expectations(counts: Counts, model: Model):
    """One row (place, value) per expected count that a task has summed over its texts, and their likelihood."""

    def run(batches):
        total, logs = None, 0.0
        for symbols, at in symbol_runs(batches, counts.kind):
            segments = Segments(symbols, at)
            start, moves, weights, score = segments.passes(model)
            seen = np.concatenate(segments.steps)
            shares = np.stack([np.bincount(seen, w, counts.symbols) for w in weights], axis=1)
            found = np.concatenate([start, moves.ravel(), shares.ravel()])
            total, logs = found if total is None else total + found, logs + score.sum()
        if total is not None:
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(place, LIKELIHOOD).astype(np.int32)), pa.array(np.append(total[place], logs))], names=["place", "value"]
            )

    return run


def trained(texts: DataFrame, counts: Counts, rounds: int | None = None) -> tuple[Model, np.ndarray]:
    """The model after Baum-Welch over all texts, and the shares of the states in each length of the words that share a symbol.

    Rounds go on until the gain is small, or for ``rounds`` rounds if given. They read the texts as symbols, written once.
    """
    shares = np.full(counts.symbols, SMOOTH)
    shares[counts.symbol] += counts.counts
    shares[counts.vocabulary :] += 10**counts.rest
    shares /= shares.sum()
    model, tied = Model.first(shares), np.ones((LENGTHS + 1, STATES))
    last, done, gain = -np.inf, 0, np.inf
    if counts.total:
        symbols = written(texts.mapInArrow(encoded(counts), "symbols binary"), "symbols")
    while counts.total and (gain >= TOLERANCE if rounds is None else done < rounds):
        sums = symbols.mapInArrow(expectations(counts, model), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
        values, logs = np.zeros(STATES + STATES * STATES + counts.symbols * STATES), 0.0
        for row in sums.toLocalIterator():  # one row per parameter at most
            if row["place"] == LIKELIHOOD:
                logs = row["value"]
            else:
                values[row["place"]] = row["value"]
        model = Model.from_counts(values, shares)
        tied = values.reshape(-1, STATES)[-LENGTHS - 1 :] + SMOOTH
        last, done, gain = logs, done + 1, (logs - last) / counts.total
    return model, tied / tied.sum(1, keepdims=True)


PLACES = [f"s{i}" for i in range(STATES)]


def word_states(counts: Counts, model: Model):
    """Rows (token, length, n, s0, s1, ...): occurrences and expected state counts of the words that are no symbols."""

    def rows(batches):
        for batch in hashing.slices(batches):
            tokens, lengths, at = token_arrays(batch.column("text"))
            symbols = counts.symbols_of(tokens, lengths)
            segments = Segments(symbols, at)
            _, _, weights, _ = segments.passes(model)
            place = np.concatenate(segments.at)
            shared = np.flatnonzero(symbols[place] >= counts.vocabulary)
            place = place[shared]
            known, sample, owner, n = np.unique(tokens[place], return_index=True, return_inverse=True, return_counts=True)
            parts = [np.rint(np.bincount(owner, w[shared], len(known)) * PARTS).astype(np.int64) for w in weights]
            yield [known, np.minimum(lengths[place[sample]], LENGTHS), n, *parts]

    return lambda batches: summed(rows(batches), ["token", "length", "n", *PLACES])


def emissions(texts: DataFrame, counts: Counts, model: Model, tied: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(token, n, e): how likely each state shows each training word that is no symbol; and, per length, one never seen.

    Within the share of its length, a word weighs its smoothed count in a state; the weights of all words of the length
    and of one unseen word add up to that share.
    """
    schema = "token bigint, length int, n bigint, " + ", ".join(f"{s} bigint" for s in PLACES)
    sums = texts.mapInArrow(word_states(counts, model), schema).groupBy("token")
    words = written(sums.agg(F.max("length").alias("length"), F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in PLACES]), "words")

    def of_length(values: np.ndarray, k: int):
        return F.get(F.lit([float(x) for x in values[:, k]]), F.col("length"))

    def weight(k: int):
        own = F.col(PLACES[k]) / PARTS + PRIOR * of_length(tied, k)
        return (F.col("n") + SMOOTH) * own / (F.col("n") + PRIOR)

    whole = SMOOTH * tied
    for row in words.groupBy("length").agg(*[F.sum(weight(k)).alias(s) for k, s in enumerate(PLACES)]).toLocalIterator():
        whole[row["length"]] += [row[s] for s in PLACES]  # one row per length
    share = model.emit[counts.vocabulary :] / whole
    return words.select("token", "n", F.array(*[weight(k) * of_length(share, k) for k in range(STATES)]).alias("e")), SMOOTH * tied * share


@dataclass
class Known:
    """Counts and emissions of the words that all tasks have, frequent ones first."""

    tokens: np.ndarray
    n: np.ndarray
    emit: np.ndarray  # one column per token


def head_of(counts: Counts, model: Model, words: DataFrame) -> Known:
    """The symbols' words and the ``HEAD`` most frequent others: a fixed size."""
    head = words.orderBy(F.desc("n"), "token").limit(HEAD)
    rows = [(row["token"], row["n"], row["e"]) for row in head.toLocalIterator()]
    by_symbol = np.argsort(counts.symbol)
    return Known(
        np.concatenate([counts.tokens[by_symbol], np.array([r[0] for r in rows], np.int64)]),
        np.concatenate([counts.counts[by_symbol], np.array([r[1] for r in rows], np.int64)]),
        np.concatenate([model.emit[counts.symbol[by_symbol]], np.array([r[2] for r in rows], float).reshape(-1, STATES)]).T.copy(),
    )


def beyond_head(head: np.ndarray):
    """Rows (row_hash, token): the distinct words of each text that are not in the head, once for copies in one slice."""

    def run(batches):
        lookup = Lookup(head)
        for batch in hashing.slices(batches):
            tokens, _, at = token_arrays(batch.column("text"))
            inside, _ = lookup.find(tokens)
            hashes = batch.column("row_hash").to_numpy()
            owner, tokens = np.repeat(hashes, np.diff(at))[~inside], tokens[~inside]
            order = np.lexsort((tokens, owner))
            tokens, owner = tokens[order], owner[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(owner[new]), pa.array(tokens[new])], names=["row_hash", "token"])

    return run


def scored(counts: Counts, model: Model, head: Known, unseen: np.ndarray):
    """Rows (doc_id, held_out, n_tokens, n_known, base_score, score) of texts that carry the rest of their words in ``rest``."""

    def run(batches):
        lookup, known = Lookup(head.tokens), len(head.tokens)
        # symbols of a slice: the head, the rest of its words, then words never seen by length
        emit, base = head.emit, counts.base_log(head.n)
        for batch in hashing.slices(batches):
            tokens, lengths, at = token_arrays(batch.column("text"))
            rest = batch.column("rest").flatten()
            token, n, own = (rest.field(i) for i in range(3))
            token, first = np.unique(token.to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            learned = known + len(token)
            if emit.shape[1] < learned + LENGTHS + 1:
                emit = np.concatenate([head.emit, np.empty((STATES, 2 * len(token) + LENGTHS + 1))], axis=1)
                base = np.concatenate([base[:known], np.empty(emit.shape[1] - known)])
            emit[:, known:learned] = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATES)[first].T
            emit[:, learned : learned + LENGTHS + 1] = unseen.T
            base[known:learned] = counts.base_log(n.to_numpy(zero_copy_only=False).astype(np.int64)[first])
            base[learned : learned + LENGTHS + 1] = counts.base_log(np.zeros(LENGTHS + 1))
            inside, symbol = lookup.find(tokens)
            other = np.flatnonzero(~inside)
            in_rest, place = found_in(token, tokens[other])
            symbol[other] = np.where(in_rest, known + place, learned + np.minimum(lengths[other], LENGTHS))
            segments, here = Segments(symbol, at), Model(model.start, model.move, emit.T)
            _, score = segments.entering(here, *segments.products(here))
            begin = at[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "held_out")),
                    pa.array(np.diff(at)),
                    pa.array(np.add.reduceat((symbol < learned).astype(np.int64), begin)),
                    pa.array(np.add.reduceat(base[symbol], begin)),
                    pa.array(score),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def hmm_scores(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), 10).alias("held_out"))
    rows = rows.withColumn("row_hash", F.xxhash64("text"))
    texts = rows.where("NOT held_out AND doc_id IS NOT NULL").select("text")
    tokens = texts.mapInArrow(counted, "token bigint, length int, n bigint")
    table = written(tokens.groupBy("token").agg(F.max("length").alias("length"), F.sum("n").alias("n")), "counts")
    counts = symbols_from(table)
    model, tied = trained(texts, counts, rounds)
    words, unseen = emissions(texts, counts, model, tied)
    head = head_of(counts, model, words)

    tail = rows.select("row_hash", "text").mapInArrow(beyond_head(head.tokens), "row_hash bigint, token bigint")
    # copies of a text meet where its words are joined; flat rows take less room on their way than lists begun before
    flat = tail.join(words, "token").select("row_hash", "token", "n", *[F.get("e", F.lit(k)).alias(s) for k, s in enumerate(PLACES)])
    flat = flat.dropDuplicates(["row_hash", "token"])
    word = F.struct("token", "n", F.array(*PLACES).alias("e"))
    rest = flat.repartition("row_hash").groupBy("row_hash").agg(F.collect_list(word).alias("rest"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    found = rows.join(rest, "row_hash", "left").select("doc_id", "held_out", "text", "rest")
    return found.mapInArrow(scored(counts, model, head, unseen), schema).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
