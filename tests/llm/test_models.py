"""Language ID and language-model scores: gradients, brute force and held-out figures."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import hmm_scoring, language_id


def test_gradients_by_differences():
    network = language_id.Network.start(["a", "b", "c"])
    rng = np.random.default_rng(0)
    runs, label = rng.integers(0, 257, (6, 5)), rng.integers(0, 3, 5)[None, None]
    grads, _ = network.gradient(runs, label)
    for weights, grad in zip(network.weights(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        was, losses = weights[at], []
        for step in (0.01, -0.01):
            weights[at] = was + step
            losses.append(network.gradient(runs, label)[1])
        weights[at] = was
        assert grad[at] == pytest.approx((losses[0] - losses[1]) / 0.02, rel=0.02)


def test_positions_by_brute_force():
    network = language_id.Network.start(["a", "b"], hidden=3)
    runs = np.random.default_rng(1).integers(0, 257, (5, 4))
    got = network.positions(runs.copy())
    for n in range(4):
        states = []
        for direction, order in ((network.forward, range(5)), (network.backward, range(4, -1, -1))):
            h, seen = np.zeros(3), {}
            for t in order:
                a, g = direction.inputs[:, runs[t, n]].astype(float), direction.states @ h
                update, reset = np.clip(a[:3] + g[:3], 0, 1), np.clip(a[3:6] + g[3:6], 0, 1)
                h = update * h + (1 - update) * np.clip(a[6:] + reset * g[6:], -1, 1)
                seen[t] = h
            states.append(seen)
        for t in range(5):
            score = network.out @ np.concatenate([states[0][t], states[1][t], [1]])
            assert got[t, :, n] == pytest.approx(np.exp(score) / np.exp(score).sum(), abs=1e-5)


def test_runs_cover_every_byte():
    data, at = np.arange(300) % 256, np.array([0, 0, 64, 129, 300])
    runs, owner = language_id.cut(data.astype(np.uint8), at)
    for i in range(4):
        column = runs[:, owner == i].T.ravel()
        assert column[column < 256].tolist() == data[at[i] : at[i + 1]].tolist()


def test_language_of_held_out_documents(spark, make_docs, sample_docs, sample_texts):
    extra = [(9000, None, "en"), (9001, "", "de"), (9002, "12 34 !?", "en"), (9003, sample_texts[0] * 40, None), (None, sample_texts[1], "en")]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in sample_docs.collect()]
    docs = make_docs(rows + extra + rows[:1])
    got = language_id.language_id(docs).collect()
    assert len(got) == len(rows) + len(extra) + 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (9000, 9001, 9002))
    assert by[9003].lang_pred == by[0].lang_pred and not by[None].held_out
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in rows if by[r[0]].held_out and len(r[1]) > 100]
    assert np.mean([by[i].lang_pred == lang for i, _, lang, _ in held]) > 0.9
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not {9000, 9001, 9002} & set(ids) and len(ids) >= len(rows)


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "some text", None), (2, None, "en"), (5, "held out", "en")])
    assert language_id.fitted(docs.where("doc_id < 3")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).count() == 0


def small_model(states=3, symbols=40):
    rng = np.random.default_rng(0)
    shares = rng.dirichlet(np.ones(symbols))
    model = hmm_scoring.Model.first(shares, states)
    return hmm_scoring.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), model.emit), rng


def test_recursions_by_brute_force(monkeypatch):
    monkeypatch.setattr(hmm_scoring, "SEGMENT", 7)
    model, rng = small_model()
    lengths = [1, 5, 7, 8, 30, 14, 3]
    symbols, at = rng.integers(0, 40, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    segments = hmm_scoring.Segments(symbols, at)
    _, score = segments.entering(model, *segments.products(model))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((40, 3))
    for i in range(len(lengths)):
        s = symbols[at[i] : at[i + 1]]
        alpha, beta = np.zeros((len(s), 3)), np.ones((len(s), 3))
        alpha[0] = model.start * model.emit[s[0]]
        for t in range(1, len(s)):
            alpha[t] = alpha[t - 1] @ model.move * model.emit[s[t]]
        for t in range(len(s) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[s[t + 1]] * beta[t + 1])
        whole = alpha[-1].sum()
        assert score[i] == pytest.approx(math.log10(whole), abs=1e-9)
        start += alpha[0] * beta[0] / whole
        for t, x in enumerate(s):
            emit[x] += alpha[t] * beta[t] / whole
            if t:
                move += alpha[t - 1][:, None] * model.move * (model.emit[x] * beta[t]) / whole
    assert segments.expected(model) == pytest.approx(np.concatenate([start, move.ravel(), emit.ravel()]), abs=1e-9)


def test_hmm_products_only_of_later_segments(monkeypatch):
    """Where a text begins is known, so its first segment needs one forward pass, not one from each state."""
    monkeypatch.setattr(hmm_scoring, "SEGMENT", 7)
    segments = hmm_scoring.Segments(np.arange(25) % 4, np.array([0, 3, 10, 25]))  # 1, 1 and 3 segments
    model = hmm_scoring.Model.first(np.full(4, 0.25), 2)
    products, logs = segments.products(model)
    assert products.shape == (2, 2, 2) and logs.shape == (2,)
    assert segments.openings(model)[0].shape == (2, 3)


def test_lookup_finds_what_a_search_finds():
    """Known tokens are found by their highest bits in one step, also those that share them with others."""
    rng = np.random.default_rng(0)
    known = rng.integers(-(2**63), 2**63, 3000)
    for some in (known, np.append(known, known[:500] ^ 1), np.arange(-40, 40), known[:1], known[:0]):
        lookup = hmm_scoring.Lookup(rng.permutation(some))
        asked = np.concatenate([some, rng.integers(-(2**63), 2**63, 3000), some[::-1] ^ 2, np.arange(100)])
        inside, at = lookup.find(asked)
        assert inside.tolist() == np.isin(asked, some).tolist()
        assert lookup.known[at[inside]].tolist() == asked[inside].tolist()
    assert len(hmm_scoring.Lookup(known).rest) < 0.25 * len(known)  # few are left to a search


def test_scaling_now_and_then(monkeypatch):
    """Words that are very unlikely in every state, or in all but one, leave no zero between two scalings."""
    monkeypatch.setattr(hmm_scoring, "SEGMENT", 50)
    rng = np.random.default_rng(0)
    emit = 10.0 ** rng.uniform(-30, -25, (40, 3))
    emit[:10] = np.where(np.arange(3) == np.arange(10)[:, None] % 3, 0.1, 1e-30)
    move = np.array([[1, 1e-9, 1e-9], [1e-9, 1, 1e-9], [1e-9, 1e-9, 1]])
    model = hmm_scoring.Model(np.full(3, 1 / 3), move / move.sum(1), emit)
    at = np.array([0, 1, 40, 49, 300])
    symbols = rng.integers(0, 40, at[-1])
    segments = hmm_scoring.Segments(symbols, at)
    start, moves, weights, score = segments.passes(model)
    for i in range(len(at) - 1):
        state, log = model.start, 0.0
        for t, x in enumerate(symbols[at[i] : at[i + 1]]):
            state = (state @ move if t else state) * emit[x]
            log, state = log + math.log10(state.sum()), state / state.sum()
        assert score[i] == pytest.approx(log, rel=1e-9)
    assert segments.entering(model, *segments.products(model))[1] == pytest.approx(score)
    assert weights.sum(0) == pytest.approx(np.ones(at[-1])) and (weights >= 0).all()
    assert start.sum() == pytest.approx(4) and moves.sum() == pytest.approx(at[-1] - 4)


def test_rounds_read_symbols(sample_texts, monkeypatch):
    """Rounds of Baum-Welch take written symbols, however they are cut, and split no text into words again."""
    monkeypatch.setattr(hmm_scoring, "VOCABULARY", 30)
    texts = pa.array([*list(sample_texts.values())[:50], None, "", " a  B "])
    tokens, lengths, at = hmm_scoring.token_arrays(texts)
    known, n = np.unique(tokens, return_counts=True)
    top = np.sort(np.argsort(-n, kind="stable")[:30])
    counts = hmm_scoring.Counts(len(tokens), len(known), known[top], n[top], np.argsort(np.argsort(-n[top])), 30, np.zeros(hmm_scoring.LENGTHS + 1))
    model = hmm_scoring.Model.first(np.full(counts.symbols, 1 / counts.symbols))
    want = hmm_scoring.Segments(counts.symbols_of(tokens, lengths), at).expected(model)
    rows = [b for k in (0, 20) for b in hmm_scoring.encoded(counts)(iter([pa.record_batch([texts[k : k + 20 if not k else None]], ["text"])]))]
    assert [len(x.as_py()) for b in rows for x in b.column(0)] == (np.diff(at) * counts.kind.itemsize).tolist()
    monkeypatch.setattr(hmm_scoring, "token_arrays", None)
    for run in (hmm_scoring.RUN, 500, 1):
        monkeypatch.setattr(hmm_scoring, "RUN", run)
        (found,) = hmm_scoring.expectations(counts, model)(iter([rows[0].slice(0, 3), rows[0].slice(3), rows[0].slice(0, 0), *rows[1:]]))
        got = np.zeros(len(want))
        got[found.column("place").to_numpy()[:-1]] = found.column("value").to_numpy()[:-1]
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_baum_welch_raises_the_likelihood():
    model, rng = small_model(2, 20)
    symbols = np.concatenate([rng.integers(0, 10, 300), rng.integers(10, 20, 300)] * 4)
    at = np.arange(0, len(symbols) + 1, 600)
    shares = np.full(20, 1e-6)
    before = -np.inf
    for _ in range(6):
        segments = hmm_scoring.Segments(symbols, at)
        total = segments.entering(model, *segments.products(model))[1].sum()
        assert total >= before - 1
        before, model = total, hmm_scoring.Model.from_counts(segments.expected(model), shares, 2)


def brute_base(rows):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = [(d, (t or "").encode().translate(low).split() + [None]) for d, t in rows]
    counts = Counter(x for d, v in tokens if d is not None and zlib.crc32(str(d).encode()) % 10 for x in v)
    total, distinct = sum(counts.values()), len(counts)
    share = lambda x: math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1)))
    return [(d, len(v), sum(counts[x] > 0 for x in v), total, sum(map(share, v))) for d, v in tokens]


def test_scores(make_docs, sample_texts, monkeypatch):
    rows = sorted(sample_texts.items()) + [(5000, None), (5001, ""), (5002, "A a Ä ä never seen before " * 700), (None, "a the")]
    rows += [rows[0], rows[0], rows[3], (5000, None), (6000, rows[0][1])]
    for head in (hmm_scoring.HEAD, 40):  # with a small head, nearly all words come by the join
        monkeypatch.setattr(hmm_scoring, "HEAD", head)
        monkeypatch.setattr(hmm_scoring, "VOCABULARY", min(30, head))
        got = sorted(hmm_scoring.hmm_scores(make_docs(rows), 3).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens))
        want = sorted(brute_base(rows), key=lambda r: (repr(r[0]), r[1]))
        assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [r[:4] for r in want]
        assert [r.base_score for r in got] == pytest.approx([r[4] for r in want], rel=1e-9)
        assert all(r.score < 0 for r in got)
        held = [r for r in got if r.held_out and r.n_tokens > 30 and r.doc_id < 5000]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_whole_texts_by_plain_recursion(make_docs, sample_texts, monkeypatch):
    """Every word has emissions of its own, learned from its expected counts, wherever its emissions come from."""
    monkeypatch.setattr(hmm_scoring, "HEAD", 40)
    monkeypatch.setattr(hmm_scoring, "VOCABULARY", 30)
    monkeypatch.setattr(hmm_scoring, "SEGMENT", 50)
    some = sorted(sample_texts.items())[:60]
    docs = make_docs([*some, (7000, "neverseen " * 120 + "Alsoneverseen"), (7001, None), some[0]])
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    learned = [t for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    texts = docs.sparkSession.createDataFrame([(t,) for t in learned], "text string")
    table = texts.mapInArrow(hmm_scoring.counted, "token bigint, length int, n bigint").groupBy("token").agg({"length": "max", "n": "sum"})
    counts = hmm_scoring.symbols_from(table.toDF("token", "length", "n"))
    model, tied = hmm_scoring.trained(texts, counts, 2)
    words, unseen = hmm_scoring.emissions(texts, counts, model, tied)
    emit = {r.token: np.array(r.e) for r in words.collect()}
    assert len(emit) == counts.distinct - 30
    # expected counts of single words by a plain forward and backward recursion over whole texts
    wanted, seen, length_of = {}, Counter(), {}
    for text in learned:
        tokens, lengths, _ = hmm_scoring.token_arrays(pa.array([text]))
        symbols = counts.symbols_of(tokens, lengths)
        alpha, beta = np.zeros((len(tokens), 6)), np.ones((len(tokens), 6))
        for t, x in enumerate(symbols):
            alpha[t] = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[x]
            alpha[t] /= alpha[t].sum()
        for t in range(len(tokens) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[symbols[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        for token, length, x, g in zip(tokens.tolist(), lengths.tolist(), symbols, gamma):
            if x >= 30:
                wanted[token] = wanted.get(token, 0) + g
                seen[token] += 1
                length_of[token] = min(length, hmm_scoring.LENGTHS)
    weight = {w: (seen[w] + 0.1) * (c + tied[length_of[w]]) / (seen[w] + 1) for w, c in wanted.items()}
    for length in set(length_of.values()):
        same = [w for w in weight if length_of[w] == length]
        whole = sum(weight[w] for w in same) + 0.1 * tied[length]
        for w in same:
            assert emit[w] == pytest.approx(model.emit[30 + length] * weight[w] / whole, rel=0.01, abs=1e-9)
        assert sum(emit[w] for w in same) + unseen[length] == pytest.approx(model.emit[30 + length])
    got = {r.doc_id: r.score for r in hmm_scoring.hmm_scores(docs, 2).collect()}
    by_word = {**emit, **{w: model.emit[i] for w, i in zip(counts.tokens.tolist(), counts.symbol)}}
    for doc_id, text in rows:
        tokens, lengths, _ = hmm_scoring.token_arrays(pa.array([text]))
        state, score = model.start, 0.0
        for t, (token, length) in enumerate(zip(tokens.tolist(), lengths)):
            state = (state if t == 0 else state @ model.move) * by_word.get(token, unseen[min(length, hmm_scoring.LENGTHS)])
            score, state = score + math.log10(state.sum()), state / state.sum()
        assert got[doc_id] == pytest.approx(score, rel=1e-6)


def test_what_is_gathered_grows_with_the_texts(make_docs, monkeypatch):
    """Two contexts with words of equal length and count: their rare words come to prefer different states."""
    monkeypatch.setattr(hmm_scoring, "VOCABULARY", 9)
    own = lambda side, i: f"{side}{chr(97 + i // 26)}{chr(97 + i % 26)}"
    text = {side: " ".join(f"{side}1 {side}2 {own(side, i)} {side}3 {side}4" for i in range(300)) for side in "xy"}
    texts = make_docs([(i, text["xy"[i % 2]]) for i in range(40)]).select("text")
    table = texts.mapInArrow(hmm_scoring.counted, "token bigint, length int, n bigint").groupBy("token").agg({"length": "max", "n": "sum"})
    counts = hmm_scoring.symbols_from(table.toDF("token", "length", "n"))
    model, tied = hmm_scoring.trained(texts, counts)
    words, _ = hmm_scoring.emissions(texts, counts, model, tied)
    emit = {r.token: np.array(r.e) for r in words.collect()}
    assert len(emit) == counts.distinct - 9 == 600
    token = lambda word: hmm_scoring.token_arrays(pa.array([word]))[0][0]
    sides = {side: np.mean([emit[token(own(side, i))] for i in range(300)], axis=0) for side in "xy"}
    # the words of one side are far likelier in some state than those of the other
    assert max(sides["x"] / sides["y"]) > 5 and max(sides["y"] / sides["x"]) > 5


def test_words_beyond_the_head_once_for_copies():
    """Copies of a text in one slice hand on their words once; equal words of other texts are rows of their own."""
    texts = ["the rare Rarer rare", "the rare", "the rare Rarer rare", "the", ""]
    head = hmm_scoring.token_arrays(pa.array(["the"]))[0]
    batch = pa.record_batch([pa.array([7, -8, 7, 9, 10]), pa.array(texts)], ["row_hash", "text"])
    (found,) = hmm_scoring.beyond_head(head)(iter([batch]))
    rare, rarer = (int(hmm_scoring.token_arrays(pa.array([w]))[0][0]) for w in ("rare", "rarer"))
    assert sorted(map(tuple, (r.values() for r in found.to_pylist()))) == sorted([(7, rare), (7, rarer), (-8, rare)])


def test_scores_without_training(make_docs):
    docs = make_docs([(None, "a b"), (None, None)])
    got = hmm_scoring.hmm_scores(docs).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3] and all(r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert hmm_scoring.hmm_scores(docs.limit(0)).count() == 0


def test_symbol_shares_add_up():
    tokens, lengths, at = hmm_scoring.token_arrays(pa.array(["a b", None, " c "]))
    assert lengths.tolist() == [1, 1, 0, 0, 1, 0] and at.tolist() == [0, 3, 4, 6]
    assert len({*tokens.tolist()}) == 4
