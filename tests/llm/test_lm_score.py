import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest import SCHEMA, prose, row

from factloom.llm import lm_score
from factloom.llm.bpe import PATTERN
from factloom.llm.lm_score import CONTEXT, LEAD, STRIDE, VOCABULARY, W, WIDTH, Model, Symbols, deal, encoder, fit, gather, lm_scores, narrow, score, size_of, units_of, windows


def setup(seed=0, vocabulary=300):
    rng = np.random.default_rng(seed)
    symbols = Symbols.fit(rng.integers(0, 50, vocabulary), own=20, tail=5, leaves=8)
    model = Model(symbols, seed=seed)
    model.flat[:] += rng.normal(0, 0.1, len(model.flat)).astype(np.float32)
    return rng, symbols, model


def led(parts, n):
    """Documents of ids with their leads, end to end, and where each starts."""
    lead = np.array([n + 1] * CONTEXT + [n])
    return np.concatenate([np.concatenate((lead, x)) for x in parts]), np.concatenate(([0], np.cumsum([len(x) + LEAD for x in parts])))


def softmax(z):
    z = np.exp(z - z.max())
    return z / z.sum()


def distribution(model, symbols, ids, i):
    """The probability of every id after ids[:i], one token at a time, without batches or masks."""
    w = {k: v.astype(float) for k, v in model.w.items()}
    block = i // STRIDE * STRIDE
    seen = [(p, symbols.units if p == 0 else symbols.of[ids[p - 1]]) for p in range(max(0, block - CONTEXT), i + 1)]
    x = np.stack([w["E"][s] + w["P"][p - (block - CONTEXT)] for p, s in seen])
    q = x[-1] @ w["Q"] / np.sqrt(WIDTH)
    h = x[-1] + softmax(x @ w["K"] @ q) @ (x @ w["V"]) @ w["O"]
    m = h + np.maximum(h @ w["A"] + w["a"], 0) @ w["B"]
    p = softmax(m @ w["U"] + w["c"])
    unit = list(p[: symbols.own])
    for k, share in enumerate(symbols.share):
        unit += list(p[symbols.own + k] * softmax(m @ w["L"][k] + w["l"][k] + share))
    return np.array(unit)[symbols.of[:-2]] * np.exp(symbols.rest[:-2])


def test_every_token_once_and_as_by_hand():
    rng, symbols, model = setup()
    sizes = [0, 1, 5, STRIDE - 1, STRIDE, STRIDE + 1, 3 * STRIDE, 0, 150]
    parts = [rng.integers(0, 300, n) for n in sizes]
    ids, first = led(parts, 300)
    piece, inputs, targets = windows(symbols.of[ids], first, symbols.units + 1)
    assert (targets < symbols.units).sum() == sum(sizes) and inputs.shape[1] == W and len(piece) == sum(-(-n // STRIDE) for n in sizes)
    got = np.concatenate([model.log_probabilities(inputs[a : a + 3], targets[a : a + 3]) for a in range(0, len(piece), 3)])
    got = got + symbols.rest[np.concatenate(parts)]
    want = np.array([np.log(distribution(model, symbols, x, i)[t]) for x in parts for i, t in enumerate(x)])
    assert np.abs(got - want).max() < 1e-3


def test_probabilities_sum_to_one_and_leaves_depend_on_the_context():
    rng, symbols, model = setup(1)
    ids = rng.integers(0, 300, 40)
    every = [distribution(model, symbols, ids, i) for i in (0, 1, 35)]
    assert all(abs(p.sum() - 1) < 1e-4 for p in every)
    same = np.flatnonzero((symbols.of[:-2] >= symbols.own + 8) & (symbols.of[:-2] < symbols.own + 16))  # one tail symbol
    assert np.ptp((np.log(every[1]) - np.log(every[0]))[same]) > 1e-3
    # ids with an output of their own, at the sizes in use
    production = Symbols.fit(rng.integers(0, 50, 60_000))
    assert production.symbols >= 128 and production.units - len(production.share) >= 1600


def test_encoder_reads_the_unused_token_as_text_and_tries_no_empty_pattern():
    """Without a special token the library looks for an empty one at every place of a text; ids and their number are as without."""
    e = encoder(VOCABULARY)
    bare = tiktoken.Encoding("bare", pat_str=PATTERN, mergeable_ranks=e._mergeable_ranks, special_tokens={})
    assert e.special_tokens_set and size_of(VOCABULARY) == bare.max_token_value + 1
    rng = random.Random(4)
    texts = [lm_score.UNUSED, f"a{lm_score.UNUSED}b " * 3, lm_score.UNUSED[:-1], "<|endoftext|>", "a\x00b", "  a\n\n \tb  ", "日本語 😀"] + [prose(rng, 200) for _ in range(20)]
    texts += ["".join(rng.choice(" \n\x00<>unsed'.é1") for _ in range(60)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "t"])
    *rows, _ = lm_score._gather(VOCABULARY)(iter([batch]))
    got = [np.frombuffer(t.as_py(), narrow(VOCABULARY))[LEAD:].tolist() for r in rows for t in r.column(3)]
    assert got == [bare.encode_ordinary(t) for t in texts]


def test_products_of_any_number_of_rows():
    rng = np.random.default_rng(3)
    for n in (0, 1, lm_score.TILE - 1, lm_score.TILE, 2 * lm_score.TILE, 3 * lm_score.TILE + 5):
        a, b = rng.normal(size=(n, 17)).astype(np.float32), rng.normal(size=(n, 5)).astype(np.float32)
        assert np.allclose(lm_score._products(a, b), a.T @ b, atol=1e-3)


def test_gradient():
    rng, symbols, model = setup(2)
    parts = [rng.integers(0, 300, n) for n in (100, 7)]
    ids, first = led(parts, 300)
    _, x, y = windows(symbols.of[ids], first, symbols.units + 1)
    _, slope = model.loss_and_slope(x, y)
    checked = 0
    for k in rng.choice(np.flatnonzero(np.abs(slope) > 2e-3), 150, replace=False):
        was, losses = model.flat[k], []
        for step in (1e-2, -1e-2):
            model.flat[k] = was + step
            losses.append(Model(symbols, model.flat).loss_and_slope(x, y)[0])
        model.flat[k] = was
        assert abs((losses[0] - losses[1]) / 2e-2 - slope[k]) < 0.05 * abs(slope[k]) + 1e-3
        checked += 1
    assert checked == 150
    for key, part in model.w.items():  # every kind of parameter is trained
        assert np.abs(slope[np.isin(model.flat, part.ravel())]).max() > 0, key


def test_training_beats_counts_on_held_out_text(spark):
    rng = random.Random(6)
    texts = [prose(rng, 200) for _ in range(860)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts[:800])], SCHEMA).repartition(5)
    symbols, flat, losses = fit(gather(docs), replica=2_000)
    held = spark.createDataFrame([row(i, t) for i, t in enumerate(texts[800:])], SCHEMA)
    rows = score(gather(held), symbols, flat).collect()
    got = -sum(r.log_prob for r in rows) / sum(r.n_tokens for r in rows)
    encode = encoder(VOCABULARY).encode_ordinary
    counts = np.bincount([i for t in texts[:800] for i in encode(t)], minlength=60_000) + 1.0
    unigram = -np.mean([np.log(counts[i] / counts.sum()) for t in texts[800:] for i in encode(t)])
    assert losses[-1] < losses[0] and got < unigram - 0.2
    assert sum(r.n_tokens for r in rows) == sum(len(encode(t)) for t in texts[800:])


def test_scores_do_not_hang_on_partitions(spark):
    rng = random.Random(7)
    rows = [row(i, prose(rng, rng.randint(1, 300))) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    some, many = ({r.doc_id: r.mean_nll for r in lm_scores(docs.repartition(n, "text"), replica=300).collect()} for n in (2, 11))
    assert max(abs(some[i] - many[i]) for i in some) < 1e-4


@pytest.mark.parametrize("repeats", [True, False])
def test_windows_that_repeat_are_scored_once_and_alike(spark, monkeypatch, repeats):
    """Copies and passages that begin at a block cost no more windows, and every text has the sum over its own windows."""

    class Caught:  # the function that score gives to the workers
        where = select = withColumn = lambda self, *_: self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    rng = random.Random(12)
    a, b = prose(rng, 300), prose(rng, 90)
    texts = [a, b, a, "", a + b, "x", "x", a] if repeats else [a, b, "", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "t"])
    *rows, counts = lm_score._gather(VOCABULARY)(iter([batch]))
    n = np.zeros(size_of(VOCABULARY), np.int64)
    n[counts.column(4)[0].values.to_numpy()] = counts.column(5)[0].values.to_numpy()
    symbols = Symbols.fit(n)
    model, want, kinds = Model(symbols, seed=3), [], set()
    for r in rows:
        for tokens in (r.column(3).slice(i, 1) for i in range(r.num_rows)):
            units, first, rest = units_of(tokens, narrow(VOCABULARY), symbols)
            _, x, y = windows(units, first, symbols.units + 1)
            kinds |= {p.tobytes() + q.tobytes() for p, q in zip(x, y)}
            want.append(float(model.log_probabilities(x, y).sum() + rest[LEAD:].sum()) if len(x) else 0.0)
    caught, count, plain = Caught(), [], Model.log_probabilities
    score(caught, symbols, model.flat)
    monkeypatch.setattr(Model, "log_probabilities", lambda self, x, y: count.append(len(x)) or plain(self, x, y))
    got = [v for out in caught.run(r.select(["doc", "row", "tokens"]) for r in rows) for v in out.column(2).to_pylist()]
    assert len(got) == len(texts) and np.abs(np.array(got) - want).max() < 0.01
    assert sum(count) == len(kinds)


def test_windows_are_told_apart_though_their_keys_agree(monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 3, (50, W)).astype(np.int16), rng.integers(0, 3, (50, STRIDE)).astype(np.int16)
    x[30], y[30] = x[7], y[7]
    x[31], y[31] = x[7], rng.permutation(y[7])
    some, which = lm_score.distinct(x, y)
    assert len(some) == 49 and (x[some][which] == x).all() and (y[some][which] == y).all()

    class Zero:
        integers = staticmethod(lambda low, high, n: np.zeros(n, np.int64))

    monkeypatch.setattr(np.random, "default_rng", lambda *_: Zero)
    some, which = lm_score.distinct(x, y)
    assert (x[some][which] == x).all() and (y[some][which] == y).all()
    assert [len(v) for v in lm_score.distinct(x[:0], y[:0])] == [0, 0]


def test_edges(messy, nothing):
    rows = lm_scores(messy).collect()
    assert len(rows) == messy.count() and sum(r.log_prob is None for r in rows) == 2
    (empty,) = [r for r in rows if r.doc_id == 4]
    assert (empty.n_tokens, empty.log_prob, empty.mean_nll, empty.perplexity) == (0, 0.0, None, None)
    one, two = [r.log_prob for r in rows if r.doc_id == 1]
    assert abs(one - two) <= 0.002
    assert lm_scores(nothing).count() == 0


def test_all_rounds_and_replicas_together_train_on_every_block_once(spark, monkeypatch):
    """The windows that the replicas train on are those of all documents, long ones in pieces included."""
    monkeypatch.setattr(lm_score, "PIECE", 4 * STRIDE)
    texts = [prose(random.Random(k), n) for k, n in enumerate((2, 40, 400, 900))] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc", "t"])
    *rows, counts = lm_score._gather(VOCABULARY)(iter([batch]))
    assert counts.column(5)[0].values.to_numpy().sum() == sum(len(encoder(VOCABULARY).encode_ordinary(t)) for t in texts if t)
    symbols = Symbols.fit(np.zeros(size_of(VOCABULARY)))
    got = []
    for r in rows:
        units, first, _ = units_of(r.column(3), narrow(VOCABULARY), symbols)
        _, x, y = windows(units, first, symbols.units + 1)
        got += [a.tobytes() + b.tobytes() for a, b in zip(x, y)]
    ids, first = led([np.array(encoder(VOCABULARY).encode_ordinary(t or ""), np.int64) for t in texts], size_of(VOCABULARY))
    _, x, y = windows(symbols.of[ids], first, symbols.units + 1)
    assert sorted(got) == sorted(a.tobytes() + b.tobytes() for a, b in zip(x, y)) and len(got) > 60
    # each kept row is dealt to one round
    docs = spark.createDataFrame([row(i, prose(random.Random(i), 30)) for i in range(60)] + [row(100 + i, "a copy") for i in range(20)], SCHEMA)
    gathered = gather(docs)
    dealt = [[bytes(r.tokens) for r in deal(gathered, VOCABULARY, k, 3, 4).collect()] for k in range(3)]
    assert sorted(x for d in dealt for x in d) == sorted(bytes(r.tokens) for r in gathered.where("tokens is not null").collect())
    assert all(len(set(d)) > 5 and len(d) > len(set(d)) for d in dealt)  # every round has documents of its own, and some of the copies
