import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA, prose, row

from factloom.llm.quality import LABELLERS, Facts, classify, fit_labellers, score, scorer
from factloom.llm.textkit import chunks


def junk(rng, n):
    text = prose(rng, n)
    kind = rng.randint(0, 4)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in text.split())
    if kind == 1:
        return " | ".join(text.split())
    if kind == 2:
        return " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split())
    if kind == 3:
        return "\n".join(" ".join([w] * 18) for w in text.split()[:10])
    return "\n".join([text.split("\n")[0]] * 30)


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(3)
    n, right = 20_000, np.array([0.95, 0.9, 0.8, 0.7])
    good = rng.random(n) < 0.75
    votes = np.where(rng.random((n, 4)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random((n, 4)) < 0.2] = 0
    full = np.zeros((n, len(LABELLERS)), int)
    full[:, :4] = votes
    pattern = ((full + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
    seen, back, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    posterior, on_good, on_bad = fit_labellers(seen, counts)
    assert np.abs(on_good[:4] - right).max() < 0.03 and np.abs(on_bad[:4] - right).max() < 0.06
    assert ((posterior[back] > 0.5) == good).mean() > 0.93


def test_a_labeller_of_one_fault_is_heard():
    """A document that only one labeller, one that never speaks up for a document on its own, objects to has a lower posterior."""
    rng = np.random.default_rng(4)
    n = 20_000
    good = rng.random(n) < 0.85
    votes = np.ones((n, len(LABELLERS)), int)
    for k in range(10):  # each finds one kind of fault, with half a per cent of false alarms
        fault = ~good & (rng.integers(0, 5, n) == k // 2)
        votes[(fault & (rng.random(n) < 0.9)) | (rng.random(n) < 0.005), k] = -1
    votes[:, 10:] = 0
    pattern = ((votes + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
    seen, counts = np.unique(pattern, return_counts=True)
    posterior = dict(zip(seen.tolist(), fit_labellers(seen, counts)[0].tolist()))
    clean = np.ones(len(LABELLERS), int)
    clean[10:] = 0
    flat = lambda v: int(((v + 1) * 3 ** np.arange(len(LABELLERS))).sum())
    for k in range(10):
        one = clean.copy()
        one[k] = -1
        assert posterior[flat(one)] < posterior[flat(clean)] - 0.1
    both = clean.copy()
    both[:2] = -1
    assert posterior[flat(both)] < 0.1


def plain_posteriors(votes, counts, rounds=100):
    """The same expectation maximisation, one pattern and one labeller at a time."""
    m = len(votes[0])
    good, bad, prior, total = [0.9] * m, [0.6] * m, 0.8, sum(counts)
    for _ in range(rounds):
        post = []
        for v in votes:
            p, q = prior, 1 - prior
            for k, x in enumerate(v):
                p *= good[k] if x == 1 else 1 - good[k] if x == -1 else 1
                q *= 1 - bad[k] if x == 1 else bad[k] if x == -1 else 1
            post.append(p / (p + q))
        clip = lambda x, a, b: max(a, min(b, x))
        for k in range(m):
            mass = lambda which, weigh: sum(weigh(p) * c / total for v, c, p in zip(votes, counts, post) if v[k] in which)
            good[k] = clip((mass((1,), lambda p: p) + 0.9e-4) / (mass((1, -1), lambda p: p) + 1e-4), 0.02, 0.999)
            bad[k] = clip((mass((-1,), lambda p: 1 - p) + 0.6e-4) / (mass((1, -1), lambda p: 1 - p) + 1e-4), 0.005, 0.99)
        prior = clip(sum(p * c / total for p, c in zip(post, counts)), 0.05, 0.95)
    return post


def plain_features(text):
    """Distinct features of a text with their values, word by word."""
    (chunk,) = chunks(pa.array([text]))
    facts = Facts(chunk)
    feature, level = facts.tokens(chunk.data)
    found = {}
    for x in feature.tolist():
        found[x] = found.get(x, 0) + 10 / (3 * len(text.split()))
    return [*found.items(), *((x, 1.0) for x in level[0].tolist())]


def test_posteriors_and_fit_against_a_plain_version(spark):
    rng = random.Random(12)
    texts = [junk(rng, 80) if rng.random() < 0.2 else prose(rng, rng.randint(5, 120)) for _ in range(150)]
    patterns = []
    for t in texts:
        (chunk,) = chunks(pa.array([t]))
        patterns.append(tuple(Facts(chunk).votes()[0].tolist()))
    tally = Counter(patterns)
    post = dict(zip(tally, plain_posteriors(list(tally), list(tally.values()))))
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    weights, _ = scorer(docs)
    # plain gradient steps over dictionaries
    rows, target = [plain_features(t) for t in texts], [post[p] for p in patterns]
    n, w, squares = len(rows), defaultdict(float), defaultdict(lambda: 1e-8)
    share = sum(t > 0.5 for t in target) / n
    for _ in range(200):
        slope = defaultdict(float)
        for fs, t in zip(rows, target):
            z = sum(w[f] * v for f, v in fs) + w["bias"]
            e = (0.5 / max(share, 0.01) if t > 0.5 else 0.5 / max(1 - share, 0.01)) * (1 / (1 + math.exp(-max(-30, min(30, z)))) - t) / n
            for f, v in fs:
                slope[f] += e * v
            slope["bias"] += e
        for f in set(w) | set(slope):
            g = slope[f] + 1e-5 * w[f]
            squares[f] += g * g
            w[f] -= 0.5 * g / math.sqrt(squares[f])
    want = [1 / (1 + math.exp(-(sum(w[f] * v for f, v in fs) + w["bias"]))) for fs in rows]
    got = {r.doc_id: r.s for r in score(docs, weights, out="s").collect()}
    assert max(abs(got[i] - x) for i, x in enumerate(want)) < 0.02
    kept = {r.doc_id for r in classify(docs).collect()}
    assert kept >= {i for i, x in enumerate(want) if x > 0.53} and not kept & {i for i, x in enumerate(want) if x < 0.47}


def test_the_sample_is_bounded_whatever_the_ids(spark):
    rng = random.Random(14)
    texts = [junk(rng, 60) if i % 6 == 0 else prose(rng, 60) for i in range(300)]
    for ids in (range(300), [8] * 300, [1] * 300, [None] * 300):
        docs = spark.createDataFrame([row(i, t) for i, t in zip(ids, texts)], SCHEMA)
        weights, _ = scorer(docs, train_rows=80)
        kept = {r.text for r in classify(docs, train_rows=80).collect()}
        bad = {texts[i] for i in range(0, 300, 6)}
        assert weights.any() and len(kept & bad) <= 20 and len(kept - bad) >= 235
    with pytest.raises(ValueError):
        scorer(docs, train_rows=0)
    # copies of one row don't take up the sample
    copies = spark.createDataFrame([row(5, texts[1])] * 500 + [row(i, t) for i, t in enumerate(texts)], SCHEMA)
    assert len({r.text for r in classify(copies, train_rows=80).collect()} - bad) >= 235


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    rows, bad = [], set()
    for i in range(900):
        if rng.random() < 0.15:
            bad.add(i)
        rows.append(row(i, junk(rng, rng.randint(60, 300)) if i in bad else prose(rng, rng.randint(60, 300))))
    docs = spark.createDataFrame(rows, SCHEMA)
    weights, accuracy = scorer(docs, train_rows=500)
    assert set(accuracy) == set(LABELLERS) and all(0 <= x <= 1 for pair in accuracy.values() for x in pair) and weights.any()
    kept = {r.doc_id for r in classify(docs, train_rows=500).collect()}
    good = set(range(900)) - bad
    assert len(kept & good) >= 0.98 * len(good) and len(kept & bad) <= 0.1 * len(bad)


def test_edges(messy, nothing):
    out = classify(messy, out="quality_score")
    rows = out.collect()
    assert sorted(out.columns) == sorted(messy.columns)
    assert all(0.5 <= r.quality_score <= 1 for r in rows) and not {3, 4, 5} & {r.doc_id for r in rows}
    assert classify(messy).columns == messy.columns
    assert classify(nothing).count() == 0
