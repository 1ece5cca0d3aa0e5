"""Quality classifier without gold labels.

Heuristic labellers vote on each document (good, bad or no opinion). A labeller that looks
for one fault votes "good" where it could have found the fault and didn't, so that its
silence and its false alarms are weighed; it has no opinion only on texts too short for it.
Expectation maximisation over the vote patterns of the whole corpus estimates how far each
labeller is to be trusted for either class, and so the posterior of every pattern.
The posteriors of a bounded sample train a linear scorer over hashed features, which
then judges every document. Votes and scores are computed from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import col, cut, fresh
from factloom.llm.textkit import U, Chunk, chunks, kgrams, segment_hash, words

#: Different rows that the scorer is fitted on at most: those whose hashes of id and text are least. All else uses every document.
TRAIN_ROWS, BUCKETS, THRESHOLD = 6_000, 1 << 16, 0.5
#: The first ones look for one fault each; the last three judge several figures and overlap with them.
LABELLERS = ("capitals", "symbols", "stutter", "loops", "bars", "variety", "word_length", "sentences", "plain", "marked", "surface", "repetition", "prose")

_CLASS = np.full(256, ord("?"), np.uint8)  # the shape of a byte
for _low, _high, _c in (("a", "z", "a"), ("A", "Z", "A"), ("0", "9", "0")):
    _CLASS[ord(_low) : ord(_high) + 1] = ord(_c)
_CLASS[128:] = ord("a")
for _c in "!?.,;:'\"-()[]{}|/\\#$%&*+=<>@^_`~":
    _CLASS[ord(_c)] = ord(_c)
_LETTER, _UPPER = (_CLASS == ord("a")) | (_CLASS == ord("A")), _CLASS == ord("A")
_MARK = np.isin(np.arange(256), [ord(c) for c in "#$%&*+=<>@^~|\\{}!"])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".?!"])


class Facts:
    """Per-word and per-row figures of a chunk."""

    def __init__(self, chunk: Chunk) -> None:
        data = chunk.data
        self.starts, self.ends, self.first = words(chunk)
        self.hash = segment_hash(data, self.starts, self.ends)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(chunk)), self.count)
        n = len(self.hash)
        self.same = np.zeros(n, bool)
        self.same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.row[1:] == self.row[:-1])
        total = np.maximum(self.count, 1)
        per_row = lambda x: np.bincount(self.row, x, len(chunk)) / total
        bytes_of = lambda mask: (lambda s: (s[chunk.offsets[1:]] - s[chunk.offsets[:-1]]))(np.concatenate(([0], np.cumsum(mask[data]))))
        letters = np.maximum(bytes_of(_LETTER), 1)
        size = np.maximum(np.diff(chunk.offsets), 1)
        self.upper = bytes_of(_UPPER) / letters
        self.marks = bytes_of(_MARK) / size
        self.letters = letters / size
        self.stutter = per_row(self.same)
        self.length = per_row(self.ends - self.starts)
        lone = (self.ends - self.starts == 1) & _MARK[data[self.starts]] if n else np.zeros(0, bool)
        self.bars = per_row(lone)
        last = data[self.ends - 1] if n else np.zeros(0, np.uint8)
        self.stops = per_row(_STOP[last])
        self.marked = per_row(_MARK[last] & ~lone)
        self.loops, self.variety = self._repeats(chunk)

    def _repeats(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Share of 4-grams that came before in the row; distinct words a square root of words."""
        out = []
        grams, ok = kgrams(self.hash, self.first, 4)
        for values, rows in ((grams[ok], self.row[ok]), (self.hash, self.row)):
            fresh_ = np.zeros(len(chunk))
            for a in range(0, len(chunk), 1 << 18):
                here = (rows >= a) & (rows < a + (1 << 18)) if len(chunk) > 1 << 18 else slice(None)
                key = np.sort((rows[here] - a).astype(U) << U(46) | values[here] >> U(18))
                new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
                count = np.bincount((key[new] >> U(46)).astype(np.int64), minlength=min(1 << 18, len(chunk) - a))
                fresh_[a : a + len(count)] = count
            out.append((fresh_, np.bincount(rows, minlength=len(chunk))))
        (new, grams_), (distinct, n) = out
        return 1 - new / np.maximum(grams_, 1), distinct / np.sqrt(np.maximum(n, 1))

    def votes(self) -> np.ndarray:
        """One column a labeller: 1 good, -1 bad, 0 no opinion. A row without words gets no vote."""
        long, some = self.count >= 20, self.count > 3
        faults = [
            (self.upper > 0.45, True),
            (self.marks > 0.05, True),
            (self.stutter > 0.2, some),
            (self.loops > 0.45, long),
            (self.bars > 0.12, True),
            (self.variety < 2, long),
            ((self.length < 2.2) | (self.length > 14), True),
            (self.stops > 0.5, long),
            (self.letters < 0.68, True),
            (self.marked > 0.25, True),
        ]
        surface = np.where((self.upper > 0.4) | (self.marks > 0.04) | (self.bars > 0.1), -1, np.where((self.upper < 0.2) & (self.marks < 0.015) & (self.bars < 0.03), 1, 0))
        repetition = np.where((self.loops > 0.4) & long | (self.stutter > 0.2), -1, np.where((self.loops < 0.15) & (self.stutter < 0.05), 1, 0))
        usual = (self.length > 3) & (self.length < 9) & (self.letters > 0.72) & (self.marked < 0.1) & (self.variety > 3)
        odd = (self.letters < 0.66) | (self.marked > 0.2) | (self.variety < 2.5) | (self.length < 2.5) | (self.length > 12)
        prose = np.where(~long, 0, np.where(odd, -1, np.where(usual, 1, 0)))
        v = np.stack([*(np.where(able, np.where(fault, -1, 1), 0) for fault, able in faults), surface, repetition, prose], axis=1)
        v[self.count == 0] = 0
        return v

    def tokens(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of every word, three a word: the word, its shape, whether it repeats the
        one before; and those of every row, three a row: its levels of loops, stutter and variety."""
        kind = _CLASS[data]
        turn = np.ones(len(data), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn[self.starts] = True
        place = np.cumsum(turn)
        shape = segment_hash(kind[turn], place[self.starts] - 1, place[self.ends - 1]) if len(self.starts) else self.hash
        word = np.stack([self.hash >> U(7), shape >> U(11) ^ U(0x5555), np.where(self.same, U(7), U(13))], axis=1)
        level = lambda x, salt: (np.minimum(x * 8, 7).astype(U) + U(salt)) * U(0x9E3779B97F4A7C15) >> U(40)
        row = np.stack([level(self.loops, 11), level(self.stutter, 31), level(np.clip(self.variety / 16, 0, 1), 51)], axis=1)
        return (word.ravel() % U(BUCKETS)).astype(np.int32), (row % U(BUCKETS)).astype(np.int32)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            v = Facts(chunk).votes() + 1
            pattern = (v * 3 ** np.arange(v.shape[1])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(pattern.astype(np.int64))], ["key", "pattern"])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation over distinct vote patterns.

    Returns the posterior of "good" of each pattern, and each labeller's accuracy on
    good and on bad documents, given that it votes. Labellers are taken as independent
    given the class, with no opinion telling nothing; at first each is trusted at 0.9 on
    good documents and at 0.6 on bad ones. A labeller of one fault may end up with a low
    accuracy on bad documents, most of which have other faults; what its vote against a document
    weighs is that accuracy over its share of false alarms.
    """
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    good, bad, prior = np.full(len(LABELLERS), 0.9), np.full(len(LABELLERS), 0.6), 0.8
    weight, posterior = counts / max(counts.sum(), 1), np.full(len(patterns), 0.5)
    for _ in range(rounds):
        yes = np.where(votes == 1, np.log(good), np.where(votes == -1, np.log1p(-good), 0)).sum(axis=1) + np.log(prior)
        no = np.where(votes == 1, np.log1p(-bad), np.where(votes == -1, np.log(bad), 0)).sum(axis=1) + np.log1p(-prior)
        posterior = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        p, q = (weight * posterior)[:, None], (weight * (1 - posterior))[:, None]
        # a pinch of prior votes settles a labeller that never speaks
        tiny = 1e-4
        good = np.clip(((p * (votes == 1)).sum(0) + 0.9 * tiny) / ((p * (votes != 0)).sum(0) + tiny), 0.02, 0.999)
        bad = np.clip(((q * (votes == -1)).sum(0) + 0.6 * tiny) / ((q * (votes != 0)).sum(0) + tiny), 0.005, 0.99)
        prior = float(np.clip(p.sum(), 0.05, 0.95))
    return posterior, good, bad


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct features with their values: ten times the share of its words' features, 1 for a feature of its own."""
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            facts = Facts(chunk)
            feature, level = facts.tokens(chunk.data)
            pair, count = np.unique(np.repeat(facts.row, 3) * BUCKETS + feature, return_counts=True)
            value = 10 * count / (3 * facts.count[pair // BUCKETS])
            pair = np.concatenate((pair, (np.arange(len(chunk))[:, None] * BUCKETS + level).ravel()))
            order = np.argsort(pair, kind="stable")
            pair, value = pair[order], np.concatenate((value, np.ones(level.size)))[order].astype(np.float32)
            offsets = np.searchsorted(pair, np.arange(len(chunk) + 1) * BUCKETS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((pair % BUCKETS).astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), *lists], ["target", "features", "values"])


def fit_scorer(row: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft targets by Adagrad, over rows of (row, feature, value); the last weight is the bias."""
    n = len(target)
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 0.01), 0.5 / max((target <= 0.5).mean(), 0.01))
    for _ in range(rounds):
        z = np.bincount(row, weights.astype(np.float32)[feature] * value, n) + weights[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(n, 1)
        slope = np.append(np.bincount(feature, error.astype(np.float32)[row] * value, BUCKETS), error.sum()) + decay * weights
        squares += slope * slope
        weights -= rate * slope / np.sqrt(squares)
    return weights


def scorer(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """The trained weights, and each labeller's estimated accuracy on good and bad documents.

    Rows that share id and text are one to the sample. Without a single text the weights are 0 and no labeller has figures.
    """
    if train_rows < 1:
        raise ValueError("the scorer needs a row to be fitted on")
    keyed = docs.where(col(text).isNotNull()).select(F.xxhash64(col(doc_id), col(text)).alias("key"), col(text).alias("t"))
    votes = cut(keyed.mapInArrow(_vote, "key long, pattern long"))
    tally = votes.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()  # bounded by the labellers, not by the corpus
    if not len(tally):
        return np.zeros(BUCKETS + 1), {}
    posterior, good, bad = fit_labellers(tally["pattern"].to_numpy(), tally["n"].to_numpy())
    known = dict(zip(tally["pattern"].tolist(), posterior.tolist()))
    # copies of a row count once here, so that they can't take up the sample
    last = votes.select("key").distinct().orderBy("key").limit(train_rows).agg(F.max("key")).first()[0]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for voted, made in zip(_vote([batch]), _features([batch])):
                target = [known[p] for p in voted.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([voted.column(0), pa.array(target), made.column(1), made.column(2)], ["key", "target", "features", "values"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, sizes, feature, value = ([np.empty(0, kind)] for kind in (float, np.int64, np.int32, np.float32))
        for batch in batches:
            target.append(batch.column(1).to_numpy())
            sizes.append(pa.compute.list_value_length(batch.column(2)).to_numpy())
            feature.append(batch.column(2).flatten().to_numpy())
            value.append(batch.column(3).flatten().to_numpy())
        goal = np.concatenate(target)
        row = np.repeat(np.arange(len(goal), dtype=np.int32), np.concatenate(sizes))
        weights = fit_scorer(row, np.concatenate(feature), np.concatenate(value), goal)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()])], ["weights"])

    made = keyed.where(F.col("key") <= last).mapInArrow(labelled, "key long, target double, features array<int>, values array<float>").dropDuplicates(["key"])
    # in the order of the keys, so that sums don't hang on which task came first; train_rows rows at most
    weights = np.frombuffer(bytes(made.repartition(1).sortWithinPartitions("key").mapInArrow(fit, "weights binary").first()[0]), np.float32).astype(float)
    return weights, {name: (float(a), float(b)) for name, a, b in zip(LABELLERS, good, bad)}


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Adds each document's probability of being good; null for a null text or one without words."""
    compact = weights.astype(np.float32)

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        values, parts = compact.astype(float), []
        for chunk in chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            facts = Facts(chunk)
            feature, level = facts.tokens(chunk.data)
            words_ = np.bincount(np.repeat(facts.row, 3), values[feature], len(chunk))
            z = 10 * words_ / np.maximum(3 * facts.count, 1) + values[level].sum(axis=1) + values[-1]
            parts.append(np.where(facts.count > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.nan))
        return pd.Series(np.concatenate([*parts, np.empty(0)]))

    scored = probability(col(text))
    return docs.withColumn(out, F.when(~F.isnan(scored), scored))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, out: str | None = None) -> DataFrame:
    """The documents whose score reaches ``threshold`` (a tie with it stays); all columns pass through.

    ``out`` names a column for the score (in place of a clashing one). A null text
    and a text without words have no score and are rejected. Ids only help to choose the rows
    that the scorer is fitted on: rows with a null or repeated id are judged by their texts like
    any other, and repeated rows alike. An empty table, or one without a text, gives an empty one.
    A long text is judged whole; the arrays for it take about thirty bytes a byte of text while it is.
    """
    weights, _ = scorer(docs, doc_id, text, train_rows)
    name = fresh(docs, "quality_score")[0]
    judged = score(docs, weights, text, name).where(F.col(name) >= threshold)
    kept = [c for c in docs.columns if not out or c.lower() != out.lower()]
    return judged.select(*map(col, kept), *([F.col(name).alias(out)] if out else []))
