"""Scores of documents under a causal self-attention model that is trained on the corpus.

Texts are encoded by a public subword vocabulary. One pass over all documents counts
every id and keeps all ids. The model reads ids as *units* and predicts a unit in two steps. The first
softmax is over *symbols*: the commonest ids are symbols of their own,
the others share tail symbols of about equal mass. Within a tail symbol a second
softmax over its *leaves* depends on the context too: the commonest ids of the symbol are
leaves of their own, the rest share the last one, within which the corpus counts give
an id's probability. A unit is a symbol of its own or a leaf. The model has one attention layer and
one feed-forward layer, in numpy.

Training is data-parallel and covers every token of every document once: documents are dealt to
rounds and, within a round, to replicas, by a hash of id and ids. A replica trains on the windows of its share,
and the replicas are averaged in a tree of tasks, weighted by their windows. How many replicas there
are follows the corpus (one for each ``REPLICA`` windows of a round), and nothing hangs on Spark's partitions.

For scoring, a document is cut into blocks of ``STRIDE`` tokens. A window is a block
and the ``CONTEXT`` tokens before it, so that windows overlap but every token is
scored in exactly one of them, by masked attention over a batch of windows. A window that
comes up again among those of a task's batch of rows has the score it had.
"""

from __future__ import annotations

import base64
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import PATTERN
from factloom.llm.common import col, cut, number
from factloom.llm.textkit import ragged

#: The vocabulary for many languages: fewer tokens than the other one takes for texts that aren't all English.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A special token that no text is given.
UNUSED = "\0<unused>\0"
STRIDE, CONTEXT = 32, 16
WIDTH, HIDDEN, OWN, TAIL = 16, 32, 104, 24
#: Leaves of a tail symbol: so many ids less one have an output of their own in it.
LEAVES = 64
ROUNDS, BATCH, RATE = 3, 128, 0.01
#: Rows whose outer products are summed up at once.
TILE = 256
#: Windows of a round for which there is a replica.
REPLICA = 24_576
FAN_IN = 16
#: Tokens of a document that are kept in one row; a longer one has several.
PIECE = 1 << 15
#: Inputs of a window, and the tokens before a block that the first of them needs.
W, LEAD = STRIDE + CONTEXT, CONTEXT + 1
_CAUSAL = (np.arange(W)[None] <= CONTEXT + np.arange(STRIDE)[:, None]).astype(np.float32)


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    # without a special token, an empty pattern is tried at every place of a text; this one is never allowed, so a text that has it is text
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={UNUSED: max(ranks.values()) + 1})


def size_of(path: str) -> int:
    """Ids of the vocabulary; the two numbers that follow stand for the beginning of a text, and for what lies before that."""
    return encoder(path).encode_single_token(UNUSED)


def narrow(path: str) -> type:
    """The integers that hold the vocabulary's ids."""
    return np.uint16 if size_of(path) + 2 <= 1 << 16 else np.int32


@dataclass
class Symbols:
    """The unit of each id, the symbol and the leaf of each unit, and what the corpus counts say within these.

    Units: the symbols of their own, then the leaves of each tail symbol. Two more that follow stand for the beginning of a text
    and for what lies before that. ``rest`` is an id's log-probability within its unit, ``share``
    a leaf's within its tail symbol.
    """

    of: np.ndarray
    own: int
    share: np.ndarray
    rest: np.ndarray

    @property
    def symbols(self) -> int:
        return self.own + len(self.share)

    @property
    def units(self) -> int:
        return self.own + self.share.size

    @classmethod
    def fit(cls, counts: np.ndarray, own: int = OWN, tail: int = TAIL, leaves: int = LEAVES) -> Symbols:
        mass = counts + 1.0
        order = np.lexsort((np.arange(len(mass)), -counts))
        own = min(own, len(mass) - 1)
        held = mass[order[own:]]
        sums = np.cumsum(held)
        symbol = np.minimum((sums - held) / sums[-1] * tail, tail - 1).astype(np.int64)  # ascending, the commonest ids of a symbol first
        leaf = np.minimum(np.arange(len(symbol)) - np.searchsorted(symbol, symbol), leaves - 1)
        of = np.empty(len(mass) + 2, np.int16 if own + tail * leaves + 2 < 1 << 15 else np.int32)
        of[order[:own]] = np.arange(own)
        of[order[own:]] = own + symbol * leaves + leaf
        of[len(mass) :] = own + tail * leaves + np.arange(2)
        unit = np.bincount(of[: len(mass)], mass, own + tail * leaves)
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = unit[own:].reshape(tail, leaves)
            share = np.log(inner / inner.sum(axis=1, keepdims=True))
        rest = np.append(np.log(mass) - np.log(unit[of[: len(mass)]]), (0, 0))
        return cls(of, own, np.where(np.isfinite(share), share, -1e9).astype(np.float32), rest.astype(np.float32))


def windows(units: np.ndarray, first: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of pieces laid end to end, each with ``LEAD`` units before its targets (``first``: where each starts, n + 1 of them).

    Gives the piece of each window, its inputs (W of them) and its targets (STRIDE of them, ``outside`` past the end).
    """
    sizes = np.diff(first)
    blocks = -(-(sizes - LEAD) // STRIDE)
    room = LEAD + blocks * STRIDE
    start = np.concatenate(([0], np.cumsum(room)))
    flat = np.full(start[-1] + W, outside, units.dtype)
    flat[np.arange(len(units)) + np.repeat(start[:-1] - first[:-1], sizes)] = units
    piece = np.repeat(np.arange(len(sizes)), blocks)
    at = start[piece] + STRIDE * (np.arange(len(piece)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    slide = np.lib.stride_tricks.sliding_window_view
    return piece, slide(flat, W)[at], slide(flat, STRIDE)[at + LEAD]


def distinct(inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of windows that differ from each other, and for each window which of these it equals."""
    words = [word for x in (inputs, targets) for word in np.ascontiguousarray(x).view(np.uint64).T]
    keys = np.zeros(len(inputs), np.uint64)
    for word, factor in zip(words, np.random.default_rng(9).integers(1, 1 << 63, len(words)).astype(np.uint64)):
        keys ^= word
        keys *= factor
        keys ^= keys >> np.uint64(29)
    _, some, which = np.unique(keys, return_index=True, return_inverse=True)
    again = some[which]
    there = np.flatnonzero(again != np.arange(len(again)))
    if (inputs[there] != inputs[again[there]]).any() or (targets[there] != targets[again[there]]).any():  # keys agree by accident
        return np.arange(len(inputs)), np.arange(len(inputs))
    return some, which


def _exp(z: np.ndarray) -> None:
    """exp in place, of 60 at most, so that sums stay finite."""
    if z.size and z.max() > 60:
        np.minimum(z, 60, out=z)
    np.exp(z, out=z)


def _keep_heap() -> None:
    """Has the C library reuse the memory of large arrays, which would otherwise be mapped anew for each."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 30)
        libc.mallopt(-1, 1 << 28)
    except OSError:  # another C library
        pass


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of many rows, in stretches for which the library has a faster way."""
    k = len(a) // TILE
    n = k * TILE
    return (a[:n].reshape(k, TILE, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(k, TILE, b.shape[1])).sum(axis=0) + a[n:].T @ b[n:]


def _ones(n: int) -> np.ndarray:
    return np.ones((n, 1), np.float32)


class Model:
    """One causal attention layer and one feed-forward layer over units, a softmax over symbols and one over the leaves of each tail symbol."""

    def __init__(self, symbols: Symbols, flat: np.ndarray | None = None, seed: int = 5) -> None:
        d, h, s, share = WIDTH, HIDDEN, symbols.symbols, symbols.share
        self.symbols, self.begin = symbols, symbols.units
        self.shapes = {"E": (symbols.units + 2, d), "P": (W, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "A": (d, h), "a": (h,), "B": (h, d), "U": (d, s), "c": (s,), "L": (len(share), d, share.shape[1]), "l": share.shape}
        sizes = [int(np.prod(x)) for x in self.shapes.values()]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([np.zeros(n) if len(x) == 1 or k in "Ll" else rng.normal(0, 0.1 if k in "EP" else x[0] ** -0.5, n) for (k, x), n in zip(self.shapes.items(), sizes)])
        self.flat = flat.astype(np.float32)
        self.w = {k: part.reshape(x) for (k, x), part in zip(self.shapes.items(), np.split(self.flat, np.cumsum(sizes)[:-1]))}

    def state(self, inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        """What each place of the block knows (the last array), and the arrays on the way to it."""
        w, n = self.w, len(inputs)
        x = w["E"].take(inputs, axis=0)
        x += w["P"]
        xq = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, WIDTH)
        # queries and keys occur as one product, values and what is made of them as another, so that attention reads the inputs themselves
        qk, vo = w["Q"] @ w["K"].T * np.float32(WIDTH**-0.5), w["V"] @ w["O"]
        q = (xq @ qk).reshape(n, STRIDE, WIDTH)
        xt = np.ascontiguousarray(x.transpose(0, 2, 1))
        s = q @ xt
        _exp(s)  # without taking the maximum off: a place sees itself, so no row is all masked
        s *= _CAUSAL
        some = np.flatnonzero(inputs[:, 0] == self.begin + 1)
        if len(some):
            s[some] *= (inputs[some] != self.begin + 1)[:, None, :]
        mass = s.reshape(-1, W) @ _ones(W)
        mass += np.float32(1e-30)
        r = (s @ x).reshape(-1, WIDTH)
        r /= mass
        h = r @ vo
        h += xq
        u = h @ w["A"]
        u += w["a"]
        up = u > 0
        u *= up
        m = u @ w["B"]
        m += h
        return x, xt, xq, qk, vo, q, s, mass, r, h, up, u, m

    def outputs(self, m: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places that have a target, what is known there (with a 1 at its end, for the biases), the target's symbol, those that are tail
        symbols (by symbol), their leaves, and where each tail symbol ends among them."""
        goal = targets.ravel()
        there = np.flatnonzero(goal < self.begin)
        known = np.ones((len(there), WIDTH + 1), np.float32)
        known[:, :-1] = m if len(there) == len(m) else m[there]
        goal = goal[there]
        own, leaves = self.symbols.own, self.symbols.share.shape[1]
        tail = np.flatnonzero(goal >= own)
        tail = tail[np.argsort(goal[tail], kind="stable")]
        inner = goal[tail] - own
        symbol = goal.astype(np.int64)
        symbol[tail] = own + inner // leaves
        ends = np.searchsorted(inner, np.arange(1, len(self.symbols.share) + 1) * leaves)
        return there, known, symbol, tail, inner % leaves, ends

    def leaves(self, known: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of the leaves of each place's tail symbol."""
        w, begin = self.w, 0
        y = np.empty((len(known), self.symbols.share.shape[1]), np.float32)
        weights = np.concatenate((w["L"], (w["l"] + self.symbols.share)[:, None]), axis=1)
        for i, end in enumerate(ends.tolist()):
            if begin < end:
                np.matmul(known[begin:end], weights[i], out=y[begin:end])
            begin = end
        return y

    def loss_and_slope(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log-probability of the target units, and its gradient, flat."""
        w = self.w
        x, xt, xq, qk, vo, q, s, mass, r, h, up, u, m = self.state(inputs)
        there, known, symbol, tail, leaf, ends = self.outputs(m, targets)
        n = max(len(there), 1)
        out, ut = np.concatenate((w["U"], w["c"][None])), np.ascontiguousarray(w["U"].T)
        rows = np.arange(len(there))
        z = known @ out
        loss = -float(z[rows, symbol].sum())
        _exp(z)
        total = z @ _ones(z.shape[1])  # by which narrow arrays are divided and not z
        loss += float(np.log(total).sum())
        z[rows, symbol] -= total[:, 0]
        over = 1 / (total * np.float32(n))
        dmt = z @ ut
        dmt *= over
        slope = _products(known * over, z)
        g = {"U": slope[:-1], "c": slope[-1], "L": np.zeros_like(w["L"]), "l": np.zeros_like(w["l"])}
        if len(tail):
            own = known[tail]
            y = self.leaves(own, ends)
            inner = np.arange(len(tail))
            hit = y[inner, leaf]
            _exp(y)
            total = y @ _ones(y.shape[1])
            loss += float(np.log(total).sum()) - float(hit.sum())
            y *= 1 / (total * np.float32(n))
            y[inner, leaf] -= np.float32(1 / n)
            back, begin = np.empty((len(tail), WIDTH), np.float32), 0
            for i, end in enumerate(ends.tolist()):
                if begin < end:
                    slope = own[begin:end].T @ y[begin:end]
                    g["L"][i], g["l"][i] = slope[:-1], slope[-1]
                    np.matmul(y[begin:end], w["L"][i].T, out=back[begin:end])
                begin = end
            dmt[tail] += back
        if len(there) == len(m):
            dm = dmt
        else:
            dm = np.zeros_like(m)
            dm[there] = dmt
        b = len(inputs)
        g["B"] = _products(u, dm)
        du = dm @ w["B"].T
        du *= up
        g["A"], g["a"] = _products(h, du), (_ones(len(du)).T @ du)[0]
        dh = du @ w["A"].T
        dh += dm
        slope = _products(r, dh)
        g["V"], g["O"] = slope @ w["O"].T, w["V"].T @ slope
        # s is not normalised: with y = s x / mass, ds = s (dr x' - dr y) / mass
        dr = dh @ vo.T
        dr /= mass
        inner = (dr * r) @ _ones(WIDTH)
        dr3 = dr.reshape(b, STRIDE, WIDTH)
        ds = dr3 @ xt
        ds -= inner.reshape(b, STRIDE, 1)
        ds *= s
        dx = s.transpose(0, 2, 1) @ dr3
        dx += ds.transpose(0, 2, 1) @ q
        dq = (ds @ x).reshape(-1, WIDTH)
        slope = _products(xq, dq) * np.float32(WIDTH**-0.5)
        g["Q"], g["K"] = slope @ w["K"], slope.T @ w["Q"]
        dh += dq @ qk.T
        dx[:, CONTEXT:] += dh.reshape(b, STRIDE, WIDTH)
        g["P"] = dx.sum(0)
        flat_in = inputs.ravel()
        order = np.argsort(flat_in, kind="stable")
        sorted_ = flat_in[order]
        edge = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        g["E"] = np.zeros_like(w["E"])
        g["E"][sorted_[edge]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), edge, axis=0)
        return loss / n, np.concatenate([g[key].ravel() for key in self.shapes])

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The log-probability of each target unit, row by row without those that are none."""
        m = self.state(inputs)[-1]
        there, known, symbol, tail, leaf, ends = self.outputs(m, targets)
        z = known @ np.concatenate((self.w["U"], self.w["c"][None]))
        out = z[np.arange(len(there)), symbol]
        _exp(z)
        out -= np.log(z @ _ones(z.shape[1]))[:, 0]
        if len(tail):
            y = self.leaves(known[tail], ends)
            hit = y[np.arange(len(tail)), leaf]
            _exp(y)
            out[tail] += hit - np.log(y @ _ones(y.shape[1]))[:, 0]
        return out

    def train(self, inputs: np.ndarray, targets: np.ndarray, rate: float = RATE, batch: int = BATCH) -> float:
        """One pass by Adam over windows; the mean loss on the way."""
        first, second, losses = np.zeros_like(self.flat), np.zeros_like(self.flat), []
        steps = range(0, len(inputs), batch)
        for i, a in enumerate(steps, 1):
            loss, slope = self.loss_and_slope(inputs[a : a + batch], targets[a : a + batch])
            first += np.float32(0.1) * (slope - first)
            slope *= slope
            second += np.float32(0.01) * (slope - second)
            step = rate * (1 - (i - 1) / len(steps)) / (1 - 0.9**i)
            np.divide(second, np.float32(1 - 0.99**i), out=slope)
            np.sqrt(slope, out=slope)
            slope += np.float32(1e-8)
            np.divide(first, slope, out=slope)
            slope *= np.float32(step)
            self.flat -= slope
            losses.append(loss)
        return float(np.mean(losses)) if losses else 0.0


def _gather(path: str):
    """Rows (doc, row, piece, tokens, ids, counts): every document's ids in pieces, and counts of all ids.

    ``row`` numbers the rows of a task; ``tokens`` has ``LEAD`` ids before those of the piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {"doc": pa.int64(), "row": pa.int64(), "piece": pa.int32(), "tokens": pa.binary(), "ids": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}
        small, size, encode = narrow(path), size_of(path), encoder(path).encode_to_numpy
        total, seen, none = np.zeros(size + 2, np.int64), 0, np.empty(0, np.uint32)
        lead = np.array([size + 1] * CONTEXT + [size], np.uint32)

        def rows_of(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, kind) for k, kind in fields.items()], list(fields))

        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                chunk = batch.slice(begin, 128)
                each = [encode(t, allowed_special=set(), disallowed_special=()) if t else none for t in chunk.column(1).to_pylist()]
                # a lead for each row, so that a piece and its own is one stretch
                led = np.concatenate([x for ids in each for x in (lead, ids)]).astype(small)
                total += np.bincount(led, minlength=size + 2)
                sizes = np.array([len(x) for x in each], np.int64)
                start = np.cumsum(sizes + LEAD) - sizes - LEAD
                parts = np.maximum(-(-sizes // PIECE), 1)
                row = np.repeat(np.arange(len(chunk)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                a = start[row] + PIECE * piece
                b = np.minimum(a + LEAD + PIECE, (start + LEAD + sizes)[row])
                if (parts == 1).all():
                    ends, flat = np.append(a, len(led)), led
                else:
                    ends, flat = np.concatenate(([0], np.cumsum(b - a))), ragged(led, a, b - a)
                if int(ends[-1]) * small().itemsize >= 1 << 31:
                    raise ValueError("a text of more than 2 GB of ids")
                packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((ends * small().itemsize).astype(np.int32)), pa.py_buffer(flat)])
                yield rows_of(len(row), doc=chunk.column(0).take(pa.array(row)), row=pa.array(row + seen), piece=pa.array(piece.astype(np.int32)), tokens=packed)
                seen += len(chunk)
        used = np.flatnonzero(total[:size])
        yield rows_of(1, ids=pa.array([used.tolist()], fields["ids"]), counts=pa.array([total[used].tolist()], fields["counts"]))

    return run


def units_of(tokens: pa.Array, kind: type, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of pieces end to end, where each starts (n + 1 of them), and the log-probability of each id within its unit."""
    tokens = tokens.cast(pa.large_binary())
    _, offsets, data = tokens.buffers()
    at = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind)
    return symbols.of[ids], (at - at[0]) // np.dtype(kind).itemsize, symbols.rest[ids]


def _replica(symbols: Symbols, flat: np.ndarray, kind: type, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, targets = [np.empty((0, W), symbols.of.dtype)], [np.empty((0, STRIDE), symbols.of.dtype)]
        for batch in batches:
            if batch.num_rows:
                units, first, _ = units_of(batch.column(0), kind, symbols)
                _, x, y = windows(units, first, symbols.units + 1)
                inputs.append(x)
                targets.append(y)
        x, y = np.concatenate(inputs), np.concatenate(targets)
        if not len(x):
            return
        number_ = TaskContext.get().partitionId()
        _keep_heap()
        order = np.random.default_rng([round_, number_]).permutation(len(x))
        model = Model(symbols, flat.copy())
        loss = model.train(x[order], y[order])
        yield _row(model.flat, len(x), loss, number_)

    return run


def _row(flat: np.ndarray, weight: float, loss: float, key: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.astype(np.float32).tobytes()]), pa.array([float(weight)]), pa.array([float(loss)]), pa.array([int(key)])], ["flat", "weight", "loss", "key"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["key"])
    total = sum(r["weight"] for r in rows)
    if total:
        yield _row(sum(np.frombuffer(r["flat"], np.float32).astype(float) * (r["weight"] / total) for r in rows), total, sum(r["loss"] * r["weight"] / total for r in rows), rows[0]["key"])


def gather(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """What one pass over the texts leaves in the checkpoint folder: ids of all documents, and counts."""
    keyed = docs.where(col(text).isNotNull()).select(number(docs, doc_id).alias("doc"), col(text).alias("t"))
    return cut(keyed.mapInArrow(_gather(path), "doc long, row long, piece int, tokens binary, ids array<int>, counts array<bigint>"))


def deal(gathered: DataFrame, path: str, round_: int, rounds: int, parts: int) -> DataFrame:
    """The pieces that a round trains on, one partition a replica. Copies of a text have ids of their own, so they are spread over both."""
    some = gathered.where(F.length("tokens") > LEAD * np.dtype(narrow(path)).itemsize).withColumn("key", F.xxhash64("doc", "piece", "tokens"))
    share = some.where(F.pmod("key", F.lit(rounds)) == round_).select("key", "tokens")
    return share.repartition(parts, F.xxhash64("key", F.lit(round_))).sortWithinPartitions("key").select("tokens")


def fit(gathered: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, replica: int = REPLICA) -> tuple[Symbols, np.ndarray, list[float]]:
    """The symbols, the trained parameters, and the mean training loss of each round, from what ``gather`` left."""
    pairs = gathered.where("ids is not null").select(F.explode(F.arrays_zip("ids", "counts")).alias("p")).groupBy("p.ids").agg(F.sum("p.counts").alias("n")).collect()  # as many as the vocabulary has
    counts = np.zeros(size_of(path), np.int64)
    for i, n in pairs:
        counts[i] = n
    symbols = Symbols.fit(counts)
    flat, losses = Model(symbols).flat, []
    kind = "flat binary, weight double, loss double, key long"
    parts = max(1, round(int(counts.sum()) / (STRIDE * rounds * replica)))
    for round_ in range(rounds):
        level, left = deal(gathered, path, round_, rounds, parts).mapInArrow(_replica(symbols, flat, narrow(path), round_), kind), parts
        while left > 1:
            left = -(-left // FAN_IN)
            level = level.repartition(left, F.col("key") % left).mapInArrow(_average, kind)
        got = level.first()
        if got is None:
            continue
        flat = np.frombuffer(bytes(got["flat"]), np.float32).copy()
        losses.append(got["loss"])
    return symbols, flat, losses


def score(gathered: DataFrame, symbols: Symbols, flat: np.ndarray, path: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_tokens, log_prob, mean_nll, perplexity), one a document that ``gather`` saw."""
    kind = narrow(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_heap()
        model, held = Model(symbols, flat), []

        def rows(done: list[list]) -> pa.RecordBatch:
            doc, _, n, log_prob = zip(*done) if done else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(log_prob, pa.float64())], ["doc_id", "n_tokens", "log_prob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            units, first, rest = units_of(batch.column(2), kind, symbols)
            piece, inputs, targets = windows(units, first, symbols.units + 1)
            some, which = distinct(inputs, targets)  # texts repeat each other, and a window scores alike wherever it is
            found = [model.log_probabilities(inputs[k], targets[k]) for k in (some[a : a + BATCH] for a in range(0, len(some), BATCH))]
            there, each = targets < symbols.units, np.zeros((len(some), STRIDE), np.float32)
            each[there[some]] = np.concatenate([*found, np.empty(0, np.float32)])
            target = np.ones(len(units), bool)
            target[(first[:-1, None] + np.arange(LEAD)).ravel()] = False
            sums = np.concatenate(([0.0], np.cumsum(each[which][there].astype(float) + rest[target])))
            ends = first - LEAD * np.arange(len(first))
            for doc, row, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if held and held[-1][1] == row:  # a further piece of the same document
                    held[-1][2] += b - a
                    held[-1][3] += sums[b] - sums[a]
                else:
                    held.append([doc, row, b - a, sums[b] - sums[a]])
            if len(held) > 1:
                yield rows(held[:-1])
                held = held[-1:]
        yield rows(held)

    scored = gathered.where("tokens is not null").select("doc", "row", "tokens").mapInArrow(run, "doc_id long, n_tokens long, log_prob double")
    log_prob = F.round("log_prob", 3)  # what is left of floating point's order of summation
    return scored.withColumn("log_prob", log_prob).withColumn("mean_nll", F.when(F.col("n_tokens") > 0, -F.col("log_prob") / F.col("n_tokens"))).withColumn("perplexity", F.exp("mean_nll"))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, rounds: int = ROUNDS, replica: int = REPLICA) -> DataFrame:
    """Trains on the documents and scores each of them: one row (doc_id, n_tokens, log_prob, mean_nll, perplexity) a row of ``docs``.

    A null text has nulls; an empty one no tokens, log_prob 0 and no mean. Repeated
    rows score alike, as do equal texts under any ids, null ones included (log_prob to about a thousandth). A text of any length is
    trained on and scored whole, in pieces of ``PIECE`` tokens that know what came before (up to 2 GB of ids).
    An empty table gives an empty one; other columns are left aside.
    """
    gathered = gather(docs, doc_id, text, path)
    symbols, flat, _ = fit(gathered, path, rounds, replica)
    without = docs.where(col(text).isNull()).select(number(docs, doc_id).alias("doc_id"), *(F.lit(None).cast(kind).alias(c) for c, kind in (("n_tokens", "long"), ("log_prob", "double"), ("mean_nll", "double"), ("perplexity", "double"))))
    return score(gathered, symbols, flat, path).union(without)
