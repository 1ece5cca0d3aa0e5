"""Vectorised text kernels over Arrow string columns.

Texts are taken as the UTF-8 bytes that Arrow already holds: no Python string is
made. A *word* is a maximal run of bytes other than ASCII white space; a word,
line or k-gram is named by a 64-bit polynomial hash of its bytes, read off prefix
sums, so that the cost per byte is a few array operations however many words there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, BASE2 = U(0x9E3779B97F4A7C15 | 1), U(0xC2B2AE3D27D4EB4F | 1)
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20
#: Bytes of a single text that are hashed at once.
PART = 1 << 24
#: k-grams whose minimisers are chosen at once.
SPAN = 1 << 22
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
TOP = U(0xFFFFFFFFFFFFFFFF)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = _powers.get(int(base), (np.empty(0, U), np.empty(0, U)))
    if len(up) < n:
        size = max(n, 2 * len(up), 1 << 16)
        inverse = U(pow(int(base), -1, 1 << 64))
        one = np.ones(1, U)
        up, down = (np.cumprod(np.concatenate((one, np.full(size - 1, b, U))), dtype=U) for b in (base, inverse))
        if size <= 1 << 23:  # tables for giant documents are not kept
            _powers[int(base)] = up, down
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: U = BASE) -> np.ndarray:
    """The hash of values[start:end] for each pair."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] for each pair, end to end."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


@dataclass
class Chunk:
    """Consecutive rows of a batch: ``offsets[i]:offsets[i + 1]`` of ``data`` is the text of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Row ranges of about ``size`` bytes; a null text is an empty one that isn't valid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = ~column.is_null().to_numpy(zero_copy_only=False)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield Chunk(a, raw[at[a] : at[b]], at[a : b + 1] - at[a], valid[a:b])
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` within each row, and each row's first run (n + 1 of them)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[:1] = after[-1:] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of each row's first word (n + 1 of them)."""
    return spans(chunk.data, chunk.offsets, ~SPACE[chunk.data])


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word; the index of each row's first word.

    A giant text is taken in parts that end at white space, so that what is held at once is some
    ten bytes a word besides the text, not thirty a byte.
    """
    data = chunk.data
    if len(data) <= PART or len(chunk) > 1:
        starts, ends, first = words(chunk)
        return segment_hash(data, starts, ends), first
    found, a = [], 0
    while a < len(data):
        b = min(a + PART, len(data))
        while b < len(data) and not SPACE[data[b]]:  # to the end of the word
            gap = np.flatnonzero(SPACE[data[b : b + CHUNK]])
            b = b + int(gap[0]) if len(gap) else min(b + CHUNK, len(data))
        part = Chunk(0, data[a:b], np.array([0, b - a]), chunk.valid)
        starts, ends, _ = words(part)
        found.append(segment_hash(part.data, starts, ends))
        a = b
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])


def kgrams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position on, and whether they lie within one row."""
    n = len(hashes)
    at = np.arange(n)
    ok = at + k <= np.repeat(first[1:], np.diff(first))
    out = np.full(n, TOP, U)
    where = at[ok]
    if len(where):
        out[where] = segment_hash(hashes, where, where + k, BASE2)
    return out, ok


def minimisers(grams: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions that hold the least k-gram of some window of ``w`` consecutive k-grams of one row.

    The choice depends on the text inside the window only, so that a passage of
    k + w - 1 words has the same positions chosen wherever it stands.
    """
    n = len(grams)
    if n > SPAN:  # in parts that overlap by a window
        parts, row = [], np.repeat(np.arange(len(first) - 1), np.diff(first))
        for a in range(0, n - w + 1, SPAN - w):
            b = min(a + SPAN, n)
            rows = np.arange(row[a], row[b - 1] + 2)
            # a row's k-grams reach over the part's end; those that reach over its row's end are told by the row's real end
            parts.append(a + _minimisers(grams[a:b], np.repeat(first[rows[1:]] - a, np.diff(np.clip(first[rows], a, b))), k, w))
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    return _minimisers(grams, np.repeat(first[1:], np.diff(first)), k, w)


def _minimisers(grams: np.ndarray, row_end: np.ndarray, k: int, w: int) -> np.ndarray:
    """``minimisers`` of up to SPAN k-grams, given where the row of each ends."""
    n = len(grams)
    if n < w:
        return np.empty(0, np.int64)
    low = U((1 << 26) - 1)
    least = (grams & ~low) | np.arange(n, dtype=U)
    span = 1
    while span < w:
        step = min(span, w - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    at = np.arange(len(least))
    return np.unique((least[at + w + k - 1 <= row_end[: len(least)]] & low).astype(np.int64))
