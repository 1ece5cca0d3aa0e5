"""Substring dedup by recompression.

The words of a document are its first symbols. A round names each run of equal
symbols, then each pair of neighbours whose left one is on the "left" side and whose
right one is on the "right" side of that round's partition of all symbols. A name is
a function of its parts (a 64-bit hash of them) and a side one of the symbol and the
round, so names are global: equal passages get equal symbols in every document, but
for a few at their borders, and no dictionary has to be exchanged. A symbol that has
grown to ``grown`` words stands still: it is an *interior symbol* of that level.
The name of a run hangs on its length, so a run of that many words has anchors named
by its symbol alone as well: each copy of it in the first ``EDGE`` words, and from
there on one for each ``grown`` words. Runs of different lengths share these.

Spark counts the interior symbols over the corpus. Those in two documents or more
reveal repeats, which are verified and extended word by word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm.repeats import HOT, MIN_WORDS, Anchors, long_repeats
from factloom.llm.textkit import U, mix

GROWN, ROUNDS = 8, 24
EDGE = 100


def _round(symbols: np.ndarray, sizes: np.ndarray, starts: np.ndarray, rows: np.ndarray, number: int, grown: int, edge: int = EDGE) -> tuple[np.ndarray, ...]:
    """One round: runs of a symbol are named, then pairs across the partition. Last come the anchors within runs, and their names."""
    n = len(symbols)
    head = np.ones(n, bool)
    inner, names = starts[:0], symbols[:0]
    head[1:] = (symbols[1:] != symbols[:-1]) | (rows[1:] != rows[:-1]) | (sizes[1:] >= grown)
    if not head.all():
        at = np.flatnonzero(head)
        many = np.diff(np.append(at, n))
        run = np.cumsum(head) - 1
        copy, size = np.arange(n) - at[run], sizes[at][run]
        held = np.flatnonzero((many[run] > 1) & (many[run] * size >= grown) & ((copy * size < edge) | (copy % -(-grown // size) == 0)))
        inner, names = starts[held], mix(symbols[held] ^ U(0xE7037ED1A0B428DB))
        named = mix(symbols[at] * U(0xD6E8FEB86659FD93) + many.astype(U))
        symbols, starts, rows = np.where(many > 1, named, symbols[at]), starts[at], rows[at]
        sizes = np.add.reduceat(sizes, at)
        n = len(at)
    side = (mix(symbols ^ mix(np.full(1, number, U))) & U(1)).astype(bool)
    small = sizes < grown
    pair = np.zeros(n, bool)
    pair[:-1] = ~side[:-1] & side[1:] & small[:-1] & small[1:] & (rows[:-1] == rows[1:])
    left = np.flatnonzero(pair)
    keep = np.ones(n, bool)
    keep[left + 1] = False
    symbols, sizes = symbols.copy(), sizes.copy()
    symbols[left] = mix(mix(symbols[left]) * U(0xA0761D6478BD642F) + mix(symbols[left + 1] ^ U(0x589965CC75374CC3)))
    sizes[left] += sizes[left + 1]
    return symbols[keep], sizes[keep], starts[keep], rows[keep], inner, names


def interior_anchors(grown: int = GROWN, rounds: int = ROUNDS, edge: int = EDGE) -> Anchors:
    def choose(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(hashes)
        found = []
        state = (hashes, np.ones(n, np.int64), np.arange(n), np.repeat(np.arange(len(first) - 1), np.diff(first)))
        for number in range(1, rounds + 1):
            if not len(state[0]):
                break
            *state, at, names = _round(*state, number, grown, edge)
            found.append((at, names))
        symbols, sizes, starts, _ = state
        interior = sizes >= grown
        found.append((starts[interior], symbols[interior]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    return choose


def recompression_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, grown: int = GROWN, hot: int = HOT) -> DataFrame:
    """Stretches of ``min_words`` or more words that two documents share (see ``long_repeats``).

    ``grown`` is the length in words from which a symbol is interior. A text of fewer than ``min_words``
    words shares nothing; an empty table gives no rows. Repeated rows are one document, and a tie between partners goes to the least id.
    There is no proof that every passage of ``min_words`` holds an interior symbol whose making didn't look
    beyond it: symbols near a passage's ends may. Tests ask for 0.95 to 0.98 of all windows; on the given data all are found.
    """
    # the anchor itself is `grown` words of the stretch
    return long_repeats(docs, interior_anchors(grown, edge=max(EDGE, 2 * min_words)), left=max(1, min_words - grown), right=min_words, doc_id=doc_id, text=text, min_words=min_words, hot=hot)
