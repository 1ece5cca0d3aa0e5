"""Byte-pair encoding by a dynamic programme over prefixes, and decoding.

Of the encodings of a word's prefixes, the one that byte-pair merging produces is
fixed by its last token: it is the one token, among those that end there, that is
compatible with the last token of the prefix before it. An Aho-Corasick automaton
over the vocabulary, whose links go from suffix to suffix, gives the tokens that end at each byte, longest first; two
adjacent tokens are compatible if undoing their merges meets no earlier merge
across the border. One last token a prefix is stored and the back-pointers are
followed from the end. No merge is ever carried out on the text.

Equal pieces of text have equal ids, so a task encodes a distinct piece once and
keeps it; the results don't depend on what is kept. Two generations of up to ``CACHE``
pieces are kept: a full one takes the place of the one before it, from which pieces that come up again are taken
over. Words that begin with a space are pieces themselves; the others, which only parts of pieces are, have a table of their own.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import col, fresh

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual pre-tokenisation of byte-level vocabularies: merges never cross these pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000
#: Transitions of the automaton that are remembered besides those of its trie.
STEPS = 300_000
ROWS = 256
ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
beside_space = re.compile(r" \s|\s ").search


def odd_space(text: str) -> bool:
    """Whether a text may hold white space other than spaces and line feeds."""
    return not text.isascii() or any(c in text for c in ODD_ASCII)


class Vocabulary:
    """Ranks of a byte-level vocabulary, and what the dynamic programme needs of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.compatible_pairs: dict[int, dict[int, bool]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif len(parts := self._merged(token, rank)) == 2:  # else merging never makes it; it can only be a whole piece
                self.halves[rank] = tuple(parts)
                self.joined[tuple(parts)] = rank
        self._build_automaton()
        self.forget()

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The token's bytes after all merges that come before its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` can stand side by side in a merged text."""
        halves, joined, limit = self.halves, self.joined, 1 << 60
        while True:
            if joined.get((left, right), limit) < limit:
                return False  # this merge came first, and would have taken both
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    limit, inner = left, halves[left][1]
                    if inner != left:
                        left = inner
                        break
                else:
                    limit, inner = right + 1, halves[right][0]
                    if inner != right:
                        right = inner
                        break
                undo_left = not undo_left
            else:
                return True

    def _build_automaton(self) -> None:
        """Trie of the tokens with suffix links: ``longest`` has each state's longest token that ends
        there, ``shorter`` a token's longest proper suffix that is a token."""
        step, fail, own = {}, [0], [-1]
        for rank in self.halves:
            state = 0
            for byte in self.bytes_of[rank]:
                to = step.get(key := state << 8 | byte)
                if to is None:
                    to = step[key] = len(own)
                    own.append(-1)
                    fail.append(0)
                state = to
            own[state] = rank
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in step.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        longest, shorter, level = own[:], {}, [0]
        while level:
            below = []
            for state in level:
                for byte, to in children.get(state, ()):
                    below.append(to)
                    if state:
                        back = fail[state]
                        while back and back << 8 | byte not in step:
                            back = fail[back]
                        fail[to] = step.get(back << 8 | byte, 0)
                    if own[to] < 0:
                        longest[to] = longest[fail[to]]
                    else:
                        shorter[own[to]] = longest[fail[to]]
            level = below
        self.step, self.fail, self.longest = step, fail, longest
        self.most_steps = len(step) + STEPS
        size = max(self.halves) + 2  # the last one is for a byte without a token, which is an error
        self.shorter, self.length = ([of.get(rank, 0) for rank in range(size)] for of in (shorter, {rank: len(self.bytes_of[rank]) for rank in self.halves}))

    def _step(self, state: int, byte: int) -> int:
        back = state
        while back and back << 8 | byte not in self.step:
            back = self.fail[back]
        to = self.step.get(back << 8 | byte, 0)
        if len(self.step) < self.most_steps:
            self.step[state << 8 | byte] = to
        return to

    def forget(self) -> None:
        """Lets go of what was remembered of the texts, so that an idle worker holds the vocabulary only."""
        self.pieces: dict[str, bytes] = {}  # by what follows a space
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.compatible_pairs = {}

    def encode_word(self, word: bytes) -> bytes:
        whole = self.ranks.get(word)
        if whole is not None:
            return whole.to_bytes(4, "little")
        step, longest, shorter, length, pairs = self.step, self.longest, self.shorter, self.length, self.compatible_pairs
        last, state, end = [-1], 0, 0
        for byte in word:
            end += 1
            to = step.get(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            token = longest[state]
            while start := end - length[token]:
                before = last[start]
                known = pairs.get(token)
                if known is None:
                    known = pairs[token] = {}
                fits = known.get(before)
                if fits is None:
                    fits = known[before] = self.compatible(before, token)
                if fits:
                    break
                token = shorter[token]
            last.append(token)
        ids = []
        while end:
            ids.append(last[end])
            end -= length[last[end]]
        ids.reverse()
        return array("i", ids).tobytes()

    def _keep(self, after: str, ids: bytes) -> bytes:
        if len(self.pieces) >= CACHE:
            self.older, self.pieces = self.pieces, {}
        self.pieces[after] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """The ids of a word that the pattern found."""
        if word[0] != " ":
            ids = self.plain.get(word)
            if ids is None:
                if len(self.plain) >= CACHE:
                    self.plain.clear()
                ids = self.plain[word] = self.encode_word(word.encode())
            return ids
        after = word[1:]
        ids = self.pieces.get(after)
        if ids is None:
            ids = self.older.get(after)
            ids = self._keep(after, self.encode_word(word.encode()) if ids is None else ids)
        return ids

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._word, self.find(piece)))

    def _after_space(self, after: str) -> bytes:
        """The ids of a space and what follows it up to the next; neither side of the space is white."""
        ids = self.pieces.get(after)  # it may have come up before in the same text
        if ids is None:
            ids = self.older.get(after)
            if ids is None:
                if after.isalpha() or len(words := self.find(" " + after)) == 1:  # letters are one word
                    ids = self.encode_word(b" " + after.encode())
                else:
                    ids = b"".join(map(self._word, words))
            self._keep(after, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as int32s.

        Where one space stands between two characters that aren't white space, a
        word begins with it whatever surrounds it, so the text is cut there first.
        A text with more white space around a space is handed to the pattern whole.
        """
        if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or (odd_space(text) and beside_space(text)):
            return self._piece(text)
        head, *rest = text.split(" ")
        got = list(map(self.pieces.get, rest))
        if None in got:
            got = [self._after_space(a) if x is None else x for a, x in zip(rest, got)]
        return b"".join((self._piece(head), *got))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str = PATTERN) -> Vocabulary:
    """The vocabulary in a tiktoken file (base64 token, rank), once a process."""
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text", keep: list[str] | None = None, verify: bool = False) -> DataFrame:
    """``keep`` columns (all but the text), with ``token_ids`` and ``n_tokens``.

    A null text has null ids and count, an empty one no ids and count 0. Repeated
    rows are encoded alike; a clashing input column is replaced. With ``verify``,
    ``round_trip`` says whether decoding the ids gives the text again (null for a
    null text). One pass, no exchange, so an empty table gives an empty one; a text of any length is one unit.
    Ids aren't looked at, and there are no ties: a text has one encoding.
    """
    new = ["token_ids", "n_tokens"] + ["round_trip"] * verify
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in new]
    source = docs.select(*map(col, keep), col(text).alias(fresh(docs, "text")[0] if text in keep else text))
    types = [f for f in docs.select(*map(col, keep)).schema.fields]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in types] + ["token_ids array<int>", "n_tokens int"] + ["round_trip boolean"] * verify)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                texts = batch.column(len(keep)).to_pylist()
                encoded = [None if t is None else vocab.encode(t) for t in texts]
                missing = np.array([t is None for t in texts])
                lengths = np.array([len(x or b"") // 4 for x in encoded], np.int32)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.frombuffer(b"".join(x or b"" for x in encoded), np.int32)
                marked = pa.array(offsets, mask=np.append(missing, False)) if missing.any() else pa.array(offsets)
                out = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(marked, pa.array(values)), pa.array(lengths, mask=missing)]
                if verify:
                    same = [None if t is None else vocab.decode(values[i:j]) == t.encode() for t, i, j in zip(texts, offsets, offsets[1:])]
                    out.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, [*keep, *new])
        vocab.forget()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """Adds the text of each row's ids as column ``out`` (null for null ids; an unknown id is an error)."""
    if out in encoded.columns:
        encoded = encoded.drop(out)

    @F.pandas_udf("string")
    def text_of(values):
        vocab = vocabulary(path)
        return values.map(lambda x: None if x is None else vocab.decode(np.asarray(x)).decode("utf-8", "replace"))

    return encoded.withColumn(out, text_of(col(ids)))
