"""Column functions over token arrays: n-grams, windows, span accessors.

Positions are 0-based and character ends inclusive, as in the mention tables.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

SPACES = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: White space other than single spaces.
_UNEVEN = r"(?U)[\s&&[^ ]]|  "


def split_words(text: Column) -> Column:
    """What white space separates. A text of single spaces is cut at them without a pattern, which would be compiled for each text."""
    return F.when(text.rlike(_UNEVEN), F.split(strip(text), SPACES)).otherwise(F.split(F.trim(text), " "))


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 3, delim: str = " ", lower: bool = False) -> Column:
    """All n-grams by start, then by length; duplicates stay."""
    if n_min == n_max == 1:
        return F.coalesce(F.transform(tokens, lambda w: F.coalesce(F.lower(w) if lower else w, F.lit(""))), F.array().cast("array<string>"))
    words = F.transform(tokens, F.lower) if lower else tokens
    size = F.size(words)

    def at(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(n_min), F.least(F.lit(n_max), size - i)), lambda n: F.array_join(F.slice(words, i + 1, n), delim, ""))

    return F.when(size >= n_min, F.flatten(F.transform(F.sequence(F.lit(0), size - n_min), at))).otherwise(F.array().cast("array<string>"))


@F.arrow_udf(ArrayType(IntegerType()))
def _running(lengths: pa.Array) -> pa.Array:
    """Exclusive running sums of ``length + 1`` within each list, over a whole batch at once."""
    sizes = np.diff(lengths.offsets.to_numpy())
    step = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    sums = np.concatenate(([0], np.cumsum(step)))
    out = sums[:-1] - np.repeat(sums[ends - sizes], sizes)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    missing = lengths.is_null().to_numpy(zero_copy_only=False)
    marked = pa.array(offsets, mask=np.append(missing, False)) if missing.any() else pa.array(offsets)
    return pa.ListArray.from_arrays(marked, pa.array(out.astype(np.int32)))


def offsets(words: Column) -> Column:
    """Where each word starts in the text that single spaces join. Linear in the words: only their lengths go to an array kernel, and the sums back."""
    return _running(F.transform(words, F.length))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_to_word(char_offsets: Column, at: Column) -> Column:
    """The last word that starts at or before a character."""
    return F.size(F.filter(char_offsets, lambda o: o <= at)) - 1


def part(tokens: Column, first: Column, last: Column) -> Column:
    """Tokens from ``first`` to ``last``, both included, cut to the array; empty if there are none."""
    low = F.greatest(first, F.lit(0))
    high = F.least(last, F.size(tokens) - 1)
    return F.when(high >= low, F.slice(tokens, low + 1, high - low + 1)).otherwise(F.array().cast("array<string>"))


def left_ngrams(words: Column, word_start: Column, window: int = 3, n_min: int = 1, n_max: int = 1, lower: bool = True) -> Column:
    return ngrams(part(words, word_start - window, word_start - 1), n_min, n_max, lower=lower)


def right_ngrams(words: Column, word_end: Column, window: int | Column = 3, n_min: int = 1, n_max: int = 1, lower: bool = True) -> Column:
    return ngrams(part(words, word_end + 1, word_end + window), n_min, n_max, lower=lower)


def sentence_ngrams(words: Column, word_start: Column, word_end: Column, n_min: int = 1, n_max: int = 1, lower: bool = True, window: int = 100) -> Column:
    """What lies left, then right of a span in its sentence, ``window`` tokens either way."""
    return F.concat(left_ngrams(words, word_start, window, n_min, n_max, lower), right_ngrams(words, word_end, window, n_min, n_max, lower))


def between_ngrams(words: Column, a: tuple[Column, Column], b: tuple[Column, Column], n_min: int = 1, n_max: int = 1, lower: bool = True) -> Column:
    """N-grams after the earlier of two spans (word start, word end) of a sentence.

    The window is the distance of the starts less one, counted from the *end* of the
    earlier span, so it reaches into the later span if the earlier has several tokens.
    """
    distance = F.abs(a[0] - b[0])
    end = F.when(a[0] < b[0], a[1]).otherwise(b[1])
    return right_ngrams(words, end, distance - 1, n_min, n_max, lower)


def overlap(a: Column, b: Column) -> Column:
    """Whether two arrays have an element in common."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def is_superset(a: Column, b: Column) -> Column:
    """Whether ``a`` has every element of ``b``."""
    return F.size(F.array_except(b, a)) == 0


def mark(words: Column, word_start: Column, word_end: Column, index: int) -> Column:
    """The tokens with ``~~[[i`` and ``i]]~~`` around a span."""
    before, inside, after = part(words, F.lit(0), word_start - 1), part(words, word_start, word_end), part(words, word_end + 1, F.size(words))
    return F.concat(before, F.array(F.lit(f"~~[[{index}")), inside, F.array(F.lit(f"{index}]]~~")), after)


def mark_pair(words: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The tokens with both spans of one sentence marked; marks at one place stand in the order of their indices."""
    at = F.sequence(F.lit(0), F.size(words))

    def marks(i: Column) -> Column:
        put = [F.when(place == i, F.array(F.lit(text))).otherwise(F.array().cast("array<string>")) for place, text in ((a[0], "~~[[1"), (a[1] + 1, "1]]~~"), (b[0], "~~[[2"), (b[1] + 1, "2]]~~"))]
        return F.concat(*put, F.when(i < F.size(words), F.slice(words, i + 1, 1)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(at, marks))


def same_sentence(args: list[Column]) -> Column:
    """All arguments of a candidate are spans of one sentence."""
    first = args[0]["sent_pos"]
    hit = first.isNotNull()
    for a in args[1:]:
        hit = hit & (a["sent_pos"] == first)
    return F.coalesce(hit, F.lit(False))


def subspan(span: Column, start: int | None = None, stop: int | None = None) -> Column:
    """Part of a span by characters from its own start, as a struct of char_start and char_end (included) in the sentence.

    A negative ``stop`` counts from the span's end.
    """
    begin = span["char_start"] + (start or 0)
    end = span["char_end"] if stop is None else span["char_start"] + stop - 1 if stop >= 0 else span["char_end"] + stop
    return F.struct(begin.alias("char_start"), end.alias("char_end"))


def word_counter(sentence_words: list[Column]) -> Column:
    """The words of the sentences of a candidate's arguments, to be counted over candidates."""
    return F.concat(*sentence_words)


def scrub(text: Column) -> Column:
    """Without characters beyond ASCII."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def singular(name: str) -> str:
    """An attribute's name without the plural's ending."""
    return re.sub(r"e?s$", "", name)
