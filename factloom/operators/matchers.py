"""Matchers: a predicate algebra over mentions, compiled to columns, and the longest-match rule.

A matcher's ``on(span)`` gives a boolean column for a span given by its accessors.
``apply`` filters mentions by it and then, for ``longest_match_only``, drops every
mention that lies within a matched one generated before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import spaces


@dataclass(frozen=True)
class Span:
    """Columns that a predicate may look at: the raw text, and the tokens of an attribute."""

    text: Column
    tokens: Callable[[str], Column]
    within: bool = False
    #: The tokens one by one, where it is known how many there are.
    items: Callable[[str], list[Column]] | None = None

    def value(self, attribute: str, sep: str = " ") -> Column:
        return self.text if attribute == "words" else F.array_join(self.tokens(attribute), sep, "")


def row_span() -> Span:
    return Span(F.col("span_text"), lambda a: F.col(a))


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern as Java's engine reads it: named groups, Unicode classes and case."""
    return ("(?iuU)" if ignore_case else "(?U)") + re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))


class Matcher:
    longest_match_only = True

    def on(self, span: Span) -> Column:
        raise NotImplementedError

    def __or__(self, other: Matcher) -> Matcher:
        return Union(self, other)

    def __and__(self, other: Matcher) -> Matcher:
        return Intersect(self, other)

    def __invert__(self) -> Matcher:
        return Inverse(self)

    def tables(self) -> list[DictionaryMatch]:
        """The dictionary tables that this matcher asks."""
        return []

    def apply(self, mentions: DataFrame, by: tuple[str, ...] = ("doc_id", "sent_pos")) -> DataFrame:
        flagged = mentions
        for d in self.tables():
            flagged = d.flag(flagged)
        kept = flagged.where(F.coalesce(self.on(row_span()), F.lit(False))).select(*mentions.columns)
        return longest(kept, by) if self.longest_match_only else kept


def ngrams(matcher: Matcher, sentences: DataFrame, n_min: int = 1, n_max: int = 5, attributes: tuple[str, ...] = ("words",), joined: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The sentences' token n-grams that match: ``matcher.apply(ngram_mentions(...))``, in one pass without an exchange.

    Only a longer n-gram can hold a span, so for the longest-match rule the few that start up to ``n_max`` words
    before are asked as well. Spans that don't match are never made.
    """
    if matcher.tables():
        return matcher.apply(spaces.ngram_mentions(sentences, n_min, n_max, attributes=attributes, joined=joined, carry=carry))
    return spaces.ngram_rows(sentences, [_wanted(matcher, n_max, joined)], n_min, n_max, attributes, joined, carry)


def ngrams_each(found_by: list[Matcher], sentences: DataFrame, n_min: int = 1, n_max: int = 5, attributes: tuple[str, ...] = ("words",), joined: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The n-grams that any of several matchers (without dictionary tables) finds, from one pass over the sentences.

    Column ``which`` has the bit 1 << k for the k-th matcher; ``candidates.index_each`` takes them apart.
    """
    if any(m.tables() for m in found_by):
        raise TypeError("a dictionary table is asked by ngrams, one matcher at a time")
    return spaces.ngram_rows(sentences, [_wanted(m, n_max, joined) for m in found_by], n_min, n_max, attributes, joined, carry, which=True)


def _wanted(matcher: Matcher, n_max: int, joined: bool) -> Callable[[Column, int, Column], Column]:
    """Whether the matcher takes an n-gram of ``spaces.ngram_rows``."""
    size = F.size("_c_words")
    stored = lambda a: f"_c_{a}" if a in ("words", "char_offsets") else f"_a_{a}"

    def hit(at: Column, n: int, text: Column, back: int = 0) -> Column:
        """Whether the n-gram that starts ``back`` words before the place matches."""
        first = at - back if back else at
        items = lambda a: [F.get(stored(a), first + k if k else first) for k in range(n)]
        return F.coalesce(matcher.on(Span(text, lambda a: F.array(*items(a)), items=items)), F.lit(False))

    def wanted(at: Column, n: int, text: Column) -> Column:
        ok = hit(at, n, text)
        for m in range(n + 1, n_max + 1) if matcher.longest_match_only else ():
            for back in range(m - n + 1):
                longer = spaces.ngram_text(at, m, joined, back)
                there = at - back + m <= size if back else at + m <= size
                there = there & (at >= back) if back else there
                ok = ok & ~(there & hit(at, m, longer, back) & (longer != ""))
        return ok

    return wanted


def longest(mentions: DataFrame, by: tuple[str, ...] = ("doc_id", "sent_pos"), ngrams_only: bool = True) -> DataFrame:
    """Drops mentions inside a matched mention that was generated before.

    Token n-grams are generated long ones first, so whatever contains a span comes
    before it and one window finds the furthest end among the spans that start no
    later. With pieces or expansions (``ngrams_only=False``) an anti-join on the
    order of generation is needed.
    """
    if ngrams_only:
        before = Window.partitionBy(*by).orderBy("char_start", F.desc("char_end")).rowsBetween(Window.unboundedPreceding, -1)
        return mentions.withColumn("reach", F.max("char_end").over(before)).where("reach is null or reach < char_end").drop("reach")
    a, b = mentions.alias("a"), mentions.select(*by, "ord", "char_start", "char_end").alias("b")
    inside = (F.col("b.ord") < F.col("a.ord")) & (F.col("b.char_start") <= F.col("a.char_start")) & (F.col("b.char_end") >= F.col("a.char_end"))
    for c in by:
        inside = inside & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, inside, "left_anti")


class DictionaryMatch(Matcher):
    """The span's value is in a dictionary: a list of words, or a one-column DataFrame joined by equality.

    Combined with other matchers, a table gives each mention a flag first; inside ``Concat``, whose parts are no
    mentions of their own, only lists will do.
    """

    def __init__(self, d: list[str] | DataFrame, ignore_case: bool = True, attrib: str = "words", inverse: bool = False, stemmer: Callable[[Column], Column] | None = None, longest_match_only: bool = True) -> None:
        self.d, self.ignore_case, self.attrib, self.inverse, self.stemmer, self.longest_match_only = d, ignore_case, attrib, inverse, stemmer, longest_match_only

    def _norm(self, x: Column) -> Column:
        x = F.lower(x) if self.ignore_case else x
        return self.stemmer(x) if self.stemmer else x

    def tables(self) -> list[DictionaryMatch]:
        return [self] if isinstance(self.d, DataFrame) else []

    def _entries(self) -> DataFrame:
        return self.d.select(self._norm(F.col(self.d.columns[0])).alias("_entry")).where("_entry is not null").distinct()

    def flag(self, mentions: DataFrame) -> DataFrame:
        name = f"_in_{id(self)}"
        value = self._norm(row_span().value(self.attrib))
        return mentions.withColumn("_entry", value).join(self._entries().withColumn(name, F.lit(True)), "_entry", "left").drop("_entry")

    def on(self, span: Span) -> Column:
        if isinstance(self.d, DataFrame):
            if span.within:
                raise TypeError("a dictionary table can't be asked about part of a mention")
            hit = F.coalesce(F.col(f"_in_{id(self)}"), F.lit(False))
        else:
            hit = self._norm(span.value(self.attrib)).isin([]) if not self.d else F.array_contains(F.array(*(self._norm(F.lit(w)) for w in self.d)), self._norm(span.value(self.attrib)))
        return ~F.coalesce(hit, F.lit(False)) if self.inverse else hit

    def apply(self, mentions: DataFrame, by: tuple[str, ...] = ("doc_id", "sent_pos")) -> DataFrame:
        if not isinstance(self.d, DataFrame):
            return super().apply(mentions, by)
        how = "left_anti" if self.inverse else "left_semi"
        value = row_span().value(self.attrib)
        kept = mentions.withColumn("_entry", self._norm(value)).join(self._entries(), "_entry", how).select(*mentions.columns)
        return longest(kept, by) if self.longest_match_only else kept


class LambdaFunctionMatcher(Matcher):
    """A predicate of one's own: a function from a ``Span`` to a boolean column."""

    def __init__(self, func: Callable[[Span], Column], longest_match_only: bool = False) -> None:
        self.func, self.longest_match_only = func, longest_match_only

    def on(self, span: Span) -> Column:
        return self.func(span)


class _Composed(Matcher):
    def __init__(self, *children: Matcher, longest_match_only: bool = True) -> None:
        self.children, self.longest_match_only = children, longest_match_only

    def tables(self) -> list[DictionaryMatch]:
        return [t for c in self.children for t in c.tables()]

    def _each(self, span: Span) -> list[Column]:
        return [F.coalesce(c.on(span), F.lit(False)) for c in self.children]


class Union(_Composed):
    def on(self, span: Span) -> Column:
        out = F.lit(False)
        for c in self._each(span):
            out = out | c
        return out


class Intersect(_Composed):
    def on(self, span: Span) -> Column:
        out = F.lit(True)
        for c in self._each(span):
            out = out & c
        return out


class Inverse(_Composed):
    def __init__(self, child: Matcher, longest_match_only: bool = True) -> None:
        super().__init__(child, longest_match_only=longest_match_only)

    def on(self, span: Span) -> Column:
        return ~self._each(span)[0]


class Concat(_Composed):
    """A word boundary at which one child matches what is left and the other what is right of it.

    The left part loses as many characters as the separator has, even if there is
    none to lose.
    """

    def __init__(self, left: Matcher, right: Matcher, permutations: bool = False, left_required: bool = True, right_required: bool = True, ignore_sep: bool = True, sep: str = " ", longest_match_only: bool = True) -> None:
        super().__init__(left, right, longest_match_only=longest_match_only)
        self.permutations, self.left_required, self.right_required, self.ignore_sep, self.sep = permutations, left_required, right_required, ignore_sep, sep

    def on(self, span: Span) -> Column:
        left, right = self.children
        hit = F.lit(False)
        if not self.left_required:
            hit = hit | F.coalesce(right.on(span), F.lit(False))
        if not self.right_required:
            hit = hit | F.coalesce(left.on(span), F.lit(False))
        if span.items is not None:
            return self._unrolled(span, hit)
        words = span.tokens("words")

        def at(w: Column) -> Column:
            cut = F.length(F.array_join(F.slice(words, F.lit(1), w), " ")) + 1  # characters before the right part
            first = Span(F.substring(span.text, F.lit(1), cut - len(self.sep)), lambda a: F.slice(span.tokens(a), F.lit(1), w), True)
            second = Span(F.substring(span.text, cut + 1, F.length(span.text)), lambda a: F.slice(span.tokens(a), w + 1, F.size(words)), True)
            return self._parts(span, cut, first, second)

        inner = F.when(F.size(words) > 1, F.exists(F.sequence(F.lit(1), F.size(words) - 1), at)).otherwise(False)
        return hit | inner

    def _parts(self, span: Span, cut: Column, first: Span, second: Span) -> Column:
        left, right = self.children
        ok = F.coalesce(left.on(first) & right.on(second), F.lit(False))
        if self.permutations:
            ok = ok | F.coalesce(right.on(first) & left.on(second), F.lit(False))
        return ok if self.ignore_sep else ok & (F.substring(span.text, cut, F.lit(1)) == self.sep)

    def _unrolled(self, span: Span, hit: Column) -> Column:
        """Every boundary of a span whose number of tokens is known, without a function over arrays."""
        words = span.items("words")
        for w in range(1, len(words)):
            cut = F.length(F.concat_ws(" ", *words[:w])) + 1
            side = lambda low, high: {"tokens": lambda a: F.array(*span.items(a)[low:high]), "items": lambda a: span.items(a)[low:high]}
            first = Span(F.substring(span.text, F.lit(1), cut - len(self.sep)), within=True, **side(0, w))
            second = Span(F.substring(span.text, cut + 1, F.length(span.text)), within=True, **side(w, len(words)))
            hit = hit | self._parts(span, cut, first, second)
        return hit


class RegexMatchSpan(Matcher):
    """The whole span matches: from its start (or anywhere, for ``search``), to its end for ``full_match``."""

    def __init__(self, rgx: str, ignore_case: bool = True, attrib: str = "words", sep: str = "", search: bool = False, full_match: bool = True, longest_match_only: bool = True) -> None:
        self.attrib, self.sep, self.longest_match_only = attrib, sep, longest_match_only
        whole = rgx if rgx.endswith("$") or not full_match else f"({rgx})$"
        self.rgx = java_regex(whole if search else f"^(?:{whole})", ignore_case)

    def on(self, span: Span) -> Column:
        value = F.replace(span.text, F.lit(self.sep), F.lit("")) if self.attrib == "words" and self.sep else span.value(self.attrib, self.sep)
        return value.rlike(self.rgx)


#: What could let a token's pattern run over into the next token, or refers to places.
_OPEN_PATTERN = re.compile(r"\.|\[\^|\\[^dws]|[$^]|\(\?")
_MARK = "\u0001"


class RegexMatchEach(Matcher):
    """Every token matches; no tokens, no match.

    A pattern of literals, plain classes and repeats is matched once over the joined
    tokens; any other is matched token by token, which is several times slower.
    """

    def __init__(self, rgx: str, ignore_case: bool = True, attrib: str = "words", full_match: bool = True, longest_match_only: bool = True) -> None:
        self.attrib, self.longest_match_only = attrib, longest_match_only
        self.rgx = java_regex("^(?:" + (rgx if rgx.endswith("$") or not full_match else f"({rgx})$") + ")", ignore_case)
        closed = full_match and not _OPEN_PATTERN.search(rgx)
        self.joined = java_regex(f"^(?:{rgx})(?:{_MARK}(?:{rgx}))*$", ignore_case) if closed else None

    def on(self, span: Span) -> Column:
        if span.items is not None:
            each = [F.coalesce(t, F.lit("")) if self.joined is not None else t for t in span.items(self.attrib)]
            return reduce(lambda x, y: x & y, [t.rlike(self.rgx) for t in each])
        tokens = span.tokens(self.attrib)
        if self.joined is not None:
            return (F.size(tokens) > 0) & F.array_join(tokens, _MARK, "").rlike(self.joined)
        return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(self.rgx))


def _tagged(rgx: str) -> Callable[..., RegexMatchEach]:
    return lambda **options: RegexMatchEach(rgx, attrib="ner_tags", **options)


PersonMatcher, LocationMatcher, OrganizationMatcher = _tagged("PERSON"), _tagged("GPE|LOC"), _tagged("NORG|ORG")
DateMatcher, NumberMatcher, MiscMatcher = _tagged("DATE"), _tagged("CARDINAL|QUANTITY"), _tagged("MISC")


class LambdaFunctionFigureMatcher(Matcher):
    """A predicate on figure mentions: a function of their columns."""

    longest_match_only = False

    def __init__(self, func: Callable[[], Column]) -> None:
        self.func = func

    def apply(self, mentions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        return mentions.where(F.coalesce(self.func(), F.lit(False)))


class DoNothingMatcher(Matcher):
    def __init__(self, longest_match_only: bool = True) -> None:
        self.longest_match_only = longest_match_only

    def on(self, span: Span) -> Column:
        return F.lit(True)
