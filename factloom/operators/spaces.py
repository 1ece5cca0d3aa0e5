"""Mention spaces: from context tables to rows of possible mentions.

A span mention has doc_id, sent_pos, ord (its place in the order of generation, which
the longest-match rule depends on), char_start, char_end (included), word_start,
word_end, span_text and the tokens of every attribute asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.tokens import char_to_word


def ngram_rows(sentences: DataFrame, wanted: list[Callable[[Column, int, Column], Column | None]], n_min: int, n_max: int, attributes: tuple[str, ...] = ("words",), joined: bool = False, carry: tuple[str, ...] = (), which: bool = False) -> DataFrame:
    """The n-grams of which one of ``wanted`` says, by the place of their first word, their length and text, that it wants them (None: all).

    A column ``which``, if asked for, has a bit for each of ``wanted``.

    Words are exploded, then lengths, and a span's columns are read from the sentence's arrays (``_c_words`` and so on, ``_a_``
    before an attribute's name). There is no function over arrays in it, so all of it is one compiled loop that copies no array:
    the work is linear in the n-grams. ``joined`` says that the text is its words with single spaces between, so that a span
    needn't be sought in it.
    """
    own = [a for a in attributes if a not in ("words", "char_offsets")]
    kept = dict.fromkeys(["doc_id", "sent_pos", *carry, "words", "char_offsets", *([] if joined else ["text"])])
    # outer, so that no test of the array's size is made below, which would cut the text again
    words = sentences.select(*(F.col(c).alias(f"_c_{c}") for c in kept), *(F.col(a).alias(f"_a_{a}") for a in own), F.posexplode_outer("words").alias("_i", "_w")).where("_i is not null")
    i, n = F.col("_i"), F.col("_n")

    def span(size: int) -> Column:
        text = ngram_text(i, size, joined)
        fits = [] if size == 1 else [i + size <= F.size("_c_words")]
        wishes = [w(i, size, text) for w in wanted]
        kept = [*fits, *([] if any(w is None for w in wishes) else [reduce(lambda x, y: x | y, wishes)])]
        bits = [reduce(lambda x, y: x + y, (F.when(w, 1 << k).otherwise(0) for k, w in enumerate(wishes))).alias("which")] if which else []
        body = F.struct(F.lit(size).alias("_n"), text.alias("_text"), *bits)
        return F.when(reduce(lambda x, y: x & y, kept), body) if kept else body

    rows = words.select("*", F.inline(F.array(*map(span, range(n_max, n_min - 1, -1))))).where("_text <> ''")
    start = F.get("_c_char_offsets", i)
    end = F.get("_c_char_offsets", i + n - 1) + F.length(F.get("_c_words", i + n - 1)) - 1
    order = (n_max - n).cast("long") * (1 << 52) + i.cast("long") * (1 << 24)
    tokens = [F.slice(F.col(f"_a_{a}" if a in own else f"_c_{a}"), i + 1, n).alias(a) for a in attributes]
    return rows.select(F.col("_c_doc_id").alias("doc_id"), F.col("_c_sent_pos").alias("sent_pos"), *(F.col(f"_c_{c}").alias(c) for c in carry), order.alias("ord"), start.alias("char_start"), end.alias("char_end"), i.alias("word_start"), (i + n - 1).alias("word_end"), F.col("_text").alias("span_text"), *tokens, *(["which"] if which else []))


def ngram_text(first: Column, n: int, joined: bool, back: int = 0) -> Column:
    """The text of the n-gram that starts ``back`` words before a place of ``ngram_rows``."""
    at = first - back if back else first
    last = at + (n - 1) if n > 1 else at
    if not joined:
        start = F.get("_c_char_offsets", at)
        return F.substring("_c_text", start + 1, F.get("_c_char_offsets", last) + F.length(F.get("_c_words", last)) - start)
    words = [F.col("_w") if k == back else F.get("_c_words", at + k if k else at) for k in range(n)]
    return words[0] if n == 1 else F.concat_ws(" ", *words)


def ngram_mentions(sentences: DataFrame, n_min: int = 1, n_max: int = 5, split_tokens: tuple[str, ...] = (), attributes: tuple[str, ...] = ("words",), legacy_split_offsets: bool = False, joined: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """All token n-grams, long ones first and then by start.

    Of the sentence only the columns named in ``carry`` come along. ``joined`` is as in ``ngram_rows``.
    Single tokens are split further at ``split_tokens`` into every run of pieces. The
    pieces' places count from the sentence; ``legacy_split_offsets`` counts them from
    the token, as if it stood at the sentence's start.
    """
    whole = ngram_rows(sentences, [lambda *_: None], n_min, n_max, attributes, joined, carry)
    if not (split_tokens and n_min <= 1 <= n_max):
        return whole
    names = [c for c in whole.columns]
    rgx = "|".join(re.escape(t) for t in sorted(split_tokens, key=len, reverse=True))
    token = F.col("token")
    pieces, marks = F.split(token, rgx, -1), F.regexp_extract_all(token, F.lit(f"({rgx})"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["p"]) + F.length(F.coalesce(x["m"], F.lit("")))).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + F.length(x["p"])).alias("e")))).alias("out"))
    bounds = F.aggregate(F.arrays_zip(pieces.alias("p"), marks.alias("m")), zero, step, lambda acc: acc["out"])
    # only tokens that a mark splits go on
    cut = sentences.select("doc_id", "sent_pos", *carry, "char_offsets", *(F.col(a).alias(f"_{a}") for a in attributes), F.posexplode_outer("words").alias("i", "token")).where(token.rlike(rgx))
    own = [F.slice(F.col(f"_{a}"), F.col("i") + 1, F.lit(1)).alias(f"_{a}") for a in attributes]
    cut = cut.select("doc_id", "sent_pos", *carry, *(["char_offsets"] if legacy_split_offsets else []), *own, "i", "token", (F.lit(0) if legacy_split_offsets else F.get("char_offsets", F.col("i"))).alias("at")).withColumn("bounds", bounds)
    # outer, so that no test of the bounds' number is made below, at every token
    pairs = cut.select("*", F.posexplode_outer("bounds").alias("x", "from")).select("*", F.explode_outer("bounds").alias("to")).where(F.col("from.s") < F.col("to.e"))
    start, end = F.col("from.s") + F.col("at"), F.col("to.e") - 1 + F.col("at")
    first = last = F.col("i")
    if legacy_split_offsets:  # their pieces may lie in another token
        first, last = char_to_word(F.col("char_offsets"), start), char_to_word(F.col("char_offsets"), end)
    else:  # starts and ends of pieces grow, so the one span that comes up twice is the whole token
        pairs = pairs.where((F.col("from.s") > 0) | (F.col("to.e") < F.length("token")))
    piece = (F.col("x") * 65536 + F.col("to.e")).cast("int")
    order = F.lit(n_max - 1).cast("long") * (1 << 52) + F.col("i").cast("long") * (1 << 24) + piece
    text = F.substring("token", F.col("from.s") + 1, F.col("to.e") - F.col("from.s"))
    split = pairs.select("doc_id", "sent_pos", *carry, order.alias("ord"), start.alias("char_start"), end.alias("char_end"), first.alias("word_start"), last.alias("word_end"), text.alias("span_text"), *(F.col(f"_{a}").alias(a) for a in attributes))
    if not legacy_split_offsets:
        return whole.union(split.select(names).where("span_text <> ''"))
    text = F.expr("substring(text, char_start + 1, char_end - char_start + 1)")
    split = split.drop("span_text", *attributes).join(sentences.select("doc_id", "sent_pos", "text", *(F.col(a).alias(f"_{a}") for a in attributes)), ["doc_id", "sent_pos"]).withColumn("span_text", text)
    split = split.select("*", *(F.expr(f"slice(`_{a}`, word_start + 1, word_end - word_start + 1)").alias(a) for a in attributes))
    # a span that comes up twice counts once, where it came up first
    first_met = Window.partitionBy("doc_id", "sent_pos", "char_start", "char_end").orderBy("ord")
    return whole.union(split.select(names).where("span_text <> ''")).withColumn("met", F.row_number().over(first_met)).where("met = 1").drop("met")


def sentence_mentions(sentences: DataFrame) -> DataFrame:
    """Each sentence as one span."""
    return sentences.where(F.size("words") > 0).select("doc_id", "sent_pos", F.lit(0).cast("long").alias("ord"), F.lit(0).alias("char_start"), (F.length("text") - 1).alias("char_end"), F.lit(0).alias("word_start"), (F.size("words") - 1).alias("word_end"), F.col("text").alias("span_text"), "words")


def context_mentions(contexts: DataFrame, kind: str, position: str) -> DataFrame:
    """Every row of a context table (paragraphs, captions, cells, tables, sections, documents) as a mention."""
    return contexts.select("doc_id", F.lit(kind).alias("context_type"), F.col(position).alias("position"))


def figure_mentions(figures: DataFrame, types: str | list[str] | None = None, position: str = "figure_pos") -> DataFrame:
    """Figures, of the given file types if any; a figure without a url is of no type."""
    if types is not None:
        wanted = [types] if isinstance(types, str) else list(types)
        ends = [F.lower("url").endswith(t.strip().lower()) for t in wanted]
        hit = ends[0]
        for e in ends[1:]:
            hit = hit | e
        figures = figures.where(F.coalesce(hit, F.lit(False)))
    return figures.select("doc_id", F.lit("figure").alias("context_type"), F.col(position).alias("position"), "url")


def expand(mentions: DataFrame, expander: Column) -> DataFrame:
    """Implicit mentions: ``expander`` gives an array of texts for a span, each of which stands in its place."""
    rows = mentions.select("*", F.posexplode(expander).alias("expansion", "implicit_text"))
    return rows.withColumn("span_text", F.col("implicit_text")).withColumn("words", F.split("implicit_text", " ")).drop("implicit_text")
