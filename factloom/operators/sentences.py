"""Texts to sentences and tokens, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.tokens import offsets, split_words


def simple_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", delim: str = ".") -> DataFrame:
    """One row a sentence: doc_id, sent_pos, text, words, char_offsets.

    A text is cut at a literal delimiter; blank pieces are dropped, words are what
    white space separates, and the sentence's text joins them by single spaces. A
    null or blank text has no sentences.
    """
    pieces = F.filter(F.split(F.col(text), re.escape(delim), -1), lambda p: p.rlike(r"(?U)\S"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(pieces).alias("sent_pos", "piece"))
    worded = rows.select("doc_id", "sent_pos", split_words(F.col("piece")).alias("words"))
    return worded.select("doc_id", "sent_pos", F.array_join("words", " ").alias("text"), "words", offsets(F.col("words")).alias("char_offsets"))


def with_stable_ids(sentences: DataFrame, name: str = "doc_id") -> DataFrame:
    """Adds abs_start, abs_end (places in the joined sentences, without separators) and stable_id."""
    before = Window.partitionBy("doc_id").orderBy("sent_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    placed = sentences.withColumn("abs_start", start).withColumn("abs_end", F.col("abs_start") + F.length("text"))
    return placed.withColumn("stable_id", F.concat_ws("", F.col(name).cast("string"), F.lit("::sentence:"), F.col("abs_start").cast("string"), F.lit(":"), F.col("abs_end").cast("string")))


def split_by_limit(sentences: DataFrame, limit: int) -> DataFrame:
    """Adds ``batch``: consecutive sentences of a document whose texts stay below ``limit`` characters together, greedily."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, n):
        fits = (acc["used"] + n < limit) | (acc["used"] == 0)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(fits, acc["used"] + n).otherwise(n).alias("used"), F.concat(acc["out"], F.array(batch)).alias("out"))

    whole = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_pos", "text"))).alias("s"))
    batches = F.aggregate(F.transform("s", lambda x: F.length(x["text"])), start, step, lambda acc: acc["out"])
    rows = whole.select("doc_id", "s", batches.alias("b")).select("doc_id", F.explode(F.arrays_zip("s", "b")).alias("x"))
    return rows.select("doc_id", F.col("x.s.sent_pos").alias("sent_pos"), F.col("x.s.text").alias("text"), F.col("x.b").alias("batch"))
