"""Annotations in long form, their keys, and sparse matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import numbering


def mapping(rows: DataFrame, stored: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """One value a (candidate_id, key): the last by ``seq``; a last value of 0 takes the key out. New values win over stored ones."""
    last = rows.groupBy("candidate_id", "key").agg(F.max_by("value", seq).alias("value"))
    if stored is not None:
        old = stored.select("candidate_id", "key", F.col("value").alias("old"))
        last = last.join(old, ["candidate_id", "key"], "full").select("candidate_id", "key", F.coalesce("value", "old").alias("value"))
    return last.where("value <> 0")


def wide(rows: DataFrame) -> DataFrame:
    """One row a candidate: parallel arrays keys and values, by key."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return rows.groupBy("candidate_id").agg(pairs.alias("p")).select("candidate_id", F.col("p.key").alias("keys"), F.col("p.value").alias("values"))


def build_keys(rows: DataFrame) -> DataFrame:
    """Key table: every key with the sorted set of relations that have it."""
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("candidate_type")).alias("candidate_classes"))


def upsert_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """New keys are added, known ones get the new classes in place of theirs."""
    return keys.join(new.select("key"), "key", "left_anti").unionByName(new)


def drop_keys(keys: DataFrame, names: DataFrame, classes: list[str]) -> DataFrame:
    """The classes leave the named keys; a key without classes goes."""
    rest = keys.join(names.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    gone = F.array(*map(F.lit, classes))
    kept = F.when(F.col("_hit"), F.array_except("candidate_classes", gone)).otherwise(F.col("candidate_classes"))
    return rest.select("key", kept.alias("candidate_classes")).where(F.size("candidate_classes") > 0)


def drop_all_keys(keys: DataFrame, classes: list[str]) -> DataFrame:
    gone = F.array(*map(F.lit, classes))
    return keys.select("key", F.array_except("candidate_classes", gone).alias("candidate_classes")).where(F.size("candidate_classes") > 0)


def numbered(keys: DataFrame) -> DataFrame:
    """Keys with their column numbers, in order of name."""
    return numbering.numbered(keys.select("key"), "key", "col").select("key", F.col("col").cast("int").alias("col"))


def matrix(rows: DataFrame, keys: DataFrame, candidates: DataFrame, order: str = "candidate_id") -> DataFrame:
    """Sparse cells (row, col, value): rows in the candidates' order, columns of all keys; unknown keys are left out."""
    ranked = numbering.numbered(candidates.select("candidate_id", *([order] if order != "candidate_id" else [])), order, "row")
    return rows.join(numbered(keys), "key").join(ranked.select("candidate_id", "row"), "candidate_id").select("row", "col", "value")


def dense_labels(rows: DataFrame, names: list[str], candidates: DataFrame) -> DataFrame:
    """One column a labeller, -1 where it has no opinion."""
    picked = rows.groupBy("candidate_id").pivot("key", names).agg(F.first("value"))
    joined = candidates.select("candidate_id").join(picked, "candidate_id", "left")
    return joined.select("candidate_id", *(F.coalesce(F.col(f"`{n}`"), F.lit(-1)).alias(n) for n in names))


def gold_labels(rows: DataFrame, names: list[str], candidates: DataFrame, annotator: str | None = None) -> DataFrame:
    """As ``dense_labels``; a candidate without a gold label is an error."""
    wanted = [annotator] if annotator else names
    dense = dense_labels(rows, wanted, candidates)
    guard: Column = F.lit(True)
    for n in wanted:
        guard = guard & (F.col(n) >= 0)
    return dense.where(F.when(guard, True).otherwise(F.raise_error(F.lit("a candidate has no gold label"))))
