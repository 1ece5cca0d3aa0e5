"""Labelling functions, majority vote, marginals and set-based scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Labeller = Callable[[], Column]


def encode(value: Column, values: list | None = None) -> Column:
    """A labelling function's result as a class: integers (and booleans, as 0 and 1) as they are,
    members of ``values`` by their place, null for no opinion; anything else is an error."""
    if not values:
        return value.cast("int")
    ladder = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, v in enumerate(values):
        ladder = ladder.when(value == F.lit(v), F.lit(i))
    return ladder.otherwise(F.raise_error(F.lit("a labelling function returned an unknown value")).cast("int"))


def apply_labellers(candidates: DataFrame, functions: dict[str, Column], values: dict[str, list] | None = None) -> DataFrame:
    """Rows (candidate_id, key, value): every labelling function's class for every candidate; no row for no opinion."""
    wide = candidates.select("candidate_id", F.array(*(F.struct(F.lit(k).alias("key"), encode(f, (values or {}).get(k)).alias("value")) for k, f in functions.items())).alias("l"))
    return wide.select("candidate_id", F.explode("l").alias("l")).select("candidate_id", F.col("l.key").alias("key"), F.col("l.value").alias("value")).where("value is not null")


def matches(candidates: DataFrame, labeller: Column, values: list[int] | None = None) -> DataFrame:
    """Candidates for which a labelling function gives one of ``values``."""
    return candidates.where(labeller.isin(values if values is not None else [1, -1]))


def shift(dense: Column) -> Column:
    """Dense labels (-1: none) to sparse ones (0: none)."""
    return dense + 1


def unshift(sparse: Column) -> Column:
    return sparse - 1


def majority(rows: DataFrame) -> DataFrame:
    """The commonest class of each candidate; ties have none."""
    votes = rows.groupBy("candidate_id", "value").agg(F.count("*").alias("n"))
    best = votes.groupBy("candidate_id").agg(F.max("n").alias("n"))
    top = votes.join(best, ["candidate_id", "n"])
    return top.groupBy("candidate_id").agg(F.min("value").alias("label"), F.count("*").alias("ties")).where("ties = 1").select("candidate_id", "label")


def coverage(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each labelling function: how many candidates it labels, and on how many another one contradicts it."""
    per = rows.groupBy("candidate_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    stats = rows.join(per, "candidate_id").groupBy("key").agg(F.count("*").alias("labelled"), F.sum((F.col("low") != F.col("high")).cast("long")).alias("conflicts"))
    return stats.crossJoin(candidates.agg(F.count("*").alias("total")))


def save_marginals(stored: DataFrame, probabilities: DataFrame, training: bool = True) -> DataFrame:
    """The marginal table after all of one ``training`` flag are replaced: classes from 1 on with a probability above 0.

    ``probabilities`` has candidate_id and an array ``p`` by class, or a number ``p`` for class 1 of two.
    """
    p = F.col("p") if probabilities.schema["p"].dataType.typeName() == "array" else F.array(1 - F.col("p"), F.col("p"))
    rows = probabilities.select("candidate_id", F.posexplode(p).alias("value", "probability")).where("value >= 1 and probability > 0")
    new = rows.select("candidate_id", F.lit(training).alias("training"), "value", "probability")
    return stored.where(F.col("training") != training).unionByName(new)


def confusion(predicted: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """True positives, false positives and false negatives, as sets."""
    return predicted.intersect(gold), predicted.subtract(gold), gold.subtract(predicted)


def scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and f1 of two sets; undefined ones are null."""
    tag = lambda df, name: df.distinct().withColumn(name, F.lit(1))
    keys = gold.columns
    both = tag(predicted, "p").join(tag(gold, "g"), keys, "full")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    p, g = F.col("p").isNotNull(), F.col("g").isNotNull()
    counts = both.agg(count(p & g).alias("tp"), count(p & ~g).alias("fp"), count(~p & g).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return counts.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def expand_entities(entities: DataFrame, parts: DataFrame, least: int = 4) -> DataFrame:
    """Entities with every known part that their own part (of ``least`` characters or more) is a prefix of."""
    e, p = entities.alias("e"), parts.select(F.col("part").alias("full"), F.substring("part", 1, least).alias("stem")).distinct().alias("p")
    stem = F.substring("e.part", 1, least)
    joined = e.where(F.length("part") >= least).join(p, (stem == F.col("p.stem")) & F.expr("startswith(p.full, e.part)"))
    others = [c for c in entities.columns if c != "part"]
    more = joined.select(*(F.col(f"e.{c}") for c in others), F.col("p.full").alias("part"))
    return entities.select(*others, "part").union(more).distinct()
