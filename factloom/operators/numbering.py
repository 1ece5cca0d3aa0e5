"""Row numbers over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are looked at for the borders of the stretches, and the number of these.
SAMPLE, STRETCHES = 8192, 256


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``, a row's place in the order of ``key`` (long, from 0; nulls first; ties in any order).

    The keys are cut into stretches of about equal numbers, whose borders are keys chosen by
    their hashes. Each stretch is numbered by itself, and the rows of the stretches before it are added.
    """
    chosen = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(SAMPLE)
    # one row, in the plan of the whole: so no job runs before, and what the rows come from isn't computed for it alone
    some = chosen.agg(F.array_sort(F.collect_list(key)).alias("_s"))
    spread = F.expr(f"array_distinct(transform(sequence(1, {STRETCHES - 1}), i -> element_at(_s, cast(i * size(_s) div {STRETCHES} as int) + 1)))")
    cuts = some.select(F.when(F.size("_s") >= STRETCHES, spread).otherwise(F.col("_s")).alias("_cuts"))
    rows = rows.crossJoin(F.broadcast(cuts))
    stretch = F.coalesce(F.size(F.filter("_cuts", lambda b: b <= F.col(key))), F.lit(0))
    placed = rows.withColumn("_stretch", F.when(F.col(key).isNull(), -1).otherwise(stretch))
    counts = placed.groupBy("_stretch").agg(F.count("*").alias("_n"))  # as many rows as stretches
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.coalesce(1).select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_stretch").orderBy(key)) - 1
    return placed.withColumn("_inner", inner).join(F.broadcast(starts), "_stretch").withColumn(name, F.col("_before") + F.col("_inner")).drop("_stretch", "_inner", "_before", "_cuts")
