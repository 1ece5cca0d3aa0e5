"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in ``weight * budget / size of source``
copies. The expected copies are summed up along the source, an offset drawn once a
source is added, and a document is emitted once for each whole number that its
stretch of the sum crosses. So a source's copies differ from their expectation by
less than one, and a document's from its own by less than one.

The running sum has two levels, so that no source is summed by one task: within
buckets of ids, and over the buckets' totals. Expected copies are counted in
millionths, as integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import col, fresh, number

SEED, UNIT = 17, 1_000_000
#: Stretches of ids that a source is summed in: a constant that bounds neither rows nor copies.
BUCKETS = 65_536


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, UNIT) drawn from the seed and the source's name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source.cast("string"), F.lit(""))))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(UNIT))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", copy: str | None = None) -> DataFrame:
    """The documents in the numbers that bring each source's characters to its target.

    ``weights`` maps a source to its weight (they are scaled to sum to 1; a source
    that isn't named gets none; None: the same for every source). ``budget`` is the
    number of characters to emit in expectation (None: as many as there are).
    ``copy`` names a column for the number of the copy, from 1. The order within a
    source is by bucket (id modulo ``BUCKETS``; of null ids, the text's digest), id and digest of the text.

    A null source is a source of its own (named "" in ``weights``), a null text
    has no characters, and a source without any is left out. Null ids come first;
    rows that repeat one another, or tie otherwise, are sampled one by one. Other columns pass through, whatever their
    names. An empty table gives an empty one. Texts are only measured, so their length doesn't matter.
    """
    b, s, g, rate, end, before, shift = fresh(docs, "b", "s", "g", "rate", "end", "before", "shift")
    id_ = number(docs, doc_id)
    # null ids have buckets of their own, by their texts, before the others
    bucket = F.when(id_.isNull(), -1 - F.pmod(F.xxhash64(col(text)), F.lit(BUCKETS))).otherwise(F.pmod(id_, F.lit(BUCKETS))).cast("int").alias(b)
    name = F.coalesce(col(source).cast("string"), F.lit("")).alias(s)
    sizes = docs.select(name, bucket, F.coalesce(F.length(col(text)), F.lit(0)).alias(g)).groupBy(s, b).agg(F.count("*").alias("n"), F.sum(g).alias("chars"))
    total = sizes.groupBy(s).agg(F.sum("chars").alias("chars"))
    if weights is None:
        weigh = F.lit(1.0)
    elif weights:
        weigh = F.coalesce(F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))[F.col(s)], F.lit(0.0))
    else:
        weigh = F.lit(0.0)
    total = total.where("chars > 0").withColumn("w", weigh)
    sums = total.agg(F.sum("w").alias("all_w"), F.sum("chars").cast("double").alias("all_chars"))
    wanted = F.lit(float(budget)) if budget is not None else F.col("all_chars")
    # one row a source against one row
    rates = total.crossJoin(F.broadcast(sums)).select(s, F.when(F.col("all_w") > 0, F.floor(wanted * F.col("w") * UNIT / (F.col("all_w") * F.col("chars").cast("double")))).otherwise(0).cast("long").alias(rate))
    ordered = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(rates, s).select(s, b, rate, (F.coalesce(F.sum("n").over(ordered), F.lit(0)) * F.col(rate) + _offset(F.col(s), seed)).alias(before)).where(F.col(rate) > 0)
    keyed = docs.withColumns({s: F.coalesce(col(source).cast("string"), F.lit("")), b: bucket, g: F.xxhash64(col(text))})
    placed = keyed.join(places.hint("shuffle_hash"), [s, b])
    rank = F.row_number().over(Window.partitionBy(s, b).orderBy(id_, g))
    stretch = placed.withColumn(end, F.col(before) + rank * F.col(rate))
    first, last = F.floor((F.col(end) - F.col(rate)) / UNIT), F.floor(F.col(end) / UNIT)
    copies = stretch.withColumn(shift, (last - first).cast("int")).where(F.col(shift) > 0)
    times = F.explode(F.sequence(F.lit(1), F.col(shift)))
    kept = [c for c in docs.columns if not copy or c.lower() != copy.lower()]
    out = copies.select(*map(col, kept), times.alias(copy or shift))
    return out if copy else out.select(*map(col, kept))


def mix_sql(documents: str = "documents", select: str = "doc_id, source, text, copy", seed: int = SEED) -> str:
    """DuckDB SQL for ``mix_sources`` with equal weights over ``documents`` (a table or a query's name)."""
    return f"""
WITH d AS (SELECT *, coalesce(source, '') AS s, coalesce(((doc_id % {BUCKETS}) + {BUCKETS}) % {BUCKETS}, -1) AS b FROM {documents}),
t AS (SELECT s, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM d GROUP BY s HAVING sum(coalesce(length(text), 0)) > 0),
r AS (SELECT s, floor((SELECT sum(chars) FROM t) * 1.0::DOUBLE * {UNIT} / ((SELECT count(*)::DOUBLE FROM t) * chars))::BIGINT AS rate FROM t),
o AS (SELECT s, rate, (('0x' || substr(md5('{seed}:' || s), 1, 12))::BIGINT) % {UNIT} AS shift FROM r),
p AS (SELECT d.*, rate, shift + rate * row_number() OVER (PARTITION BY d.s ORDER BY b, doc_id NULLS FIRST) AS stop FROM d JOIN o ON d.s = o.s),
c AS (SELECT *, stop // {UNIT} - (stop - rate) // {UNIT} AS n FROM p)
SELECT {select} FROM (SELECT *, unnest(range(1, n + 1))::INT AS copy FROM c WHERE n > 0)"""
