"""Relational tables as documents: grids from orders, page layouts from sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.tokens import offsets

GRID_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def order_grid(orders: DataFrame, block: int = 16) -> DataFrame:
    """Sentences of grids: a document holds one table, a block of ``block`` order keys, under a header row.

    Columns doc_id, table_pos, sent_pos, cell_pos, the cell's rectangle, text, words, char_offsets.
    """
    key = F.col("o_orderkey")
    values = F.array(*(F.col(c).cast("string") for c in GRID_COLUMNS))
    body = orders.select(F.floor(key / block).cast("long").alias("doc_id"), (key % block + 1).cast("int").alias("row"), F.posexplode(values).alias("col", "text"))
    head = body.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, GRID_COLUMNS))).alias("col", "text"))
    cells = head.union(body)
    place = F.col("row") * len(GRID_COLUMNS) + F.col("col")
    return cells.select("doc_id", F.lit(0).alias("table_pos"), place.alias("sent_pos"), place.alias("cell_pos"), F.col("row").alias("row_start"), F.col("row").alias("row_end"), F.col("col").alias("col_start"), F.col("col").alias("col_end"), "text", F.split("text", " ").alias("words")).withColumn("char_offsets", offsets(F.col("words")))


def with_layout(sentences: DataFrame, per_page: int = 50) -> DataFrame:
    """Adds ``box``: a page of monospaced lines in two columns, read across."""
    line = F.floor(F.col("sent_pos") / 2)
    top, left = (12 * (line % per_page)).cast("int"), (6 * (F.col("sent_pos") % 3) + 300 * (F.col("sent_pos") % 2)).cast("int")
    box = F.struct((F.floor(line / per_page) + 1).cast("int").alias("page"), top.alias("top"), (top + 10).alias("bottom"), left.alias("left"), (left + 6 * F.length("text") - 1).cast("int").alias("right"))
    return sentences.withColumn("box", box)
