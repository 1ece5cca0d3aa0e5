"""Exact top-k neighbours by inner product: Fagin's threshold algorithm in blocks.

Vectors are dealt to blocks by their nearest pivot. A block holds, for every
dimension, its vectors in order of that coordinate. For a query the lists are read
from the end that its own coordinate favours; every vector met is scored in full
(random access), and the coordinates at the depth reached bound all vectors not yet
met. The reading stops when that bound is below the kth best score.

The queries are the vectors whose id is divisible by ``every``. A first round runs each in
its own block, which gives it a kth score to beat. In the second round a query goes to
those other blocks only whose bound at depth 0 reaches that score: the same threshold
test before anything is read. Queries travel to the blocks, not vectors to the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import col, cut, number

K, BLOCK, QUERIES, FIRST_DEPTH, TILE = 10, 8192, 65_536, 4, 256
#: Pivots at most, vectors chosen by the hashes of their ids; a pivot with more than a block's vectors has several blocks.
PIVOTS = 1024
#: Block summaries that one pass of the second round holds; more are taken in further passes.
SUMMARIES = 4096


class Lists:
    """A block's vectors and its sorted lists, one a dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.read = self.scanned = 0

    def bounds(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """What a vector can score at most that none of the lists shows before ``depth``, with room for rounding."""
        n = len(self.ids)
        if depth >= n:
            return np.full(len(queries), -np.inf)
        top, bottom = self.sorted[depth], self.sorted[n - 1 - depth]
        bound = np.maximum(queries, 0) @ top + np.minimum(queries, 0) @ bottom
        return bound + 1e-9 * (1 + np.abs(queries) @ np.maximum(np.abs(self.sorted[0]), np.abs(self.sorted[-1])))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query that finds any: its number, and the positions and scores of its best
        ``k`` vectors (and any that tie with the last), of those that score ``floor`` or more; its own id aside."""
        n, dims = self.vectors.shape
        for q in np.flatnonzero(self.bounds(queries, 0) >= floor).tolist():
            depth = FIRST_DEPTH
            while depth * dims < n:
                # sorted access down to this depth, then random access to all that was met
                up = queries[q] >= 0
                met = np.unique(np.concatenate((self.order[:depth, up].ravel(), self.order[n - depth :, ~up].ravel())))
                met = met[self.ids[met] != own[q]]
                scores = np.einsum("ij,j->i", self.vectors[met], queries[q])
                kth = np.partition(scores, len(scores) - k)[-k] if len(scores) >= k else -np.inf
                bar = max(kth, floor[q])
                bound = self.bounds(queries[q : q + 1], depth)[0]
                if bound < bar:
                    self.read += 1
                    yield q, met[scores >= bar], scores[scores >= bar]
                    break
                if self.bounds(queries[q : q + 1], min(n // dims, n - 1))[0] >= bar:
                    depth = n  # even the deepest reading below a scan can't stop yet
                depth *= 4
            else:
                yield q, *self.scan(queries[q], own[q], k, floor[q])

    def scan(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The lists would show every vector before the bound falls, so all are scored."""
        self.scanned += 1
        rough = self.vectors @ query
        rough[self.ids == own] = -np.inf
        kth = np.partition(rough, len(rough) - k)[-k] if len(rough) >= k else -np.inf
        bar = max(kth, floor)
        near = np.flatnonzero((rough >= (bar - 1e-9 * (1 + abs(bar)) if np.isfinite(bar) else bar)) & np.isfinite(rough))
        # one way of summing for all, so that equal vectors score the same
        scores = np.einsum("ij,j->i", self.vectors[near], query)
        kth = np.partition(scores, len(scores) - k)[-k] if len(scores) >= k else -np.inf
        bar = max(kth, floor)
        return near[scores >= bar], scores[scores >= bar]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _found(lists: Lists, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray) -> pa.RecordBatch:
    parts = [(np.full(len(v), ids[q]), lists.ids[v], s) for q, v, s in lists.search(vectors, ids, k, floor)]
    q, v, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float64))], ["q", "v", "score"])


def _tiles(k: int):
    """Rows (tile, side, id, vec, floor) by tile and side: vectors of the block first, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, lists = None, [], [], None
        for batch in batches:
            tile, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            key = tile * 2 + side
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if tile[a] != now:
                    now, ids, vectors, lists = tile[a], [], [], None
                part = batch.slice(a, b - a)
                these, vecs = part.column(2).to_numpy(), _matrix(part.column(3))
                if side[a] == 0:
                    ids.append(these)
                    vectors.append(vecs)
                    continue
                if lists is None:
                    lists = Lists(np.concatenate(ids), np.concatenate(vectors))
                for i in range(0, len(these), TILE):
                    yield _found(lists, these[i : i + TILE], vecs[i : i + TILE], k, part.column(4).to_numpy(zero_copy_only=False)[i : i + TILE])

    return run


def _place(pivots: np.ndarray):
    half = (pivots * pivots).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            nearest = np.concatenate([np.argmax(vectors[i : i + TILE] @ pivots.T - half, axis=1) for i in range(0, len(vectors), TILE)] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int64))], ["id", "vec", "pivot"])

    return run


def _routes(blocks: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Queries to those blocks whose bound at depth 0 reaches their kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TILE):
                batch = whole.slice(i, TILE)
                vectors, home, floor = _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                bound = np.maximum(vectors, 0) @ high.T + np.minimum(vectors, 0) @ low.T
                bound += 1e-9 * (1 + np.abs(vectors) @ np.maximum(np.abs(high), np.abs(low)).T)
                row, at = np.nonzero((bound >= floor[:, None]) & (home[:, None] != blocks[None]))
                if len(row):
                    part = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[at]), part.column(0), part.column(1), part.column(3)], ["block", "id", "vec", "floor"])

    return run


def top_k(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, every: int = 1) -> DataFrame:
    """Rows (query_id, neighbour_id, rank, score): for every query its ``k`` best other vectors by inner product.

    The queries are the vectors whose id is divisible by ``every``; all vectors are searched.
    Equal scores rank by id. Fewer than ``k`` rows for a query if there are fewer
    other vectors. Rows with a null id, a null or empty vector, one with a null, NaN or infinite
    coordinate, or one whose length isn't the commonest (of equally common ones, the least), take
    no part; of rows that share an id the least vector counts. Other columns are left aside. An empty
    table gives no rows. Scores are sums in double precision.
    """
    spark = vectors.sparkSession
    vec = col(embedding).cast("array<double>")
    given = vectors.select(number(vectors, vec_id).alias("id"), vec.alias("vec")).where("id is not null and vec is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    lengths = given.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").head()
    found = "query_id long, neighbour_id long, rank int, score double"
    if lengths is None:
        return spark.createDataFrame([], found)
    given = cut(given.where(F.size("vec") == lengths["dims"]).groupBy("id").agg(F.min("vec").alias("vec")))
    n = given.count()
    pivots = np.array([r["vec"] for r in given.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, round(n / block)))).collect()])
    placed = given.mapInArrow(_place(pivots), "id long, vec array<double>, pivot long")
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block))
    home = cut(placed.join(F.broadcast(sizes), "pivot").select("id", "vec", (F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("id"), "parts")).alias("block")))  # at most PIVOTS sizes
    queries = home.where(F.col("id") % every == 0)
    nothing = F.lit(float("-inf"))

    def side(df: DataFrame, number: int, group, floor=nothing) -> DataFrame:
        return df.select("block", group.cast("long").alias("group"), F.lit(number).cast("long").alias("side"), "id", "vec", floor.alias("floor"))

    def tiles(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("block", "group").sortWithinPartitions("block", "group", "side")
        tile = F.xxhash64("block", "group").alias("tile")  # told apart by those around it: tiles of one partition only
        return ordered.select(tile, "side", "id", "vec", "floor").mapInArrow(_tiles(k), "q long, v long, score double")

    # a block's queries are asked in groups of about QUERIES, and a group has the block's vectors once
    groups = max(1, -(-n // (every * QUERIES)))
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))
    first = cut(tiles(side(home, 0, F.lit(0)).union(side(queries, 1, F.lit(0)))))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("q").alias("id"), F.col("score").alias("floor"))
    floors = cut(queries.join(kth, "id", "left").select("id", "vec", "block", F.coalesce("floor", nothing).alias("floor")))
    reach = home.select("block", F.posexplode("vec").alias("d", "x")).groupBy("block", "d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    reach = reach.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("d", "low", "high"))).alias("r"))
    numbers = [r[0] for r in reach.select("block").orderBy("block").collect()]
    out = first
    for a in range(0, len(numbers), SUMMARIES):
        least, most = numbers[a], numbers[min(a + SUMMARIES, len(numbers)) - 1]
        some = reach.where(F.col("block").between(least, most)).orderBy("block").collect()
        low, high = (np.array([[x[i] for x in r["r"]] for r in some]) for i in (1, 2))
        routed = floors.mapInArrow(_routes(np.array([r["block"] for r in some], np.int64), low, high), "block long, id long, vec array<double>, floor double")
        asked = side(routed, 1, group, F.col("floor"))
        if groups > 1:  # only the blocks that a group of queries needs
            needed = asked.select("block", "group").distinct()
            there = side(home.join(needed, "block"), 0, F.col("group"))
        else:
            there = side(home.join(asked.select("block").distinct(), "block", "left_semi"), 0, F.lit(0))
        out = out.union(tiles(there.union(asked)))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("v").alias("neighbour_id"), "rank", "score")


#: Queries of ``op4_topk``: the ids that are divisible by this.
EVERY = 100
TOP_K_SQL = f"""
SELECT query_id, neighbour_id, rank::INT AS rank, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % {EVERY} = 0) WHERE rank <= {K}"""
