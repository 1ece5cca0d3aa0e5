"""Near-duplicate documents: 128-bit SimHash, an LSH forest and verified Hamming distance.

Every bit of a document's fingerprint is the majority, over its distinct words, of
that bit of the word's hash, so frequent function words don't swamp it. Each tree
of the forest is a trie over the fingerprint's bits in an order of its own.

A document looks for its like under a prefix of its bits in every tree. How long the prefix is
follows the density: from a long one, under which few would be missed, it climbs to
shorter ones as long as no more than ``leaf`` documents are under it, and in any case
up to the depth at which the trees together find a pair at distance ``radius`` with probability ``recall``.
So sparse surroundings are searched beyond the target and dense ones up to it, completely. A subtree with more than ``crowd`` documents
is a forest by itself: its documents are planted again in trees of their own.
Every pair under a prefix is verified on all 128 bits, on the numbers of words and, as the bits of
a short text say little, on the word sets themselves if both texts are short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import col, cut, fresh, number
from factloom.llm.graph import components
from factloom.llm.textkit import U, Chunk, chunks, mix, word_hashes

BITS, RADIUS, RECALL, LEAF, CROWD = 128, 28, 0.92, 1024, 1 << 17
#: Levels of a tree that a document may climb above the depth of the target recall, and times that a crowd is planted again.
CLIMB, AGAIN = 4, 3
SIZE_RATIO = 0.6
#: Texts of so many distinct words at most are compared by their word sets too, which must agree in this share of all words.
SHORT, SHORT_JACCARD = 64, 0.65
#: The 8 bits of a byte as 8 lanes of a 64-bit word.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U).ravel()


def fingerprints(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Two 64-bit words of fingerprint a row, its number of distinct words, and these as sorted 32-bit hashes if they are few."""
    hashes, first = word_hashes(chunk)
    n = len(chunk)
    out, distinct, few = np.zeros((n, 2), U), np.zeros(n, np.int64), [None] * n
    for a in range(0, n, 1 << 18):
        b = min(n, a + (1 << 18))
        part = slice(first[a], first[b])
        row = np.repeat(np.arange(b - a, dtype=U), np.diff(first[a : b + 1]))
        key = np.sort(row << U(46) | hashes[part] >> U(18))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        at = np.searchsorted(key, np.arange(b - a + 1, dtype=U) << U(46))
        sizes = np.diff(at)
        distinct[a:b] = sizes
        rows = np.flatnonzero(sizes)
        if not len(rows):
            continue
        # runs of at most 255 words, which a lane of 8 bits can count
        runs = -(-sizes[rows] // 255)
        first_run = np.concatenate(([0], np.cumsum(runs)))
        inside = np.arange(first_run[-1]) - np.repeat(first_run[:-1], runs)
        starts = np.repeat(at[rows], runs) + 255 * inside
        word = key & U((1 << 46) - 1)
        brief = (word >> U(14)).astype(np.uint32)
        for i in rows[sizes[rows] <= SHORT].tolist():
            few[a + i] = brief[at[i] : at[i + 1]].tobytes()
        for half in range(2):
            raw = mix(word + U(half) * U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8)
            lanes = np.add.reduceat(LANES[raw], starts, axis=0)
            counts = np.add.reduceat(lanes.view(np.uint8).reshape(len(starts), 64).astype(np.int32), first_run[:-1], axis=0)
            out[a + rows, half] = np.ascontiguousarray(np.packbits(2 * counts > sizes[rows, None], axis=1)).view(U).ravel()
    return out, distinct, few


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            out, distinct, few = fingerprints(chunk)
            part, has = batch.slice(chunk.first, len(chunk)), pa.array(distinct > 0)
            columns = [part.column(0), part.column(1), pa.array(out[:, 0].view(np.int64)), pa.array(out[:, 1].view(np.int64)), pa.array(distinct), pa.array(few, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "g", "f0", "f1", "n", "few"]).filter(has)


def meets(depth: int, distance: int) -> float:
    """Probability that ``depth`` random bits of 128 miss all ``distance`` differing ones."""
    return math.prod((BITS - distance - i) / (BITS - i) for i in range(depth))


def forest_shape(n: int, leaf: int, radius: int, recall: float) -> tuple[int, int]:
    """The depth at which ``n`` evenly spread documents have leaves of ``leaf``, and the trees that give the recall there."""
    if n <= leaf:
        return 0, 1
    depth = min(40, math.ceil(math.log2(n / leaf)))
    return depth, max(4, math.ceil(math.log(1 - recall) / math.log(1 - meets(depth, radius))))


def _grow(leaf: int, radius: int, recall: float, level: int):
    """Rows (key, f0, f1, ...): every document once a tree, with its bits in the tree's order, under the subtree that it may climb to.

    The last 6 bits of the key are the depth of the target recall.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders: list[np.ndarray] = []
        for whole in batches:
            size = whole.column(6).to_numpy()
            shapes = {x: forest_shape(int(x), leaf, radius, recall) for x in np.unique(size).tolist()}
            for x, (depth, trees) in shapes.items():
                batch = whole if len(shapes) == 1 else whole.filter(pa.array(size == x))
                words = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)], axis=1)
                bits = np.unpackbits(words.view(np.uint8).reshape(-1, 16), axis=1)
                base = mix(batch.column(5).to_numpy().view(U))
                while len(orders) < trees:
                    orders.append(np.random.default_rng([1000 * level, len(orders)]).permutation(BITS))
                top = U(max(depth - CLIMB, 0))
                for t in range(trees):
                    turned = np.ascontiguousarray(np.packbits(bits[:, orders[t]], axis=1)).view(">u8").astype(U)
                    prefix = turned[:, 0] >> (U(64) - top) if top else np.zeros(len(bits), U)
                    key = mix(base ^ mix(U(t << 40) | prefix)) & ~U(63) | U(depth)
                    columns = [pa.array(x.view(np.int64)) for x in (key, turned[:, 0].copy(), turned[:, 1].copy())]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column(0), batch.column(3), batch.column(4)], ["key", "f0", "f1", "d", "n", "few"])

    return run


def close(f: np.ndarray, g: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of f and g lie within the radius."""
    return np.bitwise_count(f[:, None, 0] ^ g[None, :, 0]) + np.bitwise_count(f[:, None, 1] ^ g[None, :, 1]) <= radius


class Node:
    """The documents under a prefix, and the links between them."""

    def __init__(self, f: np.ndarray, n: np.ndarray, few: np.ndarray, radius: int) -> None:
        self.f, self.n, self.few, self.radius = f, n, few, radius
        self.sets: dict[int, frozenset] = {}

    def words(self, i: int) -> frozenset:
        if i not in self.sets:
            self.sets[i] = frozenset(np.frombuffer(self.few[i], np.uint32).tolist())
        return self.sets[i]

    def alike(self, i: int, j: int) -> bool:
        """Whether two close documents have enough words in common, if both are short; else only their bits can tell."""
        if self.few[i] is None or self.few[j] is None:
            return True
        a, b = self.words(i), self.words(j)
        both = len(a & b)
        return both >= SHORT_JACCARD * (len(a) + len(b) - both)

    def sized(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.n[i], self.n[j]
        return np.minimum(a, b) >= SIZE_RATIO * np.maximum(a, b)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Members and centres: the connected components of the links, as stars."""
        m, found, many = len(self.f), [], 0
        for a in range(0, m, 256):
            i, j = np.nonzero(close(self.f[a : a + 256], self.f[a:], self.radius))
            i, j = i[j > i] + a, j[j > i] + a
            ok = self.sized(i, j)
            found.append((i[ok], j[ok]))
            many += len(i)
            if many > 32 * m:
                return self.flood()  # a thicket, whose links are not all needed
        i, j = (np.concatenate(x) for x in zip(*found))
        if len(i):
            ok = np.array([self.alike(x, y) for x, y in zip(i.tolist(), j.tolist())])
            i, j = i[ok], j[ok]
        root, before = np.arange(m), None
        while before is None or (root != before).any():
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
        member = np.flatnonzero(root != np.arange(m))
        return member, root[member]

    def flood(self) -> tuple[np.ndarray, np.ndarray]:
        """The same from one document to its neighbours and on; what is reached isn't compared again."""
        left, members, centres = np.arange(len(self.f)), [], []
        while len(left):
            centre, border, left = int(left[0]), [int(left[0])], left[1:]
            while border and len(left):
                some, border = np.array(border[:256]), border[256:]
                near = close(self.f[some], self.f[left], self.radius)
                near &= self.sized(some[:, None], left[None])
                hit = near.any(axis=0)
                for k in np.flatnonzero(hit).tolist():
                    hit[k] = any(self.alike(int(some[x]), int(left[k])) for x in np.flatnonzero(near[:, k]))
                got, left = left[hit], left[~hit]
                border += got.tolist()
                members.append(got)
                centres.append(np.full(len(got), centre))
        none = np.empty(0, np.int64)
        return np.concatenate([*members, none]), np.concatenate([*centres, none])


def prefixes(f0: np.ndarray, depth: int, leaf: int) -> Iterator[tuple[int, int]]:
    """The stretches of a subtree (bits in order) that are compared: climbing from ``depth`` while there are at most ``leaf``."""
    todo = [(0, len(f0), max(depth - CLIMB, 0))]
    while todo:
        a, b, level = todo.pop()
        if b - a < 2:
            continue
        if b - a <= leaf or level >= depth:
            yield a, b
            continue
        c = a + int(np.searchsorted(f0[a:b] >> U(63 - level) & U(1), 1))
        todo += [(a, c, level + 1), (c, b, level + 1)]


def _verify(radius: int, leaf: int):
    def edges(block: list[np.ndarray]) -> pa.RecordBatch:
        key, f0, f1, d, n, few = block
        bounds = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        f, found = np.stack([f0, f1], axis=1).view(U), [(d[:0], d[:0])]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for x, y in prefixes(f[a:b, 0], int(key[a]) & 63, leaf):
                part = slice(a + x, a + y)
                member, centre = Node(f[part], n[part], few[part], radius).stars()
                found.append((d[part][member], d[part][centre]))
        u, v = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = int(np.flatnonzero(block[0] == block[0][-1])[0])  # the last key may go on in the next batch
            if held and held[-1][0][-1] != block[0][0]:
                yield edges([np.concatenate(x) for x in zip(*held)])
                held = []
            if last:
                yield edges([np.concatenate(x) for x in zip(*held, [c[:last] for c in block])])
                held = []
            held.append([c[last:] for c in block])
        if held:
            yield edges([np.concatenate(x) for x in zip(*held)])

    return run


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns d, g (text digest), f0, f1 (fingerprint), n (distinct words), few (these, if they are few) of the documents that have a word."""
    units = docs.select(number(docs, doc_id).alias("d"), F.xxhash64(col(text)).alias("g"), col(text).alias("t"))
    return cut(units.where("d is not null and t is not null").mapInArrow(_fingerprint, "d long, g long, f0 long, f1 long, n long, few binary"))


ALIKE = ("f0", "f1", "n", "few")
GROWN = "key long, f0 long, f1 long, d long, n long, few binary"


def near_edges(distinct: DataFrame, radius: int, recall: float, leaf: int, crowd: int) -> DataFrame:
    """Edges u, v that join up the near-duplicates among the rows (d, f0, f1, n, few)."""
    rows = distinct.withColumn("base", F.lit(0).cast("long")).withColumn("size", F.lit(distinct.count()).cast("long"))
    out = None
    for level in range(AGAIN + 1):
        grown = rows.select("d", *ALIKE, "base", "size").mapInArrow(_grow(leaf, radius, recall if level == 0 else 0.98, level), GROWN)
        crowds = None
        if level < AGAIN:
            # as many keys as subtrees; in powers of two, so that there are few shapes of forests
            size = F.pow(F.lit(2), F.ceil(F.log2(F.col("size")))).cast("long")
            crowds = cut(grown.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("key", size.alias("size")))
            if not crowds.limit(1).count():
                crowds = None
        placed = grown if crowds is None else grown.join(crowds, "key", "left_anti")
        unsigned = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in ("f0", "f1")]
        near = placed.repartition("key").sortWithinPartitions("key", *unsigned).mapInArrow(_verify(radius, leaf), "u long, v long")
        out = near if out is None else out.union(near)
        if crowds is None:
            return out
        rows = cut(grown.join(crowds, "key").withColumnRenamed("key", "base"))
    return out


def _members(table: DataFrame, radius: int, recall: float, leaf: int, crowd: int) -> DataFrame:
    """Rows (d, g, root): every document with the one of the least id of its group, which may be itself."""
    distinct = cut(table.groupBy(*ALIKE).agg(F.min("d").alias("d")))
    known = distinct.select(*(F.col(c).alias(f"{c}_") for c in ALIKE), F.col("d").alias("v"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ALIKE]
    # copies hang on the first of them and take no further part; several texts of one id hold together
    members = cut(table.join(known, same).select("d", "g", "v"))
    several = members.groupBy("d").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("d")
    tied = members.join(several, "d").select(F.col("d").alias("u"), "v")
    roots = components(near_edges(distinct, radius, recall, leaf, crowd).union(tied))
    return members.join(roots, F.col("v") == F.col("node"), "left").select("d", "g", F.coalesce("root", "v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF, crowd: int = CROWD) -> DataFrame:
    """Rows (doc_id, duplicate_of): each document of a group but the one with the least id, which the others duplicate.

    A group is a connected component of the pairs within ``radius`` bits of each
    other whose numbers of distinct words are in a ratio of at least
    ``SIZE_RATIO`` (and, for two short texts, whose sets of words agree in
    ``SHORT_JACCARD`` of them); equal bits are no exception. Copies are in one group. Rows of one id are one document. Null ids, null texts and texts
    without a word take no part, other columns are left aside, and an empty table gives no rows. Word order and repetition don't count.
    ``recall`` is for a pair at distance ``radius``; nearer ones are found with more. Up to ``leaf`` different
    fingerprints all pairs are compared. A long text is read whole, and its fingerprint needs the hashes of its words at once.
    """
    members = _members(prints(docs, doc_id, text), radius, recall, leaf, crowd)
    return members.where("d <> root").select(F.col("d").alias("doc_id"), F.col("root").alias("duplicate_of")).distinct()


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF, crowd: int = CROWD) -> DataFrame:
    """The documents without those that duplicate one of a smaller id; all columns pass through.

    Of rows that share an id, those with the least text digest stay, so that rows
    that repeat one another stay together. What takes no part (see
    ``near_duplicates``) stays.
    """
    table = prints(docs, doc_id, text)
    members = _members(table, radius, recall, leaf, crowd)
    first = table.groupBy("d").agg(F.min("g").alias("first"), F.max("g").alias("last"))
    d, g = fresh(docs, "d", "g")
    lost = table.select("d", "g").join(first.where("first <> last"), "d").where("g <> first").select(F.col("d").alias(d), F.col("g").alias(g))
    gone = members.where("d <> root").select(F.col("d").alias(d), F.col("g").alias(g))
    keyed = docs.withColumns({d: number(docs, doc_id), g: F.xxhash64(col(text))})
    return keyed.join(gone.union(lost).distinct().hint("shuffle_hash"), [d, g], "left_anti").select(*map(col, docs.columns))
