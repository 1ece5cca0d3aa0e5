"""Long repeats across documents: what the substring operators share.

An *anchor* is a position chosen by the text around it alone, with a name that
depends on the text alone, so that a passage has the same anchors wherever it
stands. The operators differ in how they choose and name anchors; from there on:

1. names are counted over the distinct texts, and anchors whose name occurs in one are
   dropped; texts that several documents have repeat as wholes and need one copy here;
2. the rest fetch their context from the text: words to the left and to the right;
3. for every split of ``min_words`` between left and right, the anchors of a name that
   agree on both parts are grouped; a group of two documents or more repeats, and the
   widest splits of an anchor are its extent;
4. extents of ``min_words`` or more are joined up within each document.

Every step is linear in the anchors, up to sorting: a passage that thousands of documents
share is grouped, not compared pairwise. The anchors of a name are grouped in a task's memory, if there
are at most ``HOT`` of them. Those of a hotter name are named anew, twice: any split has half of ``min_words``
or more on one side, so the splits that lean to the right are grouped by the name and this half on the right, the others
by the name and the half on the left. A phrase that stands in many surroundings is hot no more by then. The anchors of a name
that still is become rows, one a split, that Spark groups by a hash of name and split; partial sums on the way take the heat out of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import col, cut, number
from factloom.llm.textkit import U, Chunk, chunks, mix, word_hashes

MIN_WORDS = 50
#: Anchors of one name that a task groups in memory at most (some 6 MB of context); a name with more is split up, see above.
HOT = 1 << 14

#: Gets a chunk's word hashes and each row's first word; gives positions (word numbers in the chunk) and names.
Anchors = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _name(anchors: Anchors, min_words: int):
    """One row (d, g, n, pos, name) a text of ``min_words`` or more: its words, and its anchors by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                hashes, first = word_hashes(chunk)
                at, names = anchors(hashes, first)
                row = np.searchsorted(first, at, "right") - 1
                size = np.diff(first)
                long = np.flatnonzero(size >= min_words)
                held = np.flatnonzero((size >= min_words)[row])
                held = held[np.argsort(at[held], kind="stable")]
                counts = np.bincount(row[held], minlength=len(size))[long]
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                part = batch.slice(chunk.first, len(chunk))
                take = pa.array(long)
                place = (at - first[row])[held].astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place, names[held].view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(size[long].astype(np.int32)), *lists], ["d", "g", "n", "pos", "name"])

    return run


def windows(codes: np.ndarray, first: np.ndarray, row: np.ndarray, at: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Of word codes (and a 0 after all of them) those before each position, nearest first, and those from it on; 0 outside the row."""
    back = at[:, None] - 1 - np.arange(left)
    ahead = at[:, None] + np.arange(right)
    none = len(codes) - 1
    return codes[np.where(back >= first[row][:, None], back, none)], codes[np.where(ahead < first[row + 1][:, None], ahead, none)]


def _context(left: int, right: int):
    """Rows (d, g, text, positions, names, hot): one row an anchor with its context, 32-bit codes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                hashes, first = word_hashes(chunk)
                codes = np.append((mix(hashes) >> U(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                part = batch.slice(chunk.first, len(chunk))
                lists = part.column(3)
                counts = pa.compute.list_value_length(lists).to_numpy()
                row = np.repeat(np.arange(len(chunk)), counts)
                pos = lists.flatten().to_numpy()
                names, hot = part.column(4).flatten(), part.column(5).flatten()
                for a in range(0, len(row), 4096):
                    r, p = row[a : a + 4096], pos[a : a + 4096]
                    before, after = windows(codes, first, r, first[r] + p, left, right)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([names.slice(a, 4096), part.column(0).take(take), part.column(1).take(take), pa.array(p.astype(np.int32)), _binary(before), _binary(after), hot.slice(a, 4096)], ["name", "d", "g", "pos", "before", "after", "hot"])

    return run


def _binary(codes: np.ndarray) -> pa.Array:
    """Rows of 32-bit codes as equally long binaries."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1] * 4), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Equally long binaries as rows of 32-bit codes."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    start = np.frombuffer(offsets, np.int64)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint32, len(column) * width, int(start)).reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint32)


def _splits(name: np.ndarray, before: np.ndarray, after: np.ndarray, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each split of ``min_words``: how many words lie left of the anchor, the rows that have so many on either side, and the hash of name, split and words of these."""
    ahead, key = [], mix(name.view(U))
    for b in range(after.shape[1]):
        key = mix(key * U(0xA0761D6478BD642F) + after[:, b].astype(U))
        ahead.append(key)
    behind = np.zeros(len(name), U)
    for a in range(min(before.shape[1], min_words - 1) + 1):
        if a:
            behind = mix(behind * U(0xD6E8FEB86659FD93) + before[:, a - 1].astype(U))
        b = min_words - a
        if b > after.shape[1]:
            continue
        there = np.flatnonzero((after[:, b - 1] != 0) & ((before[:, a - 1] != 0) if a else True))
        if len(there):
            yield a, there, mix(ahead[b - 1][there] ^ mix(behind[there] + U(a)))


def _extents(name: np.ndarray, d: np.ndarray, g: np.ndarray, pos: np.ndarray, before: np.ndarray, after: np.ndarray, min_words: int) -> list[np.ndarray]:
    """For each anchor that shares ``min_words`` around it with another document: d, g, start, stop, the least other document, the first place there that is shared."""
    order = np.lexsort((pos, g, d))
    name, d, g, pos, before, after = (x[order] for x in (name, d, g, pos, before, after))
    n = len(name)
    other_doc = np.ones(n, bool)
    other_doc[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    unit = np.cumsum(other_doc)
    least, most = np.full(n, np.iinfo(np.int32).max, np.int64), np.full(n, -1, np.int64)
    other, place, at = np.full(n, n + 1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, there, key in _splits(name, before, after, min_words):
        along = np.argsort(key, kind="stable")  # within a group by document and place
        row, key = there[along], key[along]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row))))
        differs = unit[row] != unit[row[start]][group]
        second = np.minimum.reduceat(np.where(differs, np.arange(len(row)), len(row)), start)
        shared = second[group] < len(row)
        row, group, differs = row[shared], group[shared], differs[shared]
        least[row], most[row] = np.minimum(least[row], a), a
        met = np.where(differs, there[along][start[group]], there[along][np.minimum(second[group], len(along) - 1)])
        begin = pos[met] - a
        nearer = (unit[met] < other[row]) | (unit[met] == other[row]) & (begin < place[row])
        row, met, begin = row[nearer], met[nearer], begin[nearer]
        other[row], place[row] = unit[met], begin
        at[row] = met
    x = np.flatnonzero(most >= 0)
    return [d[x], g[x], pos[x] - most[x], pos[x] + min_words - least[x], d[at[x]], place[x]]


def _lean(left: int, right: int, min_words: int):
    """What ``_context`` gives of hot anchors, named anew by the half of ``min_words`` on either side, each row with the words that its splits may have."""
    context, half = _context(left, right), min_words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in context(batches):  # in one worker: a step of Spark's would hold another one
            batch = batch.filter(batch.column(6))
            if not batch.num_rows:
                continue
            name, before, after = mix(batch.column(0).to_numpy().view(U)), _matrix(batch.column(4), left), _matrix(batch.column(5), right)
            # splits with half of the words on the left at most, and those with more
            for key, near, far, rest in ((name, after, before, half), (~name, before, after, min_words - half - 1)):
                needed = min_words - rest
                if needed > near.shape[1]:
                    continue
                there = np.flatnonzero(near[:, needed - 1] != 0)
                key = key[there]
                for i in range(needed):
                    key = mix(key * U(0xA0761D6478BD642F) + near[there, i].astype(U))
                far = np.where(np.arange(far.shape[1]) < rest, far[there], np.uint32(0))
                sides = (far, near[there]) if near is after else (near[there], far)
                take = pa.array(there)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(i).take(take) for i in (1, 2, 3)), *(_binary(x) for x in sides)], ["name", "d", "g", "pos", "before", "after"])

    return run


def _keyed(left: int, right: int, min_words: int):
    """Rows (key, d, g, start): every stretch of ``min_words`` around an anchor, keyed by its name, split and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, d, g, pos = (batch.column(i).to_numpy() for i in range(4))
            for a, there, key in _splits(name, _matrix(batch.column(4), left), _matrix(batch.column(5), right), min_words):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), d[there], g[there], (pos[there] - a).astype(np.int32))], ["key", "d", "g", "start"])

    return run


def _hot_extents(context: DataFrame, left: int, right: int, min_words: int) -> DataFrame:
    """What ``_extents`` finds, by Spark's groupings."""
    keyed = context.mapInArrow(_keyed(left, right, min_words), "key long, d long, g long, start int")
    unit = F.struct("d", "g", "start")
    one = keyed.groupBy("key").agg(F.min(unit).alias("one"), F.max(unit).alias("last")).where("one.d <> last.d or one.g <> last.g").drop("last")
    shared = keyed.join(one, "key")
    own = (F.col("one.d") == F.col("d")) & (F.col("one.g") == F.col("g"))
    second = shared.where(~own).groupBy("key").agg(F.min(unit).alias("second"))
    met = F.when(own, F.col("second")).otherwise(F.col("one"))
    return shared.join(second, "key").select("d", "g", "start", (F.col("start") + min_words).alias("stop"), met["d"].alias("other"), met["start"].alias("other_start"))


def _compare(left: int, right: int, min_words: int):
    """Rows sorted by name: the extents that each anchor shares with any other of its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = _extents(*(np.concatenate(x) for x in zip(*held)), min_words)
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(kind)) for x, kind in zip(columns, kinds)], ["d", "g", "start", "stop", "other", "other_start"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = [*(batch.column(i).to_numpy() for i in range(4)), _matrix(batch.column(4), left), _matrix(batch.column(5), right)]
            name = block[0]
            last = int(np.searchsorted(name, name[-1]))  # the last name may go on in the next batch
            if last or (held and held[-1][0][-1] != name[-1]):
                held.append([x[:last] for x in block])
                yield flush()
                held = []
            held.append([x[last:].copy() for x in block])
        if held:
            yield flush()

    return run


def long_repeats(docs: DataFrame, anchors: Anchors, left: int, right: int, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words, other_doc_id, other_start_word): the stretches of a document,
    of ``min_words`` or more, that stand in another document too.

    ``other`` is the document with the least id that shares ``min_words`` or more of the stretch, and where the
    first such part starts in it. Rows of one id and text are
    one document; other texts under one id are documents of their own. Null ids and
    null texts take no part, and other columns of ``docs``, whatever their names, are left aside.
    A text of any length is taken whole.
    """
    units = docs.select(number(docs, doc_id).alias("d"), F.xxhash64(col(text)).alias("g"), col(text).alias("t")).where("d is not null and t is not null")
    rows = cut(units.mapInArrow(_name(anchors, min_words), "d long, g long, n int, pos array<int>, name array<long>"))
    units_ = rows.select("d", "g", "n").distinct()
    texts = units_.groupBy("g", "n").agg(F.min("d").alias("d"), F.max("d").alias("last"))
    named = rows.select("g", F.inline(F.arrays_zip("pos", "name")))
    same = Window.partitionBy("name")
    counted = named.withColumns({"a": F.min("g").over(same), "b": F.max("g").over(same), "hot": F.count("*").over(same) > hot})
    kept = counted.where("a <> b")
    places = kept.groupBy("g").agg(F.array_sort(F.collect_set(F.struct("pos", "name", "hot"))).alias("p")).select("g", *(F.col(f"p.{c}").alias(c) for c in ("pos", "name", "hot")))
    first = places.join(texts.select("g", "d"), "g")
    once = units.join(first.hint("shuffle_hash"), ["d", "g"]).select("d", "g", "t", "pos", "name", "hot")
    context = once.mapInArrow(_context(left, right), "name long, d long, g long, pos int, before binary, after binary, hot boolean")
    leaning = once.where(F.exists("hot", lambda x: x)).mapInArrow(_lean(left, right, min_words), context.drop("hot").schema)
    hotter = F.broadcast(leaning.groupBy("name").count().where(F.col("count") > hot).select("name"))  # one name in ``hot`` anchors at most
    ordered = context.where("not hot").drop("hot").union(leaning.join(hotter, "name", "left_anti")).repartition("name").sortWithinPartitions("name")
    extents = ordered.mapInArrow(_compare(left, right, min_words), "d long, g long, start int, stop int, other long, other_start int")
    extents = extents.union(_hot_extents(leaning.join(hotter, "name", "left_semi"), left, right, min_words))
    # a text that several documents have is one stretch in each of them
    many = texts.where("d <> last").select("g", F.col("d").alias("one"), "n")
    copied = units_.select("g", F.col("d").alias("member")).join(many, "g")
    second = copied.where("member > one").groupBy("g").agg(F.min("member").alias("second"))
    extents = extents.union(many.select(F.col("one").alias("d"), "g", F.lit(0).alias("start"), F.col("n").alias("stop"), F.lit(None).cast("long"), F.lit(None).cast("int")))
    # extents that touch or overlap are one stretch
    along = Window.partitionBy("d", "g").orderBy("start", F.desc("stop"))
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    stretch = extents.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    met = F.when(F.col("other").isNotNull(), F.struct("other", "other_start"))
    joined = stretch.groupBy("d", "g", "run").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min(met).alias("o"))
    # the stretch of a copied text's first document stands for all of its documents
    each = joined.join(copied.join(second, "g").select("g", "member", "one", "second"), "g", "left")
    twin = F.when(F.col("member").isNotNull(), F.struct(F.when(F.col("member") == F.col("one"), F.col("second")).otherwise(F.col("one")).alias("other"), F.lit(0).alias("other_start")))
    out = each.withColumn("o", F.least("o", twin))
    return out.select(F.coalesce("member", "d").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("o.other").alias("other_doc_id"), F.col("o.other_start").alias("other_start_word"))


#: Every window of ``MIN_WORDS`` words that another document has, joined up: what both operators find.
REPEATS_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, words, unnest(range(0, len(words) - {MIN_WORDS} + 1)) AS i FROM d WHERE len(words) >= {MIN_WORDS}),
w AS MATERIALIZED (SELECT doc_id, i, hash(array_to_string(words[i + 1:i + {MIN_WORDS}], ' ')) AS h FROM p),
m AS MATERIALIZED (SELECT h, doc_id, min(i) AS i FROM w GROUP BY h, doc_id),
s AS MATERIALIZED (SELECT h, list_sort(list(doc_id))[1:2] AS two FROM m GROUP BY h HAVING count(*) > 1),
o AS (SELECT w.doc_id, w.i, w.h, CASE WHEN w.doc_id = two[1] THEN two[2] ELSE two[1] END AS other FROM w JOIN s ON w.h = s.h),
q AS (SELECT o.*, m.i AS there FROM o JOIN m ON o.h = m.h AND o.other = m.doc_id),
n AS (SELECT *, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_WORDS}, -1) THEN 1 ELSE 0 END AS new FROM q),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (SELECT doc_id, min(i)::INT AS start_word, (max(i) + {MIN_WORDS})::INT AS end_word, min((other, there)) AS o FROM r GROUP BY doc_id, run)
SELECT doc_id, start_word, end_word, end_word - start_word AS n_words, o[1] AS other_doc_id, o[2]::INT AS other_start_word FROM g"""
