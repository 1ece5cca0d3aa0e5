"""Line deduplication by pairwise alignment.

Documents that share a line are paired, each pair is aligned by patience diff, and
the aligned blocks go from the later document, so that the first copy of a passage
stays. Every line that isn't blank pairs a document with the first document that has it,
rare or not. So the pairs grow with the lines, not with the square of a line's frequency,
and every line that an earlier document holds meets an alignment with a document that holds it.

An alignment keeps the order. What it leaves of the later document is therefore aligned
again with the whole earlier one (a block moved, or repeated in the later document),
``PASSES`` times in all, and a common line that is left even then is a block by itself. In the
end a document keeps the lines that no earlier one holds, and the blank ones that follow these.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import col, cut, fresh, number
from factloom.llm.textkit import SPACE, Chunk, chunks, segment_hash

#: Bytes, white space aside, from which a line pairs documents and can be taken out.
MIN_BYTES = 1
PASSES = 4


def line_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every line, its bytes that aren't white space, and each row's first line (n + 1 of them). An empty text has one empty line."""
    feeds = np.flatnonzero(chunk.data == 10)
    row_starts, row_ends = chunk.offsets[:-1], chunk.offsets[1:]
    row_of = np.searchsorted(row_ends, feeds, "right")
    counts = np.bincount(row_of, minlength=len(chunk)) + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.arange(len(feeds)) + row_of  # a feed ends its line and starts the next
    starts[first[:-1]], starts[inner + 1] = row_starts, feeds + 1
    ends[first[1:] - 1], ends[inner] = row_ends, feeds
    dark = np.concatenate(([0], np.cumsum(~SPACE[chunk.data], dtype=np.int64)))
    return segment_hash(chunk.data, starts, ends), dark[ends] - dark[starts], first


def _lines(min_bytes: int):
    """Rows (d, g, lines): the hash of each line; 0 for one that is blank or too short to take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                hashes, dark, first = line_hashes(chunk)
                hashes = np.where(dark >= max(min_bytes, 1), np.where(hashes == 0, np.uint64(1), hashes), np.uint64(0)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes))
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["d", "g", "lines"])

    return run


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that grows in both places; they are sorted by the first."""
    tails, at, back = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        if k:
            back[i] = at[k - 1]
        tails[k : k + 1], at[k : k + 1] = [y], [i]
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i of a, j of b), in order: equal ends first, then lines that are
    unique on both sides, then what lies between those. In a gap without such lines the
    copies of a line are matched one to one, and the longest chain of these counts."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        count_a, count_b = Counter(a[i:m]), Counter(b[j:n])
        once = {v: y for y, v in enumerate(b[j:n], j) if count_b[v] == 1 == count_a.get(v)}
        if once:
            anchors = _increasing([(x, once[v]) for x, v in enumerate(a[i:m], i) if v in once])
        else:
            places: dict[int, list[int]] = {}
            for y in range(n - 1, j - 1, -1):
                if b[y] in count_a:
                    places.setdefault(b[y], []).append(y)
            anchors = _increasing([(x, places[v].pop()) for x, v in enumerate(a[i:m], i) if places.get(v)])
        x, y = i, j
        for p, q in anchors:
            todo.append((x, p, y, q))
            out.append((p, q))
            x, y = p + 1, q + 1
        if anchors:
            todo.append((x, m, y, n))
    return sorted(out)


def removed_lines(earlier: list[int], later: list[int]) -> list[int]:
    """Lines of ``later`` (numbers, in order) that go for ``earlier``; 0 is a line that takes no part."""
    if earlier == later:
        return [j for j, x in enumerate(later) if x]
    common, gone = set(earlier) - {0}, set()
    earlier = [x for x in earlier if x]
    for number in range(PASSES + 1):
        left = [j for j, x in enumerate(later) if x in common and j not in gone]
        if not left:
            break
        gone.update(left if number == PASSES else (left[y] for _, y in patience(earlier, [later[j] for j in left])))
    return sorted(gone)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            gone = [removed_lines(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.list_(pa.int32()))], ["d", "g", "gone"])


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Columns d, g (a document's id and text digest) and gone, the numbers of the lines it loses, in order, blank ones after these aside."""
    units = docs.select(number(docs, doc_id).alias("d"), F.xxhash64(col(text)).alias("g"), col(text).alias("t")).where("d is not null and t is not null")
    lines = cut(units.mapInArrow(_lines(min_bytes), "d long, g long, lines array<long>"))
    held = lines.select("d", "g", F.explode(F.array_distinct("lines")).alias("h")).where("h <> 0")
    this = F.struct("d", "g")
    shared = held.groupBy("h").agg(F.min(this).alias("e"), F.max(this).alias("last")).where("e < last").select("h", "e")
    pairs = held.join(shared, "h").where(F.col("e") < this).select("d", "g", "e").distinct()
    unique = lines.dropDuplicates(["d", "g"])
    early = unique.select(this.alias("e"), F.col("lines").alias("early"))
    joined = pairs.join(early, "e").join(unique, ["d", "g"]).select("d", "g", "early", "lines")
    gone = joined.mapInArrow(_align, "d long, g long, gone array<int>").where(F.size("gone") > 0)
    return gone.groupBy("d", "g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, removed: str | None = None) -> DataFrame:
    """The documents without the blocks of lines that an earlier document has.

    Earlier means a smaller ``doc_id`` (rows of one id: by digest of the text). Lines are equal if
    all their bytes are; those with fewer than ``min_bytes`` bytes besides white space take no
    part. Blank lines go with the line before them.
    A document of which only white space would be left is dropped. ``n_chars``,
    where there is such a column, follows the text; ``removed`` names a column for
    the number of lines lost, in place of a clashing one. Rows that repeat one another are one
    document to this operator: all stay or change alike. A null id or text takes no part and
    stays; an empty text stays; an empty table gives an empty one. Other columns pass through. A long
    text is taken whole, by eight bytes a line of it.
    """
    d, g, lines, gone = fresh(docs, "d", "g", "lines", "gone")
    cuts = removals(docs, doc_id, text, min_bytes).select(F.col("d").alias(d), F.col("g").alias(g), F.col("gone").alias(gone))
    keyed = docs.withColumns({d: number(docs, doc_id), g: F.xxhash64(col(text))})
    joined = keyed.join(cuts.hint("shuffle_hash"), [d, g], "left")
    split = F.split(col(text), "\n", -1)
    from_, to = F.concat(F.array(F.lit(-1)), F.col(gone)), F.concat(F.col(gone), F.array(F.size(lines)))
    kept = F.filter(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda x: x["b"] - x["a"] > 1)

    def stretch(x):
        """The lines between two that go, from the first that isn't blank on; those before all that go as they are."""
        part = F.slice(F.col(lines), x["a"] + 2, x["b"] - x["a"] - 1)
        dark = F.array_position(F.transform(part, lambda y: y.rlike(r"[^ \t\n\x0b\f\r]")), True).cast("int")
        return F.when(x["a"] < 0, part).when(dark > 0, F.slice(part, dark, F.size(part))).otherwise(F.array().cast("array<string>"))

    rest = F.flatten(F.transform(kept, stretch))
    changed = F.col(gone).isNotNull()
    out = joined.withColumn(lines, F.when(changed, split))
    out = out.withColumn(gone, F.when(changed, F.struct(rest.alias("rest"), F.size(lines).alias("n"))))
    out = out.withColumn(lines, F.when(changed, F.array_join(F.col(f"{gone}.rest"), "\n"))).where(~changed | F.col(lines).rlike(r"\S"))
    new = {text: F.when(changed, F.col(lines)).otherwise(col(text))}
    for f in docs.schema.fields:
        if f.name.lower() == "n_chars" and f.dataType.typeName() in ("integer", "long"):
            new[f.name] = F.when(changed, F.length(lines)).otherwise(col(f.name)).cast(f.dataType)
    columns = [new.get(c, col(c)).alias(c) for c in docs.columns]
    if removed:
        columns = [c for c, name in zip(columns, docs.columns) if name.lower() != removed.lower()] + [F.coalesce(F.col(f"{gone}.n") - F.size(f"{gone}.rest"), F.lit(0)).alias(removed)]
    return out.select(*columns)


#: ``op10_line_dedup``: a line goes if an earlier document has it, a blank one if the last line before it that isn't blank goes.
LINE_SQL = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
f AS (SELECT line, min(doc_id) AS first FROM l WHERE regexp_matches(line, '[^ 	
]') GROUP BY line),
m AS (SELECT l.doc_id, l.text, l.line, i, CASE WHEN f.line IS NOT NULL THEN f.first < l.doc_id END AS goes FROM l LEFT JOIN f ON l.line = f.line),
w AS (SELECT *, coalesce(last_value(goes IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS lost FROM m),
r AS (SELECT doc_id, any_value(text) AS text, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost) AS rest, count(*) FILTER (WHERE lost)::INT AS n FROM w GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 0 THEN rest ELSE text END AS text, n AS n_removed FROM r WHERE n = 0 OR regexp_matches(rest, '[^ 	
]')
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE doc_id IS NULL OR text IS NULL"""
