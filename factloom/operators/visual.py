"""Words of a page to tokens of a text: exact links first, then a search nearby."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def page_words(words: DataFrame, separators: str = r"[\s]+") -> DataFrame:
    """Words of positioned blocks in reading order: block top, block left, line top, word left; numbered from 0.

    Columns doc_id, page, block_top, block_left, top, bottom, left, right, text.
    """
    cut = words.withColumn("word", F.explode(F.filter(F.split("text", separators), lambda w: w != "")))
    order = Window.partitionBy("doc_id").orderBy("page", "block_top", "block_left", "top", "left")
    return cut.withColumn("place", F.row_number().over(order) - 1)


#: Rows of documents that are linked at once, if no single document has more.
LINKED = 200_000


def link_exact(tokens: DataFrame, words: DataFrame, token_order: tuple[str, ...], word_order: tuple[str, ...]) -> DataFrame:
    """Joins the n-th occurrence of a word in the text to its n-th on the page, where both have it equally often.

    Rows go to their document's task compressed, as stretches of rows of a document, and are ranked and joined there by
    arrays: a document's rows lie in one task's memory. Rows without a document or a word link to nothing.
    """
    out = tokens.join(words, ["doc_id", "word"]).schema

    def packed(df: DataFrame, is_page: bool) -> tuple[DataFrame, pa.Schema]:
        known = df.where("doc_id is not null and word is not null").select("doc_id", "word", *(c for c in df.columns if c not in ("doc_id", "word")))
        schema = to_arrow_schema(known.schema)
        stretches = known.mapInArrow(_packer(is_page, schema), f"doc_id {known.schema['doc_id'].dataType.simpleString()}, is_page boolean, n int, size int, stretch binary")
        return stretches, schema

    (left, left_schema), (right, right_schema) = packed(tokens, False), packed(words, True)
    together = left.union(right).repartition("doc_id").sortWithinPartitions("doc_id")
    return together.mapInArrow(_linker(left_schema, right_schema, token_order, word_order, to_arrow_schema(out)), out)


def _narrow(batch: pa.RecordBatch) -> bytes:
    """A batch's bytes, made to be compressed: integers as steps from row to row, texts as their lengths and, at the end, their bytes.

    Columns with nulls and of other types stay as they are; a bit a column in front tells which.
    """
    columns, texts, bits = [], [], 0
    for k, c in enumerate(batch.columns):
        if c.null_count == 0 and (pa.types.is_integer(c.type) or pa.types.is_string(c.type)):
            bits |= 1 << k
            if pa.types.is_string(c.type):
                at = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)
                texts.append(c.buffers()[2][at[0] : at[-1]].to_pybytes() if at[-1] > at[0] else b"")
                c = pa.array(np.diff(at))
            else:
                c = pa.array(np.diff(c.to_numpy(), prepend=c.type.to_pandas_dtype()(0)))
        columns.append(c)
    body = pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))]).serialize().to_pybytes()
    return np.array([bits, len(body)], np.int64).tobytes() + body + b"".join(texts)


def _widened(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    """What ``_narrow`` was given."""
    bits, size = (int(x) for x in np.frombuffer(data, np.int64, 2))
    coded = [bool(bits >> k & 1) for k in range(len(schema))]
    kinds = [pa.int32() if x and pa.types.is_string(f.type) else f.type for x, f in zip(coded, schema)]
    body = pa.ipc.read_record_batch(pa.py_buffer(data[16 : 16 + size]), pa.schema([(str(k), t) for k, t in enumerate(kinds)]))
    columns, at = [], 16 + size
    for c, f, x in zip(body.columns, schema, coded):
        if x and pa.types.is_string(f.type):
            ends = np.concatenate(([0], np.cumsum(c.to_numpy(), dtype=np.int64))).astype(np.int32)
            c = pa.StringArray.from_buffers(len(c), pa.py_buffer(ends), pa.py_buffer(data[at : at + int(ends[-1])]))
            at += int(ends[-1])
        elif x:
            c = pa.array(np.cumsum(c.to_numpy(), dtype=f.type.to_pandas_dtype()), f.type)
        columns.append(c)
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _packer(is_page: bool, schema: pa.Schema):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
            docs = batch.column(0)
            new = pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            counts = np.diff(np.append(starts, batch.num_rows))
            raw = [_narrow(batch.slice(int(i), int(n))) for i, n in zip(starts, counts)]
            stretches = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(starts)), pa.array([is_page] * len(raw)), pa.array(counts, pa.int32()), pa.array([len(r) for r in raw], pa.int32()), pa.array(stretches, pa.binary())], ["doc_id", "is_page", "n", "size", "stretch"])

    return pack


def _ranked(table: pa.Table, order: tuple[str, ...], side: str) -> pa.Table:
    """The rows with ``k``, their place among the equal words of a document, and ``n``, how many these are."""
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("doc_id", "word", *order)], null_placement="at_start")).combine_chunks()
    rows = table.num_rows
    new = np.ones(rows, bool)
    if rows:
        new[1:] = pc.or_(*(pc.not_equal(table[c][1:], table[c][:-1]) for c in ("doc_id", "word"))).to_numpy()
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, rows))
    names = [c if c in ("doc_id", "word") else f"{side}{i}" for i, c in enumerate(table.column_names)]
    return table.rename_columns(names).append_column("k", pa.array(np.arange(rows) - np.repeat(starts, counts))).append_column("n", pa.array(np.repeat(counts, counts)))


def _linker(left: pa.Schema, right: pa.Schema, token_order: tuple[str, ...], word_order: tuple[str, ...], out: pa.Schema):
    def linked(stretches: list[tuple[bool, int, bytes]]) -> Iterator[pa.RecordBatch]:
        sides = []
        for schema, is_page, order, side in ((left, False, token_order, "t"), (right, True, word_order, "w")):
            read = [_widened(pa.decompress(s, decompressed_size=size, codec="zstd", asbytes=True), schema) for p, size, s in stretches if p == is_page]
            sides.append(_ranked(pa.Table.from_batches(read, schema), order, side))
        joined = sides[0].join(sides[1], ["doc_id", "word", "k", "n"], join_type="inner")
        names = ["doc_id", "word", *(f"t{i}" for i in range(2, len(left))), *(f"w{i}" for i in range(2, len(right)))]
        for batch in joined.select(names).to_batches():
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, out)], schema=out)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, doc = [], 0, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for d, is_page, n, size, stretch in zip(*columns):
                if rows >= LINKED and d != doc:
                    yield from linked(held)
                    held, rows = [], 0
                held.append((is_page, size, stretch))
                rows, doc = rows + n, d
        if held:
            yield from linked(held)

    return link


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def link_all(tokens: list[str], words: list[str], window: int = 200) -> list[int]:
    """The word of each token: exact by equal counts, then the nearest equal word around the expected
    place, then the cheapest of the window by edit distance times 20 plus offset. Earlier links set the expectation."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(words):
        where.setdefault(w, []).append(j)
    count: dict[str, int] = {}
    for t in tokens:
        count[t] = count.get(t, 0) + 1
    nth: dict[str, int] = {}
    links = [-1] * len(tokens)
    for i, t in enumerate(tokens):
        if len(where.get(t, ())) == count[t]:
            links[i] = where[t][nth.get(t, 0)]
            nth[t] = nth.get(t, 0) + 1
    expected = 0
    for i, t in enumerate(tokens):
        if links[i] < 0 and words:
            near = [j for j in where.get(t, ()) if abs(j - expected) <= window]
            if near:
                links[i] = min(near, key=lambda j: abs(j - expected))
            else:
                low, high = max(0, expected - window), min(len(words), expected + window)
                links[i] = min(range(low, high), key=lambda j: 20 * _distance(t, words[j]) + abs(j - expected), default=-1)
        if links[i] >= 0:
            expected = min(links[i] + 1, len(words) - 1)
    return links


def link_pages(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """All links, document by document: rows (doc_id, token_pos, place). ``tokens``: doc_id, token_pos, word; ``words``: doc_id, place, word."""
    def run(t: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        t, w = t.sort_values("token_pos"), w.sort_values("place")
        places = w["place"].tolist()
        links = link_all(t["word"].tolist(), w["word"].tolist())
        return pd.DataFrame({"doc_id": t["doc_id"], "token_pos": t["token_pos"], "place": [places[j] if j >= 0 else None for j in links]})

    return tokens.groupBy("doc_id").cogroup(words.groupBy("doc_id")).applyInPandas(run, "doc_id long, token_pos int, place int")


def align_scan(tokens: list[str], scanned: list[str]) -> list[tuple[int, int]]:
    """For each token the first and last scanned word whose characters it shares, white space aside (one to one, one to many or many to one)."""
    bounds, at = [], 0
    for s in scanned:
        bounds.append((at, at + len(s)))
        at += len(s)
    out, place = [], 0
    for t in tokens:
        low, high = place, place + len(t)
        hit = [k for k, (a, b) in enumerate(bounds) if a < high and b > low]
        out.append((hit[0], hit[-1]) if hit else (-1, -1))
        place = high
    return out


def scan_boxes(sentences: DataFrame) -> DataFrame:
    """Boxes of tokens from a scan's attributes, and the attributes taken off.

    Sentences carry ``words`` and html_attrs with left, top, right, bottom, ppageno and
    tokens, as the scan reader folds them. Sentences of one element share its scanned
    words in turn. Adds page, left, top, right and bottom, arrays by token.
    """
    names = ("left", "top", "right", "bottom", "ppageno", "tokens")
    schema = "doc_id long, sent_pos int, page array<int>, left array<int>, top array<int>, right array<int>, bottom array<int>"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sent_pos")
        attrs = dict(a.split("=", 1) for a in frame["html_attrs"].iloc[0])
        scanned = attrs["tokens"].split()
        values = {n: [int(x) for x in attrs[n].split()] for n in names[:5]}
        links = align_scan([w for words in frame["words"] for w in words], scanned)
        rows, at = [], 0
        for doc, pos, words in zip(frame["doc_id"], frame["sent_pos"], frame["words"]):
            mine = [x for x in links[at : at + len(words)]]
            at += len(words)
            pick = lambda n, f: [f(values[n][a : b + 1]) if a >= 0 else None for a, b in mine]
            rows.append((doc, pos, [p + 1 if p is not None else None for p in pick("ppageno", min)], pick("left", min), pick("top", min), pick("right", max), pick("bottom", max)))
        return pd.DataFrame(rows, columns=["doc_id", "sent_pos", "page", "left", "top", "right", "bottom"])

    scanned = sentences.where(F.exists("html_attrs", lambda a: a.startswith("tokens=")))
    found = scanned.select("doc_id", "sent_pos", "xpath", "words", "html_attrs").groupBy("doc_id", "xpath").applyInPandas(run, schema)
    rest = F.filter("html_attrs", lambda a: ~F.split(a, "=")[0].isin(*names))
    return sentences.withColumn("html_attrs", rest).join(found, ["doc_id", "sent_pos"], "left")

