"""Quality rules by compression bands.

A document's zstandard ratio (bytes in over bytes out) says how repetitive it is,
once its length is allowed for: a short text has little to refer back to. The limits
therefore depend on the length. Fixed chunks are judged as well, whole ones by one band
and the shorter one at the end by the band of its length, so that a long document can't
hide a repetitive or random part anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from factloom.llm.common import col, fresh
from factloom.llm.textkit import chunks

LEVEL, CHUNK_BYTES = 3, 1024
#: (bytes below which the band holds, least ratio, greatest ratio). Under 64 bytes the frame's overhead decides, so nothing is judged.
BANDS = ((64, 0.0, float("inf")), (256, 0.85, 2.2), (1024, 1.25, 2.6), (4096, 1.5, 3.0), (16384, 1.65, 3.6), (float("inf"), 1.75, 4.2))
#: Band of the ratio of a whole chunk, and the share of a document's chunks that may lie outside.
CHUNK_BAND, CHUNK_SHARE = (1.3, 2.7), 0.25


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """The least and the greatest ratio of a text of ``size`` bytes; a limit itself is within."""
    return next((low, high) for below, low, high in bands if size < below)


def judge(size: int, ratio: float, chunk_ratios: list[float], bands=BANDS, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE, tail: tuple[int, float] | None = None) -> str:
    """"keep", or the reason to reject: repetitive, incompressible, repetitive_chunks, incompressible_chunks, empty.

    ``chunk_ratios`` are those of whole chunks, ``tail`` the size and ratio of a shorter last one.
    """
    if size == 0:
        return "empty"
    low, high = band(size, bands)
    if not low <= ratio <= high:
        return "repetitive" if ratio > high else "incompressible"
    limits = [chunk_band] * len(chunk_ratios)
    if tail is not None:
        chunk_ratios, limits = [*chunk_ratios, tail[1]], [*limits, band(tail[0], bands)]
    n = len(chunk_ratios)
    if n and sum(r > high for r, (_, high) in zip(chunk_ratios, limits)) > share * n:
        return "repetitive_chunks"
    if n and sum(r < low for r, (low, _) in zip(chunk_ratios, limits)) > share * n:
        return "incompressible_chunks"
    return "keep"


def measure(docs: DataFrame, text: str = "text", level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES, bands=BANDS, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE) -> DataFrame:
    """All columns and zstd_ratio, chunk_low, chunk_high (least and greatest ratio of a whole chunk) and verdict.

    Clashing columns are replaced. An empty text is "empty" and has no ratio, a null
    text has nulls throughout; a text of at most a chunk has no chunk figures, as its whole is
    judged by the same band. A ratio equal to a limit is within it. Ids aren't looked at and
    repeated rows don't matter: each row is judged alone, in one pass without an exchange, so an
    empty table gives an empty one. A text of any length is compressed as one frame, whose
    compressed form is all that is held besides the text.
    """
    new = ["zstd_ratio", "chunk_low", "chunk_high", "verdict"]
    kept = [c for c in docs.columns if c.lower() not in new]
    (alias,) = fresh(docs, "judged_text")
    source = docs.select(*map(col, kept), col(text).alias(alias))
    types = docs.select(*map(col, kept)).schema.fields
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in types] + ["zstd_ratio double", "chunk_low double", "chunk_high double", "verdict string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            for part in chunks(batch.column(len(kept))):
                rows: list[tuple] = []
                for valid, a, b in zip(part.valid.tolist(), part.offsets.tolist(), part.offsets[1:].tolist()):
                    if not valid:
                        rows.append((None, None, None, None))
                        continue
                    data = memoryview(np.ascontiguousarray(part.data[a:b]))
                    ratio = (b - a) / len(size_of(data)) if b > a else None
                    parts = [chunk_bytes / len(size_of(data[i : i + chunk_bytes])) for i in range(0, b - a - chunk_bytes + 1, chunk_bytes)]
                    left = (b - a) % chunk_bytes
                    tail = (left, left / len(size_of(data[-left:]))) if parts and left else None
                    rows.append((ratio, min(parts, default=None), max(parts, default=None), judge(b - a, ratio or 0.0, parts, bands, chunk_band, share, tail)))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.float64(),) * 3 + (pa.string(),))]
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, len(part)).columns[: len(kept)], *columns], [*kept, *new])

    return source.mapInArrow(run, schema)


def compression_filter(docs: DataFrame, text: str = "text", figures: bool = False, **limits) -> DataFrame:
    """The documents within their bands; all columns pass through, clashing ones unharmed.

    Empty and null texts are rejected; all else is as in ``measure``. ``figures`` keeps the
    measured columns, in place of clashing ones.
    """
    if figures:
        measured = measure(docs, text, **limits)
        return measured.where("verdict = 'keep'").drop("verdict")
    names = ["zstd_ratio", "chunk_low", "chunk_high", "verdict"]
    aside = {c: f"{c}_in" for c in docs.columns if c.lower() in names}  # clashing columns of the input come back unharmed
    for c, stand_in in aside.items():
        while stand_in in docs.columns:
            stand_in += "_"
        aside[c] = stand_in
    renamed = docs.withColumnsRenamed(aside)
    measured = measure(renamed, aside.get(text, text), **limits).where("verdict = 'keep'")
    return measured.select(*(col(aside.get(c, c)).alias(c) for c in docs.columns))
