import base64
import random

import zstandard
from conftest import SCHEMA, prose, row

from factloom.llm.compression import BANDS, CHUNK_BYTES, compression_filter, judge, measure


def test_bands(spark):
    rng = random.Random(1)
    good = [prose(rng, n) for n in (20, 80, 300, 2000, 9000)]
    noise = [base64.b85encode(rng.randbytes(n)).decode() for n in (2000, 30_000)]
    loops = ["again and again " * n for n in (30, 400)]
    part = [prose(rng, 400) + base64.b85encode(rng.randbytes(3000)).decode()]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(good + noise + loops + part)], SCHEMA)
    verdicts = {r.doc_id: r.verdict for r in measure(docs).collect()}
    assert [verdicts[i] for i in range(5)] == ["keep"] * 5
    assert [verdicts[i] for i in (5, 6)] == ["incompressible"] * 2 and [verdicts[i] for i in (7, 8)] == ["repetitive"] * 2
    assert verdicts[9] in ("incompressible", "incompressible_chunks")
    assert {r.doc_id for r in compression_filter(docs).collect()} == set(range(5))


def test_figures_by_hand(spark):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (5, 200, 900)] + ["é" * 700]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    for r in measure(docs).collect():
        raw = texts[r.doc_id].encode()
        parts = [CHUNK_BYTES / size(raw[i : i + CHUNK_BYTES]) for i in range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]
        assert abs(r.zstd_ratio - len(raw) / size(raw)) < 1e-9
        assert (r.chunk_low, r.chunk_high) == ((min(parts), max(parts)) if parts else (None, None))
        assert r.verdict == judge(len(raw), len(raw) / size(raw), parts, tail=(len(raw) % 1024, len(raw[-(len(raw) % 1024) :]) / size(raw[-(len(raw) % 1024) :])) if parts and len(raw) % 1024 else None)


def plain_verdict(raw):
    """The rule once more, by hand: out of band as a whole, or more than a quarter of the chunks, the last one included."""
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    if not raw:
        return "empty"
    limits = lambda n: next((low, high) for below, low, high in BANDS if n < below)
    low, high = limits(len(raw))
    ratio = len(raw) / size(raw)
    if ratio > high or ratio < low:
        return "repetitive" if ratio > high else "incompressible"
    over = under = n = 0
    for a in range(0, len(raw) if len(raw) > 1024 else 0, 1024):
        part = raw[a : a + 1024]
        low, high = (1.3, 2.7) if len(part) == 1024 else limits(len(part))
        r, n = len(part) / size(part), n + 1
        over, under = over + (r > high), under + (r < low)
    return "repetitive_chunks" if n and over > n / 4 else "incompressible_chunks" if n and under > n / 4 else "keep"


def test_against_a_plain_version(spark):
    rng = random.Random(5)
    noise = lambda n: base64.b85encode(rng.randbytes(n)).decode()
    texts = [prose(rng, rng.randint(1, 700)) + rng.choice(["", noise(rng.randint(1, 900)), "so " * rng.randint(1, 500)]) for _ in range(120)]
    texts += [(prose(rng, 300)[:1024] + noise(800))[: 1024 + 700], (prose(rng, 300)[:1024] + "la " * 300)[: 1024 + 800]]  # only the end is odd
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.verdict for r in measure(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_verdict(t.encode()) for t in texts]
    assert got[120] == "incompressible_chunks" and got[121] != "keep"


def test_bands_grow_with_length():
    assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(BANDS, BANDS[1:]))
    assert judge(0, 0, []) == "empty" and judge(10, 0.4, []) == "keep"


def test_edges(messy, nothing):
    out = compression_filter(messy)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert out.columns == messy.columns and {r.verdict for r in rows} == {12} and ids.count(1) == 2
    assert not {3, 4, 9, -5} & set(ids) and None in ids
    figures = {(r.doc_id, r.verdict) for r in measure(messy).collect()}
    assert {(3, None), (4, "empty"), (5, "keep"), (9, "repetitive")} <= figures
    assert compression_filter(nothing).count() == 0 and compression_filter(nothing, figures=True).count() == 0
