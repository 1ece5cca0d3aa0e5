import random
from collections import Counter

import corpus_pipeline
import numpy as np
from conftest import SCHEMA, prose, row
from test_line_dedup import brute as line_brute
from test_quality import junk
from test_simhash import brute as copies_brute

from factloom.llm.bpe import VOCABULARY, vocabulary

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def build(tmp_path, spark):
    rng = random.Random(13)
    base = [prose(rng, rng.randint(80, 250)) for _ in range(160)]
    rows = [row(i, t, "ab"[i % 3 == 0]) for i, t in enumerate(base)]
    rows += [row(200 + i, base[i], "b") for i in range(10)]
    rows += [row(300 + i, " ".join("lomi" if rng.random() < 0.03 else w for w in base[20 + i].split(" ")), "a") for i in range(10)]
    rows += [row(400 + i, junk(rng, 150), "a") for i in range(30)]
    rows += [row(500, None), row(501, ""), row(None, base[5])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return base


def test_stages_against_brute_force(spark, tmp_path):
    base = build(tmp_path, spark)
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == DOCUMENTS
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = docs.collect()
    good = seen["quality classifier"]
    ids = {r.doc_id for r in good}
    assert len(ids & set(range(160))) >= 158 and len(ids & set(range(400, 430))) <= 2 and not {500, 501} & ids
    want = line_brute([(r.doc_id, r.text) for r in good])
    lined = seen["line dedup"]
    assert Counter((r.doc_id, r.text) for r in lined) == Counter(want) and all(r.n_chars == len(r.text) for r in lined)
    known = [(r.doc_id, r.text) for r in lined if r.doc_id is not None]
    gone = {a for a, _ in copies_brute([i for i, _ in known], [t for _, t in known])}
    once = [r for r in seen["near dedup"] if r.doc_id is not None]
    dropped = {i for i, _ in known} - {r.doc_id for r in once}
    assert dropped == gone
    assert not ids & set(range(200, 210)) & {r.doc_id for r in once}  # copies are gone
    mixed, total, chars = seen["source mixing"], sum(len(r.text) for r in seen["near dedup"]), Counter()
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in seen["near dedup"]}
    for r in mixed:
        chars[r.source] += len(r.text)
    assert all(abs(c - total / len(chars)) < 0.1 * total for c in chars.values())
    v = vocabulary(VOCABULARY)
    made = Counter((r.doc_id, v.decode(np.array(r.token_ids)).decode()) for r in seen["bpe encoding"])
    assert made == Counter((r.doc_id, r.text) for r in mixed)
    assert base


def test_run_is_the_stages(spark, tmp_path):
    build(tmp_path, spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens"] and out.count() > 100


def test_stages_on_odd_rows(spark, messy, nothing):
    """What the docstrings say of nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""
    for name, stage in corpus_pipeline.STAGES:
        assert not stage(spark, nothing, "").collect()
        out = stage(spark, messy, "")
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if name != "bpe encoding":
            assert out.columns == messy.columns and all(r.s == 3 and r.keep == 11 for r in rows)
        if name == "quality classifier":
            assert not {3, 4, 5} & set(ids) and {1, 2, 8} <= set(ids) and ids.count(1) == 2
        elif name == "line dedup":
            assert ids.count(1) == 2 and 2 not in ids and ids.count(None) == 2 and {3, 4, 5, 8} <= set(ids)
        elif name == "near dedup":
            assert ids.count(1) == 2 and not {2, 6} & set(ids) and ids.count(7) == 1 and {3, 4, 5, 8} <= set(ids) and ids.count(None) == 2
        elif name == "source mixing":
            assert len({r.source for r in rows}) == 2  # the null one is a source
        else:
            assert len(rows) == messy.count() and {r.n_tokens for r in rows if r.doc_id == 4} == {0} and {r.n_tokens for r in rows if r.doc_id == 3} == {None}
            assert [r.token_ids for r in rows if r.doc_id == 1][0] == [r.token_ids for r in rows if r.doc_id == 1][1]
