import random
from collections import Counter

import pytest
from conftest import SCHEMA, prose, row

from factloom.llm.mixing import BUCKETS, UNIT, mix_sources, mix_sql


def corpus(spark, n=400):
    rng = random.Random(4)
    rows = [row(rng.choice([i, i + BUCKETS * 3, -i - 1]), prose(rng, rng.randint(1, 60)), rng.choice("aaaaaabbc")) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_shares_and_counts(spark):
    docs, rows = corpus(spark)
    size, number = Counter(), Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(t)
        number[s] += 1
    for weights, budget in ((None, None), ({"a": 1.0, "b": 3.0}, 2 * sum(size.values())), ({"c": 1.0}, 10.0)):
        out = mix_sources(docs, weights, budget, copy="copy").collect()
        made, per = Counter(r.source for r in out), Counter((r.doc_id, r.text) for r in out)
        w = weights or dict.fromkeys(size, 1.0)
        for s in size:
            rate = w.get(s, 0) / sum(w.values()) * (budget or sum(size.values())) / size[s]
            assert abs(made[s] - rate * number[s]) < 1 + number[s] / UNIT  # systematic: within one of the expectation
            for r in rows:
                if r[3] == s:
                    assert abs(per[r[0], r[1]] - rate * sum(x[:2] == r[:2] for x in rows)) < 2
    assert mix_sources(docs, {}).count() == 0


def test_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs, _ = corpus(spark)
    docs.dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(con.execute(mix_sql()).fetchall())
    assert sorted((r.doc_id, r.source, r.text, r.copy) for r in mix_sources(docs, copy="copy").collect()) == want


def test_edges(messy, nothing):
    out = mix_sources(messy, budget=3e6)
    assert out.columns == messy.columns and out.where("source is null").count() > 0
    doubled = mix_sources(messy, copy="copy", budget=3e6)
    assert sorted(doubled.columns) == sorted(messy.columns) and doubled.agg({"copy": "max"}).first()[0] > 1
    assert mix_sources(nothing).count() == 0
    assert mix_sources(messy.where("text is null")).count() == 0  # no characters, no share
