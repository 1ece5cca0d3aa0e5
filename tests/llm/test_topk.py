import numpy as np

from factloom.llm.topk import Lists, top_k


def brute(vectors, k):
    ids = sorted(vectors)
    out = set()
    for q in ids:
        scored = sorted(((-float(np.einsum("ij,j->i", np.array([vectors[v]], float), np.array(vectors[q], float))[0]), v) for v in ids if v != q))
        out |= {(q, v, r) for r, (_, v) in enumerate(scored[:k], 1)}
    return out


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 12))
    x = (centres[rng.integers(0, 4, 300)] + rng.normal(size=(300, 12)) * 0.3).astype(np.float32)
    x[20:30] = x[10]  # ties
    x[40] = 0
    vectors = {int(i): [float(y) for y in v] for i, v in zip(rng.permutation(1000)[:300], x)}
    df = spark.createDataFrame([(i, v, "z") for i, v in vectors.items()], "vec_id long, embedding array<float>, floor string")
    want = brute(vectors, 7)
    for block in (8192, 40):
        got = {(r.query_id, r.neighbour_id, r["rank"]) for r in top_k(df, 7, block=block).collect()}
        assert got == want
    got = {(r.query_id, r.neighbour_id, r["rank"]) for r in top_k(df, 7, block=40, every=10).collect()}
    assert got == {x for x in want if x[0] % 10 == 0}
    monkeypatch.setattr("factloom.llm.topk.QUERIES", 9)  # a block's queries in many groups, few block summaries at once
    monkeypatch.setattr("factloom.llm.topk.SUMMARIES", 3)
    got = {(r.query_id, r.neighbour_id, r["rank"]) for r in top_k(df, 7, block=40, every=10).collect()}
    assert got == {x for x in want if x[0] % 10 == 0}


def test_infinite_coordinates_take_no_part_and_large_ones_do(spark):
    big = 1e9
    rows = [(1, [big, 1.0]), (2, [big, 2.0]), (3, [-big, 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, float("-inf")]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.neighbour_id, r["rank"]) for r in top_k(df, 2).collect()}
    assert got == brute({i: v for i, v in rows if i not in (4, 5)}, 2)


def test_stops_early_where_the_lists_are_steep():
    rng = np.random.default_rng(2)
    x = np.zeros((2000, 4))
    x[:, 0] = np.geomspace(1, 1e-6, 2000)
    x[:, 1:] = rng.normal(size=(2000, 3)) * 1e-9
    lists = Lists(np.arange(2000), x)
    q = np.array([[1.0, 0.0, 0.0, 0.0]])
    ((_, found, _),) = lists.search(q, np.array([-1]), 3, np.array([-np.inf]))
    assert set(found.tolist()) == {0, 1, 2} and lists.read == 1 and lists.scanned == 0


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, q int, id int"
    rows = [(1, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], None, 1), (3, None, 1, 1), (None, [1.0, 1.0], 1, 1), (4, [], 1, 1), (5, [None, 1.0], 1, 1), (6, [1.0, 2.0, 3.0], 1, 1), (7, [0.5, float("nan")], 1, 1)]
    got = {(r.query_id, r.neighbour_id, r["rank"]) for r in top_k(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 2, 1), (2, 1, 1)}
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    assert top_k(spark.createDataFrame(rows[:1], schema)).count() == 0
