import random

import pytest
from conftest import SCHEMA, prose, row

from factloom.llm.line_dedup import line_dedup, patience, removed_lines


def brute(rows):
    """Line by line, without hashes, pairs or alignments: what an earlier document has goes, and the blank lines after it."""
    out = []
    units = {(i, t) for i, t in rows if i is not None and t is not None}
    digest = {}  # documents of one id are told apart by digest, so tests have one text an id where lines are shared
    first = {}
    for i, t in units:
        digest.setdefault(i, t)
        for x in t.split("\n"):
            first[x] = min(first.get(x, i), i)
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        kept, lost, n = [], False, 0
        for x in t.split("\n"):
            if x.strip(" \t\x0b\f\r"):
                lost = first[x] < i
            if lost:
                n += 1
            else:
                kept.append(x)
        if not n or "\n".join(kept).strip():
            out.append((i, "\n".join(kept) if n else t))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")


def test_patience_is_a_common_chain():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert patience([1, 9, 2, 3], [1, 2, 8, 3]) == [(0, 0), (2, 1), (3, 3)]


def test_every_common_line_goes():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert removed_lines(a, b) == [j for j, x in enumerate(b) if x and x in a]
    assert removed_lines(list(range(1, 30)), list(range(29, 0, -1))) == list(range(29))  # in no common order at all


def test_against_all_pairs(spark):
    rng = random.Random(7)
    blocks = [[prose(rng, 6, 6) for _ in range(rng.randint(1, 4))] for _ in range(12)] + [["All rights reserved.", "", " ", "ok"], ["日本"], ["-"]]
    rows = []
    for i in range(90):
        lines = [x for _ in range(rng.randint(0, 4)) for x in ([prose(rng, 5, 5)] if rng.random() < 0.4 else [""] if rng.random() < 0.2 else rng.choice(blocks))]
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[5][1] + "\n" + "\n".join(reversed(rows[6][1].split("\n"))))]
    docs = spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(5)
    got = [(r.doc_id, r.text) for r in line_dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_a_line_that_most_documents_hold(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join([prose(rng, 5, 5), "the licence of all of these", prose(rng, 5, 5)] * rng.randint(1, 3))) for i in range(400)]
    docs = spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(6)
    out = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert "licence" in out[0] and not any("licence" in t for i, t in out.items() if i)


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        line_dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_edges(messy, nothing):
    out = line_dedup(messy, removed="n_removed")
    assert out.columns == [*messy.columns, "n_removed"]
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 2 and 2 not in ids  # a repeated row stays twice, the copy goes
    assert ids.count(None) == 2 and {3, 4, 5, 7, 8, 9, 11} <= set(ids)
    (six,) = [r for r in rows if r.doc_id == 6]
    assert six.text == "x" and six.n_chars == 1 and six.n_removed > 0
    assert line_dedup(nothing).count() == 0
