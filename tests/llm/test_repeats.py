import random
from collections import defaultdict

import pyarrow as pa
import pytest
from conftest import SCHEMA, prose, row

from factloom.llm import textkit
from factloom.llm.recompress import recompression_repeats
from factloom.llm.suffix_dedup import suffix_repeats
from factloom.llm.textkit import chunks, kgrams, minimisers, word_hashes

BOTH = pytest.mark.parametrize("operator", [suffix_repeats, recompression_repeats])


def brute(rows, least):
    """Words of each document inside a window of ``least`` words that another document has."""
    where = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for a in range(len(w) - least + 1):
            where[tuple(w[a : a + least])].add((i, t))
    covered = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for a in range(len(w) - least + 1):
            if len(where[tuple(w[a : a + least])]) > 1:
                covered[i].update(range(a, a + least))
    return covered


def check(operator, docs, rows, least, recall, **options):
    want, got = brute(rows, least), defaultdict(set)
    texts = dict(rows)
    for r in operator(docs, min_words=least, **options).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= least and r.other_doc_id in texts
    total = sum(map(len, want.values()))
    hit = sum(len(got[d] & want[d]) for d in want)
    assert hit >= recall * total and sum(len(got[d] - want[d]) for d in got) == 0


@BOTH
def test_against_all_windows(spark, operator, plain):
    rows = list(enumerate(plain))
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)
    check(operator, docs, rows, 50, 1.0 if operator is suffix_repeats else 0.95)
    ids = {r.doc_id for r in operator(docs).collect()}
    assert set(range(20, 26)) | set(range(60, 70)) <= ids  # the passage and the copies


@BOTH
def test_many_share_a_passage_with_other_surroundings(spark, operator):
    rng = random.Random(9)
    passages = [" ".join(prose(rng, 55, 99).split()) for _ in range(4)]
    rows = [(i, " ".join([prose(rng, rng.randint(0, 60), 99), rng.choice(passages), rng.choice([" ".join(passages[0].split()[:30]), ""]), prose(rng, rng.randint(0, 60), 99)])) for i in range(200)]
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(7)
    check(operator, docs, rows, 50, 1.0 if operator is suffix_repeats else 0.95)
    check(operator, docs, rows, 50, 1.0 if operator is suffix_repeats else 0.95, hot=20)  # every popular name by Spark's groupings


@BOTH
def test_edges(operator, messy, nothing):
    out = operator(messy)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "start_word", "end_word", "n_words", "other_doc_id", "other_start_word"]
    assert {1, 2, 6} <= ids and not ids & {3, 4, 5, 7, 8, 10, None}
    assert operator(nothing).count() == 0


@BOTH
def test_partners_far_along_the_order(spark, operator):
    rng = random.Random(4)
    flat = lambda n: " ".join(prose(rng, n, 99).split())
    # a long document holds a passage many times in other surroundings, another document once
    passage = flat(60)
    rows = [(0, " ".join(x for _ in range(40) for x in (flat(25), passage))), (1, " ".join((flat(30), passage, flat(30))))]
    # pairs share 20 words before a passage of 40 that many documents have
    common = flat(40)
    for i in range(10, 30, 2):
        own = flat(20)
        rows += [(j, " ".join((flat(30), own, common, flat(30)))) for j in (i, i + 1)]
    rows += [(i, " ".join((flat(30), common, flat(30)))) for i in range(100, 400)]
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(5)
    check(operator, docs, rows, 50, 1.0 if operator is suffix_repeats else 0.98)


@BOTH
def test_periodic_texts_of_different_lengths(spark, operator):
    rng = random.Random(8)
    flat = lambda n: " ".join(prose(rng, n, 99).split())
    rows = []
    for k, period in enumerate((["junk"], ["home", "about", "news"], ["a", "b", "c", "d", "e"])):
        for j, words in enumerate((90, 120, 400)):
            rows.append((10 * k + j, " ".join([flat(20), *(period * words)[:words], flat(20)])))
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(3)
    check(operator, docs, rows, 50, 0.98)


def test_hot_names_give_what_others_give(spark):
    rng = random.Random(5)
    passage = " ".join(prose(rng, 80, 99).split())
    rows = [(i, " ".join([prose(rng, rng.randint(0, 40), 99), passage if i % 3 else "", prose(rng, rng.randint(0, 40), 99)])) for i in range(60)]
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(5)
    spans = [{(r.doc_id, r.start_word, r.end_word) for r in suffix_repeats(docs, hot=h).collect()} for h in (1, 1 << 14)]
    assert spans[0] == spans[1] and len(spans[0]) == 40


def test_long_texts_are_taken_in_parts(monkeypatch):
    """Parts of a giant text, small ones here, change nothing."""
    rng = random.Random(6)
    (chunk,) = chunks(pa.array([" ".join(prose(rng, 3000, 99).split()) + "\n" + "x" * 500 + " end"]))
    whole, first = word_hashes(chunk)
    grams, _ = kgrams(whole, first, 18)
    want = minimisers(grams, first, 18, 33)
    monkeypatch.setattr(textkit, "PART", 300)
    monkeypatch.setattr(textkit, "CHUNK", 64)
    assert (word_hashes(chunk)[0] == whole).all() and (word_hashes(chunk)[1] == first).all()
    for span in (100, 517):
        monkeypatch.setattr(textkit, "SPAN", span)
        assert (minimisers(grams, first, 18, 33) == want).all()
    # rows end within parts
    (many,) = chunks(pa.array([" ".join(prose(rng, rng.randint(0, 200), 99).split()) for _ in range(20)]), 1 << 20)
    h, f = word_hashes(many)
    grams, _ = kgrams(h, f, 5)
    monkeypatch.setattr(textkit, "SPAN", 1 << 22)
    want = minimisers(grams, f, 5, 9)
    monkeypatch.setattr(textkit, "SPAN", 150)
    assert (minimisers(grams, f, 5, 9) == want).all()


@BOTH
def test_a_hot_phrase_in_many_surroundings(spark, operator):
    """A phrase of a hot name: found on either side of it, with the least partner, and without a row a split unless half a stretch is hot too."""
    rng = random.Random(12)
    flat = lambda n: " ".join(prose(rng, n, 99).split())
    phrase, ahead, behind, around = flat(12), flat(45), flat(45), (flat(25), flat(25))
    rows = [(i, " ".join((flat(50), phrase, flat(50)))) for i in range(100, 160)]
    for k, (a, b) in enumerate((("", ahead), (behind, ""), around)):
        rows += [(10 * k + j, " ".join((flat(30), a, phrase, b, flat(30)))) for j in range(4)]
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(5)
    found = [{tuple(r) for r in operator(docs, hot=h).collect()} for h in (1 << 14, 20, 2)]
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {10 * k + j for k in range(3) for j in range(4)}
    assert {r[0]: r[4] for r in found[0]} == {10 * k + j: 10 * k + (j == 0) for k in range(3) for j in range(4)}
