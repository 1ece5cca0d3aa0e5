import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import boxes, grid, paths, tokens
from factloom.operators import neighbours


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def arr(words):
    return F.array(*map(F.lit, words)).cast("array<string>")


def test_ngrams_in_order(spark):
    r = one(spark, a=tokens.ngrams(arr("This is Apple".split()), 1, 2), b=tokens.ngrams(arr(["X"]), 2, 3), c=tokens.ngrams(arr([]), 1, 3), d=tokens.ngrams(arr(["A", "b"]), 1, 2, lower=True))
    assert r.a == ["This", "This is", "is", "is Apple", "Apple"] and r.b == [] and r.c == [] and r.d == ["a", "a b", "b"]


def test_windows(spark):
    w = arr("a b c d e f".split())
    r = one(spark, left=tokens.left_ngrams(w, F.lit(1)), right=tokens.right_ngrams(w, F.lit(3)), both=tokens.sentence_ngrams(w, F.lit(2), F.lit(3)), off=tokens.right_ngrams(w, F.lit(5)))
    assert (r.left, r.right, r.both, r.off) == (["a"], ["e", "f"], ["a", "b", "e", "f"], [])


def test_between_overruns_the_earlier_span(spark):
    w = arr("a b c d e f".split())
    span = lambda a, b: (F.lit(a), F.lit(b))
    r = one(spark, x=tokens.between_ngrams(w, span(0, 0), span(3, 3)), y=tokens.between_ngrams(w, span(3, 3), span(0, 1)), z=tokens.between_ngrams(w, span(2, 2), span(2, 3)))
    assert r.x == ["b", "c"] and r.y == ["c", "d"] and r.z == []


def test_marks(spark):
    w = arr("a b c d".split())
    r = one(spark, m=tokens.mark(w, F.lit(1), F.lit(2), 1), p=tokens.mark_pair(w, (F.lit(0), F.lit(0)), (F.lit(2), F.lit(3))))
    assert r.m == ["a", "~~[[1", "b", "c", "1]]~~", "d"]
    assert r.p == ["~~[[1", "a", "1]]~~", "b", "~~[[2", "c", "d", "2]]~~"]


def test_sets(spark):
    r = one(spark, o=tokens.overlap(arr("ab"), arr("bc")), n=tokens.overlap(arr("ab"), arr("cd")), s=tokens.is_superset(arr("abc"), arr("ca")), t=tokens.is_superset(arr("ab"), arr("ac")))
    assert (r.o, r.n, r.s, r.t) == (True, False, True, False)


CASES = [((1, 1), (1, 1)), ((1, 2), (3, 4)), ((3, 4), (1, 2)), ((1, 5), (2, 3)), ((0, 0), (4, 9)), ((7, 9), (2, 3))]


def test_range_difference_is_the_enumerated_one(spark):
    rng = random.Random(1)
    cases = CASES + [tuple((a, a + rng.randint(0, 3)) for a in (rng.randint(0, 6), rng.randint(0, 6))) for _ in range(60)]
    rows = [(i, *a, *b) for i, (a, b) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, a int, b int, c int, d int")
    pair = [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]
    for r in df.select("i", grid.min_range_diff(pair).alias("x"), grid.min_range_diff(pair, absolute=False).alias("y")).collect():
        assert r.x == grid.enumerate_diff(cases[r.i]) and r.y == grid.enumerate_diff(cases[r.i], absolute=False)
    assert grid.enumerate_diff(((1, 2), (3, 4)), absolute=False) == -1


def test_chains_of_ranges_in_size(spark):
    for case in itertools.islice(itertools.product(((0, 1), (2, 4), (5, 5)), repeat=3), 27):
        got = one(spark, x=grid.min_range_diff([(F.lit(a), F.lit(b)) for a, b in case])).x
        assert got == grid.enumerate_diff(case)


def test_spans_keep_their_sign(spark):
    cell = F.struct(F.lit(1).alias("row_start"), F.lit(3).alias("row_end"), F.lit(0).alias("col_start"), F.lit(0).alias("col_end"))
    r = one(spark, a=grid.num_rows(cell), b=grid.num_rows(cell, correct=True), c=grid.num_cols(cell))
    assert (r.a, r.b, r.c) == (-1, 3, 1)


@pytest.mark.parametrize("a, b, common, depth", [("/html/body/p", "/html/body/p", 4, 0), ("/html/body/p", "/html/body/div/p", 3, 1), ("/html/body/div[1]/p", "/html/body/div[2]/p", 3, 2), ("/html", "/html/body", 2, 0)])
def test_paths(spark, a, b, common, depth):
    r = one(spark, c=paths.common_ancestor(F.lit(a), F.lit(b)), d=paths.lowest_common_ancestor_depth(F.lit(a), F.lit(b)))
    assert (len(r.c), r.d) == (common, depth) and r.c[0] == ""


def box(page, top, bottom, left, right):
    return F.struct(*(F.lit(v).alias(k) for k, v in zip(("page", "top", "bottom", "left", "right"), (page, top, bottom, left, right))))


def test_boxes(spark):
    a, b, c = box(1, 0, 10, 0, 10), box(1, 8, 20, 0, 12), box(1, 5, 12, 40, 50)
    r = one(spark, h=boxes.horz_aligned(a, b), g=boxes.horz_aligned(a, c), v=boxes.vert_aligned(a, b), w=boxes.vert_aligned(a, c), x=boxes.vert_aligned_left(a, b), y=boxes.vert_aligned_right(a, b), z=boxes.vert_aligned_center(a, c), n=boxes.horz_aligned(a, F.lit(None).cast("struct<page:int,top:int,bottom:int,left:int,right:int>")))
    assert (r.h, r.g, r.v, r.w, r.x, r.y, r.z, r.n) == (False, True, True, False, True, True, False, False)


GRID = [["Name", "Lunch order", "Spicy", "Owes"], ["Joan", "saag paneer", "medium", "$11"], ["Sally", "vindaloo", "mild", "$14"], ["Erin", "lamb madras", "HOT", "$5"]]


@pytest.fixture(scope="module")
def lunch(spark):
    rows = [(0, 0, r * 4 + c, r * 4 + c, r, r, c, c, t, t.split()) for r, line in enumerate(GRID) for c, t in enumerate(line)]
    return spark.createDataFrame(rows, "doc_id long, table_pos int, sent_pos int, cell_pos int, row_start int, row_end int, col_start int, col_end int, text string, words array<string>").cache()


def mention(lunch, text, first, last):
    return lunch.where(F.col("text") == text).withColumns({"m": F.lit(1), "sentence_words": F.col("words"), "word_start": F.lit(first), "word_end": F.lit(last)})


def grams(df):
    return sorted(r.ngram for r in df.collect())


def test_lookups_in_a_grid(lunch):
    saag = mention(lunch, "saag paneer", 0, 0)
    assert grams(neighbours.cell_ngrams(saag, lunch)) == ["paneer"]
    got = {(r.ngram, r.direction) for r in neighbours.neighbour_cells(saag, lunch).collect()}
    assert got == {("paneer", None), ("joan", "LEFT"), ("medium", "RIGHT"), ("lunch", "UP"), ("order", "UP"), ("vindaloo", "DOWN")}
    assert grams(neighbours.row_ngrams(saag, lunch)) == sorted(["paneer", "joan", "medium", "$11"])
    assert grams(neighbours.col_ngrams(saag, lunch)) == sorted("paneer lunch order vindaloo lamb madras".split())
    assert grams(neighbours.head_ngrams(saag, lunch)) == sorted(["joan", "lunch", "order"])
    assert grams(neighbours.head_ngrams(saag, lunch, "col")) == ["lunch", "order"]
    joan, owes = mention(lunch, "Joan", 0, 0), mention(lunch, "Owes", 0, 0)
    assert grams(neighbours.head_ngrams(joan, lunch)) == [] and grams(neighbours.head_ngrams(owes, lunch)) == ["name"]
    assert grams(neighbours.neighbour_cells(joan, lunch).select("ngram")) == []  # the whole sentence: nothing around it


def test_lemmas_of_earlier_lines(spark):
    rows = [(0, i, ["a", f"w{'x' * i}", "7"], (1, 12 * i, 12 * i + 10, 6, 60)) for i in range(3)]
    s = spark.createDataFrame(rows, "doc_id long, sent_pos int, lemmas array<string>, box struct<page:int,top:int,bottom:int,left:int,right:int>")
    got = {r.lemma for r in neighbours.aligned_lemmas(s).where("sent_pos = 1").collect()}
    assert got == {"a", "w", "LEFT_a", "LEFT_w", "RIGHT_a", "RIGHT_w", "CENTER_a", "CENTER_w"}
    assert not neighbours.aligned_lemmas(s).where("sent_pos = 0").count()
