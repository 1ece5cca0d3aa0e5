"""How often a query reads its texts, and that the loops over words are compiled; results against plain Python."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import tokens
from factloom.operators import candidates as cand
from factloom.operators import matchers, neighbours, numbering, sentences, spaces, visual

TEXTS = ["This is apple. an Apple  pie\tis This", "one-two a/b@c. x", "the sing. The ring the the king", "   ", "a b c d e. f"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    """The plan as it was run, each stage that was used again left out."""
    df.collect()
    return re.sub(r"(?s)== Initial Plan ==.*", "", df._jdf.queryExecution().toString())


def by_hand(words, n_min, n_max):
    return [(n, i, " ".join(words[i : i + n])) for n in range(n_max, n_min - 1, -1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("matcher", [matchers.RegexMatchSpan("[a-z]+ing"), matchers.Concat(matchers.RegexMatchSpan("the"), matchers.RegexMatchSpan("[a-z]+ing"), left_required=False), matchers.RegexMatchEach("[a-z]+"), matchers.DoNothingMatcher()])
def test_ngrams_are_found_in_a_compiled_loop(spark, matcher):
    s = sentences.simple_sentences(frame(spark))
    found = matchers.ngrams(matcher, s, 1, 3, joined=True)
    assert re.search(r"\*\(\d+\) Generate inline", plan(found))
    slow = matcher.apply(spaces.ngram_mentions(s, 1, 3))
    assert sorted(map(tuple, found.drop("words").collect())) == sorted(map(tuple, slow.drop("words").select(found.drop("words").columns).collect())) != []


@pytest.mark.parametrize("joined", [True, False])
def test_ngrams_by_hand(spark, joined):
    s = sentences.simple_sentences(frame(spark))
    all_of = spaces.ngram_mentions(s, 2, 3, joined=joined)
    assert re.search(r"\*\(\d+\) Generate inline", plan(all_of))
    want = sorted((r.doc_id, r.sent_pos, *x) for r in s.collect() for x in by_hand(r.words, 2, 3))
    assert sorted((r.doc_id, r.sent_pos, r.word_end - r.word_start + 1, r.word_start, r.span_text) for r in all_of.collect()) == want
    texts = {(r.doc_id, r.sent_pos): r.text for r in s.collect()}
    assert all(texts[r.doc_id, r.sent_pos][r.char_start : r.char_end + 1] == r.span_text == " ".join(r.words) for r in all_of.collect())


def test_words_are_the_same_however_they_are_cut(spark):
    odd = ["a b", " a  b ", "a b", "\ta", "a ", "a\nb c", "a\u001cb"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string").select(tokens.split_words(F.col("t")).alias("fast"), F.split(tokens.strip(F.col("t")), tokens.SPACES).alias("slow")).collect()
    assert all(r.fast == r.slow for r in rows)


def test_split_tokens_without_an_exchange(spark):
    got = spaces.ngram_mentions(sentences.simple_sentences(frame(spark)), 1, 2, ("-", "/", "@"), joined=True)
    assert "Exchange" not in plan(got)
    rows = [(r.doc_id, r.sent_pos, r.char_start, r.char_end) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert sorted(r.span_text for r in got.collect() if r.doc_id == 1 and " " not in r.span_text) == ["a", "a/b", "a/b@c", "b", "b@c", "c", "one", "one-two", "two", "x"]


def test_arguments_come_from_one_pass(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/d")
    s = sentences.simple_sentences(spark.read.parquet(f"{tmp_path}/d"))
    lower, ring = matchers.RegexMatchSpan("[a-z]+", ignore_case=False), matchers.RegexMatchSpan("[a-z]+ing")
    a, b = cand.index_each(matchers.ngrams_each([lower, ring], s, 1, 1, joined=True), 2)
    alone = [cand.index_mentions(matchers.ngrams(m, s, 1, 1, joined=True)) for m in (lower, ring)]
    for one, other in zip((a, b), alone):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.select(one.columns).collect())) != []
    spec = lambda x, y, **o: cand.extract(cand.CandidateSpec("r", [x, y], **o)).select("doc_id", F.col("a0.span_text").alias("t0"), F.col("a1.span_text").alias("t1"))
    for options in ({"equal": ("sent_pos",)}, {"nullables": (False, True)}, {}):
        some = ("doc_id", "sent_pos", "char_start", "char_end", "span_text")
        one = spec(a.select(*some), b.select(*some), **options)
        tree = executed(one)
        assert len(re.findall("FileScan parquet", tree[tree.index("== Physical Plan =="):])) == 1
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, spec(*alone, **options).collect()), key=str) != []


def test_nullable_arguments_by_hand(spark):
    m = lambda rows: cand.index_mentions(spark.createDataFrame(rows, "doc_id long, sent_pos int, char_start int, char_end int, span_text string"))
    a, b = m([(0, 0, 0, 0, "a"), (0, 1, 0, 0, "A"), (1, 0, 0, 0, "a"), (None, 0, 0, 0, "n")]), m([(0, 0, 2, 2, "b"), (2, 0, 0, 0, "b"), (None, 0, 2, 2, "m")])
    got = lambda *nullables: sorted(((r.doc_id, r.a0 and r.a0.span_text, r.a1 and r.a1.span_text) for r in cand.extract(cand.CandidateSpec("r", [a, b], nullables=nullables)).collect()), key=str)
    pairs, left, right = [(0, "A", "b"), (0, "a", "b")], [(0, "A", None), (0, "a", None), (1, "a", None)], [(0, None, "b"), (2, None, "b")]
    assert got(False, True) == sorted(pairs + left, key=str)
    assert got(True, False) == sorted(pairs + right, key=str)
    assert got(True, True) == sorted(pairs + left + right, key=str)


def test_numbering_runs_no_job_before(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 1000).cast("string")).alias("k"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = numbering.numbered(rows, "k", "n")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert [r.k for r in out.orderBy("n").collect()] == sorted(f"k{i}" for i in range(1000))
    few = numbering.numbered(rows.where("k < 'k11'").union(spark.createDataFrame([(None,)], "k string")), "k", "n")
    assert [(r.n, r.k) for r in few.orderBy("n").collect()] == list(enumerate([None, *sorted(f"k{i}" for i in range(1000) if f"k{i}" < "k11")]))


def test_aligned_lemmas_in_one_pass(spark, tmp_path):
    rows = [(d, i, ["W%s" % (i % 4), "x", "9"][: 1 + i % 3] if i % 5 else ["long"] * 9, (1 + i // 12, 10 * (i % 6), 10 * (i % 6) + 8, 50 * (i % 2), 50 * (i % 2) + 20 + i % 3)) for d in range(2) for i in range(24)] + [(0, 30, ["null"], (1, None, None, 0, 9)), (0, 3, ["twice"], (1, 30, 38, 50, 70))]
    spark.createDataFrame(rows, "doc_id long, sent_pos int, words array<string>, box struct<page:int,top:int,bottom:int,left:int,right:int>").write.parquet(f"{tmp_path}/d")
    got = neighbours.aligned_lemmas(spark.read.parquet(f"{tmp_path}/d"), lemmas="words")
    tree = plan(got)
    assert len(re.findall("FileScan parquet", tree)) == 1 and len(re.findall("Exchange", tree)) == 1

    def places(box):
        page, top, bottom, left, right = box
        y, x = None if top is None else (top + bottom) / 2, (left + right) / 2
        first = lambda v: (v is not None, v or 0)
        return {"Y": (y, first(x)), "LEFT": (left, first(y)), "RIGHT": (right, first(y)), "CENTER": (x, first(y))}

    want = set()
    for d, i, _, box in rows:
        for e, j, words, other in rows:
            for kind, (k, at) in places(box).items():
                k2, at2 = places(other)[kind]
                if d == e and box[0] == other[0] and k is not None and k == k2 and (at2, j) < (at, i) and len(words) < 7:
                    want |= {(d, i, p + w.lower()) for w in words if w.isalpha() for p in ("", kind + "_")}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_page_ngrams_are_made_once_a_sentence(spark):
    s = spark.createDataFrame([(0, i, ["A", f"b{i}"], (1, 0, 10, 0, 20)) for i in range(3)], "doc_id long, sent_pos int, words array<string>, box struct<page:int,top:int,bottom:int,left:int,right:int>")
    got = neighbours.direction_ngrams(s.withColumn("m", F.col("sent_pos")), s, "horz")
    assert sorted(map(tuple, got.collect())) == sorted((i, g) for i in range(3) for j in range(3) if i != j for g in ("a", f"b{j}"))
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Join") < tree.index("transform(words")


def test_links_go_compressed_and_are_whole(spark, monkeypatch):
    monkeypatch.setattr(visual, "LINKED", 7)
    tokens_of = [(d, i, w) for d in range(4) for i, w in enumerate("a b a c b a d é".split()[: 8 - d])] + [(9, 0, "alone"), (None, 0, "a"), (2, 99, None)]
    page = [(d, 10 * j, w, f"{d}/{j}") for d in range(4) for j, w in enumerate("b a a x a b é".split())] + [(8, 0, "alone", "8"), (None, 0, "a", "n"), (2, 99, None, "n")]
    t = spark.createDataFrame(tokens_of, "doc_id long, token_pos int, word string").repartition(3)
    p = spark.createDataFrame(page, "doc_id long, place int, word string, label string").repartition(3)
    got = visual.link_exact(t, p, ("token_pos",), ("place",))
    assert got.columns == ["doc_id", "word", "token_pos", "place", "label"]
    want = []
    for d in range(4):
        for w in {x[2] for x in tokens_of if x[0] == d and x[2]}:
            mine, theirs = sorted(x[1] for x in tokens_of if x[0] == d and x[2] == w), sorted(x[1:] for x in page if x[0] == d and x[2] == w)
            if len(mine) == len(theirs):
                want += [(d, w, i, j, label) for i, (j, _, label) in zip(mine, theirs)]
    assert sorted(map(tuple, got.collect())) == sorted(want) != []
    tree = plan(got).split("== Initial Plan ==")[-1]
    assert len(re.findall("Exchange hashpartitioning", tree)) == 1 and re.search(r"Exchange hashpartitioning\(doc_id", tree)
    assert visual.link_exact(t.where("false"), p, ("token_pos",), ("place",)).count() == 0


def test_stretches_come_back_as_they_were():
    schema = pa.schema([("d", pa.int64()), ("w", pa.string()), ("i", pa.int32()), ("n", pa.int64()), ("f", pa.float64()), ("s", pa.string())])
    rows = [(2**63 - 1, "a", -(2**31), 1, 0.5, "x"), (-(2**63), "", 2**31 - 1, None, None, None), (0, "éß", 0, 3, 1.0, "y"), (5, "", 7, 3, 1.0, "")]
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
    for part in (batch, batch.slice(1, 2), batch.slice(3), batch.slice(1, 1)):
        assert visual._widened(visual._narrow(part), schema).equals(part)
