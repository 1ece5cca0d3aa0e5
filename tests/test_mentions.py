import pytest
from pyspark.sql import functions as F

from factloom.operators import candidates as cand
from factloom.operators import matchers, sentences, spaces


def sents(spark, *texts):
    return sentences.simple_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def spans(df):
    return sorted(r.span_text for r in df.collect())


def test_sentences(spark):
    rows = sents(spark, "One two.  Three\nfour . . ", None, "", " five").orderBy("doc_id", "sent_pos").collect()
    assert [(r.doc_id, r.sent_pos, r.text, r.char_offsets) for r in rows] == [(0, 0, "One two", [0, 4]), (0, 1, "Three four", [0, 6]), (3, 0, "five", [0])]
    ids = [r.stable_id for r in sentences.with_stable_ids(sents(spark, "One two. Three")).orderBy("sent_pos").collect()]
    assert ids == ["0::sentence:0:7", "0::sentence:7:12"]


def test_batches_stay_below_the_limit(spark):
    got = [r.batch for r in sentences.split_by_limit(sents(spark, "aaaa. bbb. cc. d. eeeeeeeeeeee. f"), 8).orderBy("sent_pos").collect()]
    assert got == [0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize("text, tokens, n", [("New-Text", ("-", "/"), 3), ("New/Text-Word", ("-", "/"), 6), ("A-B/C-D", ("-", "/"), 10), ("a~b~~c~d", ("~", "~~"), 10), ("New-", ("-",), 2)])
def test_split_tokens(spark, text, tokens, n):
    got = spaces.ngram_mentions(sents(spark, text), 1, 1, tokens)
    assert got.count() == n
    assert spans(got)[0] and all(r.span_text == text[r.char_start : r.char_end + 1] for r in got.collect())


def test_split_places_count_from_the_sentence(spark):
    s = sents(spark, "see New-Text")
    assert "Text" in spans(spaces.ngram_mentions(s, 1, 1, ("-",))) and "Text" not in spans(spaces.ngram_mentions(s, 1, 1, ("-",), legacy_split_offsets=True))


@pytest.fixture(scope="module")
def apple(spark):
    return spaces.ngram_mentions(sents(spark, "This is apple"), 1, 2).cache()


def test_order_and_bounds(apple, spark):
    rows = apple.orderBy("ord").collect()
    assert [r.span_text for r in rows] == ["This is", "is apple", "This", "is", "apple"]
    (r,) = spaces.ngram_mentions(sents(spark, "BC548BG"), 1, 3).collect()
    assert (r.char_start, r.char_end) == (0, 6)


def test_matchers(apple):
    d = lambda *w, **o: matchers.DictionaryMatch(list(w), **o)
    no = {"longest_match_only": False}
    assert spans(d("this").apply(apple)) == ["This"]
    assert spans(d("this", ignore_case=False).apply(apple)) == []
    assert spans(d("this", inverse=True).apply(apple)) == ["This is", "is apple"]
    assert spans(matchers.Union(d("this", "this is"), d("is apple", "apple")).apply(apple)) == ["This is", "is apple"]
    assert spans(matchers.Union(d("this", "this is"), d("is apple", "apple"), **no).apply(apple)) == ["This", "This is", "apple", "is apple"]
    assert spans((d("this", "apple") & d("apple")).apply(apple)) == ["apple"]
    assert spans((~d("apple", "is apple")).apply(apple)) == ["This is"]
    assert spans(matchers.Concat(d("this"), d("is")).apply(apple)) == ["This is"]
    assert spans(matchers.Concat(d("is"), d("this")).apply(apple)) == []
    assert spans(matchers.Concat(d("is"), d("this"), permutations=True).apply(apple)) == ["This is"]
    assert spans(matchers.Concat(d("this"), d("is"), left_required=False, **no).apply(apple)) == ["This is", "is"]
    assert spans(matchers.Concat(d("this"), d("is"), ignore_sep=False, sep="-").apply(apple)) == []
    assert spans(matchers.RegexMatchSpan("isapple", sep=" ").apply(apple)) == ["is apple"]
    assert spans(matchers.RegexMatchSpan("app").apply(apple)) == []
    assert spans(matchers.RegexMatchSpan("app", full_match=False, **no).apply(apple)) == ["apple"]
    assert spans(matchers.RegexMatchSpan("PP", search=True, full_match=False, **no).apply(apple)) == ["apple", "is apple"]
    assert spans(matchers.RegexMatchEach("[a-z]+", ignore_case=False).apply(apple)) == ["is apple"]
    assert spans(matchers.LambdaFunctionMatcher(lambda s: F.length(s.text) == 4).apply(apple)) == ["This"]
    assert spans(matchers.DoNothingMatcher().apply(apple)) == ["This is", "is apple"]
    assert spans(matchers.DictionaryMatch(["thi"], stemmer=lambda c: F.regexp_replace(c, "s$", "")).apply(apple)) == ["This"]


def test_dictionary_table(spark, apple):
    words = spark.createDataFrame([("APPLE",), ("is",), (None,)], "w string")
    assert spans(matchers.DictionaryMatch(words).apply(apple)) == ["apple", "is"]
    assert spans(matchers.DictionaryMatch(words, inverse=True, longest_match_only=False).apply(apple)) == ["This", "This is", "is apple"]


def test_named_entities(spark):
    s = sents(spark, "Tim Cook has 100 million").withColumn("ner_tags", F.array(*map(F.lit, ["PERSON", "PERSON", "", "CARDINAL", "CARDINAL"])))
    m = spaces.ngram_mentions(s, 1, 2, attributes=("words", "ner_tags"))
    assert spans(matchers.PersonMatcher().apply(m)) == ["Tim Cook"] and spans(matchers.NumberMatcher().apply(m)) == ["100 million"]
    assert spans(matchers.LocationMatcher().apply(m)) == []


def test_window_rule_is_the_anti_join(spark):
    m = spaces.ngram_mentions(sents(spark, "a bb ccc dd e ff g", "x y z"), 1, 4).where("length(span_text) % 3 <> 1")
    assert spans(matchers.longest(m)) == spans(matchers.longest(m, ngrams_only=False))


def test_figures(spark):
    f = spark.createDataFrame([(0, 0, "a.PNG"), (0, 1, "b.jpg"), (0, 2, None)], "doc_id long, figure_pos int, url string")
    assert spaces.figure_mentions(f).count() == 3
    assert [r.position for r in spaces.figure_mentions(f, "png").collect()] == [0]
    assert spaces.figure_mentions(f, ["png", "jpg"]).count() == 2


def test_implicit_spans(apple):
    out = spaces.expand(apple.where("span_text = 'apple'"), F.array(F.lit("apple pie"), F.lit("apples")))
    assert [(r.expansion, r.span_text, r.words) for r in out.orderBy("expansion").collect()] == [(0, "apple pie", ["apple", "pie"]), (1, "apples", ["apples"])]


def listed(spark, texts, *words):
    m = spaces.ngram_mentions(sents(spark, *texts), 1, 2)
    return cand.index_mentions(m.where(F.col("span_text").isin(*words)))


def got(df, n=2):
    return sorted((tuple(r[f"a{i}"].span_text if r[f"a{i}"] else None for i in range(n)) for r in df.collect()), key=str)


def test_candidates(spark):
    texts = ["a b. b c", "a c", "z"]
    a, b = listed(spark, texts, "a", "b"), listed(spark, texts, "c", "b c")
    spec = lambda *args, **o: cand.extract(cand.CandidateSpec("r", list(args), **o))
    full = spec(a, b, nested_relations=True)
    assert full.count() == 3 * 2 + 1
    assert ("b", "b c") in got(spec(a, b)) and len(got(spec(a, b))) == 6  # b of sentence 1 lies in b c
    assert got(spec(a, b, equal=("sent_pos",))) == [("a", "c"), ("b", "c")]
    assert got(spec(a, b, throttler=lambda x, y: (x["sent_pos"] == 0) & (y["span_text"] == "c"))) == [("a", "c"), ("a", "c"), ("b", "c")]
    assert len(got(spec(a, a))) == 6 and len(got(spec(a, a, self_relations=True, nested_relations=True))) == 10
    assert len(got(spec(a, a, symmetric_relations=False))) == 3
    nullable = got(spec(a, b, nullables=(False, True)))
    assert len(nullable) == len(got(spec(a, b))) + 4 and ("a", None) in nullable
    assert len(got(spec(a, b, a), 3)) == 3 * 2 * 3 + 1
    once = cand.with_ids(full, "r", 2)
    assert cand.new_only(once, once.where("doc_id = 0")).count() == 1 and once.select("candidate_id").distinct().count() == 7
    split = cand.with_split(once, F.col("doc_id"))
    docs = spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")
    assert [r.doc_id for r in cand.docs_from_split(split, docs, 1).collect()] == [1]
    assert cand.get_candidates(split, split=1, sort=True).count() == 1 and cand.get_candidates(split, docs=docs.where("doc_id = 0")).count() == 6
