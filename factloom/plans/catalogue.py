"""Queries over the driver's tables, one or more an operator, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import tokens
from factloom.operators import candidates as cand
from factloom.operators import html, matchers, neighbours, sentences, spaces
from factloom.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sents(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.simple_sentences(read(spark, sf, "documents"))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.explode(F.split(tokens.strip(F.col("text")), tokens.SPACES)).alias("w")).select(F.lower("w").alias("w")).distinct()


WITH = r"""WITH p0 AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '\S')) AS ps FROM documents),
p1 AS (SELECT doc_id, unnest(range(len(ps)))::INT AS sent_pos, unnest(ps) AS piece FROM p0),
sent AS MATERIALIZED (SELECT doc_id, sent_pos, string_split_regex(trim(piece, E' \n\t\r'), '\s+') AS words FROM p1),
dict AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split_regex(trim(text, E' \n\t\r'), '\s+')) AS w FROM benchmark)) """


def with_ngrams(n_max: int) -> str:
    return WITH + rf""", n0 AS (SELECT *, unnest(range(1, {n_max} + 1)) AS n FROM sent),
n1 AS (SELECT *, unnest(range(0, len(words) - n + 1)) AS i FROM n0 WHERE n <= len(words)),
ng AS (SELECT doc_id, sent_pos, words, n::INT AS n, i::INT AS word_start, (i + n - 1)::INT AS word_end, array_to_string(words[i + 1:i + n], ' ') AS span_text,
  (CASE WHEN i = 0 THEN 0 ELSE len(array_to_string(words[1:i], ' ')) + 1 END)::INT AS char_start FROM n1),
m AS (SELECT *, (char_start + len(span_text) - 1)::INT AS char_end FROM ng) """


SPAN = ["doc_id", "sent_pos", "char_start", "char_end", "span_text"]
SPANS = "doc_id, sent_pos, char_start, char_end, span_text"


def longest_sql(where: str, n_max: int = 2) -> str:
    return with_ngrams(n_max) + f""", k AS (SELECT *, max(char_end) OVER (PARTITION BY doc_id, sent_pos ORDER BY char_start, char_end DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m WHERE {where})
SELECT {SPANS} FROM k WHERE reach IS NULL OR reach < char_end"""


# scans and parsing


@query(WITH + "SELECT doc_id, sent_pos, array_to_string(words, ' ') AS text, len(words)::INT AS n_words FROM sent")
def scan_text_sentences(spark, sf):
    return sents(spark, sf).select("doc_id", "sent_pos", "text", F.size("words").alias("n_words"))


@query(WITH + ", t AS (SELECT doc_id, sent_pos, words, unnest(range(len(words)))::INT AS i FROM sent) SELECT doc_id, sent_pos, i AS token_pos, words[i + 1] AS token, (CASE WHEN i = 0 THEN 0 ELSE len(array_to_string(words[1:i], ' ')) + 1 END)::INT AS char_offset FROM t")
def sentence_tokens(spark, sf):
    rows = sents(spark, sf).select("doc_id", "sent_pos", F.posexplode(F.arrays_zip("words", "char_offsets")).alias("token_pos", "t"))
    return rows.select("doc_id", "sent_pos", "token_pos", F.col("t.words").alias("token"), F.col("t.char_offsets").alias("char_offset"))


@query(WITH + ", s AS (SELECT doc_id, sent_pos, array_to_string(words, ' ') AS text FROM sent), a AS (SELECT *, coalesce(sum(len(text)) OVER (PARTITION BY doc_id ORDER BY sent_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM s) SELECT doc_id, sent_pos, doc_id || '::sentence:' || b || ':' || (b + len(text)) AS stable_id FROM a")
def sentence_stable_ids(spark, sf):
    return sentences.with_stable_ids(sents(spark, sf)).select("doc_id", "sent_pos", "stable_id")


@query("""WITH b AS (SELECT (o_orderkey // 16)::BIGINT AS doc_id, (o_orderkey % 16 + 1)::INT AS r, [o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority] AS v FROM orders),
c AS (SELECT doc_id, r, unnest(range(4))::INT AS c, unnest(v) AS text FROM b),
h AS (SELECT doc_id, 0 AS r, unnest(range(4))::INT AS c, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']) AS text FROM (SELECT DISTINCT doc_id FROM b))
SELECT doc_id, (r * 4 + c)::INT AS cell_pos, r AS row_start, c AS col_start, text FROM (SELECT * FROM h UNION ALL SELECT * FROM c)""")
def scan_csv_grid(spark, sf):
    return adapters.order_grid(read(spark, sf, "orders")).select("doc_id", "cell_pos", "row_start", "col_start", "text")


@query()
def html_parse(spark, sf):
    parsed = html.parse_html(read(spark, sf, "pages"), "page_id")
    return parsed.select("doc_id", "kind", "pos", "stable_id", "text")


@query()
def html_tags(spark, sf):
    return html.contexts(html.parse_html(read(spark, sf, "pages"), "page_id"), "sentence").select("doc_id", "sent_pos", "xpath", "html_tag", F.array_join("html_attrs", "|").alias("attrs"))


@query()
def html_siblings_ancestors(spark, sf):
    s = html.contexts(html.parse_html(read(spark, sf, "pages"), "page_id"), "sentence")
    return s.select("doc_id", "sent_pos", "parent_tag", *(F.array_join(c, " ").alias(c) for c in ("prev_sib_tags", "next_sib_tags", "anc_tags", "anc_classes", "anc_ids")))


@query()
def html_errors(spark, sf):
    return html.contexts(html.parse_html(read(spark, sf, "pages"), "page_id"), "error")


# mention spaces


@query(with_ngrams(3) + f"SELECT {SPANS}, word_start, word_end FROM m")
def ngrams_all(spark, sf):
    return spaces.ngram_mentions(sents(spark, sf), 1, 3, joined=True).select(*SPAN, "word_start", "word_end")


@query(WITH + r""", t AS (SELECT DISTINCT doc_id, sent_pos, words, unnest(range(len(words))) AS i FROM sent),
o AS (SELECT doc_id, sent_pos, words[i + 1] AS w, (CASE WHEN i = 0 THEN 0 ELSE len(array_to_string(words[1:i], ' ')) + 1 END) AS o FROM t),
b AS (SELECT *, list_concat([0], list_transform(list_filter(range(1, len(w) + 1), lambda x: w[x:x] IN ('-', '/', '@')), lambda x: x)) AS s, list_concat(list_transform(list_filter(range(1, len(w) + 1), lambda x: w[x:x] IN ('-', '/', '@')), lambda x: x - 1), [len(w)]) AS e FROM o),
f AS (SELECT doc_id, sent_pos, w, o, unnest(s) AS s, e FROM b), g AS (SELECT doc_id, sent_pos, w, o, s, unnest(e) AS e FROM f),
u AS (SELECT DISTINCT doc_id, sent_pos, (o + s)::INT AS char_start, (o + e - 1)::INT AS char_end, w[s + 1:e] AS span_text FROM g WHERE s < e UNION SELECT doc_id, sent_pos, o::INT, (o + len(w) - 1)::INT, w FROM o) SELECT """ + SPANS + " FROM u")
def ngrams_split_tokens(spark, sf):
    return spaces.ngram_mentions(sents(spark, sf), 1, 1, ("-", "/", "@"), joined=True).select(*SPAN)


@query(WITH + "SELECT doc_id, sent_pos, 0 AS char_start, (len(array_to_string(words, ' ')) - 1)::INT AS char_end, array_to_string(words, ' ') AS span_text FROM sent")
def mention_sentences(spark, sf):
    return spaces.sentence_mentions(sents(spark, sf)).select(*SPAN)


@query("SELECT conv_id AS doc_id, 'paragraph' AS context_type, turn AS position FROM conversations")
def mention_paragraphs(spark, sf):
    return spaces.context_mentions(read(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id"), "paragraph", "turn")


@query("SELECT (o_orderkey // 16)::BIGINT AS doc_id, 'cell' AS context_type, ((o_orderkey % 16 + 1) * 4 + c)::INT AS position FROM orders, range(4) t(c) UNION ALL SELECT d, 'cell', c::INT FROM (SELECT DISTINCT (o_orderkey // 16)::BIGINT AS d FROM orders), range(4) t(c)")
def mention_cells(spark, sf):
    return spaces.context_mentions(adapters.order_grid(read(spark, sf, "orders")), "cell", "cell_pos")


@query("SELECT DISTINCT (o_orderkey // 16)::BIGINT AS doc_id, 'table' AS context_type, 0 AS position FROM orders")
def mention_tables(spark, sf):
    return spaces.context_mentions(adapters.order_grid(read(spark, sf, "orders")).select("doc_id", "table_pos").distinct(), "table", "table_pos")


@query("SELECT doc_id, 'document' AS context_type, 0 AS position FROM documents")
def mention_documents(spark, sf):
    return spaces.context_mentions(read(spark, sf, "documents").select("doc_id", F.lit(0).alias("position")), "document", "position")


@query()
def mention_sections(spark, sf):
    return spaces.context_mentions(html.contexts(html.parse_html(read(spark, sf, "pages"), "page_id"), "section"), "section", "section_pos")


@query()
def mention_figures(spark, sf):
    return spaces.figure_mentions(html.contexts(html.parse_html(read(spark, sf, "pages"), "page_id"), "figure"), ["png", "jpg"])


@query()
def mention_captions(spark, sf):
    return spaces.context_mentions(html.contexts(html.parse_html(read(spark, sf, "pages"), "page_id"), "caption"), "caption", "caption_pos")


# matchers


def bigrams(spark, sf):
    return spaces.ngram_mentions(sents(spark, sf), 1, 2, joined=True)


def matching(matcher, spark, sf, n_max=2):
    return matchers.ngrams(matcher, sents(spark, sf), 1, n_max, joined=True).select(*SPAN)


@query(longest_sql("lower(span_text) IN (SELECT w FROM dict)"))
def match_dictionary(spark, sf):
    return matchers.DictionaryMatch(dictionary(spark, sf)).apply(bigrams(spark, sf)).select(*SPAN)


@query(longest_sql("lower(span_text) NOT IN (SELECT w FROM dict)", 1))
def match_dictionary_inverse(spark, sf):
    return matchers.DictionaryMatch(dictionary(spark, sf), inverse=True).apply(spaces.ngram_mentions(sents(spark, sf), 1, 1, joined=True)).select(*SPAN)


@query(longest_sql("regexp_matches(span_text, '^(?i:[a-z]+ing)$')"))
def match_regex_span(spark, sf):
    return matching(matchers.RegexMatchSpan("[a-z]+ing"), spark, sf)


@query(longest_sql("regexp_matches(replace(span_text, ' ', ''), '^(?i:thethe[a-z]*)$')"))
def match_regex_span_sep(spark, sf):
    return matching(matchers.RegexMatchSpan("thethe[a-z]*", sep=" "), spark, sf)


@query(longest_sql("regexp_matches(span_text, '[0-9]{3}')"))
def match_regex_search(spark, sf):
    return matching(matchers.RegexMatchSpan("[0-9]{3}", search=True, full_match=False), spark, sf)


@query(longest_sql("len(list_filter(words[word_start + 1:word_end + 1], lambda w: NOT regexp_matches(w, '^(?i:[a-z]{9,})$'))) = 0"))
def match_regex_each(spark, sf):
    return matching(matchers.RegexMatchEach("[a-z]{9,}"), spark, sf)


def tagged(spark, sf):
    """Sentences with tags put on by rule, as a tagger would: capitals are persons, digits numbers."""
    tag = lambda w: F.when(~w.rlike("^[A-Z0-9]"), "").when(w.rlike("^[0-9]+$"), "CARDINAL").when(w.rlike("^[A-Z][a-z]+$"), "PERSON").otherwise("")
    return sents(spark, sf).withColumn("ner_tags", F.transform("words", tag))


@query(longest_sql("len(list_filter(words[word_start + 1:word_end + 1], lambda w: NOT regexp_matches(w, '^[A-Z][a-z]+$'))) = 0"))
def match_ner(spark, sf):
    return matchers.ngrams(matchers.PersonMatcher(), tagged(spark, sf), 1, 2, ("words", "ner_tags"), joined=True).select(*SPAN)


@query(longest_sql("len(list_filter(words[word_start + 1:word_end + 1], lambda w: NOT regexp_matches(w, '^[0-9]+$'))) = 0"))
def match_ner_number(spark, sf):
    return matchers.ngrams(matchers.NumberMatcher(), tagged(spark, sf), 1, 2, ("words", "ner_tags"), joined=True).select(*SPAN)


ING, TH = matchers.RegexMatchSpan("[a-z]+ing"), matchers.RegexMatchSpan("th.*")
ING_SQL, TH_SQL = "regexp_matches(span_text, '^(?i:[a-z]+ing)$')", "regexp_matches(span_text, '^(?i:th.*)$')"


@query(longest_sql(f"({ING_SQL} OR {TH_SQL})"))
def match_union(spark, sf):
    return matching((ING | TH), spark, sf)


@query(longest_sql(f"({ING_SQL} AND {TH_SQL})"))
def match_intersect(spark, sf):
    return matching((ING & TH), spark, sf)


@query(longest_sql(f"NOT {TH_SQL}"))
def match_inverse(spark, sf):
    return matching((~TH), spark, sf)


@query(longest_sql("n = 2 AND regexp_matches(words[word_start + 1], '^(?i:the)$') AND regexp_matches(words[word_end + 1], '^(?i:[a-z]+ing)$')"))
def match_concat(spark, sf):
    return matching(matchers.Concat(matchers.RegexMatchSpan("the"), ING), spark, sf)


@query(longest_sql("(n = 2 AND regexp_matches(words[word_start + 1], '^(?i:the)$') AND regexp_matches(words[word_end + 1], '^(?i:[a-z]+ing)$')) OR regexp_matches(span_text, '^(?i:[a-z]+ing)$')"))
def match_concat_optional(spark, sf):
    return matching(matchers.Concat(matchers.RegexMatchSpan("the"), ING, left_required=False), spark, sf)


@query(longest_sql("len(span_text) >= 12", 3))
def match_longest(spark, sf):
    long = matchers.LambdaFunctionMatcher(lambda s: F.length(s.text) >= 12, longest_match_only=True)
    return matching(long, spark, sf, 3)


@query(with_ngrams(2) + f"SELECT {SPANS} FROM m WHERE len(span_text) % 7 = 0")
def match_lambda(spark, sf):
    return matching(matchers.LambdaFunctionMatcher(lambda s: F.length(s.text) % 7 == 0), spark, sf)


@query(longest_sql("true"))
def match_donothing(spark, sf):
    return matching(matchers.DoNothingMatcher(), spark, sf)


# candidates: a longish word and a capitalised one


LONG, CAPITAL = matchers.RegexMatchSpan("[a-z]{14,}", ignore_case=False), matchers.RegexMatchSpan("[A-Z][a-z]{9,}", ignore_case=False)
AB = """, a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_pos, word_start) - 1 AS x FROM m WHERE regexp_matches(span_text, '^[a-z]{14,}$')),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_pos, word_start) - 1 AS x FROM m WHERE regexp_matches(span_text, '^[A-Z][a-z]{9,}$')) """
PAIR_SQL = "SELECT a.doc_id, a.sent_pos AS s0, a.span_text AS t0, b.sent_pos AS s1, b.span_text AS t1, a.char_start AS c0, b.char_start AS c1 FROM a JOIN b ON a.doc_id = b.doc_id"


def arguments(spark, sf, found_by=(LONG, CAPITAL)):
    """The mentions that each matcher finds, from one pass over the documents."""
    whole = sents(spark, sf).withColumn("sentence_words", F.col("words"))
    return cand.index_each(matchers.ngrams_each(list(found_by), whole, 1, 1, joined=True, carry=("sentence_words",)), len(found_by))


def argument(spark, sf):
    """The first argument's mentions alone."""
    return arguments(spark, sf, (LONG,))[0]


def pairs(spark, sf, **options):
    return cand.extract(cand.CandidateSpec("pair", list(arguments(spark, sf)), **options))


def flat(c, *more):
    return c.select(*more, "doc_id", F.col("a0.sent_pos").alias("s0"), F.col("a0.span_text").alias("t0"), F.col("a1.sent_pos").alias("s1"), F.col("a1.span_text").alias("t1"), F.col("a0.char_start").alias("c0"), F.col("a1.char_start").alias("c1"))


@query(with_ngrams(1) + AB + "SELECT doc_id, sent_pos AS s0, span_text AS t0 FROM a")
def cand_unary(spark, sf):
    c = cand.extract(cand.CandidateSpec("one", [argument(spark, sf)]))
    return c.select("doc_id", F.col("a0.sent_pos").alias("s0"), F.col("a0.span_text").alias("t0"))


@query(with_ngrams(1) + AB + PAIR_SQL)
def cand_binary_product(spark, sf):
    return flat(pairs(spark, sf))


@query(with_ngrams(1) + AB + PAIR_SQL + " AND a.sent_pos = b.sent_pos WHERE len(a.span_text) > len(b.span_text)")
def cand_throttled(spark, sf):
    return flat(pairs(spark, sf, equal=("sent_pos",), throttler=lambda a, b: F.length(a["span_text"]) > F.length(b["span_text"])))


SELF = ", c AS (SELECT * FROM a) " + PAIR_SQL.replace("JOIN b", "JOIN c b").replace("FROM a", "FROM a")


def self_pairs(spark, sf, **options):
    a = argument(spark, sf)
    return cand.extract(cand.CandidateSpec("self", [a, a], **options))


@query(with_ngrams(1) + AB + SELF + " WHERE NOT (a.sent_pos = b.sent_pos AND a.char_start = b.char_start)")
def cand_no_self(spark, sf):
    return flat(self_pairs(spark, sf))


@query(with_ngrams(1) + AB + SELF + " WHERE a.x < b.x")
def cand_symmetric_off(spark, sf):
    return flat(self_pairs(spark, sf, symmetric_relations=False))


@query(with_ngrams(2) + ", a AS (SELECT * FROM m WHERE n = 2 AND regexp_matches(span_text, '^[a-z]{11,} [a-z]+$')), b AS (SELECT * FROM m WHERE n = 1 AND regexp_matches(span_text, '^[a-z]{11,}$')) " + PAIR_SQL + " AND a.sent_pos = b.sent_pos WHERE NOT (a.char_start <= b.char_start AND a.char_end >= b.char_end)")
def cand_no_nested(spark, sf):
    found_by = [matchers.RegexMatchSpan(r, ignore_case=False, longest_match_only=False) for r in ("[a-z]{11,} [a-z]+", "[a-z]{11,}")]
    a, b = cand.index_each(matchers.ngrams_each(found_by, sents(spark, sf), 1, 2, joined=True), 2)
    return flat(cand.extract(cand.CandidateSpec("nested", [a, b], equal=("sent_pos",))))


@query(with_ngrams(1) + AB + ", d AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b) SELECT a.doc_id, a.span_text AS t0, b.span_text AS t1 FROM a JOIN b ON a.doc_id = b.doc_id UNION ALL SELECT a.doc_id, a.span_text, NULL FROM a JOIN d ON a.doc_id = d.doc_id")
def cand_nullable(spark, sf):
    # a mention that may be missing is carried whole: so it has no more columns than are read of the other
    both = [m.select(*SPAN) for m in arguments(spark, sf)]
    return cand.extract(cand.CandidateSpec("pair", both, nullables=(False, True))).select("doc_id", F.col("a0.span_text").alias("t0"), F.col("a1.span_text").alias("t1"))


@query(with_ngrams(1) + AB + "SELECT a.doc_id, a.span_text AS t0, b.span_text AS t1, c.span_text AS t2 FROM a JOIN b ON a.doc_id = b.doc_id AND a.sent_pos = b.sent_pos JOIN a c ON c.doc_id = a.doc_id AND c.sent_pos = a.sent_pos")
def cand_ternary(spark, sf):
    a, b = arguments(spark, sf)
    c = cand.extract(cand.CandidateSpec("three", [a, b, a], equal=("sent_pos",)))
    return c.select("doc_id", *(F.col(f"a{i}.span_text").alias(f"t{i}") for i in range(3)))


@query(with_ngrams(1) + AB + "SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 2 AND doc_id IN (SELECT a.doc_id FROM a JOIN b ON a.doc_id = b.doc_id)")
def cand_split_docs(spark, sf):
    split = cand.with_split(pairs(spark, sf), F.col("doc_id") % 4)
    return cand.docs_from_split(split, read(spark, sf, "documents").select("doc_id", "lang"), 2)


@query(with_ngrams(1) + AB + f"SELECT doc_id, s0, t0, s1, t1, c0, c1 FROM ({PAIR_SQL}) WHERE doc_id % 4 = 1")
def cand_of_split(spark, sf):
    return flat(cand.get_candidates(cand.with_split(pairs(spark, sf), F.col("doc_id") % 4), split=1))


# textual functions


SAME = PAIR_SQL.replace("SELECT a.doc_id", "SELECT a.words AS w, a.word_start AS ws0, a.word_end AS we0, b.word_start AS ws1, b.word_end AS we1, a.doc_id") + " AND a.sent_pos = b.sent_pos"


def joint(spark, sf):
    return pairs(spark, sf, equal=("sent_pos",))


@query(with_ngrams(1) + AB + f"SELECT doc_id, s0, t0, s1, t1, c0, c1, s0 = s1 AS same_sentence FROM ({PAIR_SQL})")
def same_sentence(spark, sf):
    c = pairs(spark, sf)
    return flat(c.withColumn("joint", tokens.same_sentence([F.col("a0"), F.col("a1")])), "joint").withColumnRenamed("joint", "same_sentence")


@query(with_ngrams(1) + AB + f"SELECT doc_id, s0, c0, c1, array_to_string(list_transform(w[least(ws0, ws1) + 2:greatest(ws0, ws1)], lambda x: lower(x)), '|') AS between_words FROM ({SAME})")
def between_ngrams(spark, sf):
    a, b = F.col("a0"), F.col("a1")
    # the sentence of the earlier span: so both arguments read the same columns of one pass
    words = F.when(a["word_start"] < b["word_start"], a["sentence_words"]).otherwise(b["sentence_words"])
    grams = tokens.between_ngrams(words, (a["word_start"], a["word_end"]), (b["word_start"], b["word_end"]))
    return joint(spark, sf).select("doc_id", a["sent_pos"].alias("s0"), a["char_start"].alias("c0"), b["char_start"].alias("c1"), F.array_join(grams, "|").alias("between_words"))


def around(spark, sf):
    return argument(spark, sf)


@query(with_ngrams(1) + AB + "SELECT doc_id, sent_pos, char_start, array_to_string(list_transform(words[greatest(word_start - 3, 0) + 1:word_start], lambda x: lower(x)), '|') AS grams FROM a")
def left_ngrams(spark, sf):
    return around(spark, sf).select("doc_id", "sent_pos", "char_start", F.array_join(tokens.left_ngrams(F.col("sentence_words"), F.col("word_start")), "|").alias("grams"))


@query(with_ngrams(1) + AB + "SELECT doc_id, sent_pos, char_start, array_to_string(list_transform(words[word_end + 2:word_end + 4], lambda x: lower(x)), '|') AS grams FROM a")
def right_ngrams(spark, sf):
    return around(spark, sf).select("doc_id", "sent_pos", "char_start", F.array_join(tokens.right_ngrams(F.col("sentence_words"), F.col("word_end")), "|").alias("grams"))


@query(with_ngrams(1) + AB + "SELECT doc_id, sent_pos, char_start, array_to_string(list_transform(list_concat(words[greatest(word_start - 100, 0) + 1:word_start], words[word_end + 2:word_end + 101]), lambda x: lower(x)), '|') AS grams FROM a")
def sentence_ngrams(spark, sf):
    return around(spark, sf).select("doc_id", "sent_pos", "char_start", F.array_join(tokens.sentence_ngrams(F.col("sentence_words"), F.col("word_start"), F.col("word_end")), "|").alias("grams"))


@query(with_ngrams(1) + AB + ", q AS (SELECT a.doc_id, a.sent_pos, a.char_start, unnest(s.words) AS w FROM a JOIN sent s ON s.doc_id = a.doc_id AND s.sent_pos <> a.sent_pos AND abs(s.sent_pos - a.sent_pos) <= 1) SELECT doc_id, sent_pos, char_start, lower(w) AS ngram, count(*) AS times FROM q GROUP BY ALL")
def neighbor_sentence_ngrams(spark, sf):
    m = around(spark, sf).withColumn("m", F.struct("doc_id", "sent_pos", "char_start"))
    return neighbours.neighbour_sentences(m, sents(spark, sf)).groupBy("m", "ngram").agg(F.count("*").alias("times")).select("m.*", "ngram", "times")


@query(WITH + "SELECT a.doc_id, a.sent_pos, len(list_intersect(a.words, b.words)) > 0 AS overlap, len(list_filter(b.words, lambda x: NOT list_contains(a.words, x))) = 0 AS superset FROM sent a JOIN sent b ON a.doc_id = b.doc_id AND b.sent_pos = a.sent_pos + 1")
def overlap_superset(spark, sf):
    a, b = sents(spark, sf), sents(spark, sf).select("doc_id", (F.col("sent_pos") - 1).alias("sent_pos"), F.col("words").alias("next"))
    return a.join(b, ["doc_id", "sent_pos"]).select("doc_id", "sent_pos", tokens.overlap(F.col("words"), F.col("next")).alias("overlap"), tokens.is_superset(F.col("words"), F.col("next")).alias("superset"))


@query(with_ngrams(1) + AB + "SELECT doc_id, sent_pos, char_start, array_to_string(list_concat(list_concat(list_concat(words[1:word_start], ['~~[[1']), list_concat(words[word_start + 1:word_end + 1], ['1]]~~'])), words[word_end + 2:]), ' ') AS marked FROM a")
def mark_sentence(spark, sf):
    return around(spark, sf).select("doc_id", "sent_pos", "char_start", F.array_join(tokens.mark(F.col("sentence_words"), F.col("word_start"), F.col("word_end"), 1), " ").alias("marked"))


@query(with_ngrams(1) + AB + f", c AS ({SAME}), w AS (SELECT unnest(w) AS word FROM c UNION ALL SELECT unnest(w) FROM c) SELECT word, count(*) AS n FROM w GROUP BY word")
def word_counter(spark, sf):
    c = joint(spark, sf)
    return c.select(F.explode(tokens.word_counter([F.col("a0.sentence_words"), F.col("a1.sentence_words")])).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
