"""Queries on grids, page layouts, paths, features, keys, labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import boxes, grid, paths
from factloom.operators import candidates as cand
from factloom.operators import features, keys, labels, neighbours, spaces
from factloom.plans.catalogue import AB, SAME, WITH, argument, joint, query, read, sents, with_ngrams
from factloom.settings import Tabular
from factloom.sources import adapters

GRID = """WITH g0 AS (SELECT (o_orderkey // 16)::BIGINT AS doc_id, (o_orderkey % 16 + 1)::INT AS r, [o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority] AS v FROM orders),
cells AS MATERIALIZED (SELECT doc_id, r, unnest(range(4))::INT AS c, unnest(v) AS text FROM g0 UNION ALL SELECT doc_id, 0, unnest(range(4))::INT, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']) FROM (SELECT DISTINCT doc_id FROM g0)),
g AS MATERIALIZED (SELECT doc_id, r, c, (r * 4 + c)::INT AS p, text, string_split(text, ' ') AS words FROM cells),
ment AS MATERIALIZED (SELECT * FROM g WHERE regexp_matches(text, '^[1-3]-')),
tok AS MATERIALIZED (SELECT doc_id, r, c, p, unnest(words) AS w FROM g) """


def grid_sentences(spark, sf):
    return adapters.order_grid(read(spark, sf, "orders"))


def grid_mentions(spark, sf, pattern="^[1-3]-"):
    """Whole-cell mentions of urgent to medium orders, with their cells."""
    s = grid_sentences(spark, sf).where(F.col("text").rlike(pattern))
    return s.withColumns({"m": F.struct("doc_id", "cell_pos"), "sentence_words": F.col("words"), "word_start": F.lit(0), "word_end": F.size("words") - 1, "char_start": F.lit(0), "char_end": F.length("text") - 1, "span_text": F.col("text"), "ord": F.lit(0)})


def first_words(spark, sf):
    """Mentions of a cell's first word only, so that the cell has words besides."""
    head = grid_sentences(spark, sf).withColumns({"m": F.struct("doc_id", "cell_pos"), "sentence_words": F.col("words"), "word_start": F.lit(0), "word_end": F.lit(0), "char_start": F.lit(0)})
    return head.withColumn("span_text", F.col("words")[0]).withColumn("char_end", F.length("span_text") - 1).where(F.col("text").rlike("^4-NOT"))


@query("SELECT a.l_orderkey AS k, a.q0, a.q1, b.q0 AS r0, b.q1 AS r1, CASE WHEN a.q0 <= b.q1 AND b.q0 <= a.q1 THEN 0 WHEN a.q1 < b.q0 THEN a.q1 - b.q0 ELSE a.q0 - b.q1 END AS diff, abs(CASE WHEN a.q0 <= b.q1 AND b.q0 <= a.q1 THEN 0 WHEN a.q1 < b.q0 THEN a.q1 - b.q0 ELSE a.q0 - b.q1 END) <= 2 AS near FROM (SELECT l_orderkey, min(l_linenumber)::INT AS q0, max(l_linenumber)::INT AS q1 FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, min(l_quantity)::INT AS q0, max(l_quantity)::INT AS q1 FROM lineitem GROUP BY 1) b ON a.l_orderkey = b.l_orderkey")
def row_col_diff(spark, sf):
    r = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(*(f(c).cast("int").alias(n) for f, c, n in ((F.min, "l_linenumber", "q0"), (F.max, "l_linenumber", "q1"), (F.min, "l_quantity", "r0"), (F.max, "l_quantity", "r1"))))
    a, b = (F.struct(F.col(x).alias("row_start"), F.col(y).alias("row_end")) for x, y in (("q0", "q1"), ("r0", "r1")))
    return r.select(F.col("l_orderkey").alias("k"), "q0", "q1", "r0", "r1", grid.min_row_diff([a, b], absolute=False).alias("diff"), grid.is_row_aligned(a, b, (0, 2)).alias("near"))


def cell_pairs(spark, sf):
    """Pairs of a medium-or-higher priority and a status in one table."""
    m = grid_mentions(spark, sf)
    n = grid_sentences(spark, sf).where("text = 'F'").select(F.col("doc_id").alias("d"), F.struct("table_pos", "cell_pos", "row_start", "row_end", "col_start", "col_end", "sent_pos").alias("b"))
    a = m.select("doc_id", F.struct("table_pos", "cell_pos", "row_start", "row_end", "col_start", "col_end", "sent_pos").alias("a"))
    return a.join(n, F.col("doc_id") == F.col("d"))


CELL_PAIRS = GRID + ", cp AS MATERIALIZED (SELECT a.doc_id, a.p AS pa, b.p AS pb, a.r AS ra, b.r AS rb, a.c AS ca, b.c AS cb FROM ment a JOIN g b ON a.doc_id = b.doc_id WHERE b.text = 'F') "


@query(CELL_PAIRS + "SELECT doc_id, pa, pb, abs(ra - rb) BETWEEN 0 AND 1 AS row_near, abs(ca - cb) BETWEEN 1 AND 1 AS col_near, least(abs(ra - rb), abs(ca - cb)) AS axis_diff FROM cp")
def axis_aligned_spread(spark, sf):
    return cell_pairs(spark, sf).select("doc_id", F.col("a.cell_pos").alias("pa"), F.col("b.cell_pos").alias("pb"), grid.is_row_aligned("a", "b", (0, 1)).alias("row_near"), grid.is_col_aligned("a", "b", (1, 1)).alias("col_near"), grid.min_axis_diff("a", "b").alias("axis_diff"))


@query(CELL_PAIRS + "SELECT doc_id, pa, pb, true AS same_table, ra = rb AS same_row, ca = cb AS same_col, pa = pb AS same_cell, ra = rb OR ca = cb AS aligned FROM cp")
def same_table_row_col_cell(spark, sf):
    args = [F.col("a"), F.col("b")]
    tests = {"same_table": grid.same_table, "same_row": grid.same_row, "same_col": grid.same_col, "same_cell": grid.same_cell, "aligned": grid.is_tabular_aligned}
    return cell_pairs(spark, sf).select("doc_id", F.col("a.cell_pos").alias("pa"), F.col("b.cell_pos").alias("pb"), *(t(args).alias(n) for n, t in tests.items()))


@query(CELL_PAIRS + "SELECT doc_id, pa, pb, cb AS max_col, ca AS min_col, rb AS max_row, ra AS min_row FROM cp")
def minmax_row_col(spark, sf):
    return cell_pairs(spark, sf).select("doc_id", F.col("a.cell_pos").alias("pa"), F.col("b.cell_pos").alias("pb"), grid.max_col(F.col("b")).alias("max_col"), grid.min_col(F.col("a")).alias("min_col"), grid.max_row(F.col("b")).alias("max_row"), grid.min_row(F.col("a")).alias("min_row"))


def counted(rows, *more):
    return rows.groupBy("m", "ngram", *more).agg(F.count("*").alias("times")).select("m.*", "ngram", "times", *more)


FIRST = GRID.replace("'^[1-3]-'", "'^4-NOT'")


@query(FIRST + "SELECT doc_id, p AS cell_pos, lower(w) AS ngram, count(*) AS times FROM (SELECT doc_id, p, unnest(words[2:]) AS w FROM ment) GROUP BY ALL")
def cell_ngrams(spark, sf):
    return counted(neighbours.cell_ngrams(first_words(spark, sf), grid_sentences(spark, sf)))


@query(FIRST + """, nb AS (SELECT a.doc_id, a.p, t.w, CASE WHEN t.c = a.c THEN CASE WHEN t.r > a.r THEN 'DOWN' ELSE 'UP' END WHEN t.c > a.c THEN 'RIGHT' ELSE 'LEFT' END AS direction FROM ment a JOIN tok t ON a.doc_id = t.doc_id AND abs(a.r - t.r) + abs(a.c - t.c) = 1 WHERE len(a.words) > 1)
SELECT doc_id, p AS cell_pos, lower(w) AS ngram, direction, count(*) AS times FROM (SELECT * FROM nb UNION ALL SELECT doc_id, p, unnest(words[2:]), NULL FROM ment) GROUP BY ALL""")
def neighbor_cell_ngrams(spark, sf):
    return counted(neighbours.neighbour_cells(first_words(spark, sf), grid_sentences(spark, sf)), "direction")


ROW_SQL = "SELECT a.doc_id, a.p, t.w FROM ment a JOIN tok t ON a.doc_id = t.doc_id AND a.r = t.r AND a.p <> t.p UNION ALL SELECT doc_id, p, unnest(words[2:]) FROM ment"
COL_SQL = ROW_SQL.replace("a.r = t.r", "a.c = t.c")
COUNTED = "SELECT doc_id, p AS cell_pos, lower(w) AS ngram, count(*) AS times FROM ({}) GROUP BY ALL"


@query(FIRST + COUNTED.format(ROW_SQL))
def row_ngrams(spark, sf):
    return counted(neighbours.row_ngrams(first_words(spark, sf), grid_sentences(spark, sf)))


@query(FIRST + COUNTED.format(COL_SQL))
def col_ngrams(spark, sf):
    return counted(neighbours.col_ngrams(first_words(spark, sf), grid_sentences(spark, sf)))


@query(FIRST + COUNTED.format(ROW_SQL + " UNION ALL " + COL_SQL))
def aligned_ngrams(spark, sf):
    return counted(neighbours.aligned_ngrams(first_words(spark, sf), grid_sentences(spark, sf)))


@query(GRID + COUNTED.format("SELECT a.doc_id, a.p, t.w FROM ment a JOIN tok t ON a.doc_id = t.doc_id AND ((a.r = t.r AND t.c = 0) OR (a.c = t.c AND t.r = 0)) WHERE a.c <> 0 AND a.r <> 0"))
def head_ngrams(spark, sf):
    return counted(neighbours.head_ngrams(grid_mentions(spark, sf), grid_sentences(spark, sf)))


# page layouts


def layout(spark, sf):
    return adapters.with_layout(sents(spark, sf))


PAGE = WITH + """, l AS (SELECT doc_id, sent_pos, words, (sent_pos // 100 + 1)::INT AS page, (12 * (sent_pos // 2 % 50))::INT AS t, (12 * (sent_pos // 2 % 50) + 10)::INT AS b, (6 * (sent_pos % 3) + 300 * (sent_pos % 2))::INT AS l, (6 * (sent_pos % 3) + 300 * (sent_pos % 2) + 6 * len(array_to_string(words, ' ')) - 1)::INT AS r FROM sent) """
NEXT = " FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.sent_pos = x.sent_pos + 1"


def page_pairs(spark, sf):
    """Each sentence and the next."""
    a = layout(spark, sf).select("doc_id", "sent_pos", F.col("box").alias("x"))
    b = layout(spark, sf).select("doc_id", (F.col("sent_pos") - 1).alias("sent_pos"), F.col("box").alias("y"))
    return a.join(b, ["doc_id", "sent_pos"])


@query(PAGE + "SELECT x.doc_id, x.sent_pos, x.t + 1.5 <= y.b - 1.5 AND y.t + 1.5 <= x.b - 1.5 AS horz, x.l + 1.5 <= y.r - 1.5 AND y.l + 1.5 <= x.r - 1.5 AS vert, abs(x.l - y.l) <= 2 AS vert_left, abs(x.r - y.r) <= 2 AS vert_right, abs((x.l + x.r) / 2 - (y.l + y.r) / 2) <= 5 AS vert_center" + NEXT)
def bbox_alignment(spark, sf):
    x, y = F.col("x"), F.col("y")
    return page_pairs(spark, sf).select("doc_id", "sent_pos", boxes.horz_aligned(x, y).alias("horz"), boxes.vert_aligned(x, y).alias("vert"), boxes.vert_aligned_left(x, y).alias("vert_left"), boxes.vert_aligned_right(x, y).alias("vert_right"), boxes.vert_aligned_center(x, y).alias("vert_center"))


@query(PAGE + "SELECT x.doc_id, x.sent_pos, x.page, x.page = y.page AS same_page" + NEXT)
def same_page(spark, sf):
    return page_pairs(spark, sf).select("doc_id", "sent_pos", F.col("x.page").alias("page"), boxes.same_page([F.col("x"), F.col("y")]).alias("same_page"))


@query(PAGE + "SELECT doc_id, sent_pos, t / 792.0::DOUBLE AS v, l / 612.0::DOUBLE AS h FROM l")
def page_percentiles(spark, sf):
    return layout(spark, sf).select("doc_id", "sent_pos", boxes.page_vert_percentile(F.col("box")).alias("v"), boxes.page_horz_percentile(F.col("box")).alias("h"))


def page_mentions(spark, sf):
    """Sentences that begin with a capitalised word of ten letters or more, as mentions of that word."""
    s = layout(spark, sf).where(F.col("words")[0].rlike("^[A-Z][a-z]{9,}$"))
    return s.withColumn("m", F.struct("doc_id", "sent_pos"))


CAP = ", c AS (SELECT * FROM l WHERE regexp_matches(words[1], '^[A-Z][a-z]{9,}$')) SELECT doc_id, sent_pos, ngram, count(*) AS times FROM (SELECT c.doc_id, c.sent_pos, lower(unnest(l.words)) AS ngram FROM c JOIN l ON c.doc_id = l.doc_id AND c.page = l.page AND c.sent_pos <> l.sent_pos AND {}) GROUP BY ALL"


@query(PAGE + CAP.replace("{}", "c.t + 1.5 <= l.b - 1.5 AND l.t + 1.5 <= c.b - 1.5"))
def horz_ngrams(spark, sf):
    return counted(neighbours.direction_ngrams(page_mentions(spark, sf), layout(spark, sf), "horz"))


@query(PAGE + CAP.replace("{}", "c.l + 1.5 <= l.r - 1.5 AND l.l + 1.5 <= c.r - 1.5"))
def vert_ngrams(spark, sf):
    return counted(neighbours.direction_ngrams(page_mentions(spark, sf), layout(spark, sf), "vert"))


@query(PAGE + r""", o AS (SELECT *, CASE WHEN len(words) < 7 THEN list_filter(list_transform(words, lambda x: lower(x)), lambda x: regexp_matches(x, '^\p{L}+$')) ELSE [] END AS own, (t + b) / 2 AS yc, (l + r) / 2 AS xc FROM l),
e AS (SELECT *, unnest(own) AS w FROM o),
k AS (SELECT DISTINCT o.doc_id, o.sent_pos, 'LEFT_' AS n, w FROM o JOIN e USING (doc_id, page, l) WHERE (e.yc, e.sent_pos) < (o.yc, o.sent_pos) UNION SELECT DISTINCT o.doc_id, o.sent_pos, 'RIGHT_', w FROM o JOIN e USING (doc_id, page, r) WHERE (e.yc, e.sent_pos) < (o.yc, o.sent_pos)
UNION SELECT DISTINCT o.doc_id, o.sent_pos, 'Y_', w FROM o JOIN e USING (doc_id, page, yc) WHERE (e.xc, e.sent_pos) < (o.xc, o.sent_pos) UNION SELECT DISTINCT o.doc_id, o.sent_pos, 'CENTER_', w FROM o JOIN e USING (doc_id, page, xc) WHERE (e.yc, e.sent_pos) < (o.yc, o.sent_pos))
SELECT doc_id, sent_pos, n || w AS lemma FROM k UNION SELECT doc_id, sent_pos, w FROM k""")
def visual_aligned_lemmas(spark, sf):
    return neighbours.aligned_lemmas(layout(spark, sf), lemmas="words")


# element paths, made from ids


def path_pairs(spark, sf):
    d = F.col("doc_id")
    path = lambda shift: F.concat(F.lit("/html/body/div["), (d % 3 + shift).cast("string"), F.lit("]/p["), (d % 5 + 1).cast("string"), F.lit("]"))
    return read(spark, sf, "documents").select("doc_id", path(1).alias("x"), F.when(d % 2 == 0, F.concat(path(1), F.lit("/b"))).otherwise(path(2)).alias("y"))


PATHS = """WITH q AS (SELECT doc_id, '/html/body/div[' || (doc_id % 3 + 1) || ']/p[' || (doc_id % 5 + 1) || ']' AS x, CASE WHEN doc_id % 2 = 0 THEN '/html/body/div[' || (doc_id % 3 + 1) || ']/p[' || (doc_id % 5 + 1) || ']/b' ELSE '/html/body/div[' || (doc_id % 3 + 2) || ']/p[' || (doc_id % 5 + 1) || ']' END AS y FROM documents),
s AS (SELECT doc_id, string_split(x, '/') AS a, string_split(y, '/') AS b FROM q),
n AS (SELECT *, (SELECT count(*) FROM range(1, least(len(a), len(b)) + 1) t(i) WHERE a[1:i] = b[1:i])::INT AS k FROM s) """


@query(PATHS + "SELECT doc_id, array_to_string(a[1:k], '/') AS common FROM n")
def common_ancestor(spark, sf):
    return path_pairs(spark, sf).select("doc_id", F.array_join(paths.common_ancestor(F.col("x"), F.col("y")), "/").alias("common"))


@query(PATHS + "SELECT doc_id, (least(len(a), len(b)) - k)::INT AS depth FROM n")
def lca_depth(spark, sf):
    return path_pairs(spark, sf).select("doc_id", paths.lowest_common_ancestor_depth(F.col("x"), F.col("y")).alias("depth"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'html body div p b' ELSE 'html body div p' END AS tags FROM documents")
def ancestor_tags(spark, sf):
    return path_pairs(spark, sf).select("doc_id", F.array_join(paths.ancestor_tags(F.col("y")), " ").alias("tags"))


# features


def word_mentions(spark, sf):
    """Long words, with their sentences; lemmas are lower case and tags the first letter."""
    a = argument(spark, sf).withColumn("m", F.struct("doc_id", "sent_pos", "char_start"))
    return a.withColumn("lemmas", F.transform("sentence_words", F.lower)).withColumn("pos_tags", F.transform("sentence_words", lambda w: F.substring(w, 1, 1)))


def keyed(rows):
    return rows.select("m.*", "key")


LEM = with_ngrams(1) + AB + ", f AS (SELECT doc_id, sent_pos, char_start, word_start AS i, words, list_transform(words, lambda x: lower(x)) AS lem, list_transform(words, lambda x: x[1:1]) AS pos, len(words) AS n FROM a) "


@query(LEM + "SELECT doc_id, sent_pos, char_start, unnest(['WORD_SEQ_[' || words[i + 1] || ']', 'LEMMA_SEQ_[' || lem[i + 1] || ']', 'POS_SEQ_[' || pos[i + 1] || ']']) AS key FROM f")
def feat_textual_seq(spark, sf):
    return keyed(features.sequence_features(word_mentions(spark, sf)))


NUM = r"regexp_matches({0}, '^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$|^[+-]?(inf|infinity|nan)$')"


@query(LEM + ", w AS (SELECT *, list_transform(lem, lambda x: CASE WHEN " + NUM.format("x") + " THEN '_NUMBER' ELSE x END) AS num FROM f)" + """,
v AS (SELECT *, list_reverse(list_transform(list_filter([1, 2, 3], lambda k: i - k >= -n), lambda k: num[CASE WHEN i - k < 0 THEN i - k + n ELSE i - k END + 1])) AS ll,
 list_reverse(list_transform(list_filter([1, 2, 3], lambda k: i - k >= -n), lambda k: pos[CASE WHEN i - k < 0 THEN i - k + n ELSE i - k END + 1])) AS lp,
 num[i + 2:i + 4] AS rl, pos[i + 2:i + 4] AS rp FROM w),
k AS (SELECT doc_id, sent_pos, char_start, list_concat(list_concat(list_transform(range(1, len(ll) + 1), lambda k: 'W_LEFT_' || k || '_[' || array_to_string(ll[len(ll) - k + 1:], ' ') || ']'), list_transform(range(1, len(lp) + 1), lambda k: 'W_LEFT_POS_' || k || '_[' || array_to_string(lp[len(lp) - k + 1:], ' ') || ']')),
 list_concat(list_transform(range(1, len(rl) + 1), lambda k: 'W_RIGHT_' || k || '_[' || array_to_string(rl[1:k], ' ') || ']'), list_transform(range(1, len(rp) + 1), lambda k: 'W_RIGHT_POS_' || k || '_[' || array_to_string(rp[1:k], ' ') || ']'))) AS ks FROM v),
x AS (SELECT *, unnest(range(1, len(ll) + 1)) AS p FROM v), y AS (SELECT *, unnest(range(1, len(rl) + 1)) AS q FROM x)
SELECT doc_id, sent_pos, char_start, unnest(ks) AS key FROM k UNION SELECT doc_id, sent_pos, char_start, 'W_LEMMA_L_' || p || '_R_' || q || '_[' || array_to_string(ll[len(ll) - p + 1:], ' ') || ']_[' || array_to_string(rl[1:q], ' ') || ']' FROM y
UNION SELECT doc_id, sent_pos, char_start, 'W_POS_L_' || p || '_R_' || q || '_[' || array_to_string(lp[len(lp) - p + 1:], ' ') || ']_[' || array_to_string(rp[1:q], ' ') || ']' FROM y""")
def feat_textual_window(spark, sf):
    return keyed(features.window_features(word_mentions(spark, sf)))


@query(LEM + r""", s AS (SELECT *, list_transform(words[greatest(i - 7, 0) + 1:i], lambda x: lower(x)) AS lw, list_transform(words[i + 2:i + 8], lambda x: lower(x)) AS rw FROM f)
SELECT DISTINCT doc_id, sent_pos, char_start, unnest(list_concat(list_concat(['CONTAINS_WORDS_[' || words[i + 1] || ']', 'SPAN_TYPE_[EXPLICIT]', 'LENGTH_1'],
 list_concat(list_transform(lw, lambda x: 'LEFT_WORDS_[' || x || ']'), list_transform(range(1, len(lw)), lambda k: 'LEFT_WORDS_[' || lw[k] || ' ' || lw[k + 1] || ']'))),
 list_concat(list_transform(rw, lambda x: 'RIGHT_WORDS_[' || x || ']'), list_transform(range(1, len(rw)), lambda k: 'RIGHT_WORDS_[' || rw[k] || ' ' || rw[k + 1] || ']')))) AS key FROM s""")
def feat_textual_word(spark, sf):
    return keyed(features.word_features(word_mentions(spark, sf)))


@query(FIRST + ", k AS (" + " UNION ALL ".join([
    "SELECT doc_id, p, 'ROW_NUM_[' || r || ']' AS k FROM ment", "SELECT doc_id, p, 'COL_NUM_[' || c || ']' FROM ment", "SELECT doc_id, p, 'ROW_SPAN_[1]' FROM ment", "SELECT doc_id, p, 'COL_SPAN_[1]' FROM ment",
    "SELECT doc_id, p, 'CELL_WORDS_[' || lower(unnest(words[2:])) || ']' FROM ment",
    f"SELECT doc_id, p, 'ROW_WORDS_[' || lower(w) || ']' FROM ({ROW_SQL})", f"SELECT doc_id, p, 'COL_WORDS_[' || lower(w) || ']' FROM ({COL_SQL})",
    "SELECT a.doc_id, a.p, 'ROW_HEAD_WORDS_[' || lower(t.w) || ']' FROM ment a JOIN tok t ON a.doc_id = t.doc_id AND a.r = t.r AND t.c = 0 WHERE a.c <> 0",
    "SELECT a.doc_id, a.p, 'COL_HEAD_WORDS_[' || lower(t.w) || ']' FROM ment a JOIN tok t ON a.doc_id = t.doc_id AND a.c = t.c AND t.r = 0 WHERE a.r <> 0",
]) + ") SELECT DISTINCT doc_id, p AS cell_pos, 'TAB_' || k AS key FROM k")
def feat_tabular_unary(spark, sf):
    return keyed(features.tabular_features(first_words(spark, sf), grid_sentences(spark, sf), Tabular(cell_ngrams=1, head_ngrams=1, row_ngrams=1, col_ngrams=1)))


@query(CELL_PAIRS + "SELECT doc_id, pa, pb, unnest(list_concat(['TAB_SAME_TABLE', 'TAB_SAME_TABLE_ROW_DIFF_[' || (ra - rb) || ']', 'TAB_SAME_TABLE_COL_DIFF_[' || (ca - cb) || ']', 'TAB_SAME_TABLE_MANHATTAN_DIST_[' || (abs(ra - rb) + abs(ca - cb)) || ']'], CASE WHEN pa = pb THEN ['TAB_SAME_CELL'] ELSE [] END)) AS key FROM cp")
def feat_tabular_multinary(spark, sf):
    def arg(name):
        return F.struct(*(F.col(f"{name}.{c}").alias(c) for c in ("table_pos", "cell_pos", "row_start", "row_end", "col_start", "col_end")), F.lit(0).alias("word_start"), F.lit(0).alias("char_start"))

    c = cell_pairs(spark, sf).select(F.struct("doc_id", F.col("a.cell_pos").alias("pa"), F.col("b.cell_pos").alias("pb")).alias("candidate_id"), arg("a").alias("a0"), arg("b").alias("a1"))
    return features.tabular_multinary(c).select("candidate_id.*", "key")


BIGRAMS = FIRST.replace("unnest(words) AS w FROM g)", "unnest(list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))) AS w FROM g)").replace("ment AS MATERIALIZED (SELECT * FROM g", "ment AS MATERIALIZED (SELECT *, list_concat(words[2:], list_transform(range(2, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS rest FROM g")
ROW_TWO, COL_TWO = (x.replace("unnest(words[2:])", "unnest(rest)") for x in (ROW_SQL, COL_SQL))


@query(BIGRAMS + ", k AS (" + " UNION ALL ".join([
    "SELECT doc_id, p, 'ROW_NUM_[' || r || ']' AS k FROM ment", "SELECT doc_id, p, 'COL_NUM_[' || c || ']' FROM ment", "SELECT doc_id, p, 'ROW_SPAN_[1]' FROM ment", "SELECT doc_id, p, 'COL_SPAN_[1]' FROM ment",
    "SELECT doc_id, p, 'CELL_WORDS_[' || lower(unnest(rest)) || ']' FROM ment",
    f"SELECT doc_id, p, 'ROW_WORDS_[' || lower(w) || ']' FROM ({ROW_TWO})", f"SELECT doc_id, p, 'COL_WORDS_[' || lower(w) || ']' FROM ({COL_TWO})",
    "SELECT a.doc_id, a.p, 'ROW_HEAD_WORDS_[' || lower(t.w) || ']' FROM ment a JOIN tok t ON a.doc_id = t.doc_id AND a.r = t.r AND t.c = 0 WHERE a.c <> 0",
    "SELECT a.doc_id, a.p, 'COL_HEAD_WORDS_[' || lower(t.w) || ']' FROM ment a JOIN tok t ON a.doc_id = t.doc_id AND a.c = t.c AND t.r = 0 WHERE a.r <> 0",
]) + ") SELECT DISTINCT doc_id, p AS cell_pos, 'TAB_' || k AS key FROM k")
def feat_tabular_default(spark, sf):
    """As the settings have it by default: n-grams of up to two words."""
    return keyed(features.tabular_features(first_words(spark, sf), grid_sentences(spark, sf)))


@query(CELL_PAIRS + """, tri AS (SELECT doc_id, pa, pb, ra, rb, ca, cb, least(pa, pb) + 1 AS pc FROM cp),
t3 AS (SELECT *, pc // 4 AS rc, pc % 4 AS cc FROM tri),
d3 AS (SELECT *, ra - rb AS r1, rb - rc AS r2, ca - cb AS c1, cb - cc AS c2 FROM t3),
m3 AS (SELECT *, CASE WHEN abs(r2) < abs(r1) THEN r2 ELSE r1 END AS dr, CASE WHEN abs(c2) < abs(c1) THEN c2 ELSE c1 END AS dc FROM d3)
SELECT doc_id, pa, pb, unnest(['TAB_SAME_TABLE', 'TAB_SAME_TABLE_ROW_DIFF_[' || dr || ']', 'TAB_SAME_TABLE_COL_DIFF_[' || dc || ']', 'TAB_SAME_TABLE_MANHATTAN_DIST_[' || (abs(dr) + abs(dc)) || ']']) AS key FROM m3""")
def feat_nary(spark, sf):
    """Tabular features of three arguments: two cells, and the one that follows the first of them."""
    def arg(cell, row, col):
        return F.struct(F.lit(0).alias("table_pos"), cell.alias("cell_pos"), *(row.alias(n) for n in ("row_start", "row_end")), *(col.alias(n) for n in ("col_start", "col_end")), F.lit(0).alias("word_start"), F.lit(0).alias("char_start"))

    def own(name):
        return arg(*(F.col(f"{name}.{c}") for c in ("cell_pos", "row_start", "col_start")))

    third = F.least("a.cell_pos", "b.cell_pos") + 1
    key = F.struct("doc_id", F.col("a.cell_pos").alias("pa"), F.col("b.cell_pos").alias("pb")).alias("candidate_id")
    c = cell_pairs(spark, sf).select(key, own("a").alias("a0"), own("b").alias("a1"), arg(third, F.floor(third / 4).cast("int"), (third % 4).cast("int")).alias("a2"))
    return features.tabular_multinary(c).select("candidate_id.*", "key")


def cells(spark, sf, pattern):
    found = grid_sentences(spark, sf).where(F.col("text").rlike(pattern))
    return cand.index_mentions(spaces.context_mentions(found, "cell", "cell_pos"))


@query(GRID + "SELECT a.doc_id, a.p AS p0, b.p AS p1 FROM g a JOIN g b ON a.doc_id = b.doc_id WHERE regexp_matches(a.text, '^[1-3]-') AND regexp_matches(b.text, '^([2-5]-|F$)') AND a.p <> b.p")
def cand_cell_pairs(spark, sf):
    """Pairs of two cells of a table: no spans at all."""
    c = cand.extract(cand.CandidateSpec("cells", [cells(spark, sf, "^[1-3]-"), cells(spark, sf, "^([2-5]-|F$)")]))
    return c.select("doc_id", F.col("a0.position").alias("p0"), F.col("a1.position").alias("p1"))


MIXED = GRID + "SELECT a.doc_id, a.p AS s0, split_part(a.text, ' ', 1) AS t0, b.p AS p1 FROM g a JOIN g b ON a.doc_id = b.doc_id WHERE regexp_matches(a.text, '^4-NOT') AND b.text = 'F'"


def mixed(spark, sf, **options):
    spans = cand.index_mentions(first_words(spark, sf))
    return cand.extract(cand.CandidateSpec("mixed", [spans, cells(spark, sf, "^F$")], **options))


@query(MIXED)
def cand_mixed_kinds(spark, sf):
    """Pairs of a span and a cell."""
    return mixed(spark, sf).select("doc_id", F.col("a0.sent_pos").alias("s0"), F.col("a0.span_text").alias("t0"), F.col("a1.position").alias("p1"))


@query(GRID + "SELECT (SELECT count(*) FROM (" + MIXED[len(GRID):] + "))::BIGINT AS kept, 0::BIGINT AS legacy")
def cand_mixed_kinds_counts(spark, sf):
    """How many such pairs there are, and how many if pairs of two kinds count as nested."""
    kept, legacy = (mixed(spark, sf, legacy_mixed_nesting=x).agg(F.count("*").alias(n)) for x, n in ((False, "kept"), (True, "legacy")))
    return kept.crossJoin(legacy)


@query()
def feat_structural(spark, sf):
    from factloom.operators import html

    s = html.contexts(html.parse_html(read(spark, sf, "pages"), "page_id"), "sentence").withColumn("m", F.struct("doc_id", "sent_pos"))
    return keyed(features.structural_features(s))


@query(PAGE + "SELECT x.doc_id, x.sent_pos, unnest(list_filter(['VIZ_SAME_PAGE', CASE WHEN x.t + 1.5 <= y.b - 1.5 AND y.t + 1.5 <= x.b - 1.5 THEN 'VIZ_HORZ_ALIGNED' END, CASE WHEN x.l + 1.5 <= y.r - 1.5 AND y.l + 1.5 <= x.r - 1.5 THEN 'VIZ_VERT_ALIGNED' END, CASE WHEN abs(x.l - y.l) <= 2 THEN 'VIZ_VERT_ALIGNED_LEFT' END, CASE WHEN abs(x.r - y.r) <= 2 THEN 'VIZ_VERT_ALIGNED_RIGHT' END, CASE WHEN abs((x.l + x.r) / 2 - (y.l + y.r) / 2) <= 5 THEN 'VIZ_VERT_ALIGNED_CENTER' END], lambda k: k IS NOT NULL)) AS key" + NEXT + " WHERE x.page = y.page")
def feat_visual(spark, sf):
    c = page_pairs(spark, sf).select(F.struct("doc_id", "sent_pos").alias("candidate_id"), F.struct(F.col("x").alias("box")).alias("a0"), F.struct(F.col("y").alias("box")).alias("a1"))
    return features.visual_multinary(c).select("candidate_id.*", "key")


# annotations: feature rows of candidates, keys and matrices


def annotations(spark, sf):
    """Two relations' rows: the argument's first letters and its length, of joint and of throttled pairs."""
    c = joint(spark, sf).withColumn("candidate_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("a0.sent_pos").cast("string"), F.col("a0.char_start").cast("string"), F.col("a1.char_start").cast("string")))
    # named before they are exploded, so that the rest of the mentions isn't carried along
    c = c.select("candidate_id", F.col("a0.span_text").alias("t0"), F.col("a1.span_text").alias("t1"))
    rows = c.select("candidate_id", F.when(F.length("t0") > F.length("t1"), "Long").otherwise("Short").alias("candidate_type"), F.posexplode(F.array(F.concat(F.lit("P_"), F.substring("t0", 1, 2)), F.concat(F.lit("P_"), F.substring("t1", 1, 2)), F.lit("LEN"))).alias("seq", "key"), F.length("t0").alias("len"))
    return rows.withColumn("value", F.when(F.col("key") == "LEN", F.col("len") % 3).otherwise(1).cast("double"))


ANN = with_ngrams(1) + AB + f", j AS ({SAME}), an AS (SELECT doc_id || ':' || s0 || ':' || c0 || ':' || c1 AS candidate_id, CASE WHEN len(t0) > len(t1) THEN 'Long' ELSE 'Short' END AS candidate_type, unnest([0, 1, 2]) AS seq, unnest(['P_' || t0[1:2], 'P_' || t1[1:2], 'LEN']) AS key, unnest([1, 1, len(t0) % 3])::DOUBLE AS value FROM j), mp AS (SELECT candidate_id, key, max_by(value, seq) AS value FROM an GROUP BY ALL HAVING max_by(value, seq) <> 0) "
KEYS = ", ks AS (SELECT key, list_sort(list_distinct(list(candidate_type))) AS cc FROM an GROUP BY key) "


@query(ANN + "SELECT * FROM mp")
def feature_mapping(spark, sf):
    return keys.mapping(annotations(spark, sf))


@query(ANN + KEYS + "SELECT key, array_to_string(cc, ',') AS classes FROM ks")
def feature_keys(spark, sf):
    return keys.build_keys(annotations(spark, sf)).select("key", F.array_join("candidate_classes", ",").alias("classes"))


@query(ANN + KEYS + ", d AS (SELECT key, list_filter(cc, lambda x: x <> 'Long' OR key NOT LIKE 'P_t%') AS cc FROM ks), u AS (SELECT * FROM d WHERE len(cc) > 0 AND key <> 'LEN' UNION ALL SELECT 'LEN', ['Other']) SELECT key, array_to_string(cc, ',') AS classes FROM u")
def feature_keys_drop_upsert(spark, sf):
    k = keys.build_keys(annotations(spark, sf))
    dropped = keys.drop_keys(k, k.where("key like 'P_t%'").select("key"), ["Long"])
    new = spark.range(1).select(F.lit("LEN").alias("key"), F.array(F.lit("Other")).alias("candidate_classes"))
    return keys.upsert_keys(dropped, new).select("key", F.array_join("candidate_classes", ",").alias("classes"))


@query(ANN + KEYS + ", r AS (SELECT candidate_id, (row_number() OVER (ORDER BY candidate_id) - 1)::INT AS row FROM (SELECT DISTINCT candidate_id FROM an)), c AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::INT AS col FROM ks) SELECT row, col, value FROM mp JOIN r USING (candidate_id) JOIN c USING (key)")
def feature_matrix(spark, sf):
    a = annotations(spark, sf)
    return keys.matrix(keys.mapping(a), keys.build_keys(a), a.select("candidate_id").distinct())


# labels


def labelled(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"), "text", "lang", "n_chars")
    return docs, {"short": F.when(F.col("n_chars") < 500, 0), "marks": F.when(F.col("text").contains("!!"), 0).when(F.col("text").contains(" | "), 0), "english": F.when(F.col("lang") == "en", F.lit(1)), "long": F.when(F.col("n_chars") > 3000, 1)}


LF = """WITH lf AS (SELECT doc_id AS candidate_id, unnest(['short', 'marks', 'english', 'long']) AS key, unnest([CASE WHEN n_chars < 500 THEN 0 END, CASE WHEN contains(text, '!!') OR contains(text, ' | ') THEN 0 END, CASE WHEN lang = 'en' THEN 1 END, CASE WHEN n_chars > 3000 THEN 1 END])::INT AS value FROM documents), la AS (SELECT * FROM lf WHERE value IS NOT NULL) """


@query(LF + "SELECT * FROM la")
def lf_labels(spark, sf):
    return labels.apply_labellers(*labelled(spark, sf))


@query(LF + "SELECT candidate_id, " + ", ".join(f"max(CASE WHEN key = '{k}' THEN coalesce(value, -1) END)::INT AS {k}" for k in ("short", "marks", "english", "long")) + " FROM lf GROUP BY candidate_id")
def label_matrix(spark, sf):
    docs, fs = labelled(spark, sf)
    return keys.dense_labels(labels.apply_labellers(docs, fs), list(fs), docs)


@query("SELECT doc_id AS candidate_id, quality, toxic FROM labels")
def gold_labels(spark, sf):
    gold = read(spark, sf, "labels").withColumnRenamed("doc_id", "candidate_id")
    rows = labels.apply_labellers(gold, {"quality": F.col("quality"), "toxic": F.col("toxic")})
    return keys.gold_labels(rows, ["quality", "toxic"], gold)


@query(LF + ", v AS (SELECT candidate_id, value, count(*) AS n FROM la GROUP BY ALL), b AS (SELECT *, rank() OVER (PARTITION BY candidate_id ORDER BY n DESC) AS r FROM v) SELECT candidate_id, min(value) AS label FROM b WHERE r = 1 GROUP BY candidate_id HAVING count(*) = 1")
def label_majority_vote(spark, sf):
    return labels.majority(labels.apply_labellers(*labelled(spark, sf)))


@query(LF + ", p AS (SELECT candidate_id, min(value) AS lo, max(value) AS hi FROM la GROUP BY 1) SELECT key, count(*) AS labelled, sum((lo <> hi)::INT)::BIGINT AS conflicts, (SELECT count(*) FROM documents) AS total FROM la JOIN p USING (candidate_id) GROUP BY key")
def label_coverage(spark, sf):
    docs, fs = labelled(spark, sf)
    return labels.coverage(labels.apply_labellers(docs, fs), docs)


@query("SELECT doc_id AS candidate_id, true AS training, 1 AS value, (n_chars % 8) / 8.0::DOUBLE AS probability FROM documents WHERE n_chars % 8 > 0 UNION ALL SELECT doc_id, false, 1, 0.5::DOUBLE FROM labels")
def marginals_save(spark, sf):
    old = read(spark, sf, "labels").select(F.col("doc_id").alias("candidate_id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("training"), F.lit(1).alias("value"), F.lit(0.5).alias("probability"))
    new = read(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"), ((F.col("n_chars") % 8) / 8.0).alias("p"))
    return labels.save_marginals(old, new)


def guesses(spark, sf):
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    bad = docs.where(F.col("text").contains("!!") | F.col("text").contains(" | ") | F.col("text").contains("###")).select("doc_id", "lang")
    return bad, docs.where("quality = 0").select("doc_id", "lang")


SETS = "WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)), p AS (SELECT doc_id, lang FROM d WHERE contains(text, '!!') OR contains(text, ' | ') OR contains(text, '###')), g AS (SELECT doc_id, lang FROM d WHERE quality = 0) "


@query(SETS + "SELECT 'tp' AS kind, * FROM (SELECT * FROM p INTERSECT SELECT * FROM g) UNION ALL SELECT 'fp', * FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT 'fn', * FROM (SELECT * FROM g EXCEPT SELECT * FROM p)")
def confusion_sets(spark, sf):
    parts = [df.select(F.lit(k).alias("kind"), "doc_id", "lang") for k, df in zip(("tp", "fp", "fn"), labels.confusion(*guesses(spark, sf)))]
    return parts[0].union(parts[1]).union(parts[2])


@query(SETS + ", c AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn) SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS \"precision\", round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM c")
def entity_f1(spark, sf):
    s = labels.scores(*guesses(spark, sf))
    return s.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("WITH e AS (SELECT DISTINCT p_brand AS attr, p_name[1:6] AS part FROM part) SELECT attr, part FROM e UNION SELECT e.attr, q.p_name FROM e JOIN part q ON starts_with(q.p_name, e.part) WHERE len(e.part) >= 4")
def entity_expansion(spark, sf):
    p = read(spark, sf, "part")
    e = p.select(F.col("p_brand").alias("attr"), F.substring("p_name", 1, 6).alias("part")).distinct()
    return labels.expand_entities(e, p.select(F.col("p_name").alias("part")))


# stores and links


@query(with_ngrams(1) + AB + "SELECT doc_id, sent_pos, char_start FROM a WHERE doc_id % 2 = 0")
def incremental_append(spark, sf):
    """The candidates of even documents that a store of the odd ones doesn't have."""
    a = argument(spark, sf)
    all_of = cand.with_ids(cand.extract(cand.CandidateSpec("one", [a])), "one", 1)
    new = cand.new_only(all_of, all_of.where("doc_id % 2 = 1"))
    return new.select("doc_id", F.col("a0.sent_pos").alias("sent_pos"), F.col("a0.char_start").alias("char_start"))


@query(with_ngrams(1) + AB + f"SELECT doc_id, s0, c0, c1 FROM ({SAME}) WHERE doc_id % 3 <> 0")
def clear_cascade(spark, sf):
    """What is left of the candidates when the mentions of every third document are cleared."""
    gone = read(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id")
    c = joint(spark, sf).join(gone, "doc_id", "left_anti")
    return c.select("doc_id", F.col("a0.sent_pos").alias("s0"), F.col("a0.char_start").alias("c0"), F.col("a1.char_start").alias("c1"))


@query(WITH + ", t AS MATERIALIZED (SELECT doc_id, unnest(words) AS w, sent_pos, unnest(range(len(words))) AS i FROM sent), a AS MATERIALIZED (SELECT doc_id, w, sent_pos, i::INT AS i, row_number() OVER (PARTITION BY doc_id, w ORDER BY sent_pos, i) AS k, count(*) OVER (PARTITION BY doc_id, w) AS n FROM t), b AS MATERIALIZED (SELECT * FROM a WHERE sent_pos % 10 <> 3), c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY sent_pos, i) AS k2, count(*) OVER (PARTITION BY doc_id, w) AS n2 FROM b) SELECT a.doc_id, a.w AS word, a.sent_pos, a.i AS token_pos, c.sent_pos AS page_line FROM a JOIN c ON a.doc_id = c.doc_id AND a.w = c.w AND a.k = c.k2 AND a.n = c.n2")
def pdf_link_exact(spark, sf):
    """Tokens linked to the words of a page from which every tenth line is missing."""
    from factloom.operators.visual import link_exact

    t = sents(spark, sf).select("doc_id", "sent_pos", F.posexplode("words").alias("token_pos", "word"))
    page = t.where("sent_pos % 10 <> 3").select("doc_id", "word", F.col("sent_pos").alias("page_line"), F.col("token_pos").alias("page_place"))
    return link_exact(t, page, ("sent_pos", "token_pos"), ("page_line", "page_place")).select("doc_id", "word", "sent_pos", "token_pos", "page_line")
