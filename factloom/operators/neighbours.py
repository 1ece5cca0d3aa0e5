"""Table-valued lookups around a mention: cells, rows, columns, heads, boxes, sentences.

``mentions`` carry a key ``m`` of their own; the sentence tables carry doc_id,
sent_pos, words and, for grids, table_pos, cell_pos and the cell's rectangle, and for
pages a ``box``. All lookups are joins on the document and the table or page, with the
interval test as the residual. Results are rows (m, ngram), duplicates included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import boxes, grid
from factloom.functions.tokens import ngrams, sentence_ngrams

RECTANGLE = ("row_start", "row_end", "col_start", "col_end")


def own_sentence(mentions: DataFrame, n_min: int = 1, n_max: int = 1, lower: bool = True) -> DataFrame:
    """N-grams of the rest of a mention's sentence (its ``sentence_words``)."""
    return mentions.select("m", F.explode(sentence_ngrams(F.col("sentence_words"), F.col("word_start"), F.col("word_end"), n_min, n_max, lower)).alias("ngram"))


def neighbour_sentences(mentions: DataFrame, sentences: DataFrame, d: int = 1, n_min: int = 1, n_max: int = 1, lower: bool = True) -> DataFrame:
    """N-grams of the sentences at most ``d`` away, the own one aside."""
    s = sentences.select(F.col("doc_id").alias("d_"), F.col("sent_pos").alias("s_"), F.col("words").alias("w_"))
    near = mentions.withColumn("s_", F.explode(F.sequence(F.col("sent_pos") - d, F.col("sent_pos") + d))).where("s_ <> sent_pos")
    joined = near.join(s, (near["doc_id"] == s["d_"]) & (near["s_"] == s["s_"])).select("m", "w_")
    return joined.select("m", F.explode(ngrams(F.col("w_"), n_min, n_max, lower=lower)).alias("ngram"))


def _others(mentions: DataFrame, sentences: DataFrame, aligned: Column, same_cell: bool | None = None) -> DataFrame:
    """Mentions with the other sentences ``s`` of their table that pass the test on (m_cell, s)."""
    m = mentions.select("m", F.col("doc_id").alias("d_"), F.col("table_pos").alias("t_"), F.col("sent_pos").alias("p_"), F.col("cell_pos").alias("c_"), F.struct(*RECTANGLE).alias("m_cell"))
    s = sentences.select("doc_id", "table_pos", "sent_pos", "cell_pos", "words", F.struct(*RECTANGLE).alias("s"))
    on = (m["d_"] == s["doc_id"]) & (m["t_"] == s["table_pos"]) & (m["p_"] != s["sent_pos"])
    if same_cell:
        on = on & (m["c_"] == s["cell_pos"])
    return m.join(s, on & aligned)


def _explode(rows: DataFrame, n_min: int, n_max: int, lower: bool, *more: str) -> DataFrame:
    return rows.select("m", F.explode(ngrams(F.col("words"), n_min, n_max, lower=lower)).alias("ngram"), *more)


def _rest(mentions: DataFrame, n_min: int, n_max: int, lower: bool) -> DataFrame:
    """Mentions with ``rest``, how many n-grams their own sentence has besides them."""
    return mentions.select("m", F.size(sentence_ngrams(F.col("sentence_words"), F.col("word_start"), F.col("word_end"), n_min, n_max, lower)).alias("rest"))


def cell_ngrams(mentions: DataFrame, sentences: DataFrame, n_min: int = 1, n_max: int = 1, lower: bool = True) -> DataFrame:
    """The rest of the own sentence, and the cell's other sentences once for each n-gram of that rest."""
    others = _explode(_others(mentions, sentences, F.lit(True), same_cell=True), n_min, n_max, lower)
    repeated = others.join(_rest(mentions, n_min, n_max, lower), "m").where("rest > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rest")))).select("m", "ngram")
    return own_sentence(mentions.where("table_pos is not null"), n_min, n_max, lower).union(repeated)


def neighbour_cells(mentions: DataFrame, sentences: DataFrame, dist: int = 1, n_min: int = 1, n_max: int = 1, lower: bool = True) -> DataFrame:
    """N-grams of the aligned cells at a distance of at most ``dist``, with the direction: rows (m, ngram, direction).

    The own sentence's rest comes with a null direction. A mention that is its whole
    sentence has no neighbours; the others' come once for each n-gram of the rest.
    """
    row, col = grid.min_row_diff(["s", "m_cell"], absolute=False), grid.min_col_diff(["s", "m_cell"], absolute=False)
    near = _others(mentions, sentences, grid.is_axis_aligned("m_cell", "s")).withColumn("r_", row).withColumn("c_d", col)
    # cells in the own row and the own column, each axis in turn
    near = near.where("(r_ = 0 or c_d = 0)").withColumn("times", F.when(F.expr("r_ = 0 and c_d = 0"), 2).otherwise(1))
    near = near.where((F.col("r_").bitwiseXOR(F.col("c_d")) != 0) & (F.abs("r_") + F.abs("c_d") <= dist))
    way = F.when(F.col("c_d") == 0, F.when(F.col("r_") > 0, "DOWN").otherwise("UP")).otherwise(F.when(F.col("c_d") > 0, "RIGHT").otherwise("LEFT"))
    found = _explode(near.withColumn("direction", way), n_min, n_max, lower, "direction")
    repeated = found.join(_rest(mentions, n_min, n_max, lower), "m").where("rest > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rest")))).select("m", "ngram", "direction")
    return own_sentence(mentions.where("table_pos is not null"), n_min, n_max, lower).withColumn("direction", F.lit(None).cast("string")).union(repeated)


def axis_ngrams(mentions: DataFrame, sentences: DataFrame, axis: str, n_min: int = 1, n_max: int = 1, spread: tuple[int, int] = (0, 0), lower: bool = True) -> DataFrame:
    """The rest of the own sentence, and all sentences of the cells in its row (or column)."""
    aligned = _others(mentions, sentences, grid.is_axis_aligned("m_cell", "s", axis, spread))
    return own_sentence(mentions.where("table_pos is not null"), n_min, n_max, lower).union(_explode(aligned, n_min, n_max, lower))


def row_ngrams(mentions: DataFrame, sentences: DataFrame, **options) -> DataFrame:
    return axis_ngrams(mentions, sentences, "row", **options)


def col_ngrams(mentions: DataFrame, sentences: DataFrame, **options) -> DataFrame:
    return axis_ngrams(mentions, sentences, "col", **options)


def aligned_ngrams(mentions: DataFrame, sentences: DataFrame, **options) -> DataFrame:
    return row_ngrams(mentions, sentences, **options).union(col_ngrams(mentions, sentences, **options))


def head_ngrams(mentions: DataFrame, sentences: DataFrame, axis: str | None = None, n_min: int = 1, n_max: int = 1, lower: bool = True) -> DataFrame:
    """N-grams of the first cell of the row and of the column.

    An axis on which the mention itself stands first ends the lookup, so that a
    mention in the first column has no head of either kind, and one in the first row
    has its row's head only.
    """
    m = mentions.where("table_pos is not null")
    parts = []
    for name, other in (("row", "col"), ("col", "row")):
        if axis in (None, name):
            able = m.where(F.col(f"{other}_start") != 0)
            if axis is None and name == "col":
                able = able.where(F.col("col_start") != 0)
            mm = able.select("m", F.col("doc_id").alias("d_"), F.col("table_pos").alias("t_"), F.col("cell_pos").alias("c_"), F.struct(*RECTANGLE).alias("m_cell"))
            cells = sentences.select("doc_id", "table_pos", "cell_pos", F.struct(*RECTANGLE).alias("s")).distinct()
            joined = mm.join(cells, (F.col("d_") == F.col("doc_id")) & (F.col("t_") == F.col("table_pos")) & (F.col("c_") != F.col("cell_pos")) & grid.is_axis_aligned("m_cell", "s", name))
            head = joined.groupBy("m", "doc_id", "table_pos").agg(F.min(F.struct(F.col(f"s.{other}_start"), F.col("cell_pos"))).alias("h")).select("m", "doc_id", "table_pos", F.col("h.cell_pos").alias("cell_pos"))
            parts.append(_explode(head.join(sentences.select("doc_id", "table_pos", "cell_pos", "words"), ["doc_id", "table_pos", "cell_pos"]), n_min, n_max, lower))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def direction_ngrams(mentions: DataFrame, sentences: DataFrame, direction: str, n_min: int = 1, n_max: int = 1, lower: bool = True) -> DataFrame:
    """N-grams of the page's other sentences that are aligned with the mention's box ("horz" or "vert")."""
    test = boxes.horz_aligned if direction == "horz" else boxes.vert_aligned
    m = mentions.select("m", F.col("doc_id").alias("d_"), F.col("sent_pos").alias("p_"), F.col("box").alias("m_box"), F.col("box.page").alias("pg_"))
    # n-grams are made once a sentence, not once a pair
    s = sentences.select("doc_id", "sent_pos", ngrams(F.col("words"), n_min, n_max, lower=lower).alias("grams"), F.col("box").alias("s_box"), F.col("box.page").alias("page"))
    joined = m.join(s, (m["d_"] == s["doc_id"]) & (m["pg_"] == s["page"]) & (m["p_"] != s["sent_pos"]) & test(F.col("s_box"), F.col("m_box")))
    # outer, so that no test of the n-grams' number is made below, which would cut the sentence again
    return joined.select("m", F.explode_outer("grams").alias("ngram")).where("ngram is not null")


def direction_spans(mentions: DataFrame, spans: DataFrame, direction: str, lower: bool = True) -> DataFrame:
    """As ``direction_ngrams``, by single spans with boxes of their own; those that hold the mention or lie in it are left out."""
    test = boxes.horz_aligned if direction == "horz" else boxes.vert_aligned
    m = mentions.select("m", F.col("doc_id").alias("d_"), F.col("sent_pos").alias("p_"), F.col("char_start").alias("s_"), F.col("char_end").alias("e_"), F.col("box").alias("m_box"))
    inside = F.expr("p_ = sent_pos and ((s_ <= char_start and e_ >= char_end) or (s_ >= char_start and e_ <= char_end))")
    joined = m.join(spans, (m["d_"] == spans["doc_id"]) & (F.col("m_box.page") == F.col("box.page")) & test(F.col("box"), F.col("m_box")) & ~inside)
    return joined.select("m", (F.lower("span_text") if lower else F.col("span_text")).alias("ngram"))


def aligned_lemmas(sentences: DataFrame, lemmas: str = "lemmas", most: int = 7) -> DataFrame:
    """Rows (doc_id, sent_pos, lemma): lemmas of earlier sentences at the same height, left, right or centre of a page.

    Only sentences of fewer than ``most`` lemmas lend theirs, alphabetic ones only,
    plain and with the kind of alignment in front.
    """
    b = F.col("box")
    alphabetic = F.when(F.size(lemmas) < most, F.filter(F.transform(F.col(lemmas), F.lower), lambda x: x.rlike(r"^\p{L}+$"))).otherwise(F.array().cast("array<string>"))
    base = sentences.where(F.col("box.page").isNotNull()).select("doc_id", "sent_pos", F.col("box.page").alias("page"), alphabetic.alias("own"), ((b["top"] + b["bottom"]) / 2).alias("yc"), ((b["left"] + b["right"]) / 2).alias("xc"), b["left"].alias("left"), b["right"].alias("right"))
    kinds = {"Y": ("yc", "xc"), "LEFT": ("left", "yc"), "RIGHT": ("right", "yc"), "CENTER": ("xc", "yc")}
    # one exchange by document; everything after it is grouped by the document and more
    near = base.repartition("doc_id").select("doc_id", "page", "sent_pos", "own", F.explode(F.array(*(F.struct(F.lit(name).alias("kind"), F.col(key).cast("double").alias("k"), F.col(along).cast("double").alias("a")) for name, (key, along) in kinds.items()))).alias("x"))
    group = ["doc_id", "page", "kind", "k"]
    rows = near.select("doc_id", "page", "sent_pos", "x.kind", "x.k", "x.a", F.explode_outer(F.array_distinct("own")).alias("w")).where("k is not null")
    # a lemma is seen from its first sentence in the group on; there it is new
    met = F.row_number().over(Window.partitionBy(*group, "w").orderBy("a", "sent_pos"))
    new = rows.withColumn("met", met).groupBy(*group, "a", "sent_pos").agg(F.collect_list(F.when(F.col("met") == 1, F.col("w"))).alias("new"))
    before = Window.partitionBy(*group).orderBy("a", "sent_pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = new.withColumn("seen", F.flatten(F.collect_list("new").over(before))).where(F.size("seen") > 0)
    plain = F.array_distinct(F.flatten(F.collect_list("seen")))
    named = F.flatten(F.collect_list(F.transform("seen", lambda w: F.concat("kind", F.lit("_"), w))))
    whole = seen.groupBy("doc_id", "sent_pos").agg(plain.alias("plain"), named.alias("named"))
    return whole.select("doc_id", "sent_pos", F.explode(F.array_distinct(F.concat("plain", "named"))).alias("lemma"))
