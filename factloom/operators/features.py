"""Feature generators: rows (m or candidate_id, key, value).

What depends on one mention is computed once a mention and joined to the candidates
(``for_candidates``); the families are a union and a key counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import boxes, grid, paths
from factloom.functions.tokens import left_ngrams, ngrams, part, right_ngrams
from factloom.operators import neighbours
from factloom.settings import Settings, Tabular, Textual

FAMILIES = ("textual", "structural", "tabular", "visual")
#: What a number looks like to the window features: what floats are written as, underscores between digits included.
NUMBER = r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))\s*$"


def _rows(mentions: DataFrame, keys: Column) -> DataFrame:
    return mentions.select("m", F.explode(F.array_distinct(keys)).alias("key"), F.lit(1.0).alias("value"))


def _wrap(prefix: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(f"{prefix}_["), g, F.lit("]")))


def sequence_features(mentions: DataFrame) -> DataFrame:
    """WORD, LEMMA, POS and DEP sequences of the span, from the sentence's arrays words, lemmas, pos_tags and dep_labels."""
    named = {"WORD": "sentence_words", "LEMMA": "lemmas", "POS": "pos_tags", "DEP": "dep_labels"}
    keys = [F.concat(F.lit(f"{k}_SEQ_["), F.array_join(part(F.col(c), F.col("word_start"), F.col("word_end")), " ", ""), F.lit("]")) for k, c in named.items() if c in mentions.columns]
    return _rows(mentions, F.array(*keys))


def window_features(mentions: DataFrame, window: int = 3, isolated: bool = True, combinations: bool = True) -> DataFrame:
    """Lemmas and tags left and right of the span, up to ``window``, and all pairs of both sides.

    Left of the sentence's start the positions count from its end, as far as it has
    so many tokens; right of its end there is nothing. Lemmas that read as numbers are _NUMBER.
    """
    def side(array: str, left: bool, number: bool) -> Column:
        tokens = F.col(array)
        size = F.size(tokens)
        # the i-th token from the span; negative positions wrap round once
        at = (lambda i: F.col("word_start") - i) if left else (lambda i: F.col("word_end") + i)
        there = (lambda i: at(i) >= -size) if left else (lambda i: at(i) < size)
        pick = lambda i: F.get(tokens, F.when(at(i) < 0, at(i) + size).otherwise(at(i)))
        read = (lambda i: F.when(pick(i).rlike(NUMBER), "_NUMBER").otherwise(pick(i))) if number else pick
        inside = F.filter(F.sequence(F.lit(1), F.lit(window)), there)
        found = F.transform(inside, read)
        return F.reverse(found) if left else found

    cols = {"ll": side("lemmas", True, True), "lp": side("pos_tags", True, False), "rl": side("lemmas", False, True), "rp": side("pos_tags", False, False)}
    m = mentions.select("m", *(c.alias(k) for k, c in cols.items()))
    tail = lambda a, i: F.array_join(F.slice(a, F.size(a) - i + 1, i), " ", "")
    head = lambda a, i: F.array_join(F.slice(a, F.lit(1), i), " ", "")
    upto = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    key = lambda prefix, i, body: F.concat(F.lit(f"{prefix}_"), i.cast("string"), F.lit("_["), body, F.lit("]"))
    def one_side(prefix: str, array: str, cut) -> Column:
        return F.transform(upto(F.col(array)), lambda i: key(prefix, i, cut(F.col(array), i)))

    def both_sides(prefix: str, left: str, right: str) -> Column:
        def pair(i: Column, j: Column) -> Column:
            return F.concat(F.lit(f"{prefix}_L_"), i.cast("string"), F.lit("_R_"), j.cast("string"), F.lit("_["), tail(F.col(left), i), F.lit("]_["), head(F.col(right), j), F.lit("]"))

        return F.flatten(F.transform(upto(F.col(left)), lambda i: F.transform(upto(F.col(right)), lambda j: pair(i, j))))

    out = []
    if isolated:
        out += [one_side("W_LEFT", "ll", tail), one_side("W_LEFT_POS", "lp", tail), one_side("W_RIGHT", "rl", head), one_side("W_RIGHT_POS", "rp", head)]
    if combinations:
        out += [both_sides("W_LEMMA", "ll", "rl"), both_sides("W_POS", "lp", "rp")]
    return _rows(m, F.concat(*out))


def word_features(mentions: DataFrame, window: int = 7) -> DataFrame:
    """CONTAINS, LEFT and RIGHT words, the span's type, capital and length."""
    words, start, end = F.col("sentence_words"), F.col("word_start"), F.col("word_end")
    first = F.substring("span_text", 1, 1)
    implicit = F.col("expansion").isNotNull() if "expansion" in mentions.columns else F.lit(False)
    keys = F.concat(
        _wrap("CONTAINS_WORDS", ngrams(part(words, start, end), 1, 2)),
        _wrap("LEFT_WORDS", left_ngrams(words, start, window, 1, 2)),
        _wrap("RIGHT_WORDS", right_ngrams(words, end, window, 1, 2)),
        F.array(F.when(implicit, "SPAN_TYPE_[IMPLICIT]").otherwise("SPAN_TYPE_[EXPLICIT]"), F.concat(F.lit("LENGTH_"), (end - start + 1).cast("string"))),
        F.when(first.rlike(r"^\p{Lu}$"), F.array(F.lit("STARTS_WITH_CAPITAL"))).otherwise(F.array().cast("array<string>")),
    )
    return _rows(mentions, keys)


def textual_features(mentions: DataFrame, settings: Textual = Settings().textual) -> DataFrame:
    """DDL_ sequence and window features and BASIC_ word features."""
    ddl = sequence_features(mentions)
    if "lemmas" in mentions.columns:
        ddl = ddl.union(window_features(mentions, settings.window, settings.isolated, settings.combinations))
    return ddl.withColumn("key", F.concat(F.lit("DDL_"), "key")).union(word_features(mentions, settings.word_window).withColumn("key", F.concat(F.lit("BASIC_"), "key")))


def dependency_edges(sentences: DataFrame) -> DataFrame:
    """Rows (doc_id, sent_pos, node, parent, word, label): the dependency tree, 0-based, the root's parent -1."""
    low = F.array_min("dep_parents")
    edges = sentences.select("doc_id", "sent_pos", low.alias("low"), F.posexplode(F.arrays_zip("dep_parents", "words", "dep_labels")).alias("node", "t"))
    return edges.select("doc_id", "sent_pos", "node", (F.col("t.dep_parents") - F.col("low") - 1).alias("parent"), F.col("t.words").alias("word"), F.col("t.dep_labels").alias("label"))


def dependency_features(mentions: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """TDL_ keys from the dependency tree around a span: words and labels up to ``depth`` steps towards the root, and those
    of children and siblings outside the span. ``mentions`` have m, doc_id, sent_pos, word_start and word_end."""
    e = edges.select("doc_id", "sent_pos", "node", "parent", "word", "label")
    inside = mentions.select("m", "doc_id", "sent_pos", "word_start", "word_end", F.explode(F.sequence("word_start", "word_end")).alias("node"))
    own = inside.join(e, ["doc_id", "sent_pos", "node"])
    outside = lambda node: ~F.col(node).between(F.col("word_start"), F.col("word_end"))
    up = own.select("m", "doc_id", "sent_pos", "word_start", "word_end", F.col("parent").alias("node"), F.array().cast("array<string>").alias("ws"), F.array("label").alias("ls")).where(outside("node"))
    parts = []
    for _ in range(depth):
        up = up.join(e, ["doc_id", "sent_pos", "node"]).withColumn("ws", F.concat(F.array("word"), "ws"))
        parts.append(up.select("m", F.explode(F.array(F.concat(F.lit("PARENT_WORD_["), F.array_join("ws", " "), F.lit("]")), F.concat(F.lit("PARENT_LABEL_["), F.array_join("ls", " "), F.lit("]")))).alias("key")))
        up = up.select("m", "doc_id", "sent_pos", "word_start", "word_end", F.col("parent").alias("node"), "ws", F.concat(F.array("label"), "ls").alias("ls"))
    low = e.select("doc_id", "sent_pos", F.col("node").alias("other"), F.col("parent").alias("p"), F.col("word").alias("w"), F.col("label").alias("l"))
    for name, on in (("CHILD", F.col("p") == F.col("node")), ("SIBLING", (F.col("p") == F.col("parent")) & (F.col("p") >= 0))):
        near = own.alias("x").join(low.alias("y"), (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.sent_pos") == F.col("y.sent_pos")) & on).where(outside("other"))
        parts.append(near.select("m", F.explode(F.array(F.concat(F.lit(f"{name}_WORD_["), "w", F.lit("]")), F.concat(F.lit(f"{name}_LABEL_["), "l", F.lit("]")))).alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct().select("m", F.concat(F.lit("TDL_"), "key").alias("key"), F.lit(1.0).alias("value"))


def structural_features(mentions: DataFrame) -> DataFrame:
    """Keys of the element that holds the mention: html_tag, html_attrs, parent_tag, siblings and ancestors."""
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.col(c), " ", "None")
    keys = F.concat(
        F.array(F.concat(F.lit("TAG_"), "html_tag")),
        F.transform("html_attrs", lambda a: F.concat(F.lit("HTML_ATTR_"), a)),
        F.when(F.col("parent_tag").isNotNull(), F.array(F.concat(F.lit("PARENT_TAG_"), "parent_tag"))).otherwise(none),
        F.when(F.size("prev_sib_tags") > 0, F.array(F.concat(F.lit("PREV_SIB_TAG_"), F.element_at("prev_sib_tags", -1)), F.concat(F.lit("NODE_POS_"), (F.size("prev_sib_tags") + 1).cast("string")))).otherwise(F.array(F.lit("FIRST_NODE"))),
        F.when(F.size("next_sib_tags") > 0, F.array(F.concat(F.lit("NEXT_SIB_TAG_"), F.get("next_sib_tags", F.lit(0))))).otherwise(F.array(F.lit("LAST_NODE"))),
        F.array(F.concat(F.lit("ANCESTOR_CLASS_["), joined("anc_classes"), F.lit("]")), F.concat(F.lit("ANCESTOR_TAG_["), joined("anc_tags"), F.lit("]")), F.concat(F.lit("ANCESTOR_ID_["), joined("anc_ids"), F.lit("]"))),
    )
    return _rows(mentions.where(F.col("html_tag").isNotNull()), F.transform(keys, lambda k: F.concat(F.lit("STR_"), k)))


def _args(candidates: DataFrame, names: tuple[str, ...] | None) -> list[str]:
    """The argument columns a0, a1, ... (or those named)."""
    return list(names) if names else sorted((c for c in candidates.columns if c[:1] == "a" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def _all_set(columns: list[Column]) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def structural_multinary(candidates: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Common ancestor and its depth, of candidates whose arguments all carry an ``xpath``."""
    x = [F.col(f"{a}.xpath") for a in _args(candidates, names)]
    keys = F.array(F.concat(F.lit("STR_COMMON_ANCESTOR_["), F.array_join(paths.common_ancestor(*x), " "), F.lit("]")), F.concat(F.lit("STR_LOWEST_ANCESTOR_DEPTH_["), paths.lowest_common_ancestor_depth(*x).cast("string"), F.lit("]")))
    return candidates.where(_all_set(x)).select("candidate_id", F.explode(keys).alias("key"), F.lit(1.0).alias("value"))


def tabular_features(mentions: DataFrame, sentences: DataFrame, settings: Tabular = Settings().tabular) -> DataFrame:
    """TAB_ keys of one mention: cell, row and column words (or other attributes of the tokens), numbers, spans and heads."""
    m = mentions.where(F.col("table_pos").isNotNull())
    own = m.select("m", F.explode(F.concat(
        F.transform(F.sequence("row_start", "row_end"), lambda r: F.concat(F.lit("ROW_NUM_["), r.cast("string"), F.lit("]"))),
        F.transform(F.sequence("col_start", "col_end"), lambda c: F.concat(F.lit("COL_NUM_["), c.cast("string"), F.lit("]"))),
        F.array(F.concat(F.lit("ROW_SPAN_["), grid.num_rows("").cast("string"), F.lit("]")), F.concat(F.lit("COL_SPAN_["), grid.num_cols("").cast("string"), F.lit("]"))),
    )).alias("key"))
    for attribute in settings.attributes:
        around = sentences if attribute == "words" else sentences.withColumn("words", F.col(attribute))
        mine = m if attribute == "words" else m.withColumn("sentence_words", F.col(attribute))
        tables = {
            "CELL": neighbours.cell_ngrams(mine, around, n_max=settings.cell_ngrams),
            "ROW_HEAD": neighbours.head_ngrams(mine, around, "row", n_max=settings.head_ngrams),
            "COL_HEAD": neighbours.head_ngrams(mine, around, "col", n_max=settings.head_ngrams),
            "ROW": neighbours.row_ngrams(mine, around, n_max=settings.row_ngrams),
            "COL": neighbours.col_ngrams(mine, around, n_max=settings.col_ngrams),
        }
        for name, rows in tables.items():
            own = own.union(rows.select("m", F.concat(F.lit(f"{name}_{attribute.upper()}_["), "ngram", F.lit("]")).alias("key")))
    return own.distinct().select("m", F.concat(F.lit("TAB_"), "key").alias("key"), F.lit(1.0).alias("value"))


def tabular_multinary(candidates: DataFrame, names: tuple[str, ...] | None = None, settings: Tabular = Settings().tabular) -> DataFrame:
    """Distances of a candidate's arguments in one grid or several; SAME_SENTENCE comes with every SAME_CELL."""
    args = _args(candidates, names)
    x = [F.col(a) for a in args]
    row, col = grid.min_row_diff(args, settings.absolute_rows), grid.min_col_diff(args, settings.absolute_cols)
    kind = F.when(grid.same_table(x), "SAME_TABLE").otherwise("DIFF_TABLE")
    number = lambda prefix, v: F.concat(prefix, F.lit("_["), v.cast("string"), F.lit("]"))
    steps = lambda f: sum((a[f] - b[f] for a, b in zip(x[1:-1], x[2:])), x[0][f] - x[1][f])
    keys = F.concat(
        F.array(kind, number(F.concat(kind, F.lit("_ROW_DIFF")), row), number(F.concat(kind, F.lit("_COL_DIFF")), col), number(F.concat(kind, F.lit("_MANHATTAN_DIST")), F.abs(row) + F.abs(col))),
        F.when(grid.same_cell(x), F.array(F.lit("SAME_CELL"), number(F.lit("WORD_DIFF"), steps("word_start")), number(F.lit("CHAR_DIFF"), steps("char_start")), F.lit("SAME_SENTENCE"))).otherwise(F.array().cast("array<string>")),
    )
    tabular = candidates.where(_all_set([a["table_pos"] for a in x]))
    return tabular.select("candidate_id", F.explode(F.array_distinct(F.transform(keys, lambda k: F.concat(F.lit("TAB_"), k)))).alias("key"), F.lit(1.0).alias("value"))


def visual_features(mentions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """VIZ_ keys of one mention: aligned lemmas (of its sentence) and its pages (the tokens' ``pages``, if there are any, or its box's)."""
    aligned = mentions.select("m", "doc_id", "sent_pos").join(lemmas, ["doc_id", "sent_pos"]).select("m", F.concat(F.lit("VIZ_ALIGNED_"), "lemma").alias("key"))
    pages = F.array_distinct("pages") if "pages" in mentions.columns else F.array("box.page")
    page = mentions.where(F.col("box.page").isNotNull()).select("m", F.explode(F.transform(pages, lambda p: F.concat(F.lit("VIZ_PAGE_["), p.cast("string"), F.lit("]")))).alias("key"))
    return aligned.union(page).distinct().withColumn("value", F.lit(1.0))


def visual_multinary(candidates: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """SAME_PAGE, and the alignments on it, of all of a candidate's arguments."""
    b = [F.col(f"{a}.box") for a in _args(candidates, names)]
    tests = {"HORZ_ALIGNED": boxes.horz_aligned, "VERT_ALIGNED": boxes.vert_aligned, "VERT_ALIGNED_LEFT": boxes.vert_aligned_left, "VERT_ALIGNED_RIGHT": boxes.vert_aligned_right, "VERT_ALIGNED_CENTER": boxes.vert_aligned_center}
    keys = F.filter(F.array(F.lit("SAME_PAGE"), *(F.when(boxes.all_aligned(t, b), name) for name, t in tests.items())), lambda k: k.isNotNull())
    same = candidates.where(boxes.same_page(b))
    return same.select("candidate_id", F.explode(F.transform(keys, lambda k: F.concat(F.lit("VIZ_"), k))).alias("key"), F.lit(1.0).alias("value"))


def for_candidates(candidates: DataFrame, n: int, unary: DataFrame) -> DataFrame:
    """The mentions' features for the candidates that hold them; the argument's number follows the family's prefix for n > 1."""
    args = candidates.select("candidate_id", F.posexplode(F.array(*(F.col(f"a{i}.m") for i in range(n)))).alias("i", "m"))
    family, rest = F.substring_index("key", "_", 1), F.expr("substring(key, instr(key, '_'))")
    name = F.col("key") if n == 1 else F.concat(family, F.lit("_e"), F.col("i").cast("string"), rest)
    return args.join(unary, "m").select("candidate_id", name.alias("key"), "value")


def extract(families: dict[str, Callable[[], DataFrame]], wanted: tuple[str, ...] = FAMILIES, custom: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The union of the wanted families and of custom rows (candidate_id, key, value)."""
    unknown = set(wanted) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown feature family: {sorted(unknown)}")
    parts = [families[w]() for w in wanted if w in families] + list(custom)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
