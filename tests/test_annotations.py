import pytest
from pyspark.sql import functions as F

from factloom import settings
from factloom.functions import grid
from factloom.operators import features, keys, labels, learning, numbering
from factloom.plans import package
from factloom.plans.store import Store
from factloom.streaming import incremental


def keyset(df):
    return {r.key for r in df.collect()}


@pytest.fixture(scope="module")
def mention(spark):
    words = "The 12 Big cats sat".split()
    row = (1, words, [w.lower() for w in words], [w[0] for w in words], 2, 3, "Big cats")
    return spark.createDataFrame([row], "m int, sentence_words array<string>, lemmas array<string>, pos_tags array<string>, word_start int, word_end int, span_text string").cache()


def test_textual_features(mention):
    got = keyset(features.textual_features(mention))
    assert {"DDL_WORD_SEQ_[Big cats]", "DDL_POS_SEQ_[B c]", "BASIC_CONTAINS_WORDS_[Big cats]", "BASIC_LEFT_WORDS_[the 12]", "BASIC_RIGHT_WORDS_[sat]", "BASIC_STARTS_WITH_CAPITAL", "BASIC_LENGTH_2", "BASIC_SPAN_TYPE_[EXPLICIT]"} <= got
    # the third word left wraps round to the sentence's end; numbers are named
    assert {"DDL_W_LEFT_1_[_NUMBER]", "DDL_W_LEFT_3_[sat the _NUMBER]", "DDL_W_RIGHT_1_[sat]", "DDL_W_LEMMA_L_2_R_1_[the _NUMBER]_[sat]"} <= got
    assert not {k for k in got if k.startswith("DDL_W_RIGHT_2")}
    assert not [k for k in keyset(features.window_features(mention, combinations=False)) if "_L_" in k]


def test_families(spark, mention):
    rows = mention.select(F.lit("c").alias("candidate_id"), F.struct("m").alias("a0"), F.struct("m").alias("a1"))
    unary = features.word_features(mention).withColumn("key", F.concat(F.lit("BASIC_"), "key"))
    one, two = features.for_candidates(rows, 1, unary), features.for_candidates(rows, 2, unary)
    assert two.count() == 2 * one.count() and "BASIC_e1_LENGTH_2" in keyset(two)
    extra = spark.createDataFrame([("c", "MINE", 2.0)], "candidate_id string, key string, value double")
    assert features.extract({"textual": lambda: one}, custom=(extra,)).count() == one.count() + 1
    with pytest.raises(ValueError):
        features.extract({}, wanted=("smell",))
    edges = features.dependency_edges(spark.createDataFrame([(0, 0, [2, 0, 2], ["a", "b", "c"], ["x", "root", "y"])], "doc_id long, sent_pos int, dep_parents array<int>, words array<string>, dep_labels array<string>"))
    assert sorted((r.node, r.parent) for r in edges.collect()) == [(0, 1), (1, -1), (2, 1)]


def test_pairs(spark):
    side = "struct<xpath:string,table_pos:int,cell_pos:int,row_start:int,row_end:int,col_start:int,col_end:int,word_start:int,char_start:int>"
    c = spark.createDataFrame([("c", ("/html/p", 0, 1, 0, 0, 1, 1, 0, 0), ("/html/p", 0, 1, 0, 0, 1, 1, 2, 7)), ("d", ("/html/p", 0, 1, 0, 0, 1, 1, 0, 0), ("/html/b", 1, 5, 2, 2, 0, 0, 0, 0))], f"candidate_id string, a0 {side}, a1 {side}")
    same = keyset(features.tabular_multinary(c.where("candidate_id = 'c'")))
    assert same == {"TAB_SAME_TABLE", "TAB_SAME_TABLE_ROW_DIFF_[0]", "TAB_SAME_TABLE_COL_DIFF_[0]", "TAB_SAME_TABLE_MANHATTAN_DIST_[0]", "TAB_SAME_CELL", "TAB_WORD_DIFF_[-2]", "TAB_CHAR_DIFF_[-7]", "TAB_SAME_SENTENCE"}
    assert "TAB_DIFF_TABLE_ROW_DIFF_[-2]" in keyset(features.tabular_multinary(c)) and "STR_LOWEST_ANCESTOR_DEPTH_[1]" in keyset(features.structural_multinary(c))


def test_mapping(spark):
    rows = spark.createDataFrame([("c", "a", 1.0, 0), ("c", "a", 2.0, 1), ("c", "b", 1.0, 0), ("c", "b", 0.0, 1)], "candidate_id string, key string, value double, seq int")
    old = spark.createDataFrame([("c", "a", 9.0), ("c", "b", 9.0), ("d", "a", 5.0)], "candidate_id string, key string, value double")
    assert sorted(tuple(r) for r in keys.mapping(rows).collect()) == [("c", "a", 2.0)]
    assert sorted(tuple(r) for r in keys.mapping(rows, old).collect()) == [("c", "a", 2.0), ("d", "a", 5.0)]
    assert keys.wide(old).where("candidate_id = 'c'").first().keys == ["a", "b"]


def test_keys(spark):
    rows = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X"), ("b", "X")], "key string, candidate_type string")
    k = keys.build_keys(rows)
    show = lambda df: {r.key: r.candidate_classes for r in df.collect()}
    assert show(k) == {"a": ["X", "Y"], "b": ["X"]}
    assert show(keys.drop_keys(k, k.select("key"), ["X"])) == {"a": ["Y"]} and show(keys.drop_all_keys(k, ["Y"])) == {"a": ["X"], "b": ["X"]}
    assert show(keys.upsert_keys(k, spark.createDataFrame([("a", ["Z"]), ("c", ["X"])], k.schema))) == {"a": ["Z"], "b": ["X"], "c": ["X"]}
    cells = spark.createDataFrame([("c2", "b", 3.0), ("c1", "a", 1.0), ("c1", "unknown", 1.0)], "candidate_id string, key string, value double")
    assert sorted(tuple(r) for r in keys.matrix(cells, k, cells.select("candidate_id").distinct()).collect()) == [(0, 0, 1.0), (1, 1, 3.0)]


def test_labels(spark):
    c = spark.createDataFrame([(1, "yes"), (2, "no"), (3, None)], "candidate_id long, w string")
    rows = labels.apply_labellers(c, {"word": F.col("w"), "flag": F.col("w") == "yes"}, {"word": ["no", "yes"]})
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "flag", 1), (1, "word", 1), (2, "flag", 0), (2, "word", 0)]
    dense = {r.candidate_id: (r.word, r.flag) for r in keys.dense_labels(rows, ["word", "flag"], c).collect()}
    assert dense == {1: (1, 1), 2: (0, 0), 3: (-1, -1)}
    with pytest.raises(Exception, match="gold"):
        keys.gold_labels(rows, ["word"], c).collect()
    assert keys.gold_labels(rows, ["word"], c.where("w is not null"), "word").count() == 2
    with pytest.raises(Exception, match="unknown value"):
        labels.apply_labellers(c, {"word": F.col("w")}, {"word": ["no"]}).collect()
    r = c.select(labels.shift(F.lit(-1)).alias("s"), labels.unshift(labels.shift(F.lit(1))).alias("u")).first()
    assert (r.s, r.u) == (0, 1) and labels.matches(c, F.when(F.col("w") == "no", -1)).count() == 1
    votes = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", 0), (2, "a", 0), (2, "b", 1)], "candidate_id long, key string, value int")
    assert [tuple(r) for r in labels.majority(votes).collect()] == [(1, 1)]


def test_scores(spark):
    s = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    tp, fp, fn = labels.confusion(s(1, 2, 3, 3), s(1, 2, 4))
    assert [sorted(r.x for r in d.collect()) for d in (tp, fp, fn)] == [[1, 2], [3], [4]]
    r = labels.scores(s(1, 2, 3, 3), s(1, 2, 4)).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and abs(r.f1 - 2 / 3) < 1e-9
    r = labels.scores(s(1).limit(0), s(1).limit(0)).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, None, None, None)
    old = spark.createDataFrame([(1, True, 1, 0.4), (1, False, 1, 0.3)], "candidate_id long, training boolean, value int, probability double")
    new = spark.createDataFrame([(2, [0.2, 0.0, 0.8])], "candidate_id long, p array<double>")
    assert sorted(tuple(r) for r in labels.save_marginals(old, new).collect()) == [(1, False, 1, 0.3), (2, True, 2, 0.8)]


def toy(spark):
    cells = [(str(i), "good" if i % 2 else "bad", 1.0) for i in range(40)] + [(str(i), f"n{i % 5}", 1.0) for i in range(40)]
    rows = spark.createDataFrame(cells, "candidate_id string, key string, value double")
    k = keys.build_keys(rows.withColumn("candidate_type", F.lit("T")))
    return rows, k, keys.matrix(rows, k, rows.select("candidate_id").distinct()).join(rows.select("candidate_id").distinct().withColumn("row", F.row_number().over(__import__("pyspark").sql.Window.orderBy("candidate_id")) - 1), "row")


def test_soft_labels_train_a_classifier(spark):
    _, k, cells = toy(spark)
    x = learning.vectors(cells.select("candidate_id", "col", "value"), k.count(), "candidate_id")
    p = x.select("candidate_id", F.when(F.col("candidate_id").cast("int") % 2 == 1, 0.9).otherwise(0.1).alias("p"))
    rows = learning.soft_rows(x, p, "candidate_id")
    assert rows.count() == 80
    model = learning.fit(rows)
    got = learning.predict(model, x, "candidate_id").collect()
    assert all(r.prediction == int(r.candidate_id) % 2 and abs(r.probability[1] - (0.9 if r.prediction else 0.1)) < 0.05 for r in got)
    assert learning.fit(learning.hard_rows(x, p.select("candidate_id", (F.col("p") > 0.5).cast("int").alias("label")), "candidate_id"), 0.01).numFeatures == k.count()


def test_a_package_predicts_as_before(spark, tmp_path):
    rows, k, cells = toy(spark)
    x = learning.vectors(cells.select("candidate_id", "col", "value"), k.count(), "candidate_id")
    model = learning.fit(learning.soft_rows(x, x.select("candidate_id", (F.col("candidate_id").cast("int") % 2).cast("double").alias("p")), "candidate_id"), 0.01)
    package.stage("toy_candidates")(lambda docs: docs)
    package.stage("toy_features")(lambda found: found.join(rows, "candidate_id"))
    spec = package.PipelineSpec(stages={"candidates": "toy_candidates", "features": "toy_features"})
    package.declare(spec.candidate_classes, "T", {"arguments": ["A"], "nullables": [False]})
    one = package.Package(spec, k, model)
    one.save(str(tmp_path / "p"))
    two = package.Package.load(spark, str(tmp_path / "p"))
    docs = rows.select("candidate_id").distinct()
    assert two.spec == spec and {r.candidate_id: r.prediction for r in two.predict(docs).collect()} == {str(i): i % 2 for i in range(40)}


def test_declarations():
    known = {}
    first = package.declare(known, "T", {"arguments": ["A"]})
    assert package.declare(known, "T", {"arguments": ["A"]}) is first and first["values"] == [True, False]
    for bad in ({"arguments": ["B"]}, {"values": [True], "cardinality": 2}, {"values": [None, "x"]}, {"values": [1, 2]}):
        with pytest.raises(ValueError):
            package.declare(known, "T", bad)


def test_settings(tmp_path, mention):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / settings.FILE).write_text('{"textual": {"word_window": 1}, "tabular": {"attributes": ["words", "lemmas"]}}')
    got = settings.load(tmp_path / "a" / "b")
    assert got.textual.word_window == 1 and got.textual.window == 3 and got.tabular.attributes == ("words", "lemmas") and got.tabular.row_ngrams == 2
    assert settings.Settings().textual.word_window == 7
    # they take effect
    near = {k for k in keyset(features.textual_features(mention, got.textual)) if k.startswith("BASIC_LEFT_WORDS")}
    assert near == {"BASIC_LEFT_WORDS_[12]"}
    with pytest.raises(ValueError):
        settings.overlay(settings.Settings(), {"textual": {"colour": 1}})


def test_three_arguments(spark):
    side = "struct<xpath:string,table_pos:int,cell_pos:int,row_start:int,row_end:int,col_start:int,col_end:int,word_start:int,char_start:int,sent_pos:int,box:struct<page:int,top:int,bottom:int,left:int,right:int>>"
    arg = lambda path, table, cell, r, c, word, box: (path, table, cell, r, r, c, c, word, 4 * word, cell, box)
    b = (1, 0, 10, 0, 50)
    rows = [
        ("cell", arg("/html/p/b", 0, 1, 0, 1, 0, b), arg("/html/p/i", 0, 1, 0, 1, 2, b), arg("/html/p/i", 0, 1, 0, 1, 7, b)),
        ("row", arg("/html/p", 0, 1, 0, 1, 0, b), arg("/html/p", 0, 3, 0, 3, 0, (1, 5, 15, 200, 250)), arg("/html/q", 0, 2, 0, 2, 0, (1, 2, 12, 100, 150))),
        ("tables", arg("/html/p", 0, 1, 0, 1, 0, b), arg("/html/p", 1, 3, 4, 3, 0, b), arg("/html", 0, 2, 2, 0, 0, (2, 2, 12, 100, 150))),
        ("text", arg("/html/p", 0, 1, 0, 1, 0, b), arg("/html/p", None, None, None, None, 0, b), arg("/html", 0, 2, 2, 0, 0, b)),
    ]
    c = spark.createDataFrame(rows, f"candidate_id string, a0 {side}, a1 {side}, a2 {side}")
    of = lambda df, i: keyset(df.where(F.col("candidate_id") == i))
    tab = features.tabular_multinary(c)
    assert of(tab, "cell") >= {"TAB_SAME_CELL", "TAB_WORD_DIFF_[-7]", "TAB_CHAR_DIFF_[-28]", "TAB_SAME_SENTENCE", "TAB_SAME_TABLE_MANHATTAN_DIST_[0]"}
    assert of(tab, "row") == {"TAB_SAME_TABLE", "TAB_SAME_TABLE_ROW_DIFF_[0]", "TAB_SAME_TABLE_COL_DIFF_[1]", "TAB_SAME_TABLE_MANHATTAN_DIST_[1]"}
    assert "TAB_DIFF_TABLE" in of(tab, "tables") and not of(tab, "text")
    viz = features.visual_multinary(c)
    assert of(viz, "row") == {"VIZ_SAME_PAGE", "VIZ_HORZ_ALIGNED"} and not of(viz, "tables")
    strs = features.structural_multinary(c)
    assert of(strs, "cell") == {"STR_COMMON_ANCESTOR_[ html p]", "STR_LOWEST_ANCESTOR_DEPTH_[1]"} and "STR_LOWEST_ANCESTOR_DEPTH_[0]" in of(strs, "tables")
    args = [F.col(f"a{i}") for i in range(3)]
    got = {r.candidate_id: (r.t, r.r, r.c, r.k, r.al) for r in c.select("candidate_id", grid.same_table(args).alias("t"), grid.same_row(args).alias("r"), grid.same_col(args).alias("c"), grid.same_cell(args).alias("k"), grid.is_tabular_aligned(args).alias("al")).collect()}
    assert got == {"cell": (True,) * 5, "row": (True, True, False, False, True), "tables": (False,) * 5, "text": (False,) * 5}


def test_dependency_features(spark):
    sents = spark.createDataFrame([(0, 0, [2, 0, 4, 2], ["Cats", "chase", "small", "mice"], ["subj", "root", "mod", "obj"])], "doc_id long, sent_pos int, dep_parents array<int>, words array<string>, dep_labels array<string>")
    m = spark.createDataFrame([(1, 0, 0, 3, 3), (2, 0, 0, 2, 3)], "m int, doc_id long, sent_pos int, word_start int, word_end int")
    got = features.dependency_features(m, features.dependency_edges(sents))
    one = keyset(got.where("m = 1"))
    assert one == {"TDL_PARENT_WORD_[chase]", "TDL_PARENT_LABEL_[obj]", "TDL_CHILD_WORD_[small]", "TDL_CHILD_LABEL_[mod]", "TDL_SIBLING_WORD_[Cats]", "TDL_SIBLING_LABEL_[subj]"}
    assert not {k for k in keyset(got.where("m = 2")) if "CHILD" in k}  # the child is in the span


def test_numbers_without_a_single_task(spark):
    import random

    values = [random.Random(3).choice("abcdefgh") * k for k in range(1, 120)] * 3
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)] + [(None, -1)], "k string, i int").repartition(5)
    got = numbering.numbered(rows, "k", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(values) + 1))
    assert [r.k for r in got] == [None, *sorted(values)]
    assert numbering.numbered(rows.limit(0), "k", "n").count() == 0


def docs(spark, *ids):
    return spark.createDataFrame([(i, f"text {i}. more {i}") for i in ids], "doc_id long, text string")


STAGES = [("sentences", lambda d: d.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("sent_pos", "s")), ["doc_id", "sent_pos"]), ("mentions", lambda s: s.select("doc_id", "sent_pos", F.length("s").alias("n")), ["doc_id", "sent_pos"])]


def test_store_verbs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("documents") is None
    for _ in range(2):
        incremental.run_batch(store, docs(spark, 1, 2), STAGES)
    assert (store.read("documents").count(), store.read("sentences").count(), store.read("mentions").count()) == (2, 4, 4)
    incremental.run_batch(store, docs(spark, 2, 3), STAGES)
    assert store.read("mentions").count() == 6
    store.upsert("documents", spark.createDataFrame([(3, "new"), (4, "new")], "doc_id long, text string"), ["doc_id"])
    assert sorted(r.doc_id for r in store.read("documents").where("text = 'new'").collect()) == [3, 4]
    store.clear("documents", where=F.col("doc_id") == 1)
    assert store.read("documents").count() == 3 and store.read("sentences").count() == 4 and store.read("mentions").count() == 4
    store.clear("sentences", docs=docs(spark, 2))
    assert store.read("mentions").count() == 2
    store.clear("documents")
    assert store.read("documents").count() == 0 and store.read("mentions").count() == 0


def test_a_stream_of_documents(spark, tmp_path):
    docs(spark, 1, 2, 3).repartition(3).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.start(stream, store, STAGES, str(tmp_path / "ck")).awaitTermination(120)
    assert store.read("mentions").count() == 6
