from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import html, visual
from factloom.sources import files

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>.big { color: red;
 }</style></head><body><h1 id=top class="big">Head</h1><!-- gone --><p>One <b>bold</b> tail. More
<p>Two &amp; <span>three</span><br>four − five
<table name=t><caption>Cap</caption><tr><th rowspan=2>A</th><th colspan="2">B</th></tr><tr><td>c<td>d</tr></table>after
<script>var x = "</p>";</script><figure><img src=a.png><figcaption>Fig</figcaption></figure>
<section><ul><li>x<li>y</ul></section></body></html>"""


def rows(text=PAGE, **options):
    return html.parse_document("d", text, html.ParserConfig(**options))


def texts(kind, found):
    return [r["text"] for r in found if r["kind"] == kind]


def test_contexts():
    found = rows()
    count = Counter(r["kind"] for r in found)
    assert (count["section"], count["table"], count["cell"], count["caption"], count["figure"]) == (2, 1, 4, 2, 1)
    assert texts("paragraph", found) == ["T", "Head", "One", "bold", "tail. More", "Two & threefour - five", "Cap", "A", "B", "c", "d", "after", "Fig", "x", "y"]
    cells = [(r["row_start"], r["row_end"], r["col_start"], r["col_end"]) for r in found if r["kind"] == "cell"]
    assert cells == [(0, 1, 0, 0), (0, 0, 1, 2), (1, 1, 1, 1), (1, 1, 2, 2)]
    ids = {r["stable_id"] for r in found}
    assert {"d::section:0", "d::table:0", "d::cell:0:0:1", "d::figure:0", "d::caption:1", "d::paragraph:3", "d::sentence:0:1"} <= ids and len(ids) == len(found)
    assert next(r for r in found if r["kind"] == "figure")["url"] == "a.png"


def test_shape():
    s = {r["text"]: r for r in rows() if r["kind"] == "sentence"}
    head = s["Head"]
    assert (head["xpath"], head["html_tag"], head["parent_tag"]) == ("/html/body/h1", "h1", "body")
    assert head["html_attrs"] == ["id=top", "class=big", "style=color: red;"]
    assert head["anc_tags"] == ["html", "body", "h1"] and head["anc_classes"] == ["None", "None", "big"] and head["anc_ids"][-1] == "top"
    assert s["tail"]["xpath"] == "/html/body/p[1]" and s["bold"]["xpath"] == "/html/body/p[1]/b"
    assert s["y"]["xpath"] == "/html/body/section/ul/li[2]" and s["y"]["prev_sib_tags"] == ["li"]
    joined = "".join(r["text"] for r in rows() if r["kind"] == "sentence")
    assert all(joined[r["abs_start"] :].startswith(r["text"]) for r in s.values())


def test_options():
    assert "var x" in " ".join(texts("paragraph", rows(blacklist=())))
    assert "Two &" in texts("paragraph", rows(flatten=()))
    assert Counter(r["kind"] for r in rows("<p>a<table><tr><td>b</table>", tabular=False))["table"] == 0
    assert texts("sentence", rows("<p>a. b", delim="none")) == ["a. b"]
    assert texts("paragraph", rows("<p> a ", strip=False)) == [" a "]


def test_odd_figures():
    assert not [r for r in rows("<figure>no image</figure>") if r["kind"] == "figure"]
    many = rows("<figure><img src=1><img src=2><figcaption>c</figcaption></figure>")
    assert not [r for r in many if r["kind"] == "caption"] and len([r for r in many if r["kind"] == "figure"]) == 2
    assert texts("paragraph", rows("<table></table>tail")) == ["tail"]


def test_a_bad_document_is_reported(spark):
    docs = spark.createDataFrame([(1, "<tr><td>a</td></tr>"), (2, "<p>fine"), (3, None), (4, "")], "k long, page string")
    parsed = html.parse_html(docs, "k", "page")
    assert [r.doc_id for r in html.contexts(parsed, "error").collect()] == [1]
    assert [(r.doc_id, r.text) for r in html.contexts(parsed, "sentence").collect()] == [(2, "fine")]
    assert {r.doc_id for r in html.contexts(parsed, "section").collect()} == {2, 4}
    assert html.parse_html(docs.limit(0), "k", "page").count() == 0


def put(folder, name, text):
    (folder / name).write_text(text)


def test_file_sources(spark, tmp_path):
    put(tmp_path, "b.html", "<html><p>b</html>")
    put(tmp_path, "a.html", "<html><p>a</html>")
    docs = files.read_html(spark, str(tmp_path))
    assert [(r.name, r.stable_id) for r in files.documents_by_name(docs).collect()] == [("a", "a::document:0:0"), ("b", "b::document:0:0")]
    assert [r.name for r in files.read_html(spark, str(tmp_path), max_docs=1).collect()] == ["a"] and files.count_documents(docs, 1) == 1
    assert sorted((r.name, r.doc_id) for r in files.number_documents(docs).collect()) == [("a", 0), ("b", 1)]
    assert [r.name for r in files.last_documents(docs, spark.createDataFrame([("b",), ("x",)], "name string")).collect()] == ["b"]
    with pytest.raises(OSError):
        files.read_html(spark, str(tmp_path / "none"))
    put(tmp_path, "two.html", "<html></html><html></html>")
    with pytest.raises(Exception, match="more than one"):
        files.read_html(spark, str(tmp_path / "two.html")).collect()
    put(tmp_path, "t.txt", "  some text\n")
    assert files.read_text(spark, str(tmp_path / "t.txt")).first().text == "<html><p name='None'>some text</p></html>"


def test_tables_as_documents(spark, tmp_path):
    put(tmp_path, "x.csv", 'id,note\n1,"a;b"\n2,\n')
    rule = {"note": lambda v: files.column_constructor(v, "part", delim=";")}
    found = [r.text for r in files.read_csv(spark, str(tmp_path / "x.csv"), header=True, parser_rule=rule).orderBy("name").collect()]
    assert found[0] == "<html name='x:0'><section name='id'><p name='None'>1</p></section><section name='note'><p name='part'>a</p><p name='part'>b</p></section></html>"
    assert len(found) == 2 and files.read_csv(spark, str(tmp_path / "x.csv")).count() == 3
    parsed = html.parse_document("x:0", found[0])
    assert Counter(r["kind"] for r in parsed)["section"] == 3
    put(tmp_path, "y.tsv", "head\tx\nn1\ttext one\n")
    (one,) = files.read_tsv(spark, str(tmp_path / "y.tsv"), header=True).collect()
    assert one.name == "n1" and "text one" in one.text
    put(tmp_path, "z.tsv", "no tab here\n")
    with pytest.raises(Exception, match="not a name"):
        files.read_tsv(spark, str(tmp_path / "z.tsv")).collect()
    with pytest.raises(RuntimeError):
        files.build_node("table", "a", "b")


SCAN = """<html><head><meta name="ocr-capabilities" content="ocr_page ocrx_word"></head><body><div class="ocr_page" title="bbox 0 0 9 9; ppageno 3"><p class="ocr_par">
<span class="ocr_line"><span class="ocrx_word" title="bbox 1 2 3 4">Hello</span> <span class="ocrx_word" title="bbox 5 6 7 8; x_wconf 90">wor-</span></span>
<span class="ocr_line"><span class="ocrx_word" title="bbox 9 10 11 12">ld.</span></span></p></div></body></html>"""


def test_scans(spark, tmp_path):
    put(tmp_path, "s.hocr", SCAN)
    docs = files.number_documents(files.read_hocr(spark, str(tmp_path / "s.hocr")))
    s = html.contexts(html.parse_html(docs, "doc_id", "text", html.ParserConfig(delim="none")), "sentence")
    (r,) = visual.scan_boxes(s).collect()
    assert r.words == ["Hello", "wor-", "ld."] and r.left == [1, 5, 9] and r.bottom == [4, 8, 12] and r.page == [1, 1, 1]
    assert r.html_attrs == ["class=ocr_par"]
    (glued,) = files.read_hocr(spark, str(tmp_path / "s.hocr"), space=False).collect()
    assert ">Hellowor-ld.<" in glued.text
    with pytest.raises(ValueError):
        files.fold_hocr("<html><p>no scan</html>")


def test_scanned_words_to_tokens():
    assert visual.align_scan(["ab", "cd"], ["ab", "cd"]) == [(0, 0), (1, 1)]
    assert visual.align_scan(["abcd"], ["ab", "cd"]) == [(0, 1)] and visual.align_scan(["ab", "cd"], ["abcd"]) == [(0, 0), (0, 0)]


def test_links_to_a_page(spark):
    assert visual.link_all("a b a c".split(), "a b a c".split()) == [0, 1, 2, 3]
    assert visual.link_all("a b teh d".split(), "a b the d".split()) == [0, 1, 2, 3]
    assert visual.link_all("a x b".split(), "a x x b".split()) == [0, 1, 3]
    t = spark.createDataFrame([(0, i, w) for i, w in enumerate("a b a teh".split())], "doc_id long, token_pos int, word string")
    w = spark.createDataFrame([(0, i + 5, x) for i, x in enumerate("a b a the".split())], "doc_id long, place int, word string")
    exact = visual.link_exact(t, w, ("token_pos",), ("place",))
    assert sorted((r.token_pos, r.place) for r in exact.collect()) == [(0, 5), (1, 6), (2, 7)]
    assert sorted((r.token_pos, r.place) for r in visual.link_pages(t, w).collect()) == [(0, 5), (1, 6), (2, 7), (3, 8)]
    blocks = spark.createDataFrame([(0, 1, 50, 0, 50, 60, 0, 9, "last"), (0, 1, 0, 0, 0, 9, 5, 9, "b c"), (0, 1, 0, 0, 0, 9, 0, 4, "a")], "doc_id long, page int, block_top int, block_left int, top int, bottom int, left int, right int, text string")
    assert [r.word for r in visual.page_words(blocks).orderBy("place").collect()][-1] == "last"


def test_expressions_of_the_tree(spark):
    s = html.contexts(html.parse_html(spark.createDataFrame([(1, PAGE)], "k long, h string"), "k", "h"), "sentence")
    assert s.where("table_pos is not null").count() == 4 and s.where(F.col("text") == "Cap").first().table_pos is None
