"""Files to documents: one row (name, stable_id, text) a document."""

from __future__ import annotations

import glob
import html as html_lib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.html import Element, build_tree

ALL = 2**31 - 1


def resolve(path: str, pattern: str = "*") -> list[str]:
    """The files that a path stands for (a file, a folder or a glob), by path; an error if there are none."""
    if os.path.isdir(path):
        found = [p for p in glob.glob(os.path.join(path, pattern)) if os.path.isfile(p)]
    else:
        found = [p for p in glob.glob(path) if os.path.isfile(p)]
    if not found:
        raise OSError(f"no file at {path!r}")
    return sorted(found)


def _documents(df: DataFrame) -> DataFrame:
    return df.select("name", F.concat("name", F.lit("::document:0:0")).alias("stable_id"), "text")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def _whole(spark: SparkSession, path: str, pattern: str, encoding: str, max_docs: int) -> DataFrame:
    """Whole files with their names; the files, not the rows, are cut to ``max_docs``, so no sort is needed."""
    files = resolve(path, pattern)[:max_docs]
    read = spark.read.format("binaryFile").load([f"file://{os.path.abspath(f)}" for f in files])
    return read.select(F.col("path"), _stem(F.col("path")).alias("name"), F.decode("content", encoding).alias("text"))


def read_html(spark: SparkSession, path: str, encoding: str = "UTF-8", max_docs: int = ALL) -> DataFrame:
    """One document a file; a file with more than one html element is an error."""
    whole = _whole(spark, path, "*html", encoding, max_docs)
    roots = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"<html[\s>]"), F.lit(0)))
    return _documents(whole.withColumn("text", F.when(roots <= 1, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("more than one html element in "), "path")))))


def read_text(spark: SparkSession, path: str, encoding: str = "UTF-8", max_docs: int = ALL) -> DataFrame:
    """Whole files as one paragraph each."""
    whole = _whole(spark, path, "*", encoding, max_docs)
    body = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return _documents(whole.withColumn("text", F.concat(F.lit("<html><p name='None'>"), body, F.lit("</p></html>"))))


def build_node(kind: str, name: str | Column, content: str | Column) -> Column:
    """A piece of HTML of a kind: doc, section, text or figure."""
    n = F.lit(name) if isinstance(name, str) or name is None else name
    c = F.lit(content) if isinstance(content, str) else content
    shapes = {"doc": ("<html name='%s'>%s</html>"), "section": ("<section name='%s'>%s</section>"), "text": ("<p name='%s'>%s</p>"), "figure": ("<figure name='%s'><img src='%s'></figure>")}
    if kind not in shapes:
        raise RuntimeError(f"no node of kind {kind!r}")
    return F.format_string(shapes[kind], F.coalesce(n, F.lit("None")), F.coalesce(c, F.lit("")))


def column_constructor(text: Column, name: str | None = None, kind: str = "text", delim: str | None = None) -> Column:
    """A column's value as an array of structs (type, name, content), cut at a delimiter if there is one."""
    parts = F.split(text, re.escape(delim), -1) if delim else F.array(text)
    return F.transform(parts, lambda p: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), p.alias("content")))


def read_csv(spark: SparkSession, path: str, header: bool = False, delim: str = ",", parser_rule: dict | None = None, max_docs: int = ALL) -> DataFrame:
    """One document a record, named ``file:number``; one section a column, named by the header.

    ``parser_rule`` maps a column (its name, or its number without a header) to a
    function from its value to an array of (type, name, content). Files are numbered
    apart, each in the order of its records.
    """
    rules, out = parser_rule or {}, None
    for file in resolve(path, "*csv"):
        read = spark.read.csv(f"file://{os.path.abspath(file)}", header=False, sep=delim, multiLine=True, escape='"')
        numbered = read.withColumn("_n", F.monotonically_increasing_id())  # one file read whole is one partition, in order
        first = numbered.where("_n = 0").first() if header else None
        names = [str(first[c] or "") if header and first else None for c in read.columns]
        rows = numbered.where("_n > 0").withColumn("_n", F.col("_n") - 1) if header else numbered
        sections = []
        for i, (c, name) in enumerate(zip(read.columns, names)):
            rule = rules.get(name if header else i, lambda v: column_constructor(v))
            nodes = rule(F.coalesce(F.col(c), F.lit("")))
            body = F.array_join(F.transform(nodes, lambda x: F.concat(F.lit("<p name='"), F.coalesce(x["name"], F.lit("None")), F.lit("'>"), F.coalesce(x["content"], F.lit("")), F.lit("</p>"))), "")
            sections.append(build_node("section", F.lit(name), body))
        stem = os.path.splitext(os.path.basename(file))[0]
        name = F.concat(F.lit(f"{stem}:"), F.col("_n").cast("string"))
        part = rows.select(name.alias("name"), build_node("doc", name, F.concat(*sections)).alias("text"))
        out = part if out is None else out.union(part)
    return _documents(out.limit(max_docs) if max_docs < ALL else out)


def read_tsv(spark: SparkSession, path: str, header: bool = False, max_docs: int = ALL) -> DataFrame:
    """One document a line: name, tab, text. A line without exactly one tab is an error."""
    out = None
    for file in resolve(path, "*tsv"):
        lines = spark.read.text(f"file://{os.path.abspath(file)}").withColumn("_n", F.monotonically_increasing_id())
        lines = lines.where("_n > 0") if header else lines
        parts = F.split("value", "\t", -1)
        ok = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not a name and a text: "), "value")))
        part = lines.select(ok.alias("p")).select(F.col("p")[0].alias("name"), F.concat(F.lit("<html><p name='None'>"), F.col("p")[1], F.lit("</p></html>")).alias("text"))
        out = part if out is None else out.union(part)
    return _documents(out.limit(max_docs) if max_docs < ALL else out)


def count_documents(docs: DataFrame, max_docs: int = ALL) -> int:
    return min(docs.count(), max_docs)


def fold_hocr(text: str, space: bool = True) -> str:
    """A scan's words folded into their paragraphs: the boxes and pages as attributes, token by token."""
    root = build_tree(text, flatten=())
    if "ocr-capabilities" not in text:
        raise ValueError("no ocr-capabilities in the head")

    def words_of(node: Element) -> Iterator[Element]:
        for c in node.children:
            if "ocrx_word" in c.attrs.get("class", ""):
                yield c
            yield from words_of(c)

    def plain(node: Element) -> str:
        return node.text + "".join(plain(c) + c.tail for c in node.children)

    def write(node: Element, page: list[int]) -> str:
        kind = node.attrs.get("class", "")
        if "ocr_page" in kind.split():
            page[0] += 1
        attrs = {k: v for k, v in node.attrs.items()}
        direct = [c for c in words_of(node)] if node.tag == "p" or any("ocrx_word" in c.attrs.get("class", "") or re.search(r"ocrx?_line", c.attrs.get("class", "")) for c in node.children) else []
        if direct:
            boxes = [re.search(r"bbox (\d+) (\d+) (\d+) (\d+)", w.attrs.get("title", "")) for w in direct]
            tokens = [" ".join(plain(w).split()) for w in direct]
            for i, name in enumerate(("left", "top", "right", "bottom")):
                attrs[name] = " ".join(b.group(i + 1) if b else "0" for b in boxes)
            attrs["ppageno"] = " ".join(str(page[0] - 1) for _ in direct)
            attrs["tokens"] = " ".join(tokens)
            body = html_lib.escape((" " if space else "").join(tokens))
        else:
            body = html_lib.escape(node.text) + "".join(write(c, page) + html_lib.escape(c.tail) for c in node.children)
        inner = "".join(f" {k}='{html_lib.escape(v, quote=True)}'" for k, v in attrs.items())
        return f"<{node.tag}{inner}>{body}</{node.tag}>"

    return write(root, [0])


def read_hocr(spark: SparkSession, path: str, encoding: str = "UTF-8", space: bool = True, max_docs: int = ALL) -> DataFrame:
    """Scans: words folded into paragraphs, pages numbered in their order."""
    whole = _whole(spark, path, "*hocr", encoding, max_docs).drop("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[fold_hocr(t, space) for t in frame["text"]])

    return _documents(whole.mapInPandas(run, "name string, text string"))


def documents_by_name(docs: DataFrame) -> DataFrame:
    return docs.orderBy("name")


def last_documents(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """Documents of the last batch of names that are in the store."""
    return docs.join(batch.select("name").distinct(), "name", "left_semi")


def number_documents(docs: DataFrame) -> DataFrame:
    """Adds doc_id by name. Names are unique; numbering them is one small sort of names."""
    ids = docs.select("name").distinct().withColumn("doc_id", F.row_number().over(Window.orderBy("name")).cast("long") - 1)
    return docs.join(ids, "name")
