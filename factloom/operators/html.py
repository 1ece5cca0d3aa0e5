"""HTML to context tables: a tolerant tree on the standard library's tokenizer, walked once a document.

This is the engine's one opaque step. ``parse_html`` yields a single table of tagged
rows, and ``contexts`` projects the seven context tables from it. A document that
can't be placed in the model gives one row of kind ``error`` and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s small span strong sub sup tt u var".split())
#: A start tag closes these open elements, up to the boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"})}


class Element:
    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.text = self.tail = ""
        self.children: list[Element] = []

    def path(self) -> str:
        """The element's path; a step has a position where siblings share its tag."""
        steps, node = [], self
        while node is not None:
            step = node.tag
            if node.parent is not None:
                alike = [c for c in node.parent.children if c.tag == node.tag]
                if len(alike) > 1:
                    step += f"[{next(i for i, c in enumerate(alike, 1) if c is node)}]"
            steps.append(step)
            node = node.parent
        return "/" + "/".join(reversed(steps))

    def ancestors(self) -> list[Element]:
        """From the root down to the element itself."""
        out, node = [], self
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]


class TreeBuilder(HTMLParser):
    """Builds a tree with html and body ensured; unclosed elements are closed as a browser would, roughly."""

    def __init__(self, flatten: tuple[str, ...] = ("span", "br")) -> None:
        super().__init__(convert_charrefs=True)
        self.flatten = frozenset(flatten)
        self.root = Element("html", {}, None)
        self.open = [self.root]
        self.head_done = False

    def _add(self, tag: str, attrs: dict[str, str]) -> Element:
        node = Element(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        return node

    def _body(self) -> None:
        if len(self.open) == 1:
            bodies = [c for c in self.root.children if c.tag == "body"]
            self.open.append(bodies[0] if bodies else self._add("body", {}))

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                self._close(tags, stop)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.root.attrs.update(named)
            return
        if tag in self.flatten:
            return
        if tag == "head" and len(self.open) == 1:
            self.open.append(self._add("head", named))
            return
        if tag == "body":
            del self.open[1:]
            bodies = [c for c in self.root.children if c.tag == "body"]
            if not bodies:
                self.open.append(self._add("body", named))
            else:
                self.open.append(bodies[0])
            return
        if self.open[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base"):
            self.open.pop()
        if len(self.open) == 1:
            self._body()
        if tag in BLOCK:
            self._close({"p"}, {"td", "th", "table", "body", "section", "caption", "figure"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = self._add(tag, named)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in self.flatten and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID or tag in self.flatten:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("table", "body") and tag not in ("table",):
                return

    def handle_data(self, data: str) -> None:
        if len(self.open) == 1:
            if not data.strip():
                return
            self._body()
        if self.open[-1].tag == "head":
            if not data.strip():
                return
            self.open.pop()
            self._body()
        at = self.open[-1]
        if at.children:
            at.children[-1].tail += data
        else:
            at.text += data


@dataclass
class ParserConfig:
    """What the parser is asked for; plain values, so that it can be shipped and stored."""

    blacklist: tuple[str, ...] = ("style", "script")
    flatten: tuple[str, ...] = ("span", "br")
    strip: bool = True
    structural: bool = True
    tabular: bool = True
    delim: str = "."
    replacements: tuple[tuple[str, str], ...] = (("[‐‑‒–—−]", "-"),)
    split_sentences: Callable[[str], Iterator[list[str]]] | None = None


@dataclass
class Context:
    kind: str
    pos: int
    section: int | None = None
    table: int | None = None
    cell: int | None = None
    figure: int | None = None
    caption: int | None = None
    box: tuple[int, int, int, int] | None = None


@dataclass
class Grid:
    taken: set = field(default_factory=set)
    row: int = -1
    col: int = 0
    cells: int = 0


class Placement(ValueError):
    """An element stands where the data model has no place for it."""


COLUMNS = {
    "kind": "string", "pos": "int", "section_pos": "int", "table_pos": "int", "cell_pos": "int", "figure_pos": "int", "caption_pos": "int", "paragraph_pos": "int",
    "row_start": "int", "row_end": "int", "col_start": "int", "col_end": "int", "name": "string", "url": "string", "stable_id": "string", "text": "string",
    "words": "array<string>", "char_offsets": "array<int>", "abs_start": "int", "xpath": "string", "html_tag": "string", "html_attrs": "array<string>", "parent_tag": "string",
    "prev_sib_tags": "array<string>", "next_sib_tags": "array<string>", "anc_tags": "array<string>", "anc_classes": "array<string>", "anc_ids": "array<string>",
}


class Walk:
    """One document's walk in document order: contexts, paragraphs and sentences as rows."""

    def __init__(self, doc: str, config: ParserConfig) -> None:
        self.doc, self.config = doc, config
        self.rows: list[dict] = []
        self.count = dict.fromkeys(("section", "table", "figure", "caption", "paragraph", "sentence"), 0)
        self.grids: dict[int, Grid] = {}
        self.offset = 0
        self.style = ""

    def next(self, kind: str) -> int:
        self.count[kind] += 1
        return self.count[kind] - 1

    def emit(self, kind: str, pos: int, stable: str, **values) -> None:
        self.rows.append({"kind": kind, "pos": pos, "stable_id": f"{self.doc}::{kind}:{stable}", **values})

    def run(self, root: Element) -> list[dict]:
        head = next((c for c in root.children if c.tag == "head"), None)
        self.style = next((c.text for c in head.children if c.tag == "style"), "") if head else ""
        done: set[int] = set()
        todo: list[tuple[Element, Context | None, bool]] = [(root, None, False)]
        while todo:
            node, around, leaving = todo.pop()
            if leaving:
                self.paragraph(node, "tail", around)
                continue
            if id(node) in done:
                continue
            own = self.open(node, around, done) or around
            self.paragraph(node, "text", own)
            todo.append((node, own, True))
            todo += [(c, own, False) for c in reversed(node.children) if c.tag not in self.config.blacklist]
        return self.rows

    def open(self, node: Element, around: Context | None, done: set[int]) -> Context | None:
        name = node.attrs.get("name")
        if node.tag in ("html", "section"):
            pos = self.next("section")
            self.emit("section", pos, str(pos), name=name)
            return Context("section", pos, section=pos)
        if node.tag in ("img", "figure"):
            return self.figure(node, around, name, done)
        if self.config.tabular and node.tag in ("table", "tr", "td", "th"):
            return self.grid(node, around, name)
        if node.tag in ("caption", "figcaption"):
            if around is None or around.kind not in ("table", "figure"):
                raise Placement("a caption needs a table or a figure around it")
            pos = self.next("caption")
            self.emit("caption", pos, str(pos), name=name, table_pos=around.table if around.kind == "table" else None, figure_pos=around.figure)
            return Context("caption", pos, section=around.section, caption=pos)
        return None

    def figure(self, node: Element, around: Context | None, name: str | None, done: set[int]) -> Context | None:
        if around is None or around.kind not in ("section", "cell"):
            return None
        source = node
        if node.tag == "figure":
            images = [c for c in node.children if c.tag == "img"]
            if len(images) != 1:
                if images:
                    done.update(id(c) for c in node.children if c.tag == "figcaption")
                return None
            source = images[0]
            done.add(id(source))
        pos = self.next("figure")
        cell = around.cell if around.kind == "cell" else None
        self.emit("figure", pos, str(pos), name=name, url=source.attrs.get("src"), section_pos=around.section, table_pos=around.table if cell is not None else None, cell_pos=cell)
        return Context("figure", pos, section=around.section, figure=pos)

    def grid(self, node: Element, around: Context | None, name: str | None) -> Context | None:
        if node.tag == "table":
            if around is None or around.kind not in ("section", "cell"):
                raise Placement("a table needs a section or a cell around it")
            pos = self.next("table")
            self.grids[pos] = Grid()
            self.emit("table", pos, str(pos), name=name, section_pos=around.section)
            return Context("table", pos, section=around.section, table=pos)
        if around is None or around.kind != "table":
            raise Placement("a row or cell needs a table around it")
        grid = self.grids[around.pos]
        if node.tag == "tr":
            grid.row, grid.col = grid.row + 1, 0
            return None
        if grid.row < 0:
            raise Placement("a cell needs a row before it")
        while (grid.row, grid.col) in grid.taken:
            grid.col += 1

        def span(attribute: str) -> int:
            try:
                return int(node.attrs.get(attribute, 1)) - 1
            except ValueError:
                return 0

        top, left = grid.row, grid.col
        bottom, right = top + span("rowspan"), left + span("colspan")
        grid.taken.update((r, c) for r in range(top, bottom + 1) for c in range(left, right + 1))
        pos = grid.cells
        grid.cells, grid.col = grid.cells + 1, grid.col + 1
        self.emit("cell", pos, f"{around.pos}:{top}:{left}", name=name, table_pos=around.pos, cell_pos=pos, row_start=top, row_end=bottom, col_start=left, col_end=right)
        return Context("cell", pos, section=around.section, table=around.pos, cell=pos, box=(top, bottom, left, right))

    def paragraph(self, node: Element, part: str, around: Context | None) -> None:
        text = node.text if part == "text" else node.tail
        text = text.strip() if self.config.strip else text
        if not text or around is None:
            return
        for pattern, put in self.config.replacements:
            text = re.sub(pattern, put, text)
        pos = self.next("paragraph")
        cell = around.cell if around.kind == "cell" else None
        place = {"section_pos": around.section, "table_pos": around.table if cell is not None else None, "cell_pos": cell, "caption_pos": around.caption}
        self.emit("paragraph", pos, str(pos), name=node.attrs.get("name"), text=text, **place)
        holder = node if part == "text" else node.parent
        shape = self.shape(holder) if self.config.structural and holder is not None else {}
        box = dict(zip(("row_start", "row_end", "col_start", "col_end"), around.box)) if cell is not None and around.box else {}
        for words in self.sentences(text):
            offsets = [0, *accumulate(len(w) + 1 for w in words[:-1])]
            end = self.offset + offsets[-1] + len(words[-1])
            self.emit("sentence", self.next("sentence"), f"{self.offset}:{end}", name=node.attrs.get("name"), text=" ".join(words), words=words, char_offsets=offsets, abs_start=self.offset, paragraph_pos=pos, **place, **box, **shape)
            self.offset = end

    def sentences(self, text: str) -> Iterator[list[str]]:
        if self.config.split_sentences is not None:
            yield from self.config.split_sentences(text)
            return
        for piece in text.split(self.config.delim):
            words = piece.split()
            if words:
                yield words

    def shape(self, node: Element) -> dict:
        attrs = [f"{k}={v}" for k, v in node.attrs.items()]
        rule = re.search(r"(." + node.attrs["class"] + r")\s*\{(.*?)\}", self.style, re.DOTALL) if self.style and "class" in node.attrs else None
        if rule:
            body = re.sub(r"[\r\n\t]", "", rule.group(2))
            at = next((i for i, a in enumerate(attrs) if "style" in a), None)
            if at is None:
                attrs.append("style=" + re.sub(r"\s+", " ", body.strip()))
            else:
                attrs[at] += body
        line = node.ancestors()
        siblings = node.parent.children if node.parent is not None else [node]
        at = next(i for i, c in enumerate(siblings) if c is node)
        return {
            "xpath": node.path(), "html_tag": node.tag, "html_attrs": attrs, "parent_tag": node.parent.tag if node.parent is not None else None,
            "prev_sib_tags": [c.tag for c in siblings[:at]], "next_sib_tags": [c.tag for c in siblings[at + 1 :]],
            "anc_tags": [a.tag for a in line], "anc_classes": [a.attrs.get("class", "None") for a in line], "anc_ids": [a.attrs.get("id", "None") for a in line],
        }


def build_tree(html: str, flatten: tuple[str, ...] = ("span", "br")) -> Element:
    builder = TreeBuilder(flatten)
    builder.feed(html)
    builder.close()
    return builder.root


def parse_document(doc: str, html: str, config: ParserConfig | None = None) -> list[dict]:
    config = config or ParserConfig()
    return Walk(doc, config).run(build_tree(html, config.flatten))


def parse_html(docs: DataFrame, doc_id: str = "doc_id", html: str = "html", config: ParserConfig | None = None) -> DataFrame:
    """All context rows of all documents. A null text has none; a failing document has one of kind ``error``."""
    config = config or ParserConfig()
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items())

    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = pa.schema([pa.field("doc_id", batch.schema.field(0).type), *(pa.field(k, kinds[v]) for k, v in COLUMNS.items())])
            for a in range(0, batch.num_rows, 256):
                out = []
                for doc, text in zip(*(batch.column(i).slice(a, 256).to_pylist() for i in (0, 1))):
                    if text is None:
                        continue
                    try:
                        rows = parse_document(str(doc), text, config)
                    except Exception as error:  # one bad document must not take the others with it
                        rows = [{"kind": "error", "text": f"{type(error).__name__}: {error}"}]
                    out += [{"doc_id": doc, **r} for r in rows]
                yield from pa.Table.from_pylist(out, shape).to_batches()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(html).alias("html")).mapInArrow(run, schema)


PLACES = {
    "section": ["name", "stable_id"],
    "table": ["section_pos", "name", "stable_id"],
    "cell": ["table_pos", "cell_pos", "row_start", "row_end", "col_start", "col_end", "name", "stable_id"],
    "figure": ["section_pos", "table_pos", "cell_pos", "name", "url", "stable_id"],
    "caption": ["table_pos", "figure_pos", "name", "stable_id"],
    "paragraph": ["section_pos", "table_pos", "cell_pos", "caption_pos", "name", "text", "stable_id"],
    "error": ["text"],
}


def contexts(parsed: DataFrame, kind: str) -> DataFrame:
    """One context table; its position column is named after it (``sent_pos`` for sentences)."""
    if kind == "sentence":
        return parsed.where("kind = 'sentence'").drop("kind", "figure_pos", "caption_pos", "url").withColumnRenamed("pos", "sent_pos")
    rows = parsed.where(F.col("kind") == kind)
    own = [] if kind in ("cell", "error") else [F.col("pos").alias(f"{kind}_pos")]
    return rows.select("doc_id", *own, *PLACES[kind])
