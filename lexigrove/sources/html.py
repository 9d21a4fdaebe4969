"""HTML and Markdown documents to sections, one document at a time in the partition that holds it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexigrove.sources.shared import small_batches, spread

SECTION = (
    "position int, heading string, level int, heading_path array<string>, paragraphs array<string>, lists array<array<string>>,"
    " tables array<struct<headers:array<string>,rows:array<array<string>>>>, code array<struct<content:string,language:string>>, links array<struct<text:string,url:string>>"
)
_SKIP = frozenset("script style noscript template svg canvas".split())
_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol table pre blockquote".split())
_NESTED = frozenset("p ul ol table pre blockquote".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, joint: str = " ") -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if node.strip():
                    parts.append(node.strip() if joint else node)
            elif node.tag not in _SKIP:
                todo.extend(reversed(node.children))
        return joint.join(parts)

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("document", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS and self.at.tag == "p":
            self.at = self.at.parent  # a block ends an open paragraph
        if tag in ("li", "tr", "td", "th") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse_tree(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _new(heading: str | None, level: int | None, path: list[str]) -> dict:
    return {"heading": heading, "level": level, "heading_path": path, "paragraphs": [], "lists": [], "tables": [], "code": [], "links": []}


def _filled(s: dict) -> bool:
    return bool(s["heading"] or s["paragraphs"] or s["lists"] or s["tables"] or s["code"])


class Outline:
    """Sections in order; a heading closes the one before and stands under the last of a higher level."""

    def __init__(self):
        self.done, self.now, self.stack, self.linked = [], _new(None, None, []), [], set()

    def link(self, link: dict) -> None:
        """A section has a link once."""
        if (key := (link["text"], link["url"])) not in self.linked:
            self.linked.add(key)
            self.now["links"].append(link)

    def heading(self, text: str, level: int) -> None:
        if _filled(self.now):
            self.done.append(self.now)
        self.stack = [x for x in self.stack if x[0] < level] + [(level, text)]
        self.now, self.linked = _new(text, level, [t for _, t in self.stack]), set()

    def finish(self) -> list[dict]:
        if _filled(self.now):
            self.done.append(self.now)
        return [{"position": i} | s for i, s in enumerate(self.done)]


def table_of(node: Node) -> dict:
    rows = [n for n in node.walk() if n.tag == "tr"]
    cells = lambda r: [c.text() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]
    head = node.find("thead")
    first = head.find("tr") if head else rows[0] if rows and all(c.tag == "th" for c in rows[0].children if isinstance(c, Node) and c.tag in ("td", "th")) else None
    body = [cells(r) for r in rows if r is not first]
    return {"headers": cells(first) if first else [], "rows": [r for r in body if r]}


def html_sections(html: str) -> list[dict]:
    tree = parse_tree(html)
    root = tree.find("main") or tree.find("article") or tree.find("body") or tree
    out = Outline()
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in _SKIP:
            continue
        if node.tag in _BLOCKS:
            if node.tag[0] == "h" and node.tag[1:].isdigit():
                if text := node.text():
                    out.heading(text, int(node.tag[1]))
                continue
            if node.tag in ("p", "blockquote"):
                if text := node.text():
                    out.now["paragraphs"].append(text if node.tag == "p" else f"> {text}")
            elif node.tag in ("ul", "ol"):
                items = [t for c in node.children if isinstance(c, Node) and c.tag == "li" and (t := c.text())]
                if items:
                    out.now["lists"].append(items)
            elif node.tag == "table":
                found = table_of(node)
                if found["headers"] or found["rows"]:
                    out.now["tables"].append(found)
            else:
                inner = node.find("code") or node
                language = next((c.split("-", 1)[1] for c in inner.attrs.get("class", "").split() if c.startswith(("language-", "lang-"))), None)
                if (text := inner.text("").strip("\n")).strip():
                    out.now["code"].append({"content": text, "language": language})
            for a in node.walk():
                if a.tag == "a" and a.attrs.get("href"):
                    link = {"text": a.text(), "url": a.attrs["href"]}
                    out.link(link)
            continue
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out.finish()


_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)\s*([\w+-]*)")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)")


def _plain(text: str) -> str:
    return re.sub(r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", r"\1", _LINK.sub(r"\1", text)).strip()


def markdown_sections(text: str) -> list[dict]:
    out, lines, i = Outline(), text.replace("\r\n", "\n").split("\n"), 0
    cells = lambda s: [_plain(c) for c in s.strip().strip("|").split("|")]
    para: list[str] = []

    def flush() -> None:
        if para:
            joined = " ".join(x.strip() for x in para)
            out.now["paragraphs"].append(_plain(joined))
            note(joined)
            para.clear()

    def note(raw: str) -> None:
        for label, url in _LINK.findall(raw):
            out.link({"text": label, "url": url})

    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            out.now["code"].append({"content": "\n".join(lines[i + 1 : end]), "language": m[2] or None})
            i = end + 1
            continue
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            if _plain(m[2]):
                out.heading(_plain(m[2]), len(m[1]))
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-{2,}", lines[i + 1]) and "|" in lines[i + 1] + "|":
            flush()
            rows, j = [], i + 2
            while j < len(lines) and "|" in lines[j]:
                rows.append(cells(lines[j]))
                j += 1
            out.now["tables"].append({"headers": cells(line), "rows": rows})
            i = j
            continue
        elif m := _ITEM.match(line):
            flush()
            items, j = [], i
            while j < len(lines) and (m := _ITEM.match(lines[j])):
                items.append(_plain(m[1]))
                note(m[1])
                j += 1
            out.now["lists"].append(items)
            i = j
            continue
        elif line.startswith(">"):
            flush()
            out.now["paragraphs"].append("> " + _plain(line.lstrip("> ")))
        elif not line.strip() or re.match(r"^\s*([-*_])(\s*\1){2,}\s*$", line):
            flush()
        else:
            para.append(line)
        i += 1
    flush()
    return out.finish()


_ROWS = 200  # sections that are held as Python objects at once, but for one document's


def sections(docs: DataFrame, id_col: str, text_col: str, kind: str = "html") -> DataFrame:
    """One row for each section of each document. Documents are parsed one by one, and what is held does not grow with their
    number."""
    make = {"html": html_sections, "markdown": markdown_sections}[kind]
    small_batches(docs.sparkSession)
    shape = StructType([docs.schema[id_col], *StructType.fromDDL(SECTION)])
    to = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for i in range(batch.num_rows):
                one = batch.column(0)[i].as_py()
                rows += ({id_col: one} | s for s in make(batch.column(1)[i].as_py() or ""))
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=to)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=to)

    return spread(docs.select(id_col, text_col)).mapInArrow(run, shape)


def section_text(prefix: str = "") -> Column:
    """The section as text: heading, paragraphs, items, rows and code, parted by blank lines."""
    c = lambda n: F.col(prefix + n)
    joined = lambda rows, sep: F.transform(rows, lambda r: F.array_join(r, sep))
    items = F.transform(c("lists"), lambda one: F.array_join(F.transform(one, lambda x: F.concat(F.lit("- "), x)), "\n"))
    rows = F.transform(c("tables"), lambda t: F.array_join(joined(F.when(F.size(t["headers"]) > 0, F.concat(F.array(t["headers"]), t["rows"])).otherwise(t["rows"]), " | "), "\n"))
    code = F.transform(c("code"), lambda x: F.concat(F.lit("```"), F.coalesce(x["language"], F.lit("")), F.lit("\n"), x["content"], F.lit("\n```")))
    parts = F.concat(F.array(F.coalesce(c("heading"), F.lit(""))), c("paragraphs"), items, rows, code)
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n\n")


def metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Language, title, description, author, keywords and canonical address by pattern, without parsing."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    found = lambda p: F.nullif(F.trim(F.regexp_extract(h, p, 1)), F.lit(""))
    named = lambda n: found(rf"(?is)<meta[^>]*name=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']")
    words = F.filter(F.transform(F.split(F.coalesce(named("keywords"), F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")
    return pages.select(
        id_col, found(r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)").alias("lang"), found(r"(?is)<title[^>]*>([^<]*)</title>").alias("title"), named("description").alias("description"),
        found(r"(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)[\"']").alias("canonical"), named("author").alias("author"), words.alias("keywords"),
    )
