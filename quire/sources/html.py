"""HTML pages as typed rows: blocks, tables, bibliography, metadata.

Pages are parsed in Arrow batches with the standard library's event parser, which
takes unclosed tags as they come; each function maps page rows to many rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Elements without an end tag, and elements whose text is not read.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template", "noscript", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FORMULA_CLASSES = ("ltx_equation", "ltx_eqn_table", "ltx_equationgroup")


class _Reader(HTMLParser):
    """Collects rows (role, level, text, number) in document order, tables as grids, bibliography items apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, str, str | None]] = []
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.items: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.title, self.authors = "", []
        self._text: list[str] = []
        self._role, self._level = "PARAGRAPH", 0
        self._silent = self._math = 0
        self._cells: list[list[list]] = []
        self._item: list[str] | None = None
        self._in_title = False
        self._author: list[str] | None = None
        self._formula: list[str] | None = None

    @staticmethod
    def _clean(parts: list[str]) -> str:
        return re.sub(r"\s+", " ", "".join(parts)).strip()

    def _flush(self):
        text = self._clean(self._text)
        if text and self._item is None and not self._cells:
            self.rows.append((self._role, self._level, text, None))
        self._text, self._role, self._level = [], "PARAGRAPH", 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        css = a.get("class") or ""
        if tag == "title":
            self._in_title = True
        if tag in SILENT:
            self._silent += tag not in VOID
        elif tag in HEADINGS:
            self._flush()
            self._role, self._level = "HEADING", int(tag[1])
        elif tag in ("p", "div", "section", "article", "ul", "ol", "figure", "blockquote"):
            self._flush()
        elif tag in ("figcaption", "caption"):
            self._flush()
            self._role = "CAPTION"
        elif tag == "math":
            self._math += 1
            alt = a.get("alttext") or ""
            if alt:
                (self._formula if self._formula is not None else self._text).append(f"${alt}$")
        elif tag == "table" and any(c in css for c in FORMULA_CLASSES):
            self._flush()
            self._formula = []
        elif tag == "table":
            self._flush()
            self._cells.append([])
        elif tag == "tr" and self._cells:
            self._cells[-1].append([])
        elif tag in ("td", "th") and self._cells:
            if not self._cells[-1]:
                self._cells[-1].append([])
            self._cells[-1][-1].append([[], _span(a.get("rowspan")), _span(a.get("colspan"))])
        elif tag == "li" and ("bibitem" in css or "ltx_bib" in css):
            self._flush()
            self._item = []
        elif tag == "img":
            self.links.append(("FIGURE", a.get("src") or ""))
        elif tag == "a" and a.get("href"):
            self.links.append(("LINK", a["href"]))
        if "ltx_personname" in css or a.get("rel") == "author":
            self._author = []

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        if tag in SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag == "math":
            self._math = max(0, self._math - 1)
        elif tag == "table" and self._formula is not None:
            text = self._clean(self._formula)
            number = re.search(r"\(([0-9A-Za-z.]+)\)\s*$", text)
            if text:
                self.rows.append(("FORMULA", 0, re.sub(r"\s*\([0-9A-Za-z.]+\)\s*$", "", text) if number else text, number.group(1) if number else None))
            self._formula = None
        elif tag == "table" and self._cells:
            grid = self._cells.pop()
            self.tables.append([[(self._clean(c[0]), c[1], c[2]) for c in row] for row in grid])
            self.rows.append(("TABLE", 0, f"table {len(self.tables) - 1}", None))
        elif tag == "li" and self._item is not None:
            text = self._clean(self._item)
            if text:
                self.items.append(text)
            self._item = None
        elif tag in HEADINGS or tag in ("p", "div", "section", "article", "figcaption", "caption", "li", "body", "html"):
            self._flush()
        if tag in ("span", "a", "p") and self._author is not None:
            name = self._clean(self._author)
            if name:
                self.authors.append(name)
            self._author = None

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        if self._silent or self._math:
            return
        if self._author is not None:
            self._author.append(data)
        if self._item is not None:
            self._item.append(data)
        elif self._formula is not None:
            self._formula.append(data)
        elif self._cells:
            if self._cells[-1] and self._cells[-1][-1]:
                self._cells[-1][-1][-1][0].append(data)
        else:
            self._text.append(data)

    def done(self) -> _Reader:
        self.close()
        while self._cells:
            self.handle_endtag("table")
        if self._item is not None:
            self.handle_endtag("li")
        self._flush()
        return self


def _span(value) -> int:
    return max(1, int(value)) if value and str(value).isdigit() else 1


def read(html: str | None) -> _Reader:
    reader = _Reader()
    if html:
        reader.feed(html)
    return reader.done()


def blocks_of(html: str | None) -> list[tuple[int, str, str, str, str | None]]:
    """(pos, role, section_path, text, formula_number) of one page in document order."""
    path: list[tuple[int, str]] = []
    out = []
    for pos, (role, level, text, number) in enumerate(read(html).rows):
        if role == "HEADING":
            path = [p for p in path if p[0] < level] + [(level, text)]
        out.append((pos, role, " > ".join(t for _, t in path), text, number))
    return out


def grid_of(table: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of texts with rowspans carried down; colspans stay one cell, short rows are filled."""
    down: dict[int, tuple[str, int]] = {}
    rows = []
    for cells in table:
        row, queue = [], list(cells)
        while queue or len(row) in down:
            at = len(row)
            if at in down:
                text, left = down.pop(at)
                if left > 1:
                    down[at] = (text, left - 1)
            else:
                text, span, _ = queue.pop(0)
                if span > 1:
                    down[at] = (text, span - 1)
            row.append(text)
        rows.append(row)
    width = max((len(r) for r in rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def grid_html(grid: list[list[str]]) -> str:
    """The grid as an HTML table, first row as heads."""
    line = lambda row, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in row) + "</tr>"
    return "<table>" + "".join(line(r, "th" if i == 0 else "td") for i, r in enumerate(grid)) + "</table>"


def grid_csv(grid: list[list[str]]) -> str:
    """The grid as CSV with ``\\n`` line ends; line breaks in cells become blanks."""
    quote = lambda c: '"' + c.replace('"', '""') + '"' if re.search(r'[",]', c) else c
    return "".join(",".join(quote(re.sub(r"[\r\n]+", " ", c)) for c in row) + "\n" for row in grid)


def _rows(make):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield make(pdf)

    return run


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, role, section_path, text, formula_number) of pages (page_id, html). Null pages give no row."""
    columns = ["page_id", "pos", "role", "section_path", "text", "formula_number"]
    make = lambda pdf: pd.DataFrame([(p, *row) for p, h in zip(pdf["page_id"], pdf["html"]) for row in blocks_of(h)], columns=columns)
    return pages.select("page_id", "html").mapInPandas(_rows(make), "page_id long, pos int, role string, section_path string, text string, formula_number string")


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_index, rows, csv) of every table; ragged rows are filled."""
    columns = ["page_id", "table_index", "rows", "csv"]

    def make(pdf):
        out = []
        for p, h in zip(pdf["page_id"], pdf["html"]):
            for i, t in enumerate(read(h).tables):
                g = grid_of(t)
                out.append((p, i, g, grid_csv(g)))
        return pd.DataFrame(out, columns=columns)

    return pages.select("page_id", "html").mapInPandas(_rows(make), "page_id long, table_index int, rows array<array<string>>, csv string")


def bibliography(pages: DataFrame) -> DataFrame:
    """(page_id, sequence_number, raw_text) of every bibliography item."""
    columns = ["page_id", "sequence_number", "raw_text"]
    make = lambda pdf: pd.DataFrame([(p, i, t) for p, h in zip(pdf["page_id"], pdf["html"]) for i, t in enumerate(read(h).items, 1)], columns=columns)
    return pages.select("page_id", "html").mapInPandas(_rows(make), "page_id long, sequence_number int, raw_text string")


def metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, authors) of each page."""

    def make(pdf):
        read_ = [(p, read(h)) for p, h in zip(pdf["page_id"], pdf["html"])]
        return pd.DataFrame([(p, re.sub(r"\s+", " ", r.title).strip() or next((t for role, lv, t, _ in r.rows if role == "HEADING"), None), r.authors) for p, r in read_], columns=["page_id", "title", "authors"])

    return pages.select("page_id", "html").mapInPandas(_rows(make), "page_id long, title string, authors array<string>")


def experiment_records(grids: DataFrame) -> DataFrame:
    """(table_id, method, metric, value, condition) of numeric cells: first row the metrics, first cell the method."""
    row = F.posexplode("rows").alias("r", "cells")
    cells = grids.select("table_id", F.element_at("rows", 1).alias("heads"), row).where("r > 0")
    each = cells.select("table_id", F.col("cells")[0].alias("method"), "heads", F.posexplode("cells").alias("c", "value"), "cells").where("c > 0")
    is_value = F.col("value").rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?\s*(?:%|±\s*[0-9.]+)?$")
    rest = F.filter(F.slice("cells", 2, 10_000), lambda x: ~x.rlike(r"^[+-]?[0-9.]+") & (x != ""))
    return each.where(is_value).select("table_id", "method", F.get("heads", F.col("c")).alias("metric"), "value", F.array_join(rest, ", ").alias("condition"))
