"""HTML pages to text blocks, one Arrow batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "page_id bigint, blocks array<struct<kind:string,element_id:string,text:string>>"


class _Blocks(HTMLParser):
    """Paragraphs and tables of one page, with bold / italic marks put once per change."""

    SKIP = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.kind, self.element_id = [], None, ""
        self.parts, self.marks, self.skipping = [], [], 0
        self.rows, self.cells, self.table_depth = None, None, 0

    def _flush(self) -> str:
        lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(self.parts).split("\n")]
        self.parts, self.marks = [], []
        return "\n".join(x for x in lines if x)

    def _close_block(self):
        if self.kind is not None and self.table_depth == 0:
            text = self._flush()
            if text:
                self.blocks.append((self.kind, self.element_id, text))
            self.kind = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skipping += 1
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "table":
            if self.table_depth == 0:
                self._close_block()
                self.kind, self.element_id, self.rows, self.parts = "table", "", [], []
            self.table_depth += 1
        elif self.table_depth and tag == "tr":
            self.cells = []
        elif self.table_depth and tag in ("td", "th"):
            self.parts, self.marks = [], []
        elif tag == "p" and not self.table_depth:
            self._close_block()
            classes = (a.get("class") or "").split()
            names = {"prov-article": "article", "prov-clause": "clause", "prov-content": "content"}
            self.kind = next((v for k, v in names.items() if k in classes), "text")
            self.element_id, self.parts, self.marks = a.get("id") or "", [], []
        if self.kind and tag not in ("p", "table", "tr", "td", "th", "br"):
            style = a.get("style") or ""
            bold = tag in ("b", "strong") or re.search(r"font-weight\s*:\s*bold", style)
            italic = tag in ("i", "em") or re.search(r"font-style\s*:\s*italic", style)
            held = "".join(m for _, m, _ in self.marks)
            mark = ("" if not bold or "b" in held else "b") + ("" if not italic or "i" in held else "i")
            self.marks.append((tag, mark, len(self.parts)))

    def _close_mark(self, tag):
        while self.marks:
            name, mark, start = self.marks.pop()
            if mark:
                sign = {"b": "**", "i": "*", "bi": "***"}[mark]
                inner = "".join(self.parts[start:]).split("\n")
                self.parts[start:] = ["\n".join(f"{sign}{x.strip()}{sign}" if x.strip() else "" for x in inner)]
            if name == tag:
                break

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipping = max(0, self.skipping - 1)
            return
        if any(name == tag for name, _, _ in self.marks):
            self._close_mark(tag)
        if tag in ("td", "th") and self.cells is not None:
            text = self._flush()
            self.cells += [text] if text else []
        elif tag == "tr" and self.cells:
            self.rows.append("  \n".join(self.cells) if len(self.cells) == 1 else " | ".join(self.cells))
            self.cells = None
        elif tag == "table" and self.table_depth:
            self.table_depth -= 1
            if self.table_depth == 0:
                if self.rows:
                    self.blocks.append(("table", "", "\n\n".join(self.rows)))
                self.kind, self.rows, self.parts = None, None, []
        elif tag == "p" and not self.table_depth:
            while self.marks:
                self._close_mark(self.marks[-1][0])
            self._close_block()

    def handle_data(self, data):
        if self.kind and not self.skipping:
            self.parts.append(data.replace("\xa0", " "))

    def result(self):
        while self.marks:
            self._close_mark(self.marks[-1][0])
        self._close_block()
        return self.blocks


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for html in batch["html"]:
            page = _Blocks()
            page.feed(html or "")
            page.close()
            out.append([{"kind": k, "element_id": e, "text": t} for k, e, t in page.result()])
        yield pd.DataFrame({"page_id": batch["page_id"], "blocks": out})


def html_to_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, html`` -> block rows in page order with their markdown line."""
    parsed = pages.select("page_id", "html").mapInPandas(_parse, BLOCK_SCHEMA)
    rows = parsed.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.*")
    tagged = lambda name: F.when(F.col("element_id") != "", F.concat(F.lit(f"<!-- {name}_id: "), "element_id", F.lit(" -->")))
    line = (
        F.when(F.col("kind") == "article", F.concat_ws("\n", F.concat(F.lit("## "), "text"), tagged("article")))
        .when(F.col("kind") == "clause", F.concat_ws(" ", "text", tagged("clause"))).otherwise(F.col("text"))
    )
    return rows.withColumn("markdown", line)


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """Blocks of a page joined again: clauses of a run on consecutive lines, else blank lines between."""
    items = F.array_sort(F.collect_list(F.struct("pos", "kind", "markdown")))
    text = F.aggregate(
        items, F.struct(F.lit("").alias("out"), F.lit("").alias("last")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.when(acc["out"] == "", "").when((acc["last"] == "clause") & (x["kind"] == "clause"), "\n").otherwise("\n\n"), x["markdown"]).alias("out"),
            x["kind"].alias("last")))
    return blocks.groupBy("page_id").agg(F.concat(text["out"], F.lit("\n")).alias("markdown"))
