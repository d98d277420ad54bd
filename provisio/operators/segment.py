"""Text segmentation: contracts into clauses, statutes into path-addressed chunks.

A text and its pieces stay in one row until the final explode, so numbering
inside a text needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.functions import text as T

# Headings, anchors and markers of statute texts.
ARTICLE_HEADING = r"(?:Điều|ĐIỀU)\s+(\d+)[.:\-)]\s*"
CLAUSE_LIST_HEADING = r"(?m)(?:^|\n)\s*(?:Điều|ĐIỀU)\s+(\d+)\s*[.:)\-–]\s*"
ANCHOR = r"<!--\s*(article|clause)_id:\s*([0-9a-zA-Z_-]+)\s*-->"
MARKED_HEADING = r"(?imuU)^#{1,3}\s*\**\s*(Điều\s+\d+[^\n]*?)\**[^\S\n]*$"
POINT_START = r"(?imu)^\*?([a-zđ])\)\*?\s+"
SIGNATURE_HINT = r"(?iuU)nơi\s*nhận|kt\.\s*thủ\s*tướng|tm\.\s*chính\s*phủ|ký\s*tên"
APPENDIX_HEADING = r"(?imuU)^(?:#{1,3}\s*)?\**\s*Phụ\s*lục\s*[A-Z0-9IVX]*\s*\**[^\n]*$"
PREAMBLE_WIDTH, BLOCK_WIDTH = 12000, 8000


def chunk_by_heading(
    texts: DataFrame, heading: str = ARTICLE_HEADING, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP
) -> DataFrame:
    """``contract_id, text`` -> ``contract_id, chunk_index, clause_number, part, content``.

    ``heading`` must capture the clause number.  Only texts with a piece above
    ``size`` go through the Arrow splitter; the others stay in the JVM.
    """
    flags = "(?md)" if not heading.startswith("(?") else ""  # only \n ends a line
    at_start = rf"(?s){flags}^{heading.lstrip('^')}" if not heading.startswith("(?") else heading
    raw = F.transform(F.split("text", rf"{flags}(?={heading})"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))
    pieces = F.filter(raw, lambda p: p != "")
    has_heading = F.col("text").rlike(f"{flags}{heading}")
    cut = texts.withColumn("__h", has_heading).withColumn(
        "__p", F.when(F.col("__h"), pieces).otherwise(F.array(F.coalesce("text", F.lit("")))))
    long = F.exists("__p", lambda p: F.length(p) > size)
    parts = T.piece_splitter(size, overlap)(F.when(long, F.col("__p")))
    cut = cut.withColumn("__parts", F.coalesce(parts, F.transform("__p", lambda p: F.array(p))))
    number = lambda p: F.when(p.rlike(at_start), F.regexp_extract(p, at_start, 1)).otherwise(F.lit("Preamble"))
    headed = F.flatten(F.transform(
        F.arrays_zip("__p", "__parts"),
        lambda z: F.transform(z["__parts"], lambda c, i: F.struct(
            number(z["__p"]).alias("clause_number"), (i + 1).alias("part"), c.alias("content")))))
    plain = F.transform(F.get("__parts", F.lit(0)), lambda c, i: F.struct(
        (i + 1).cast("string").alias("clause_number"), F.lit(1).alias("part"), F.trim(c).alias("content")))
    out = cut.select("contract_id", F.posexplode(F.when(F.col("__h"), headed).otherwise(plain)).alias("pos", "c"))
    return out.select("contract_id", (F.col("pos") + 1).alias("chunk_index"), "c.*").filter("content <> ''")


def clause_list(texts: DataFrame, heading: str = CLAUSE_LIST_HEADING) -> DataFrame:
    """Headings at line start -> number, title (first line, 150 characters), body on one line."""
    pieces = F.filter(F.split("text", f"(?={heading})"), lambda p: p.rlike(f"^{heading}"))
    rows = texts.select("contract_id", F.posexplode(pieces).alias("pos", "p"))
    body = F.regexp_replace("p", f"^{heading}", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    folded = T.fold_space(F.array_join(lines, "\n"))
    return rows.select(
        "contract_id", (F.col("pos") + 1).alias("position"), F.regexp_extract("p", heading, 1).alias("clause_number"),
        F.substring(F.get(lines, F.lit(0)), 1, 150).alias("title"), F.regexp_replace(folded, "^- ", "").alias("summary"))


# -- statutes ----------------------------------------------------------------


def match_positions(text: Column, pattern: str) -> Column:
    """Array of ``start, end, match`` (0-based) of every match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(
        F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))
    return F.aggregate(steps, zero, lambda acc, s: F.struct(
        (acc["at"] + s["g"] + s["n"]).alias("at"),
        F.array_append(acc["out"], F.struct(
            (acc["at"] + s["g"]).alias("start"), (acc["at"] + s["g"] + s["n"]).alias("end"), s["m"].alias("match"))).alias("out"),
    ))["out"]


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + F.lit(1), F.greatest(end - start, F.lit(0)))


def _anchors(docs: DataFrame) -> DataFrame:
    marks = docs.select("doc_id", "body", match_positions(F.col("body"), ANCHOR).alias("m"))
    rows = marks.select("doc_id", "body", F.posexplode("m").alias("pos", "a"), F.col("m").alias("all"))
    kind = F.regexp_extract("a.match", ANCHOR, 1)
    before = F.substr("body", F.lit(1), F.col("a.start"))
    line_start = F.col("a.start") - F.length(F.substring_index(before, "\n", -1))
    start = F.when(kind == "article", F.col("a.end")).otherwise(line_start)
    end = F.coalesce(F.get("all", F.col("pos") + 1)["start"], F.length("body"))
    return rows.select(
        "doc_id", "body", "pos", kind.alias("kind"), F.regexp_extract("a.match", ANCHOR, 2).alias("element_id"),
        start.alias("start"), end.alias("end"))


def anchor_ranges(docs: DataFrame) -> DataFrame:
    return _anchors(docs).drop("body")


def anchor_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, body`` -> one row per anchor with its text range and heading.

    An article's range starts after its anchor, a clause's at the start of its
    line; both end at the next anchor.
    """
    return _anchors(docs).select(
        "doc_id", "pos", "kind", "element_id", "start", "end", _cut(F.col("body"), F.col("start"), F.col("end")).alias("span"),
        article_heading(F.col("body"), F.col("start")).alias("heading"))


def article_heading(body: Column, start: Column, back: int = 400, ahead: int = 80) -> Column:
    """Last heading in the window around a span start."""
    from_ = F.greatest(F.lit(0), start - back)
    heads = F.regexp_extract_all(_cut(body, from_, start + ahead), F.lit(MARKED_HEADING), F.lit(1))
    return F.trim(F.trim(F.trim(F.try_element_at(heads, F.lit(-1))), F.lit("*")))


def split_points(clauses: DataFrame) -> DataFrame:
    """``key columns, clause_text`` -> lead and one row per lettered point."""
    pieces = F.filter(F.split(F.trim("clause_text"), f"(?={POINT_START})"), lambda p: F.trim(p) != "")
    keys = [c for c in clauses.columns if c != "clause_text"]
    rows = clauses.select(*keys, F.posexplode(pieces).alias("pos", "p"))
    letter = F.lower(F.nullif(F.regexp_extract("p", POINT_START, 1), F.lit("")))
    return rows.select(
        *keys, "pos", F.when(letter == "đ", "dd").otherwise(letter).alias("letter"), F.trim("p").alias("point_text"))


def preamble_chunks(docs: DataFrame) -> DataFrame:
    """Text before the first article, if it is longer than 40 characters."""
    first = F.least(*[
        F.coalesce(F.get(match_positions(F.col("body"), p), F.lit(0))["start"], F.length("body"))
        for p in (MARKED_HEADING, r"<!--\s*article_id:")])
    # The line break before the heading is not part of the text.
    rows = docs.select("doc_id", F.trim(F.regexp_replace(F.substr("body", F.lit(1), first), r"\n\z", "")).alias("t"))
    return rows.filter("length(t) > 40").select(
        "doc_id", F.lit("PREAMBLE").alias("path"), F.lit("preamble").alias("chunk_type"), F.substring("t", 1, PREAMBLE_WIDTH).alias("chunk_text"))


def signature_chunks(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Tail after the last range that the contents place, when it reads like a signature block.

    ``placed``: ``doc_id, element_id`` of the articles and clauses with chunks.
    """
    spans = anchor_ranges(docs).join(placed.select("doc_id", "element_id").distinct(), ["doc_id", "element_id"], "left_semi")
    last = spans.groupBy("doc_id").agg(F.max("end").alias("last_end"))
    tail = F.regexp_replace(F.substr("body", F.col("last_end") + 1, F.length("body")), r"^\s+|\s+$", "")
    rows = docs.join(last, "doc_id").select("doc_id", tail.alias("t"))
    return rows.filter(F.col("t").rlike(SIGNATURE_HINT) & (F.length("t") > 20)).select(
        "doc_id", F.lit("SIGN").alias("path"), F.lit("signature").alias("chunk_type"), F.substring("t", 1, BLOCK_WIDTH).alias("chunk_text"))


TABLE_RUN = r"(?m)(?:^[ \t]*\|[^\n]*(?:\n|\z))+"
SEPARATOR_ROW = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?$"


def _tables(block: Column) -> Column:
    """Array of ``header, rows`` of the markdown tables in a block."""
    runs = F.regexp_extract_all(block, F.lit(TABLE_RUN), F.lit(0))
    lines = F.transform(runs, lambda r: F.filter(F.transform(F.split(r, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    parsed = F.transform(lines, lambda ls: F.struct(
        F.get(ls, F.lit(0)).alias("header"),
        F.slice(ls, F.when(F.get(ls, F.lit(1)).rlike(SEPARATOR_ROW), 3).otherwise(2), F.size(ls)).alias("rows")))
    return F.filter(parsed, lambda t: F.size(t["rows"]) > 0)


def appendix_rows(docs: DataFrame) -> DataFrame:
    """Appendix blocks found by heading: one chunk per table row, else the block."""
    blocks = F.filter(F.split("body", f"(?={APPENDIX_HEADING})"), lambda b: b.rlike(APPENDIX_HEADING))
    rows = docs.select("doc_id", F.posexplode(blocks).alias("pl", "block")).withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", ""))
    title = F.trim(F.trim(F.trim(F.regexp_extract("block", APPENDIX_HEADING, 0)), F.lit("*")))
    rows = rows.withColumn("title", title).withColumn("tables", _tables(F.col("block")))
    token = F.concat(F.lit("PL"), "pl")
    whole = rows.filter("size(tables) = 0").select(
        "doc_id", token.alias("path"), F.substring("block", 1, BLOCK_WIDTH).alias("chunk_text"))
    cells = rows.select("doc_id", token.alias("pl"), "title", F.posexplode("tables").alias("t", "table")).select(
        "doc_id", "pl", "title", "t", "table.header", F.posexplode("table.rows").alias("r", "row"))
    by_row = cells.select(
        "doc_id", F.concat("pl", F.lit(".N"), F.col("t") + 1, F.lit(".R"), F.col("r") + 1).alias("path"),
        F.concat_ws("\n", "title", "header", "row").alias("chunk_text"))
    return whole.unionByName(by_row).withColumn("chunk_type", F.lit("appendix"))


def appendix_node_chunks(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Appendix chunks placed by the table of contents (first table only)."""
    roots = nodes.filter("level = 'Appendix'").select("doc_id", F.col("path").alias("root"), "title")
    groups = nodes.filter("level = 'Group'").select(
        "doc_id", F.col("parent_path").alias("root"), F.struct("node_no", "path", "title").alias("g"))
    listed = groups.groupBy("doc_id", "root").agg(F.array_sort(F.collect_list("g")).alias("groups"))
    j = roots.join(docs.select("doc_id", "body"), "doc_id").join(listed, ["doc_id", "root"], "left")
    at = F.instr(F.lower("body"), F.lower("title"))
    rest = F.when(at > 0, F.substr("body", at, F.length("body")))
    block = F.coalesce(F.get(F.split(rest, rf"(?<=.)(?={APPENDIX_HEADING})"), F.lit(0)), F.col("title"))
    j = j.withColumn("block", block).withColumn("table", F.get(_tables(F.col("block")), F.lit(0)))
    many = F.coalesce(F.size("groups"), F.lit(0))
    cells = j.filter("table is not null").select("doc_id", "root", "title", "groups", many.alias("many"), "table.header", F.posexplode("table.rows").alias("r", "row"))
    by_row = cells.select(
        "doc_id", F.when(F.col("r") < F.col("many"), F.get("groups", F.col("r"))["path"]).otherwise(
            F.concat("root", F.lit(".N1.R"), F.col("r") + 1)).alias("path"),
        F.concat_ws("\n", "title", "header", "row").alias("chunk_text"))
    by_group = j.filter("table is null and size(groups) > 0").select("doc_id", "title", F.explode("groups").alias("g")).select(
        "doc_id", F.col("g.path").alias("path"), F.concat_ws("\n", "title", "g.title").alias("chunk_text"))
    whole = j.filter("table is null and coalesce(size(groups), 0) <= 0").select(
        "doc_id", F.col("root").alias("path"), F.substring("block", 1, BLOCK_WIDTH).alias("chunk_text"))
    return by_row.unionByName(by_group).unionByName(whole).withColumn("chunk_type", F.lit("appendix"))


def body_chunks(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One chunk per cut leaf: article heading, clause lead, point text.

    ``nodes`` are the rows of :func:`tree.flatten_tree`.  All joins are equi-joins
    on (document, path) or (document, element id).
    """
    from provisio.operators.tree import cut_leaves

    n = nodes.withColumn("doc_path", F.concat_ws(".", "doc_id", "path")).withColumn("up", F.concat_ws(".", "doc_id", "parent_path"))
    keyed = n.select(F.col("doc_path").alias("path"), F.when(F.col("parent_path").isNotNull(), F.col("up")).alias("parent_path"),
                     "doc_id", "level", "title", "node_id", "node_no", F.col("path").alias("structural"))
    leaves = cut_leaves(keyed)
    ordinal = keyed.filter("level = 'Point'").groupBy("parent_path").agg(F.array_sort(F.collect_list("node_no")).alias("order"))
    art_path = F.when(F.col("level") == "Article", F.col("path")).otherwise(P.article_root(F.col("path")))
    cl_path = F.when(F.col("level") == "Clause", F.col("path")).otherwise(F.when(F.col("level") == "Point", F.col("parent_path")))
    ids = lambda level, p, i, t: keyed.filter(F.col("level") == level).select(F.col("path").alias(p), F.col("node_id").alias(i), F.col("title").alias(t))
    spans = anchor_spans(docs).dropDuplicates(["doc_id", "kind", "element_id"])
    span = lambda kind, i, s, h: spans.filter(F.col("kind") == kind).select("doc_id", F.col("element_id").alias(i), F.col("span").alias(s), F.col("heading").alias(h))
    j = (
        leaves.withColumn("art_path", art_path).withColumn("cl_path", cl_path)
        .join(ids("Article", "art_path", "art_id", "art_title"), "art_path", "left")
        .join(ids("Clause", "cl_path", "cl_id", "cl_title"), "cl_path", "left")
        .join(span("article", "art_id", "art_span", "heading"), ["doc_id", "art_id"], "left")
        .join(span("clause", "cl_id", "cl_span", "cl_heading"), ["doc_id", "cl_id"], "left")
        .join(ordinal, "parent_path", "left")
    )
    rubric = F.coalesce(F.nullif("heading", F.lit("")), "art_title", F.when(F.col("level") == "Point", "Điều ?").otherwise(""))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, ANCHOR, ""), r"[ \t]+\n", "\n")
    pieces = F.filter(F.split(F.trim(bare(F.col("cl_span"))), f"(?={POINT_START})"), lambda p: F.trim(p) != "")
    lettered = r"(?iu)\A\*?([a-zđ])\)\*?\s+"
    points = F.transform(F.filter(pieces, lambda p: p.rlike(lettered)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    lead = F.get(F.filter(pieces, lambda p: ~p.rlike(lettered)), F.lit(0))
    letter = F.when(P.path_leaf(F.col("path")) == "dd", "đ").otherwise(P.path_leaf(F.col("path")))
    own = F.get(F.filter(points, lambda p: F.lower(F.regexp_extract(p, r"(?iu)\A\*?([a-zđ])\)", 1)) == letter), F.lit(0))
    nth = F.get(points, F.array_position(F.col("order"), F.col("node_no")).cast("int") - 1)
    text = (
        F.when(F.col("level") == "Point", F.concat_ws("\n", rubric, F.nullif(F.regexp_replace(lead, r"\s+$", ""), F.lit("")), F.coalesce(own, nth, F.col("title"))))
        .when(F.col("level") == "Clause", F.concat_ws("\n", rubric, F.coalesce(F.regexp_replace(bare(F.col("cl_span")), r"^\s+|\s+$", ""), F.col("title"))))
        .otherwise(F.concat_ws("\n", rubric, F.nullif(F.regexp_replace(bare(F.col("art_span")), r"^\s+|\s+$", ""), F.lit(""))))
    )
    return j.select(
        "doc_id", F.col("structural").alias("path"), F.coalesce("cl_id", "art_id").alias("source_element_id"),
        F.when(T.is_effectivity_title(rubric), "effectivity").otherwise("body").alias("chunk_type"), F.trim(text).alias("chunk_text"))


def document_chunks(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """All chunks of crawled documents; the appendix by contents where it lists one, else by heading."""
    with_toc = nodes.filter("level = 'Appendix'").select("doc_id").distinct()
    body = body_chunks(docs, nodes)
    used = nodes.filter("level in ('Article', 'Clause')").select("doc_id", F.col("node_id").alias("element_id"))
    parts = [
        preamble_chunks(docs), body, signature_chunks(docs, used),
        appendix_node_chunks(docs, nodes), appendix_rows(docs.join(with_toc, "doc_id", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("structural_path", F.col("path")).withColumn("path", P.path_build(F.col("doc_id"), F.col("path")))


# -- A11 ---------------------------------------------------------------------

NUMBERED_HEADING = r"(?imuU)^[^\S\n]*#{1,3}[^\S\n]*\**[^\S\n]*Điều\s+(\d+)\b"
CLAUSE_NUMBER = r"(?muU)^\s*(?:Khoản\s+)?(\d+)[.)]\s+"


def element_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, body`` -> ``doc_id, article_no, clause_no (0 = article), element_id``.

    Split at anchors; the article number is the last heading seen so far, the
    clause number stands between the previous anchor and this one.  Kept in one
    row per text until the explode.
    """
    gaps = F.split("body", ANCHOR)
    found = F.regexp_extract_all("body", F.lit(ANCHOR), F.lit(0))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("head"), none.alias("art"), F.array().cast(
        "array<struct<article_no:string,clause_no:string,element_id:string>>").alias("out"))

    def step(acc, s):
        head = F.coalesce(F.try_element_at(F.regexp_extract_all(s["g"], F.lit(NUMBERED_HEADING), F.lit(1)), F.lit(-1)), acc["head"])
        is_art = F.regexp_extract(s["m"], ANCHOR, 1) == "article"
        art = F.when(is_art, head).otherwise(acc["art"])
        clause = F.when(is_art, "0").otherwise(F.nullif(F.regexp_extract(s["g"], CLAUSE_NUMBER, 1), F.lit("")))
        return F.struct(head.alias("head"), art.alias("art"), F.array_append(acc["out"], F.struct(
            art.alias("article_no"), clause.alias("clause_no"), F.regexp_extract(s["m"], ANCHOR, 2).alias("element_id"))).alias("out"))

    rows = docs.select("doc_id", F.posexplode(F.aggregate(steps, start, step)["out"]).alias("pos", "e")).select("doc_id", "pos", "e.*")
    return rows.filter("article_no is not null and clause_no is not null").groupBy("doc_id", "article_no", "clause_no").agg(
        F.min_by("element_id", "pos").alias("element_id"))


def backfill_element_ids(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with the id of their clause, else of their article."""
    ids = element_ids(docs)
    no = lambda p: F.nullif(F.regexp_extract("path", rf"(?:^|\.){p}(\d+)(?:\.|$)", 1), F.lit(""))
    c = chunks.withColumn("article_no", no("D")).withColumn("clause_no", no("K"))
    by_clause = ids.filter("clause_no <> '0'").withColumnRenamed("element_id", "clause_el")
    by_article = ids.filter("clause_no = '0'").select("doc_id", "article_no", F.col("element_id").alias("article_el"))
    return (
        c.join(by_clause, ["doc_id", "article_no", "clause_no"], "left").join(by_article, ["doc_id", "article_no"], "left")
        .withColumn("source_element_id", F.coalesce("clause_el", "article_el")).drop("article_no", "clause_no", "clause_el", "article_el")
    )
