"""Relation edges between documents and between provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.functions.references import digits, internal_refs
from provisio.operators.skew import left_join_filled, top_k
from provisio.operators.tree import suffix_match_path

# Relation codes and graph edge types.
GRAPH_TYPE = {
    "van_ban_bi_bai_bo": "REPEALS",
    "thay_the": "SUPERSEDES",
    "tam_ngung_hieu_luc": "SUSPENDS",
    "dinh_chi_thi_hanh": "SUSPENDS",
    "sua_doi_bo_sung": "AMENDS",
    "bo_sung": "ADDS",
    "can_cu_ban_hanh": "BASED_ON",
    "quy_dinh_chi_tiet_huong_dan_thi_hanh": "DETAILS",
    "huong_dan_ap_dung": "GUIDES",
    "dinh_chinh": "CORRECTS",
    "hop_nhat": "CONSOLIDATES",
    "dan_chieu": "CITES",
    "giai_thich": "EXPLAINS",
    "cong_bo": "ANNOUNCES",
    "ban_dich": "TRANSLATES",
}
GRAPH_TYPES = sorted(set(GRAPH_TYPE.values()))
RELATED_BY_PATH = ("can_cu_ban_hanh", "dan_chieu", "sua_doi_bo_sung")
RELATED_BY_GRAPH = ("BASED_ON", "CITES", "AMENDS", "DETAILS", "GUIDES")
REPEAL_TYPES = ("van_ban_bi_bai_bo", "thay_the")
AMENDMENT_TYPE = {1: "bai_bo", 3: "can_cu", 10: "sua_doi"}
NUMBER_IN_TITLE = r"(?iuU)s[oố]\s+([0-9]+/[0-9]+/[A-Za-z0-9À-ỹĐđ\-]+)"


def relation_type_map(code: Column) -> Column:
    same = F.when(code.isin(*GRAPH_TYPES), code)
    return F.coalesce(P.lookup(GRAPH_TYPE, code), same, F.lit("CITES"))


# -- D4 ---------------------------------------------------------------------

_RELATED = "map<string,struct<count:int,documents:array<struct<doc_id:string,doc_num:string,title:string,doc_type:string,issue_date:string,eff_from:string,eff_to:string>>>>"
RELATIONS_SCHEMA = f"doc_id string, relations {_RELATED}, relations_incoming {_RELATED}"


def _listed(raw: DataFrame) -> DataFrame:
    """One row per listed document, with the direction of its list."""
    def side(field: str, flip: bool) -> DataFrame:
        return (
            raw.select("doc_id", F.explode(field).alias("relation_type", "bucket"))
            .select("doc_id", "relation_type", F.explode("bucket.documents").alias("d"))
            .withColumn("flip", F.lit(flip))
        )

    return side("relations", False).unionByName(side("relations_incoming", True)).filter("d.doc_id <> ''")


def flatten_relations(raw: DataFrame) -> DataFrame:
    """Relation lists -> distinct directed edges; incoming lists are turned round."""
    rows = _listed(raw).filter("doc_id <> '' and relation_type <> ''")
    this, other = F.col("doc_id"), F.col("d.doc_id")
    return rows.select(
        F.when(F.col("flip"), other).otherwise(this).alias("from_doc_id"),
        F.when(F.col("flip"), this).otherwise(other).alias("to_doc_id"), "relation_type",
    ).distinct()


def relation_stubs(raw: DataFrame) -> DataFrame:
    """One placeholder document per listed id."""
    d = _listed(raw).select("d.*")
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    rows = d.select(
        "doc_id", filled(F.col("doc_num"), F.col("doc_id")).alias("doc_num"),
        filled(F.col("title"), F.concat(F.lit("Stub "), F.col("doc_id"))).alias("title"),
        filled(F.col("doc_type"), F.lit("Unknown")).alias("doc_type"),
        *[F.try_to_date(F.substring(c, 1, 10)).alias(c) for c in ("issue_date", "eff_from", "eff_to")],
        F.lit(0).alias("status_flag"),
    )
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("m")).select("doc_id", "m.*")


# -- F1..F3 -----------------------------------------------------------------


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source_path, ref`` -> structural target below the same root.

    Numbers are looked up in the node table of the root by their digits; a number that is
    not there is written out as a label.  Equi-joins on (root, number) only; a
    range of articles meets those that the root has.
    """
    root = P.path_prefix(F.col("path"), 1)
    leaf = P.path_leaf(F.col("path"))
    base = nodes.select("path", "level", "sort_order", root.alias("root"), leaf.alias("leaf"))

    def numbered(level: str, prefix: str, out: str) -> DataFrame:
        n = base.filter((F.col("level") == level) & F.col("leaf").rlike(rf"^{prefix}\d+$"))
        return n.groupBy("root", digits(F.expr(f"substring(leaf, {len(prefix) + 1})")).alias("no")).agg(
            F.max_by("path", F.struct("sort_order", "path")).alias(out))

    arts, chaps = numbered("Article", "D", "art_path"), numbered("Chapter", "C", "chap_path")
    below = base.filter("level in ('Clause', 'Point')").withColumn("art_path", P.article_root(F.col("path")))
    clauses = below.filter("level = 'Clause'").groupBy("art_path", F.col("leaf").alias("k")).agg(
        F.min_by("path", F.struct("sort_order", "path")).alias("clause_path"))
    parent_leaf = P.path_leaf(P.path_parent(F.col("path")))
    points = below.filter("level = 'Point'").groupBy("art_path", parent_leaf.alias("k"), F.col("leaf").alias("pt")).agg(
        F.min_by("path", F.struct("sort_order", "path")).alias("point_path"))

    src = F.col("source_path")
    own = lambda p: digits(F.regexp_extract(src, rf"^(?:.*\.)?{p}(\d+)(?:\.|$)", 1))
    ranges = refs.filter("ref.article_to IS NOT NULL").select(
        "source_path", P.path_prefix(src, 1).alias("root"), F.col("ref.article").alias("low"), F.col("ref.article_to").alias("high")).distinct()
    refs = refs.filter("ref.article_to IS NULL")
    r = F.col("ref")
    needs_own = r["this_article"] | (
        r["article"].isNull() & (r["clause"].isNotNull() | r["point"].isNotNull() | r["this_clause"]))
    step = refs.select(
        "source_path", P.path_prefix(src, 1).alias("root"), r["chapter"].alias("chapter"), r["point"].alias("pt"),
        F.when(needs_own, own("D")).otherwise(r["article"]).alias("art_no"),
        F.when(r["this_clause"], own("K")).otherwise(r["clause"]).alias("clause_no"),
    ).distinct()
    label = lambda p, c: F.concat(F.col("root"), F.lit(f".{p}"), F.col(c).cast("string"))
    # Most references lack a chapter, clause or point, and many name an article that is not there.
    find = lambda rows, there, keys: left_join_filled(rows, there, keys, src)
    step = (
        find(find(step, arts.withColumnRenamed("no", "art_no"), ["root", "art_no"]), chaps.withColumnRenamed("no", "chapter"), ["root", "chapter"])
        .withColumn("base", F.coalesce("art_path", label("D", "art_no")))
        .withColumn("k", F.concat(F.lit("K"), F.col("clause_no").cast("string")))
    )
    step = find(find(step, clauses, ["art_path", "k"]), points, ["art_path", "k", "pt"])
    clause = F.coalesce("clause_path", F.concat_ws(".", "base", "k"))
    target = (
        F.when(F.col("art_no").isNull(), F.coalesce("chap_path", label("C", "chapter")))
        .when(F.col("clause_no").isNull(), F.col("base"))
        .when(F.col("pt").isNull(), clause)
        .otherwise(F.coalesce("point_path", F.concat_ws(".", clause, F.col("pt"))))
    )
    # Digit strings compare as numbers by (length, digits).
    size = lambda c: F.struct(F.length(c), F.col(c))
    spanned = ranges.join(arts, "root").filter((size("no") >= size("low")) & (size("no") <= size("high")))
    named = step.select("source_path", target.alias("target_path")).filter("target_path is not null")
    return named.unionByName(spanned.select("source_path", F.col("art_path").alias("target_path")))


def path_relations(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct citation edges of body and effectivity chunks, self loops dropped."""
    refs = (
        chunks.filter(F.coalesce("chunk_type", F.lit("body")).isin("body", "effectivity"))
        .select(F.col("path").alias("source_path"), F.explode(internal_refs(F.col("chunk_text"))).alias("ref"))
    )
    return (
        resolve_refs(refs, nodes).filter("source_path <> target_path").distinct()
        .withColumn("ref_type", F.lit("dan_chieu"))
    )


# -- F4..F6 -----------------------------------------------------------------

AMENDMENTS_SCHEMA = (
    "map<string,struct<targetProvision:struct<id:string,documentId:string>,sourceProvisions:array<struct<"
    "id:string,documentId:string,titleDocument:string,title:string,type:string,content:string>>>>"
)


def number_in_title(title: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(title, NUMBER_IN_TITLE, 1)), F.lit(""))


def amendment_type(code: Column) -> Column:
    return F.when(code.isNull(), "sua_doi").otherwise(
        F.coalesce(P.lookup(AMENDMENT_TYPE, code.try_cast("int")), F.concat(F.lit("loai_"), code)))


def resolve_doc_number(rows: DataFrame, catalog: DataFrame, fallback: Column | None = None) -> DataFrame:
    """``doc_id, title_document`` -> ``resolved_num`` by catalog, title, fallback."""
    known = catalog.select("doc_id", F.col("doc_num").alias("catalog_num"))
    choices = [F.col("catalog_num"), number_in_title(F.col("title_document"))]
    return rows.join(known, "doc_id", "left").withColumn(
        "resolved_num", F.coalesce(*choices, *([] if fallback is None else [fallback]))).drop("catalog_num")


def clause_amendments(raw: DataFrame, nodes: DataFrame, docs: DataFrame, chunk_paths: DataFrame):
    """Amendment files -> (edges, warnings).

    ``raw``: ``doc_id, amendments`` (map); ``nodes``: ``doc_id, toc_id,
    structural_path``; ``docs``: ``doc_id, doc_num``; ``chunk_paths``: ``doc_id, path``.
    """
    toc = nodes.select("doc_id", "toc_id", "structural_path").dropDuplicates(["doc_id", "toc_id"])
    items = raw.select("doc_id", F.explode("amendments").alias("key", "p")).filter("p is not null").select(
        "doc_id", F.coalesce(F.nullif("p.targetProvision.id", F.lit("")), "key").alias("target_id"), "p.sourceProvisions")
    placed = items.join(
        toc.select("doc_id", F.col("toc_id").alias("target_id"), F.col("structural_path").alias("target_struct")),
        ["doc_id", "target_id"], "left")
    lost = placed.filter("target_struct is null").select(
        "doc_id", F.concat(F.lit("target toc id not found: "), F.col("target_id")).alias("warning"))
    empty = placed.filter("target_struct is not null and coalesce(size(sourceProvisions), 0) <= 0").select(
        "doc_id", F.concat(F.lit("no sources for target "), F.col("target_id")).alias("warning"))
    src = placed.filter("target_struct is not null").select(
        F.col("doc_id").alias("target_doc_id"), "target_struct", F.explode("sourceProvisions").alias("s")
    ).select(
        "target_doc_id", "target_struct", F.nullif("s.documentId", F.lit("")).alias("doc_id"), F.col("s.id").alias("src_id"),
        F.col("s.titleDocument").alias("title_document"), F.col("s.title").alias("title"),
        F.col("s.type").alias("type"), F.col("s.content").alias("note"), P.title_to_path(F.col("s.title")).alias("guess"))
    src = resolve_doc_number(src, docs)
    no_number = src.filter("resolved_num is null").select(
        F.col("target_doc_id").alias("doc_id"),
        F.concat(F.lit("no number for source document "), F.coalesce("doc_id", F.lit("?"))).alias("warning"))
    src = src.filter("resolved_num is not null").join(
        toc.select(F.col("doc_id").alias("target_doc_id"), F.col("toc_id").alias("src_id"),
                   F.col("structural_path").alias("src_struct")), ["target_doc_id", "src_id"], "left")
    by_toc = src.filter("src_struct is not null")
    to_guess = src.filter("src_struct is null")
    structural = chunk_paths.select("doc_id", F.regexp_replace("path", r"^[^.]*\.", "").alias("path"))
    guessed = suffix_match_path(to_guess.filter("guess is not null"), structural).withColumn("src_struct", F.col("resolved"))
    no_place = to_guess.filter("guess is null").select(
        F.col("target_doc_id").alias("doc_id"),
        F.concat(F.lit("no place for source title "), F.coalesce("title", F.lit("?"))).alias("warning"))
    target_num = docs.select(F.col("doc_id").alias("target_doc_id"), F.col("doc_num").alias("target_num"))
    edges = (
        by_toc.unionByName(guessed.drop("resolved")).join(target_num, "target_doc_id", "left")
        .select(
            P.path_build(F.col("resolved_num"), F.col("src_struct")).alias("source_path"),
            P.path_build(F.coalesce("target_num", "target_doc_id"), F.col("target_struct")).alias("target_path"),
            amendment_type(F.col("type")).alias("ref_type"), F.col("doc_id").alias("source_doc_id"), "target_doc_id", "note")
        .dropDuplicates(["source_path", "target_path", "ref_type"])
    )
    return edges, lost.unionByName(empty).unionByName(no_number).unionByName(no_place)


def amendment_sources(raw: DataFrame) -> DataFrame:
    """Distinct source documents named per amended document."""
    return (
        raw.select("doc_id", F.explode(F.map_values("amendments")).alias("p"))
        .select("doc_id", F.explode("p.sourceProvisions").alias("s"))
        .select("doc_id", F.col("s.documentId").alias("source_doc_id")).filter("source_doc_id <> ''").distinct()
    )


# -- F7..F9 -----------------------------------------------------------------


def related_documents(docs: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """``doc_id, related`` one outgoing hop over the related types, first ``limit`` by id."""
    hop = edges.filter(F.col("relation_type").isin(*RELATED_BY_PATH)).select(
        F.col("from_doc_id").alias("doc_id"), F.col("to_doc_id").alias("related"))
    found = hop.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").filter("doc_id <> related").distinct()
    return top_k(found, ["doc_id"], ["related"], limit).drop("rn")


def repealed_by(docs: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """``doc_id, by_doc_id`` documents that repeal or replace."""
    hop = edges.filter(F.col("relation_type").isin(*REPEAL_TYPES)).select(
        F.col("to_doc_id").alias("doc_id"), F.col("from_doc_id").alias("by_doc_id"))
    found = hop.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    return top_k(found, ["doc_id"], ["by_doc_id"], limit).drop("rn")


def graph_related_2hop(seeds: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """Documents within two undirected hops, first ``limit`` by id.

    A document with very many neighbours can supply at most ``limit`` + the
    start + the number of its own nearer ones, so the second hop reads each
    middle document's first ``limit + 1`` neighbours only: those in id order
    are the ones a limit in id order can keep.
    """
    kinds = edges.filter(relation_type_map(F.col("relation_type")).isin(*RELATED_BY_GRAPH))
    both = kinds.select(F.col("from_doc_id").alias("a"), F.col("to_doc_id").alias("b")).unionByName(
        kinds.select(F.col("to_doc_id").alias("a"), F.col("from_doc_id").alias("b"))).filter("a <> b").distinct()
    few = top_k(both, ["a"], ["b"], limit + 1).drop("rn")
    first = both.join(seeds.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi").select(
        F.col("a").alias("doc_id"), F.col("b").alias("related"))
    second = first.join(few, F.col("related") == F.col("a")).select("doc_id", F.col("b").alias("related")).filter(
        "doc_id <> related")
    return top_k(first.unionByName(second).distinct(), ["doc_id"], ["related"], limit).drop("rn")
