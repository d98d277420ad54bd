"""Citations in model answers: parsing, cleaning, grounding on retrieved law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.functions import scope as SC
from provisio.functions import status as S
from provisio.functions.let import bind, strip
from provisio.functions.text import article_title, clean_quote, deep_link, strip_internal_refs
from provisio.operators.skew import top_k

# Where a citation starts in free text.
NUMBER = r"(?<!\d)\d{1,4}/\d{4}/[A-ZĐ0-9.-]+"
KIND = r"(?:Thông\s*tư|Nghị\s*định|Quyết\s*định|Luật|Bộ\s*luật|Chỉ\s*thị|Nghị\s*quyết|Thông\s*báo|Công\s*văn)\s+"
CITATION = rf"(?iuU)(?:(?:{KIND})?{NUMBER}|Điều\s+\d+(?:\s+(?:Bộ\s+)?luật[^\n\[\]:;.]{{0,40}})?)"
GENERIC_TITLE = "Căn cứ pháp lý"
MAX_CITATIONS = 4

MODEL_CITATION = "array<struct<title:string,label:string,name:string,doc_number:string,summary:string,points:array<string>,location:string>>"
MODEL_FINDING = (
    "severity string, title string, issue string, summary_topics string, reasons string, impact string, actions string, "
    f"legal_basis string, legal_citations {MODEL_CITATION}, evidence_paths array<string>, recommendation string, "
    "revised_clause string, confidence string"
)


# -- H25, H26 -------------------------------------------------------------------


def _object(text: Column) -> Column:
    """The text if it is a JSON object, as it stands or after small repairs."""
    def valid(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*\{"), t)

    fixed = F.regexp_replace(text, r"\}\s*,\s*([}\]])", "}$1")
    fixed = F.regexp_replace(fixed, r",\s*(?=[}\]])", "")
    fixed = F.translate(fixed, "“”‘’", "\"\"''")
    return F.coalesce(valid(text), valid(fixed))


def parse_model_json(raw: Column) -> Column:
    """JSON object text of a model answer: fenced block, repaired, or the first ``{…}``; else null."""
    t = strip(raw)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(t.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(fenced)).otherwise(t)
    block = F.nullif(F.regexp_extract(body, r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0), F.lit(""))
    return F.coalesce(_object(body), _object(block))


def _strings(json_value: Column) -> Column:
    """A JSON string or list (of strings or of ``text/point/label`` objects) as a clean list."""
    plain = F.from_json(json_value, "array<string>")
    items = F.when(json_value.startswith("["), plain).otherwise(F.array(json_value))
    bare = F.transform(items, lambda x: strip(F.when(x.startswith("{"), F.coalesce(
        F.get_json_object(x, "$.text"), F.get_json_object(x, "$.point"), F.get_json_object(x, "$.label"))).otherwise(x)))
    return F.filter(F.coalesce(bare, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))


def confidence(value: Column) -> Column:
    n = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n))) + F.when(n.isNull(), F.lit(None)).otherwise(0.0)


def findings_from_model(answers: DataFrame) -> DataFrame:
    """``contract_id, clause_ref, raw`` -> finding rows; ``ok`` answers without an issue are dropped."""
    j = answers.withColumn("js", parse_model_json(F.col("raw"))).filter("js is not null").withColumn("m", F.from_json("js", MODEL_FINDING))
    trimmed = lambda c: F.nullif(strip(f"m.{c}"), F.lit(""))
    severity = F.coalesce("m.severity", F.lit("ok"))
    quoted = strip(F.regexp_extract("m.recommendation", "«([^»]+)»", 1))
    revised = F.coalesce(trimmed("revised_clause"), F.when(F.length(quoted) > 40, quoted))
    reasons, actions = _strings(F.col("m.reasons")), _strings(F.col("m.actions"))
    issue = F.coalesce(trimmed("issue"), F.when(F.size(reasons) > 0, F.concat(
        F.lit("Kết luận: "), F.coalesce("m.title", F.lit("Có vấn đề cần xử lý.")), F.lit("\nLý do:\n"),
        F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("- "), r)), "\n"))), F.lit(""))
    fallback = F.nullif(F.concat_ws("\n", F.nullif(F.array_join(F.transform(actions, lambda a: F.concat(F.lit("- "), a)), "\n"), F.lit("")),
                                    F.concat(F.lit("«"), revised, F.lit("»"))), F.lit(""))
    return j.filter(~((severity == "ok") & trimmed("issue").isNull())).select(
        "contract_id", "clause_ref", trimmed("title").alias("title"), issue.alias("issue"), severity.alias("severity"),
        _strings(F.col("m.summary_topics")).alias("summary_topics"), reasons.alias("reasons"), _strings(F.col("m.impact")).alias("impact"),
        actions.alias("actions"), trimmed("legal_basis").alias("legal_basis"), F.coalesce(trimmed("recommendation"), fallback).alias("recommendation"),
        revised.alias("revised_clause"), confidence(F.col("m.confidence")).alias("confidence"),
        F.col("m.legal_citations").alias("legal_citations"), F.col("m.evidence_paths").alias("evidence_paths"))


# -- H27, H28 -------------------------------------------------------------------


def citations_from_text(basis: Column) -> Column:
    """Array of ``title, summary``; a document number is never cut at its slashes."""
    tidy = lambda b: F.regexp_replace(F.regexp_replace(b, r"^[\s:.—–\-]+", ""), r"[\s.;]+$", "")

    def cited(text: Column, heads: Column) -> Column:
        bodies = F.slice(F.split(text, CITATION), F.lit(2), F.size(heads))
        rows = F.zip_with(heads, bodies, lambda h, b: F.struct(F.rtrim(strip(h), F.lit(" :—–-")).alias("title"), tidy(b).alias("summary")))
        generic = F.array(F.struct(F.lit(GENERIC_TITLE).alias("title"), text.alias("summary")))
        return F.when(text == "", F.slice(generic, 1, 0)).when(F.size(heads) == 0, generic).otherwise(rows)

    return bind(strip_internal_refs(basis), lambda t: bind(F.regexp_extract_all(t, F.lit(CITATION), F.lit(0)), lambda h: cited(t, h)))


def citations_from_model(items: Column) -> Column:
    """Model citation array -> ``title, summary, doc_number``; untitled items are dropped."""
    filled = lambda c: F.nullif(strip(c), F.lit(""))

    def one(c: Column) -> Column:
        title = F.coalesce(*[filled(c[n]) for n in ("title", "label", "name", "doc_number")], F.lit(""))
        points = F.array_join(F.filter(F.transform(c["points"], lambda p: strip(p)), lambda p: p != ""), " ")
        return F.struct(
            strip_internal_refs(title).alias("title"), strip_internal_refs(F.coalesce(c["summary"], points)).alias("summary"),
            filled(c["doc_number"]).alias("doc_number"))

    return F.filter(F.transform(F.coalesce(items, F.array().cast(MODEL_CITATION)), one), lambda c: c["title"] != "")


def resolve_citations(items: Column, basis: Column) -> Column:
    """Structured citations when there are any, else those of the free text."""
    structured = F.transform(citations_from_model(items), lambda c: F.struct(c["title"].alias("title"), c["summary"].alias("summary")))
    return F.when(F.size(structured) > 0, structured).otherwise(citations_from_text(basis))


def basis_line(citations: Column) -> Column:
    parts = F.transform(citations, lambda c: F.when(F.coalesce(c["summary"], F.lit("")) != "", F.concat(
        c["title"], F.lit(": "), c["summary"])).otherwise(c["title"]))
    return F.nullif(F.array_join(parts, "; "), F.lit(""))


# -- H29, H30 -------------------------------------------------------------------


def ground_citations(findings: DataFrame, hits: DataFrame, as_of, max_citations: int = MAX_CITATIONS, sectors=SC.SECTORS, general: str = SC.GENERAL_LABOR) -> DataFrame:
    """Citations of a finding kept to the law retrieved for it.

    ``findings``: ``finding_id, evidence_paths, citations (title, summary,
    doc_number), context``; ``hits``: ``finding_id, path`` with document columns
    (a top-k result per finding).  Asked-for paths first, else the first hit per
    citation whose number or title fits; dead or sector-bound law is dropped;
    one per document and article.  A finding of which nothing could be grounded keeps its
    own citations, with ``grounded`` false.
    """
    law = SC.scope_text(F.col("title"), F.col("doc_num"), F.col("doc_type"), F.col("chunk_text"))
    pool = hits.join(findings.select("finding_id", "context"), "finding_id").filter(~SC.sector_mismatch(law, F.col("context"), sectors, general))
    asked = findings.select("finding_id", F.posexplode("evidence_paths").alias("ord", "path")).withColumn("path", strip("path"))
    none = F.lit(None).cast("string")
    by_path = asked.join(pool, ["finding_id", "path"]).withColumn("model_summary", none)
    cited = findings.select("finding_id", F.posexplode("citations").alias("ord", "c")).select(
        "finding_id", "ord", F.lower(F.coalesce(F.nullif("c.doc_number", F.lit("")), "c.title")).alias("needle"), F.col("c.summary").alias("model_summary"))
    fits = F.contains(F.col("needle"), F.nullif(F.lower("doc_num"), F.lit(""))) | ((F.col("needle") != "") & F.contains(F.lower("title"), F.col("needle")))
    by_name = cited.join(pool, "finding_id").filter(fits)
    by_name = top_k(by_name, ["finding_id", "ord"], ["path"], 1).drop("rn", "needle")
    with_path = by_path.select("finding_id").distinct()
    chosen = by_path.unionByName(by_name.join(with_path, "finding_id", "left_anti"), allowMissingColumns=True)
    loc = P.path_location(F.col("path"))
    rows = (
        chosen.withColumn("effect", S.evaluate_effect(F.lit(True), F.col("status_flag"), F.col("eff_from"), F.col("eff_to"), as_of))
        .filter("effect.ok_to_cite").withColumn("quote", clean_quote(F.col("chunk_text"))).filter("quote <> ''").withColumn("loc", loc))
    key = F.concat_ws("|", F.lower(F.coalesce("doc_num", "title")), F.coalesce("loc.article", F.lit("")))
    once = top_k(rows.withColumn("akey", key), ["finding_id", "akey"], ["ord", "path"], 1).drop("rn")
    best = top_k(once, ["finding_id"], ["ord", "path"], max_citations, "position")
    element = F.col("source_element_id") if "source_element_id" in best.columns else none
    url = F.col("source_url") if "source_url" in best.columns else none
    target = F.coalesce(article_title(F.col("chunk_text")), F.col("loc.article"), F.col("quote"))
    kept = best.select(
        "finding_id", "position", "title", F.coalesce("model_summary", F.lit("")).alias("summary"), F.col("doc_num").alias("doc_number"),
        F.col("loc.location").alias("location"), F.col("loc.article").alias("article"), F.col("loc.clause").alias("clause"), F.col("loc.point").alias("point"),
        "quote", deep_link(url, element, target).alias("deep_link"), F.col("path").alias("evidence_path"), element.alias("source_element_id"),
        F.col("effect.status_label").alias("status"), F.lit(True).alias("grounded"))
    bare = findings.join(kept.select("finding_id").distinct(), "finding_id", "left_anti").select("finding_id", F.posexplode("citations").alias("position", "c"))
    parsed = bare.select(
        "finding_id", (F.col("position") + 1).alias("position"), F.col("c.title").alias("title"), F.coalesce("c.summary", F.lit("")).alias("summary"),
        F.col("c.doc_number").alias("doc_number"), F.lit(False).alias("grounded"))
    return kept.unionByName(parsed, allowMissingColumns=True)


def verify_cited_clauses(cited: Column, valid: Column) -> Column:
    return F.struct(F.array_intersect(cited, valid).alias("kept"), F.array_except(cited, valid).alias("dropped"))


# -- A12 --------------------------------------------------------------------------

# References inside stored findings and names of two laws.
BRACKET_REF = r"\[[^\]|]+\|\s*([^\]]+?)\s*\]"
BARE_REF = r"\b(\d{3,}:[A-Za-z0-9.]+)\b"
LAW_ALIASES = (
    ("bộ luật lao động", "2019", "45/2019/qh14"),
    ("luật người lao động việt nam đi làm việc ở nước ngoài", "2020", "69/2020/qh14"),
)
CITED_ARTICLE = r"(?iuU)Điều\s+\d+"
# As NUMBER, but of any length: stored citations name documents by the numbers that these have.
STORED_NUMBER = r"(?iu)(?<!\d)\d+/\d{4}/[A-ZĐ0-9.-]+"


def backfill_risk_citations(findings: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored findings -> citation rows with evidence, address and link.

    ``findings``: ``finding_id, legal_basis, citations (title, summary,
    doc_number, evidence_path)``.  References found in the text come first, then
    old citations that no reference represents.  ``changed`` tells whether the
    finding gained evidence that its old citations did not name.
    """
    basis = F.coalesce("legal_basis", F.lit(""))
    old_paths = F.transform("citations", lambda c: strip(c["evidence_path"]))
    raw = F.concat(F.regexp_extract_all(basis, F.lit(BRACKET_REF), F.lit(1)), F.regexp_extract_all(basis, F.lit(BARE_REF), F.lit(1)),
                   F.coalesce(old_paths, F.array().cast("array<string>")))
    as_path = F.transform(raw, lambda r: F.coalesce(P.ref_to_path(strip(r)), F.when(~F.contains(r, F.lit(":")), strip(r))))
    f = findings.withColumn("refs", F.array_distinct(F.filter(as_path, lambda r: F.coalesce(r != "", F.lit(False)))))
    number = lambda c: F.nullif(F.regexp_extract(F.concat_ws(" ", c["doc_number"], c["title"], c["summary"]), STORED_NUMBER, 0), F.lit(""))

    evidence = f.select("finding_id", "citations", F.posexplode("refs").alias("ord", "path")).join(chunks, "path")
    named = F.transform("citations", lambda c: strip(c["evidence_path"]))
    gained = evidence.filter(~F.coalesce(F.array_contains(named, F.col("path")), F.lit(False))).select("finding_id").distinct().withColumn("changed", F.lit(True))
    gist = F.get(F.filter("citations", lambda c: F.contains(F.lower(c["title"]), F.lower(F.col("doc_num")))), F.lit(0))["summary"]
    quote, loc = clean_quote(F.col("chunk_text")), P.path_location(F.col("path"))
    new_rows = evidence.select(
        "finding_id", F.lit(0).alias("part"), "ord", F.coalesce("title", "doc_num", F.lit(GENERIC_TITLE)).alias("title"),
        F.coalesce(strip(gist), F.lit("")).alias("summary"), F.col("doc_num").alias("doc_number"), "source_url",
        deep_link(F.col("source_url"), F.col("source_element_id"), F.coalesce(article_title(F.col("chunk_text")), loc["article"], quote)).alias("deep_link"),
        F.col("path").alias("evidence_path"))
    seen = new_rows.groupBy("finding_id").agg(F.collect_set(F.lower("doc_number")).alias("seen"))
    old = f.join(seen, "finding_id", "left").select("finding_id", "refs", "seen", F.posexplode("citations").alias("ord", "c")).withColumn("num", number(F.col("c")))
    old = old.filter(~F.coalesce(F.array_contains("refs", strip("c.evidence_path")), F.lit(False))
                     & ~F.coalesce(F.array_contains("seen", F.lower("num")), F.lit(False)))
    text = F.lower(F.concat_ws(" ", "c.title", "c.summary"))
    alias = F.coalesce(*[F.when(F.contains(text, F.lit(k)) & F.contains(text, F.lit(y)), F.lit(n)) for k, y, n in LAW_ALIASES])
    known = docs.filter("trim(source_url) <> ''").groupBy(F.lower("doc_num").alias("k")).agg(F.min(F.struct("doc_num", "source_url")).alias("d"))
    keyed = old.withColumn("k", F.lower("num")).join(known, "k", "left").drop("k").withColumnRenamed("d", "d1").withColumn("k", alias).join(known, "k", "left")
    d = F.coalesce("d1", "d")
    heading = F.coalesce(F.nullif(F.regexp_extract(F.concat_ws(" ", "c.title", "c.summary"), CITED_ARTICLE, 0), F.lit("")), F.lit("Điều"))
    old_rows = keyed.select(
        "finding_id", F.lit(1).alias("part"), "ord", F.col("c.title").alias("title"), F.col("c.summary").alias("summary"),
        F.coalesce(d["doc_num"], F.col("c.doc_number")).alias("doc_number"), d["source_url"].alias("source_url"),
        deep_link(d["source_url"], F.lit(None).cast("string"), heading).alias("deep_link"), F.col("c.evidence_path").alias("evidence_path"))
    return new_rows.unionByName(old_rows).join(gained, "finding_id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
