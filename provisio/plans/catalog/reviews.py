"""Contract rules (H), report (I) and conversation queries (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import contract as C
from provisio.operators import citations, memory, preamble, report, retrieve, review
from provisio.operators.rules import FieldRule, FlagRule
from provisio.plans.oracle import AS_OF as DAY
from provisio.plans.projections import AS_OF
from provisio.plans.registry import query

# Rules in the languages of the texts, run by the same evaluators.
FLAGS = (
    FlagRule("en_tion", "Điều 2", "tion", "English nation", "critical", ("english",), "the [a-z]{2,6}tion", "reason en", "impact en", "action en", "Điều 1", (1,), "blurb en", (("the ([a-z]{2,6})tion", "this"),)),
    FlagRule("de_heit", "Điều 2", "heit", "Deutsche heit", "warning", ("deutsch",), "keit|heit", "reason de", "impact de", "action de", "Điều 2", (2,), "blurb de", (("keit", "K"),)),
    FlagRule("es_cion", "Điều 3", "cion", "Acción", "critical", ("español",), "ción de", "reason es", "impact es", "action es", "Điều 3", (3, 1), "blurb es", (("ción de ", ""),)),
    FlagRule("fr_eaux", "Điều 4", "eaux", "Les eaux", "warning", ("français",), "eaux (la|le)", "reason fr", "impact fr", "action fr", "Điều 4", (4,), "blurb fr"),
)
FIELDS = (
    FieldRule("english", "English words", ("the ", "tion")), FieldRule("german", "Deutsche Wörter (der)", ("der ", "heit|keit")),
    FieldRule("employee_residence", "Mots français", ("eaux|tion",)),
)
HITS = """hits AS (SELECT CAST(doc_id AS VARCHAR) AS contract_id, text, regexp_matches(lower(text), 'the [a-z]{2,6}tion') AS en, regexp_matches(lower(text), 'keit|heit') AS de,
  regexp_matches(lower(text), 'ción de') AS es, regexp_matches(lower(text), 'eaux (la|le)') AS fr FROM documents)"""


def texts(t):
    return t.spread("documents").select(F.col("doc_id").cast("string").alias("contract_id"), "text", "lang")


def contract_fields(t):
    """Customers and orders as short Vietnamese contracts."""
    o = t.spread("orders", rows=50_000)
    day = F.date_format("o_orderdate", "d/M/yyyy")
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("HỢP ĐỒNG MUA BÁN SỐ "), key, F.lit("\nHôm nay, ngày "), day, F.lit("\nBên A: (Người bán)\nCông ty: Công ty "), key,
        F.lit("\nMã số thuế: "), F.lpad(key, 10, "1"), F.lit("\nĐịa chỉ: Phố "), "o_custkey", F.lit("\nBên B: (Người mua)\nHọ và tên: Ông "), "o_custkey",
        F.lit("\nCCCD số: "), F.lpad(key, 12, "2"), F.lit("\nTừ ngày: "), day, F.lit("\nTổng giá trị: "), "o_orderpriority", F.lit("\nphạt vi phạm 8% của "), key,
        F.lit("\nbồi thường thiệt hại cho "), key, F.lit("\nđược bảo mật số "), key, F.lit("\nĐiều 9. hết"))
    return o.select("o_orderkey", "o_custkey", text.alias("text"))


@query("extract_dates", "SELECT o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') AS execution_date, strftime(o_orderdate, '%-d/%-m/%Y') AS start_date FROM orders")
def _(t):
    d = contract_fields(t).select("o_orderkey", C.extract_dates(F.col("text")).alias("d"))
    return d.select("o_orderkey", "d.execution_date", "d.start_date")


@query("extract_finance", "SELECT o_orderkey, left(o_orderpriority, 5) AS contract_value FROM orders")
def _(t):
    d = contract_fields(t).select("o_orderkey", C.extract_finance(F.col("text")).alias("d"))
    return d.select("o_orderkey", F.substring("d.contract_value", 1, 5).alias("contract_value"))


@query("extract_clause_topics", """SELECT o_orderkey, 'phạt vi phạm 8% của ' || o_orderkey || ' bồi thường thiệt hại cho ' || o_orderkey AS penalty,
  'bồi thường thiệt hại cho ' || o_orderkey || ' được bảo mật số ' || o_orderkey AS indemnity, 'được bảo mật số ' || o_orderkey AS confidentiality FROM orders""")
def _(t):
    d = contract_fields(t).select("o_orderkey", C.extract_clause_topics(F.col("text")).alias("d"))
    return d.select("o_orderkey", F.col("d.penalty_clause").alias("penalty"), F.col("d.indemnity").alias("indemnity"), F.col("d.confidentiality").alias("confidentiality"))


@query("extract_parties", """SELECT o_orderkey, 'Công ty ' || o_orderkey || '/Người bán/Phố ' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '1') AS a,
  'Ông ' || o_custkey || '/Người mua/Phố ' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '2') AS b FROM orders""")
def _(t):
    line = lambda i: F.concat_ws("/", *[F.get("p", F.lit(i))[n] for n in ("name", "role", "address", "tax_id")])
    d = contract_fields(t).select("o_orderkey", C.extract_parties(F.col("text")).alias("p"))
    return d.select("o_orderkey", line(0).alias("a"), line(1).alias("b"))


@query("contract_type", "SELECT o_orderkey, 'Hợp đồng MUA BÁN SỐ ' || o_orderkey AS kind FROM orders")
def _(t):
    return contract_fields(t).select("o_orderkey", C.contract_type(F.col("text")).alias("kind"))


@query("is_labor_contract", """SELECT doc_id, regexp_matches(lower(lang || ' ' || left(text, 2000)), 'heit|ción') AS yes FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", C.is_labor_contract(F.col("text"), F.col("lang"), "(?iuU)heit|ción").alias("yes"))


@query("fill_gaps", """SELECT o_orderkey, 'Tổng' AS a, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS b FROM orders""")
def _(t):
    rules = F.struct(F.lit("Tổng").alias("a"), F.lit("").alias("b"))
    model = F.struct(F.lit("khác").alias("a"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("b"))
    return t.raw("orders").select("o_orderkey", C.fill_gaps(rules, model, ["a", "b"]).alias("f")).select("o_orderkey", "f.*")


@query("job_context", """SELECT CAST(doc_id AS VARCHAR) AS contract_id, left(CASE WHEN w = '' THEN lang ELSE lang || ' ' || w END, 1500) AS job FROM (SELECT doc_id, lang, regexp_extract(text, '[Tt][Hh][Ee] [A-Za-z]{2,6}') AS w FROM documents)""")
def _(t):
    none = F.array().cast("array<struct<title:string,summary:string>>")
    job = C.job_context(F.col("text"), F.col("lang"), none, "(?s)no such text", "x", ("the [a-zA-Z]{2,6}",))
    return texts(t).select("contract_id", job.alias("job"))


@query("missing_fields", """SELECT CAST(doc_id AS VARCHAR) AS contract_id, concat_ws(',', CASE WHEN NOT (l LIKE '%the %' AND l LIKE '%tion%') THEN 'english' END,
   CASE WHEN NOT (l LIKE '%der %' AND (l LIKE '%heit%' OR l LIKE '%keit%')) THEN 'german' END, CASE WHEN NOT (l LIKE '%eaux%' OR l LIKE '%tion%') THEN 'employee_residence' END) AS missing
  FROM (SELECT doc_id, lower(text) AS l FROM documents)""")
def _(t):
    return review.missing_fields(texts(t), FIELDS).select("contract_id", F.array_join("missing", ",").alias("missing"))


def dated(t):
    """Texts as contracts of different days."""
    k = F.col("contract_id").cast("bigint")
    return texts(t).withColumn("as_of", F.make_date((k % 6 + 1993).cast("int"), F.lit(7), F.lit(1)))


def governing(t):
    """The code in force on each of those days."""
    from provisio.operators.effect import resolve_governing_doc

    ask = dated(t).select(F.lit("Bộ luật").alias("kind"), "as_of").distinct()
    return resolve_governing_doc(ask, t.documents())


GOVERNING = """days AS (SELECT DISTINCT make_date(CAST(doc_id % 6 + 1993 AS INTEGER), 7, 1) AS as_of FROM documents),
 gov AS (SELECT as_of, doc_num, CASE WHEN status_flag = 4 THEN 'Đã đối chiếu · Còn hiệu lực (có sửa đổi) · ' ELSE 'Đã đối chiếu · Còn hiệu lực · ' END || as_of AS label
  FROM (SELECT q.as_of, d.doc_num, d.status_flag, row_number() OVER (PARTITION BY q.as_of ORDER BY CASE status_flag WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 4 END, issue_date DESC, doc_num DESC) AS rn
   FROM docs d JOIN days q ON eff_from <= q.as_of AND (eff_to IS NULL OR eff_to > q.as_of) WHERE doc_type = 'Bộ luật' AND status_flag IN (0, 1, 4, 5)) WHERE rn = 1)"""


@query("completeness_findings", """SELECT contract_id, CASE WHEN fr THEN 'Thiếu địa chỉ / nơi cư trú NLĐ và nội dung bắt buộc khác' ELSE 'Thiếu nội dung chủ yếu bắt buộc của HĐLĐ' END AS title, 'warning' AS severity,
  'Hợp đồng lao động chưa thể hiện đủ các nội dung chủ yếu theo Điều 21 Bộ luật Lao động (' || (en::INT + de::INT + fr::INT) || ' mục thiếu). '
   || CASE WHEN fr THEN 'Đặc biệt: chưa ghi nơi cư trú / địa chỉ hiện tại của NLĐ. ' ELSE '' END || 'Các mục sau không tìm thấy hoặc không đủ rõ trong văn bản.' AS issue,
  concat_ws('|', 'Thiếu nội dung bắt buộc', 'Điều 21 BLLĐ', CASE WHEN fr THEN 'Thiếu địa chỉ / nơi cư trú NLĐ' END, CASE WHEN en THEN 'English words' END, CASE WHEN de THEN 'Deutsche Wörter' END, CASE WHEN fr THEN 'Mots français' END) AS topics,
  concat_ws('|', CASE WHEN en THEN 'English words' END, CASE WHEN de THEN 'Deutsche Wörter (der)' END, CASE WHEN fr THEN 'Mots français' END) AS reasons,
  'Điều 21 Bộ luật Lao động (' || coalesce(doc_num, '45/2019/QH14') || ') — ' || coalesce(label, 'Chưa đối chiếu kho') AS legal_basis,
  CASE WHEN doc_num IS NULL THEN 0.55::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
  'Điều 21 ' || coalesce('Bộ luật số ' || doc_num, 'Bộ luật Lao động') AS cited, coalesce(label, 'Chưa đối chiếu kho — chưa xác nhận hiệu lực') AS cited_status
  FROM (SELECT CAST(doc_id AS VARCHAR) AS contract_id, make_date(CAST(doc_id % 6 + 1993 AS INTEGER), 7, 1) AS as_of, NOT (l LIKE '%the %' AND l LIKE '%tion%') AS en,
    NOT (l LIKE '%der %' AND (l LIKE '%heit%' OR l LIKE '%keit%')) AS de, NOT (l LIKE '%eaux%' OR l LIKE '%tion%') AS fr FROM (SELECT doc_id, lower(text) AS l FROM documents))
  LEFT JOIN gov USING (as_of) WHERE en OR de OR fr""", ctes=GOVERNING, views="docs")
def _(t):
    c = dated(t).withColumnRenamed("lang", "contract_type")
    out = review.completeness_findings(c, governing(t), rules=FIELDS, labor_only=False)
    return out.select(
        "contract_id", "title", "severity", "issue", F.array_join("summary_topics", "|").alias("topics"), F.array_join("reasons", "|").alias("reasons"), "legal_basis", "confidence",
        F.col("legal_citations")[0]["title"].alias("cited"), F.col("legal_citations")[0]["status"].alias("cited_status"))


KEYS = "concat_ws(',', CASE WHEN en THEN 'en_tion' END, CASE WHEN de THEN 'de_heit' END, CASE WHEN es THEN 'es_cion' END, CASE WHEN fr THEN 'fr_eaux' END)"


@query("red_flag_hits", """SELECT contract_id, unnest(string_split(k, ',')) AS key FROM (SELECT contract_id, """ + KEYS + """ AS k FROM hits) WHERE k <> ''""", ctes=HITS, views="")
def _(t):
    return review.red_flag_hits(texts(t), FLAGS).select("contract_id", "key")


@query("law_blurbs", """SELECT contract_id, concat_ws('|', CASE WHEN en THEN '[BLLĐ · Điều 1] blurb en' END, CASE WHEN de THEN '[BLLĐ · Điều 2] blurb de' END,
  CASE WHEN es AND (en::INT + de::INT) < 2 THEN '[BLLĐ · Điều 3] blurb es' END, CASE WHEN fr AND (en::INT + de::INT + es::INT) < 2 THEN '[BLLĐ · Điều 4] blurb fr' END) AS blurbs FROM hits""", ctes=HITS)
def _(t):
    return review.law_blurbs(texts(t), 2, FLAGS).select("contract_id", F.array_join("blurbs", "|").alias("blurbs"))


def originals(t):
    """The first lines of a text are its clauses 1, 2, 3, …"""
    groups = review.clause_groups(review.red_flag_hits(texts(t), FLAGS), FLAGS)
    ch = t.lines().select(F.col("doc_id").alias("contract_id"), F.col("line_no").alias("chunk_index"), F.col("line_no").cast("string").alias("clause_number"), F.col("chunk_text").alias("content"))
    return review.original_clauses(groups, ch, texts(t))


GROUPS = f"""{HITS}, grp AS (SELECT contract_id, '2' AS n, concat_ws(',', CASE WHEN en THEN 'en_tion' END, CASE WHEN de THEN 'de_heit' END) AS keys FROM hits WHERE en OR de
  UNION ALL SELECT contract_id, '3', 'es_cion' FROM hits WHERE es UNION ALL SELECT contract_id, '4', 'fr_eaux' FROM hits WHERE fr)"""


@query("clause_groups", "SELECT contract_id, n AS clause_number, keys FROM grp", ctes=GROUPS)
def _(t):
    g = review.clause_groups(review.red_flag_hits(texts(t), FLAGS), FLAGS)
    return g.select("contract_id", "clause_number", F.array_join("keys", ",").alias("keys"))


@query("original_clause", "SELECT contract_id, n AS clause_number, md5(chunk_text) AS text_md5 FROM grp LEFT JOIN lines ON doc_id = contract_id AND CAST(line_no AS VARCHAR) = n", ctes=GROUPS, views="lines")
def _(t):
    return originals(t).select("contract_id", "clause_number", F.md5("original_clause").alias("text_md5"))


@query("merge_by_clause", """SELECT contract_id, 'Điều ' || n AS clause_ref, CASE keys WHEN 'en_tion,de_heit' THEN 'tion · heit' WHEN 'en_tion' THEN 'tion' WHEN 'de_heit' THEN 'heit' WHEN 'es_cion' THEN 'cion' ELSE 'eaux' END AS title,
  CASE WHEN keys LIKE '%en_tion%' OR keys = 'es_cion' THEN 'critical' ELSE 'warning' END AS severity,
  CASE keys WHEN 'en_tion,de_heit' THEN 'Điều 1; Điều 2' WHEN 'en_tion' THEN 'Điều 1' WHEN 'de_heit' THEN 'Điều 2' WHEN 'es_cion' THEN 'Điều 3' ELSE 'Điều 4' END AS legal_basis,
  concat_ws('|', CASE WHEN keys LIKE 'en_tion%' THEN 'Điều 1 — ' || law END, CASE WHEN keys LIKE '%de_heit' THEN 'Điều 2 — ' || law END, CASE keys WHEN 'es_cion' THEN 'Điều 3 — ' || law WHEN 'fr_eaux' THEN 'Điều 4 — ' || law END) AS cited
  FROM (SELECT grp.*, coalesce('Bộ luật số ' || doc_num, 'Bộ luật Lao động') AS law FROM grp LEFT JOIN gov ON gov.as_of = make_date(CAST(contract_id::BIGINT % 6 + 1993 AS INTEGER), 7, 1))""", ctes=f"{GROUPS}, {GOVERNING}", views="docs")
def _(t):
    groups = originals(t).join(dated(t).select("contract_id", "as_of"), "contract_id")
    out = review.merge_by_clause(review.cite_groups(groups, flag_citations(t)), FLAGS)
    return out.select("contract_id", "clause_ref", "title", "severity", "legal_basis", F.array_join(F.transform("legal_citations", lambda c: c["title"]), "|").alias("cited"))


@query("revise_clause", """SELECT doc_id, line_no, CASE WHEN b = trim(chunk_text) OR length(b) < 40 THEN trim(chunk_text) || chr(10) || chr(10) || '[Đề xuất chỉnh sửa bắt buộc]' || chr(10) || '- action de' || chr(10) || '- action es' ELSE b END AS revised
  FROM (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(chunk_text, 'keit', 'K', 'gi'), 'ción de ', '', 'gi'), '\\s{2,}', ' ', 'g')), '\\s+([,.;:])', '\\1', 'g') AS b FROM lines)""")
def _(t):
    keys = F.array(F.lit("de_heit"), F.lit("es_cion"))
    return t.lines().select("doc_id", "line_no", review.revise_clause(F.col("chunk_text"), keys, FLAGS).alias("revised"))


def flag_citations(t):
    g = governing(t)
    asked = g.select("doc_id", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3, 4)])).alias("article_no"))
    return review.hydrate_flag_citation(dated(t).select("as_of"), g, retrieve.article_snippet(asked, t.chunks()), FLAGS)


@query("hydrate_flag_citation", """SELECT as_of, key, 'Điều ' || a || ' — ' || coalesce('Bộ luật số ' || doc_num, 'Bộ luật Lao động') AS title, coalesce(doc_num, '45/2019/QH14') AS doc_number, blurb AS quote,
  coalesce(label, 'Chưa đối chiếu kho — chưa xác nhận hiệu lực') AS status
  FROM days LEFT JOIN gov USING (as_of), (VALUES ('en_tion', 1, 'blurb en'), ('de_heit', 2, 'blurb de'), ('es_cion', 3, 'blurb es'), ('fr_eaux', 4, 'blurb fr')) f(key, a, blurb)""", ctes=GOVERNING, views="docs")
def _(t):
    return flag_citations(t).select("as_of", "key", "citation.title", "citation.doc_number", "citation.quote", "citation.status")


FIND = """fnd AS (SELECT CAST(d.doc_id AS VARCHAR) AS contract_id, l.line_no AS ord, 'Điều ' || (l.line_no % 7) AS clause_ref,
   CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'warning' ELSE 'ok' END AS severity, l.lang AS topic, left(trim(l.chunk_text), 30) AS title
  FROM labels d JOIN lines l ON l.doc_id = CAST(d.doc_id AS VARCHAR))"""


def findings(t):
    """Lines of labelled texts as findings; severity from the label."""
    lab = t.raw("labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    return t.lines().join(lab, "doc_id").select(
        F.col("doc_id").alias("contract_id"), F.col("line_no").alias("ord"), F.concat(F.lit("Điều "), F.col("line_no") % 7).alias("clause_ref"),
        F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "warning").otherwise("ok").alias("severity"),
        F.array("lang").alias("summary_topics"), F.substring(F.trim("chunk_text"), 1, 30).alias("title"), F.col("chunk_text").alias("issue"))


def clause_rows(t):
    return t.lines().select(F.col("doc_id").alias("contract_id"), F.col("line_no").cast("string").alias("clause_number"), F.substring("chunk_text", 1, 40).alias("title"))


@query("covered_clauses", "SELECT DISTINCT contract_id, CAST(ord % 7 AS VARCHAR) AS clause_number FROM fnd WHERE severity = 'critical'", ctes=FIND, views="lines")
def _(t):
    return review.covered_clauses(findings(t))


@query("topic_keys", """SELECT DISTINCT contract_id, clause_number, unnest(list_filter([CASE WHEN b LIKE '%deutsche heit%' OR (b LIKE '%deutsch%' AND clause_number = '2') THEN 'de_heit' END,
   CASE WHEN b LIKE '%reason fr%' THEN 'fr_eaux' END], x -> x IS NOT NULL)) AS key FROM (SELECT contract_id, CAST(ord % 7 AS VARCHAR) AS clause_number, CASE ord % 3 WHEN 0 THEN 'deutsche heit' WHEN 1 THEN 'reason fr' ELSE 'deutsch' END AS b FROM fnd)""".replace("x -> x IS NOT NULL", "lambda x: x IS NOT NULL"), ctes=FIND, views="lines")
def _(t):
    f = findings(t).withColumn("title", F.when(F.col("ord") % 3 == 0, "Deutsche Heit").when(F.col("ord") % 3 == 2, "deutsch")).withColumn(
        "reasons", F.when(F.col("ord") % 3 == 1, F.array(F.lit("reason FR"))))
    return review.topic_keys(f, FLAGS)


@query("judge_worklist", """SELECT doc_id AS contract_id, CAST(line_no AS VARCHAR) AS clause_number, lang AS contract_type FROM lines l WHERE NOT EXISTS (SELECT 1 FROM fnd f WHERE f.contract_id = l.doc_id AND severity = 'critical' AND f.ord % 7 = l.line_no)""", ctes=FIND, views="lines")
def _(t):
    c = texts(t).select("contract_id", F.col("lang").alias("contract_type"), F.lit(AS_OF).alias("as_of"), F.lit("").alias("job_context"))
    return review.judge_worklist(clause_rows(t), review.covered_clauses(findings(t)), c).select("contract_id", "clause_number", "contract_type")


@query("union_findings", "SELECT severity, count(*) AS n FROM (SELECT severity FROM fnd UNION ALL SELECT CASE WHEN keys LIKE '%en_tion%' OR keys = 'es_cion' THEN 'critical' ELSE 'warning' END FROM grp) GROUP BY 1", ctes=f"{FIND}, {GROUPS}", views="lines")
def _(t):
    both = review.union_findings([findings(t), review.merge_by_clause(originals(t), FLAGS)])
    return both.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("apply_review", """SELECT contract_id, clause_ref, title FROM fnd WHERE CAST(contract_id AS BIGINT) % 3 = 0
  UNION ALL SELECT DISTINCT contract_id, 'Điều 1', 'edited' FROM fnd WHERE CAST(contract_id AS BIGINT) % 3 = 1""", ctes=FIND, views="lines")
def _(t):
    f = findings(t)
    k = F.col("contract_id").cast("bigint") % 3
    edit = F.array(F.struct(F.lit("Điều 1").alias("clause_ref"), F.lit("edited").alias("title")))
    r = f.select("contract_id").distinct().select("contract_id", F.when(k == 2, "rejected").otherwise("approved").alias("decision"), F.when(k == 1, edit).alias("edits"))
    return review.apply_review(f, r).select("contract_id", "clause_ref", "title")


@query("no_grounding_findings", """SELECT doc_id AS contract_id, 'Điều ' || line_no AS clause_ref FROM lines l WHERE NOT EXISTS (SELECT 1 FROM fnd f WHERE f.contract_id = l.doc_id AND f.ord = l.line_no)""", ctes=FIND, views="lines")
def _(t):
    hits = findings(t).select("contract_id", F.col("ord").cast("string").alias("clause_number"))
    return review.no_grounding_findings(clause_rows(t), hits).select("contract_id", "clause_ref")


def ground_texts(t):
    """Orders as contract heads citing a document, right, misdated or unknown."""
    o = t.spread("orders")
    key = F.col("o_orderkey")
    day = F.date_format(F.date_add(F.to_date("o_orderdate"), F.when(key % 2 == 0, 0).otherwise(1)), "'ngày 'd/M/yyyy")
    num = F.concat_ws("/", F.when(key % 7 == 0, key + 5000000).otherwise(key).cast("string"), F.year("o_orderdate").cast("string"), F.lit("NĐ-CP"))
    kind = F.when(key % 5 == 0, "Quyết định").otherwise("Nghị định")
    line = F.concat(F.lit("- Căn cứ "), kind, F.lit(" số "), num, F.lit(" "), day, F.lit(";\n"))
    return o.select(key.cast("string").alias("contract_id"), F.concat(F.lit("HỢP ĐỒNG\n"), line, line, F.lit("Hôm nay ngày 1\nCăn cứ Luật số 9/2000/QH1")).alias("text"))


# Cited numbers have at most four digits before the first slash; longer ones count as no number.
@query("preamble_citations", """SELECT CAST(o_orderkey AS VARCHAR) AS contract_id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey >= 10000 THEN NULL ELSE o_orderkey || '/' || year(o_orderdate) || '/NĐ-CP' END AS doc_num,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INTEGER) AS cited_date FROM orders""")
def _(t):
    return preamble.preamble_citations(ground_texts(t)).select("contract_id", "doc_num", "cited_date")


@query("validate_preamble", f"""SELECT contract_id, severity, n_problems FROM (SELECT d.doc_id AS contract_id, CASE WHEN k % 7 <> 0 AND k < 10000 AND (status_flag = 2 OR eff_to <= {DAY} AND eff_from <= {DAY}) THEN 'critical' ELSE 'warning' END AS severity,
   CASE WHEN k % 7 = 0 OR k >= 10000 THEN 1 ELSE (CASE WHEN status_flag = 2 OR eff_from > {DAY} OR eff_to <= {DAY} THEN 1 WHEN status_flag = 4 THEN 1 ELSE 0 END) + k % 2 END AS n_problems
  FROM (SELECT *, CAST(doc_id AS BIGINT) AS k FROM docs) d) WHERE n_problems > 0""")
def _(t):
    out = preamble.validate_preamble(preamble.preamble_citations(ground_texts(t)), t.documents(), AS_OF)
    return out.select("contract_id", "severity", F.size("reasons").alias("n_problems"))


def answers(t):
    """Orders as model answers: plain, fenced, with trailing commas or curly quotes, or broken."""
    k = F.col("o_orderkey")
    conf = F.when(k % 2 == 0, "85").otherwise("0.4")
    js = F.concat(F.lit('{"severity": "'), F.when(F.col("o_orderstatus") == "O", "ok").otherwise("critical"), F.lit('", "issue": "'),
                  F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.lit('", "reasons": ["r1", {"text": "r2"}], "actions": "làm", "confidence": '), conf,
                  F.lit(', "recommendation": "«'), F.repeat(F.lit("sửa lại "), 8), F.lit('»"'))
    raw = (
        F.when(k % 5 == 0, F.concat(js, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit("Đây:\n```json\n"), js, F.lit("}\n```")))
        .when(k % 5 == 2, F.concat(js, F.lit(",}"))).when(k % 5 == 3, F.concat(F.lit("Trả lời: "), js, F.lit("} xong"))).otherwise(F.lit("không có")))
    return t.spread("orders").select(k.cast("string").alias("contract_id"), F.lit("Điều 1").alias("clause_ref"), raw.alias("raw"))


@query("parse_model_json", "SELECT CAST(o_orderkey AS VARCHAR) AS contract_id, CASE WHEN o_orderkey % 5 < 4 THEN CASE WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'critical' END END AS severity FROM orders")
def _(t):
    return answers(t).select("contract_id", F.get_json_object(citations.parse_model_json(F.col("raw")), "$.severity").alias("severity"))


@query("findings_from_model", """SELECT CAST(o_orderkey AS VARCHAR) AS contract_id, CASE WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'critical' END AS severity, 'r1|r2' AS reasons, 'làm' AS actions,
  CASE WHEN o_orderkey % 2 = 0 THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS confidence, trim(repeat('sửa lại ', 8)) AS revised_clause FROM orders WHERE o_orderkey % 5 < 4 AND NOT (o_orderstatus = 'O' AND o_orderkey % 3 = 0)""")
def _(t):
    f = citations.findings_from_model(answers(t))
    return f.select("contract_id", "severity", F.array_join("reasons", "|").alias("reasons"), F.array_join("actions", "|").alias("actions"), "confidence", "revised_clause")


def basis_text(t):
    li = t.spread("lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat(
        F.lit("Thông tư 20/2023/TT-BCT: nội dung "), "l_partkey", F.lit("; Điều "), "l_linenumber", F.lit(" Bộ luật Lao động. phần "), "l_suppkey", F.lit(" [Luật | 12345:D1].")).alias("basis"))


@query("citations_from_text", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'Thông tư 20/2023/TT-BCT=nội dung ' || l_partkey || '|Điều ' || l_linenumber || ' Bộ luật Lao động=phần ' || l_suppkey || ' Luật' AS cites FROM lineitem""")
def _(t):
    c = F.array_join(F.transform(citations.citations_from_text(F.col("basis")), lambda x: F.concat(x["title"], F.lit("="), x["summary"])), "|")
    return basis_text(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", c.alias("cites"))


@query("resolve_citations", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Luật ' || o_custkey || ': p1 p2' ELSE 'Căn cứ pháp lý: theo luật ' || o_custkey END AS line FROM orders""")
def _(t):
    none = F.lit(None).cast("string")
    item = F.struct(none.alias("title"), F.concat(F.lit("Luật "), "o_custkey").alias("label"), none.alias("name"), none.alias("doc_number"), none.alias("summary"),
                    F.array(F.lit("p1"), F.lit(" p2 ")).alias("points"), none.alias("location"))
    items = F.when(F.col("o_orderkey") % 2 == 0, F.array(item)).cast(citations.MODEL_CITATION)
    line = citations.basis_line(citations.resolve_citations(items, F.concat(F.lit("theo luật "), "o_custkey")))
    return t.raw("orders").select("o_orderkey", line.alias("line"))


def grounded_inputs(t):
    """Labelled texts as findings: even ones name a path, odd ones a document number."""
    c = t.chunks().drop("embedding")
    hits = c.withColumn("finding_id", F.col("doc_id"))
    even = F.col("doc_id").cast("bigint") % 2 == 0
    none = F.lit(None).cast("string")
    heads = c.filter("chunk_type = 'preamble'")
    cite = F.array(F.struct(none.alias("title"), F.lit("tóm tắt").alias("summary"), F.col("doc_num").alias("doc_number"), none.alias("evidence_path")))
    f = heads.select(F.col("doc_id").alias("finding_id"), F.when(even, F.array("path")).otherwise(F.array().cast("array<string>")).alias("evidence_paths"), cite.alias("citations"), F.lit("").alias("context"))
    return f, hits


@query("ground_citations", f"""SELECT finding_id, evidence_path, summary, doc_number, true AS grounded FROM g
  UNION ALL SELECT doc_id, NULL, 'tóm tắt', doc_num, false FROM chunks WHERE chunk_type = 'preamble' AND doc_id NOT IN (SELECT finding_id FROM g)""", views="chunks", ctes=f"""g AS (
  SELECT doc_id AS finding_id, path AS evidence_path, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN '' ELSE 'tóm tắt' END AS summary, doc_num AS doc_number FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rn FROM chunks c WHERE status_flag <> 2 AND eff_from <= {DAY} AND (eff_to IS NULL OR eff_to > {DAY})
   AND (CAST(doc_id AS BIGINT) % 2 = 1 OR chunk_type = 'preamble') AND EXISTS (SELECT 1 FROM chunks p WHERE p.doc_id = c.doc_id AND p.chunk_type = 'preamble')) WHERE rn = 1)""")
def _(t):
    f, hits = grounded_inputs(t)
    out = citations.ground_citations(f, hits, AS_OF, sectors=(("no such", "word"),))
    return out.select("finding_id", "evidence_path", "summary", "doc_number", "grounded")


@query("verify_cited_clauses", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber IN (1, 3) THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS kept, CASE WHEN l_linenumber IN (1, 3) THEN 'x' ELSE l_linenumber || ',x' END AS dropped FROM lineitem""")
def _(t):
    v = citations.verify_cited_clauses(F.array(F.col("l_linenumber").cast("string"), F.lit("x")), F.array(F.lit("1"), F.lit("3")))
    return t.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_join(v["kept"], ",").alias("kept"), F.array_join(v["dropped"], ",").alias("dropped"))


@query("backfill_risk_citations", """SELECT doc_id AS finding_id, path AS evidence_path, doc_num AS doc_number, CAST(doc_id AS BIGINT) % 2 = 1 AS changed FROM chunks WHERE chunk_type = 'preamble'
  UNION ALL SELECT doc_id, NULL, CAST(doc_id AS BIGINT) + 1 || '/1000/NĐ-CP', CAST(doc_id AS BIGINT) % 2 = 1 FROM chunks WHERE chunk_type = 'preamble' AND doc_id IN (SELECT doc_id FROM docs WHERE length(doc_id) < 4 OR doc_id < '9999')""")
def _(t):
    c = t.chunks().withColumn("source_url", F.lit("https://x.example/a")).withColumn("source_element_id", F.lit("e1"))
    heads = c.filter("chunk_type = 'preamble'")
    none = F.lit(None).cast("string")
    mark = lambda n, p: F.struct(F.lit("tên").alias("title"), F.lit("tóm tắt").alias("summary"), n.alias("doc_number"), p.alias("evidence_path"))
    other = F.concat((F.col("doc_id").cast("bigint") + 1).cast("string"), F.lit("/1000/NĐ-CP"))
    own = mark(F.col("doc_num"), F.when(F.col("doc_id").cast("bigint") % 2 == 0, F.col("path")))
    # Only findings whose id is short or sorts before 9999 cite a second document, as in the SQL.
    second = (F.length("doc_id") < 4) | (F.col("doc_id") < "9999")
    f = heads.select(F.col("doc_id").alias("finding_id"), F.concat(F.lit("theo [Luật | "), "path", F.lit("]")).alias("legal_basis"),
                     F.when(second, F.array(own, mark(other, none))).otherwise(F.array(own)).alias("citations"))
    return citations.backfill_risk_citations(f, c, t.documents()).select("finding_id", "evidence_path", "doc_number", "changed")


# -- I ----------------------------------------------------------------------------

SORTED = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
DEDUPED = f"""ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, CASE WHEN severity = 'critical' THEN clause_ref ELSE clause_ref || topic END ORDER BY {SORTED}, ord % 7, ord) AS rn FROM fnd WHERE severity <> 'ok') WHERE rn = 1)"""


@query("sort_findings", f"SELECT contract_id, ord, {SORTED} AS severity_rank, ord % 7 AS clause_no FROM fnd", ctes=FIND, views="lines")
def _(t):
    return report.sort_findings(findings(t)).select("contract_id", "ord", "severity_rank", "clause_no")


@query("dedupe_findings", "SELECT contract_id, ord, severity FROM ded", ctes=f"{FIND}, {DEDUPED}", views="lines")
def _(t):
    return report.actionable(findings(t)).select("contract_id", "ord", "severity")


@query("severity_summary", """SELECT n.contract_id, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, greatest(0, n_clauses - coalesce(flagged, 0)) AS ok_clauses,
   CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'ok' END AS verdict FROM (SELECT doc_id AS contract_id, count(*) AS n_clauses FROM lines GROUP BY 1) n
  LEFT JOIN (SELECT contract_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(DISTINCT clause_ref) AS flagged FROM ded GROUP BY 1) d ON d.contract_id = n.contract_id""",
       ctes=f"{FIND}, {DEDUPED}", views="lines")
def _(t):
    return report.severity_summary(findings(t), clause_rows(t))


@query("severity_rollup", "SELECT contract_id, severity, count(*) AS n FROM fnd GROUP BY ROLLUP (contract_id, severity)", ctes=FIND, views="lines")
def _(t):
    return report.severity_rollup(findings(t))


@query("top_issues", f"SELECT contract_id, ord, position FROM (SELECT contract_id, ord, row_number() OVER (PARTITION BY contract_id ORDER BY {SORTED}, ord % 7, ord) AS position FROM ded) WHERE position <= 3", ctes=f"{FIND}, {DEDUPED}", views="lines")
def _(t):
    return report.top_issues(findings(t)).select("contract_id", "ord", "position")


@query("clause_index", """SELECT doc_id AS contract_id, CAST(line_no AS VARCHAR) AS clause_number, coalesce(n, 0) AS n_findings, worst FROM lines LEFT JOIN (SELECT contract_id, CAST(ord % 7 AS VARCHAR) AS k, count(*) AS n, min(severity) AS worst FROM ded GROUP BY 1, 2) d
  ON d.contract_id = doc_id AND k = CAST(line_no AS VARCHAR)""", ctes=f"{FIND}, {DEDUPED}", views="lines")
def _(t):
    return report.clause_index(clause_rows(t), findings(t)).select("contract_id", "clause_number", "n_findings", F.col("worst.severity").alias("worst"))


def written(t):
    """Findings whose issue and recommendation are labelled texts."""
    w = F.split(F.trim("issue"), r"\s+")
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
    issue = F.concat(F.lit("Kết luận: kết "), F.col("ord"), F.lit("\nLý do:\n- một "), F.col("ord"), F.lit("\n• hai"))
    rec = F.concat(F.lit("Đối với bên A:\n- sửa "), F.col("ord"), F.lit("\n1. bỏ\n«bản thảo "), F.col("ord"), F.lit("»"))
    none = F.lit(None).cast("array<string>")
    return findings(t).select("contract_id", "ord", "clause_ref", "severity", F.lit(None).cast("string").alias("title"), issue.alias("issue"), rec.alias("recommendation"), word(0).alias("w0"),
                              none.alias("reasons"), none.alias("summary_topics"), none.alias("impact"), none.alias("actions"), F.lit(None).cast("string").alias("legal_basis"),
                              F.lit(None).cast("string").alias("revised_clause"), F.lit(None).cast("string").alias("original_clause"), F.lit(90.0).alias("confidence"))


@query("parse_issue", "SELECT contract_id, ord, 'kết ' || ord AS conclusion, 'một ' || ord || '|hai' AS reasons FROM fnd", ctes=FIND, views="lines")
def _(t):
    return written(t).select("contract_id", "ord", report.parse_issue(F.col("issue")).alias("p")).select("contract_id", "ord", "p.conclusion", F.array_join("p.reasons", "|").alias("reasons"))


@query("parse_recommendation", "SELECT contract_id, ord, 'Đối với bên A' AS title, 'sửa ' || ord || '|bỏ' AS items, 'bản thảo ' || ord AS draft FROM fnd", ctes=FIND, views="lines")
def _(t):
    p = written(t).select("contract_id", "ord", report.parse_recommendation(F.col("recommendation")).alias("p"))
    s = F.get("p.sections", F.lit(0))
    return p.select("contract_id", "ord", s["title"].alias("title"), F.array_join(s["items"], "|").alias("items"), F.col("p.draft").alias("draft"))


WORDS = (("en", (" the ", "tion")), ("de", ("heit", "keit")), ("es", ("ción",)), ("fr", ("eaux",)))


@query("derive_topics", """SELECT doc_id, line_no, concat_ws(',', CASE WHEN l LIKE '% the %' OR l LIKE '%tion%' THEN 'en' END, CASE WHEN l LIKE '%heit%' OR l LIKE '%keit%' THEN 'de' END, CASE WHEN l LIKE '%ción%' THEN 'es' END, CASE WHEN l LIKE '%eaux%' THEN 'fr' END) AS topics
  FROM (SELECT doc_id, line_no, lower(chunk_text) AS l FROM lines)""")
def _(t):
    return t.lines().select("doc_id", "line_no", F.array_join(report.derive_topics(F.array("chunk_text"), F.lit(""), WORDS), ",").alias("topics"))


@query("normalize_finding_view", "SELECT contract_id, ord, 'kết ' || ord AS title, 'một ' || ord || '|hai' AS reasons, 'sửa ' || ord || '|bỏ' AS actions, 'bản thảo ' || ord AS revised_clause, 0.9::DOUBLE AS confidence FROM fnd", ctes=FIND, views="lines")
def _(t):
    v = report.normalize_finding_view(written(t))
    return v.select("contract_id", "ord", "title", F.array_join("reasons", "|").alias("reasons"), F.array_join("actions", "|").alias("actions"), "revised_clause", "confidence")


@query("changed_tokens", """SELECT doc_id, line_no, 'hoàn|mới' AS added FROM lines WHERE NOT regexp_matches(lower(chunk_text), 'hoàn|mới')""")
def _(t):
    added = report.changed_tokens(F.col("chunk_text"), F.concat("chunk_text", F.lit(" «hoàn» mới")))
    return t.lines().select("doc_id", "line_no", F.array_join(F.transform(added, lambda w: F.regexp_replace(w, "[«»]", "")), "|").alias("added"))


@query("citation_status_label", "SELECT doc_id, CASE status_flag WHEN 2 THEN 'Hết hiệu lực' ELSE 'Còn hiệu lực' END AS label FROM docs")
def _(t):
    return t.documents().select("doc_id", report.citation_status_label(F.col("eff_flag")).alias("label"))


@query("citation_body", """SELECT doc_id, line_no, md5(trim(chunk_text)) AS text_md5, CASE line_no % 3 WHEN 2 THEN 'verbatim' WHEN 0 THEN 'verbatim' ELSE 'gist' END AS kind, CASE WHEN line_no % 3 = 2 THEN 'khác hẳn' END AS gist FROM lines""")
def _(t):
    k = F.col("line_no") % 3
    b = report.citation_body(F.col("chunk_text"), F.when(k == 0, F.upper(F.lit(""))).when(k == 1, F.col("chunk_text")).otherwise("khác hẳn"), k == 0)
    return t.lines().select("doc_id", "line_no", b.alias("b")).select("doc_id", "line_no", F.md5("b.text").alias("text_md5"), "b.kind", "b.gist")


@query("filter_findings", "SELECT contract_id, ord FROM fnd WHERE severity = 'warning'", ctes=FIND, views="lines")
def _(t):
    return report.filter_findings(findings(t), "warning").select("contract_id", "ord")


# -- J ----------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT conv_id, turn, text AS question, nt AS answer_turn, nx AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nx, lead(turn) OVER w AS nt FROM conversations WHERE role <> 'system'
   WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


@query("qa_pairs", "SELECT conv_id, turn, answer_turn, md5(question || answer) AS pair_md5 FROM pairs", ctes=PAIRS)
def _(t):
    return memory.qa_pairs(t.raw("conversations")).select("conv_id", "turn", "answer_turn", F.md5(F.concat("question", "answer")).alias("pair_md5"))


@query("rolling_memory", """SELECT conv_id, count(*) AS n_pairs, md5(string_agg('- Hỏi: ' || question || chr(10) || '  Đã trả lời: ' || answer, chr(10) ORDER BY turn)) AS memory_md5
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM pairs) WHERE rn <= 5 GROUP BY 1""", ctes=PAIRS)
def _(t):
    return memory.rolling_memory(memory.qa_pairs(t.raw("conversations"))).select("conv_id", "n_pairs", F.md5("memory").alias("memory_md5"))


@query("trim_history", """SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM conversations) WHERE total <= 2000""")
def _(t):
    return memory.trim_history(t.raw("conversations"), tokens=F.length("text")).select("conv_id", "turn")


@query("state_history", """SELECT conv_id, turn, count(*) OVER w AS n_messages, md5(last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w) AS answer_md5 FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return memory.state_history(t.raw("conversations")).select("conv_id", "turn", "n_messages", F.md5("last_answer").alias("answer_md5"))


@query("rewind", "SELECT conv_id, turn, role FROM conversations c WHERE turn <= (SELECT avg(turn) FROM conversations x WHERE x.conv_id = c.conv_id)")
def _(t):
    m = t.raw("conversations")
    cps = m.groupBy("conv_id").agg(F.avg("turn").alias("checkpoint"))
    return memory.rewind(m, cps).select("conv_id", "turn", "role")


@query("thread_summary", """SELECT conv_id, count(*) AS n_messages, bool_or(role = 'user' AND length(text) < 60) AS needs_clarification, coalesce((SELECT string_agg(DISTINCT c, ',' ORDER BY c) FROM (SELECT unnest(regexp_extract_all(x.text, '([0-9]+)', 1)) AS c FROM conversations x WHERE x.conv_id = m.conv_id)), '') AS cited_clauses
  FROM conversations m GROUP BY 1""")
def _(t):
    return memory.thread_summary(t.raw("conversations"), (F.col("role") == "user") & (F.length("text") < 60), r"([0-9]+)")
