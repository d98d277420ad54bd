"""Report rows over findings: order, duplicates, counts, parsed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.let import bind, strip
from provisio.functions.paths import lookup
from provisio.functions.text import strip_internal_refs
from provisio.operators.skew import top_k

# Order of severities, labels, topic words.
SEVERITY_RANK = {"critical": 0, "warning": 1, "ok": 2}
LABEL = r"(?iuU)^(Kết\s*luận|Vi\s*phạm\s*pháp\s*luật|Lý\s*do|Rủi\s*ro(?:\s*hợp\s*đồng)?|Khuyến\s*nghị)\s*:\s*(.*)$"
DRAFT_LABEL = r"(?iuU)^(Đề xuất câu thay thế|Đề xuất sửa(?: điều khoản)?|Câu thay thế(?: đề xuất)?)\s*:?\s*$"
NO_ISSUE = "Chưa có mô tả vấn đề."
NO_TITLE = "Vấn đề cần xử lý"
TOPIC_WORDS = (
    ("Làm thêm giờ", ("làm thêm", "overtime", "thêm giờ")),
    ("Tiền lương OT", ("lương làm thêm", "tiền lương", "ot", "overtime pay")),
    ("Giới hạn OT", ("giới hạn", "không quá", "vượt quá")),
    ("Bảo hiểm", ("bảo hiểm", "bhxh", "bhyt")),
    ("Chấm dứt HĐLĐ", ("chấm dứt", "sa thải", "đơn phương")),
    ("Thai sản / kết hôn", ("mang thai", "thai sản", "kết hôn")),
    ("Kỷ luật / phạt tiền", ("kỷ luật", "phạt tiền", "khấu trừ")),
    ("Tranh chấp", ("tranh chấp", "tòa án", "trọng tài")),
)


def clean_text(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\*\*(.+?)\*\*", "$1"), r"__(.+?)__", "$1")
    return strip(F.regexp_replace(F.regexp_replace(s, r"^[-•*]+\s+", ""), r"^\d+[.)]\s+", ""))


def severity_rank(c: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, c), F.lit(9))


def clause_no(ref: Column) -> Column:
    """All digits of the reference as one number, 0 without any."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(ref, F.lit("")), r"\D", ""), F.lit("")).try_cast("bigint"), F.lit(0))


def _order() -> list[Column]:
    return [F.asc("severity_rank"), F.asc("clause_no"), F.asc("ord")]


def sort_keys(findings: DataFrame) -> DataFrame:
    """Adds the sort columns; ``ord`` (input order) breaks ties."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumn("clause_no", clause_no(F.col("clause_ref")))


def sort_findings(findings: DataFrame) -> DataFrame:
    return sort_keys(findings).orderBy("contract_id", *_order())


def filter_findings(findings: DataFrame, severity: str = "all") -> DataFrame:
    return findings if severity == "all" else findings.filter(F.col("severity") == severity)


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """First finding per key in sort order: clause for critical ones, clause and topic else."""
    clause = F.lower(strip(F.regexp_replace(F.coalesce("clause_ref", F.lit("")), r"(?U)\s+", " ")))
    topic = F.coalesce(F.nullif(F.get("summary_topics", F.lit(0)), F.lit("")), F.nullif("title", F.lit("")), F.substring(F.coalesce("issue", F.lit("")), 1, 48))
    key = F.when((F.col("severity") == "critical") & (clause != ""), F.concat(F.lit("clause-critical::"), clause)).otherwise(
        F.concat(clause, F.lit("::"), F.lower(strip(topic))))
    rows = sort_keys(findings)
    rest = [c for c in rows.columns if c != "contract_id"]
    best = rows.groupBy("contract_id", key.alias("dedupe_key")).agg(
        F.min_by(F.struct(*rest), F.struct("severity_rank", "clause_no", "ord")).alias("f"))
    return best.select("contract_id", "f.*")


def actionable(findings: DataFrame) -> DataFrame:
    return dedupe_findings(findings.filter("severity in ('critical', 'warning')"))


def severity_summary(findings: DataFrame, clauses: DataFrame) -> DataFrame:
    """Per contract: critical, warning, clauses without a finding, verdict."""
    f = actionable(findings)
    flagged = F.nullif(F.regexp_replace(F.coalesce("clause_ref", F.lit("")), r"\D", ""), F.lit(""))
    counts = f.groupBy("contract_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"),
        F.count_distinct(flagged).alias("flagged"))
    n = clauses.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_clauses"))
    j = n.join(counts, "contract_id", "full_outer").fillna(0, ["critical", "warning", "flagged", "n_clauses"])
    verdict = F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning").otherwise("ok")
    return j.select("contract_id", "critical", "warning", F.greatest(F.lit(0), F.col("n_clauses") - F.col("flagged")).alias("ok_clauses"), verdict.alias("verdict"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts per contract and severity with totals (null = all)."""
    return findings.rollup("contract_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def top_issues(findings: DataFrame, n: int = 3) -> DataFrame:
    return top_k(actionable(findings), ["contract_id"], _order(), n, "position")


def clause_index(clauses: DataFrame, findings: DataFrame) -> DataFrame:
    """Every clause with the number of its findings and the worst one."""
    f = actionable(findings).withColumn("clause_number", F.regexp_replace(F.coalesce("clause_ref", F.lit("")), r"\D", ""))
    per = f.groupBy("contract_id", "clause_number").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.min_by(F.struct("severity", "title"), F.struct((F.col("severity") != "critical").cast("int"), "severity_rank", "clause_no", "ord")).alias("worst"))
    return clauses.join(per, ["contract_id", "clause_number"], "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


# -- I6..I9 -----------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: strip(x)), lambda x: x != "")


def parse_issue(issue: Column) -> Column:
    """Labelled lines -> ``conclusion, reasons``; a small state machine over the lines."""
    lines = F.transform(_lines(strip(F.coalesce(issue, F.lit("")))), lambda x: strip(F.regexp_replace(x, r"^[-•*]+\s+", "")))
    start = F.struct(F.lit("").alias("conclusion"), F.array().cast("array<string>").alias("reasons"), F.lit("start").alias("mode"))

    def step(acc, line):
        label = F.regexp_replace(F.lower(F.regexp_extract(line, LABEL, 1)), r"(?U)\s+", " ")
        rest = strip(F.regexp_extract(line, LABEL, 2))
        labeled = line.rlike(LABEL)
        verdict = labeled & label.rlike("kết luận|vi phạm")
        why = (labeled & label.rlike("lý do|rủi ro")) | line.rlike(r"(?iuU)^Lý\s*do\s*:?\s*$")
        other = labeled & ~verdict & ~why
        first = ~labeled & ~why & (acc["conclusion"] == "") & (acc["mode"] == "start")
        sets = (verdict & (acc["conclusion"] == "") & (rest != "")) | first
        body = F.when(labeled | why, rest).otherwise(line)
        adds = ~sets & ~other & (body != "")
        return F.struct(
            F.when(sets, body).otherwise(acc["conclusion"]).alias("conclusion"),
            F.when(adds, F.array_append(acc["reasons"], body)).otherwise(acc["reasons"]).alias("reasons"),
            F.when(why, "reasons").when(verdict | first, "after").otherwise(acc["mode"]).alias("mode"))

    def finish(s):
        head = clean_text(F.coalesce(F.nullif(s["conclusion"], F.lit("")), F.get(lines, F.lit(0))))
        reasons = F.filter(F.transform(s["reasons"], lambda r: clean_text(r)), lambda r: (r != "") & (r != head))
        return F.struct(F.coalesce(F.nullif(head, F.lit("")), F.lit(NO_ISSUE)).alias("conclusion"), reasons.alias("reasons"))

    return bind(F.aggregate(lines, start, step), finish)


def parse_recommendation(text: Column) -> Column:
    """``sections (title, items)`` and the ``draft`` in « »."""
    t = strip(F.coalesce(text, F.lit("")))
    draft = F.nullif(strip(F.regexp_extract(t, "«([^»]+)»", 1)), F.lit(""))
    bare = F.when(draft.isNotNull(), strip(F.regexp_replace(F.regexp_replace(t, "«[^»]+»", ""), r"\n{2,}", "\n"))).otherwise(t)
    lines = F.filter(F.transform(_lines(bare), lambda x: clean_text(strip(F.regexp_replace(F.regexp_replace(x, r"^[-•*]+\s+", ""), r"^\d+[.)]\s+", "")))),
                     lambda x: (x != "") & ~x.rlike(DRAFT_LABEL))
    empty = F.array().cast("array<struct<title:string,items:array<string>>>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("items"))

    def keep(acc):
        section = F.struct(acc["title"].alias("title"), acc["items"].alias("items"))
        return F.when(F.size(acc["items"]) > 0, F.array_append(acc["done"], section)).otherwise(acc["done"])

    def step(acc, line):
        heading = (line.rlike(r"(?iuU)^(?:Đối với|Về)\b") & (F.length(line) < 140)) | (
            line.rlike(r":\s*$") & (F.length(line) < 100) & ~F.substr(line, F.lit(1), F.length(line) - 1).rlike("[.!?…]"))
        return F.struct(
            F.when(heading, keep(acc)).otherwise(acc["done"]).alias("done"),
            F.when(heading, F.regexp_replace(line, ":$", "")).otherwise(acc["title"]).alias("title"),
            F.when(heading, F.array().cast("array<string>")).otherwise(F.array_append(acc["items"], line)).alias("items"))

    sections = F.aggregate(lines, start, step, keep)
    whole = clean_text(bare)
    lone = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.array(whole).alias("items")))
    return bind(sections, lambda s: F.struct(
        F.when((F.size(s) == 0) & (whole != "") & ~whole.rlike(DRAFT_LABEL), lone).otherwise(s).alias("sections"), draft.alias("draft")))


def short_title(text: Column, width: int = 72) -> Column:
    def cut(t: Column) -> Column:
        head = F.substring(t, 1, width)
        at = F.length(F.regexp_extract(head, r"(?s)^(.*)[ ,]", 1))
        return F.when(t == "", NO_TITLE).when(F.length(t) <= width, t).otherwise(
            F.concat(strip(F.when(at > 40, F.substr(head, F.lit(1), at)).otherwise(head)), F.lit("…")))

    return bind(clean_text(text), cut)


def derive_topics(reasons: Column, conclusion: Column, catalog=TOPIC_WORDS, limit: int = 5) -> Column:
    src = F.lower(F.concat_ws(" ", F.array_join(reasons, " "), conclusion))

    def any_of(words: tuple[str, ...]) -> Column:
        out = F.contains(src, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(src, F.lit(w))
        return out

    return F.slice(F.array_compact(F.array(*[F.when(any_of(ws), F.lit(t)) for t, ws in catalog])), 1, limit)


def normalize_finding_view(findings: DataFrame, catalog=TOPIC_WORDS) -> DataFrame:
    """One display row per finding: structured fields first, parsed text where they are empty."""
    f = findings.withColumn("__i", parse_issue(F.col("issue"))).withColumn("__r", parse_recommendation(F.col("recommendation")))
    listed = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: clean_text(x)), lambda x: x != "")
    either = lambda c, other: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, listed(c)).otherwise(other)
    f = f.withColumn("__reasons", either("reasons", F.col("__i.reasons")))
    from_text = F.flatten(F.transform("__r.sections", lambda s: s["items"]))
    c = F.col("confidence")
    return f.select(
        "contract_id", "ord", "clause_ref", "severity",
        F.coalesce(F.nullif(strip("title"), F.lit("")), short_title(F.col("__i.conclusion"), 64)).alias("title"),
        F.col("__i.conclusion").alias("description"), F.col("__reasons").alias("reasons"),
        either("summary_topics", derive_topics(F.col("__reasons"), F.col("__i.conclusion"), catalog)).alias("summary_topics"),
        listed("impact").alias("impact"), either("actions", from_text).alias("actions"),
        F.nullif(strip_internal_refs(F.col("legal_basis")), F.lit("")).alias("basis"),
        F.coalesce(F.nullif(strip("revised_clause"), F.lit("")), "__r.draft").alias("revised_clause"),
        F.nullif(strip("original_clause"), F.lit("")).alias("original_clause"),
        F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c)))).alias("confidence"))


# -- I10, I12 -----------------------------------------------------------------------

MARKS = r"[«»\"'.,;:!?()]"


def changed_tokens(original: Column, revised: Column) -> Column:
    """Words of the revision (3 letters or more) that the original does not have."""
    bare = lambda w: F.lower(F.regexp_replace(w, MARKS, ""))
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    rows = F.transform(words(revised), lambda w: F.struct(w.alias("w"), bare(w).alias("b")))
    known = F.transform(words(original), bare)

    def marked(x: Column) -> Column:
        new = F.array_except(F.transform(x["rows"], lambda r: r["b"]), x["known"])
        return bind(new, lambda n: F.transform(
            F.filter(x["rows"], lambda r: (F.length(r["b"]) >= 3) & F.array_contains(n, r["b"])), lambda r: r["w"]))

    out = bind(F.struct(rows.alias("rows"), known.alias("known")), marked)
    return F.when(original.isNotNull() & (original != ""), out).otherwise(F.array().cast("array<string>"))


def citation_status_label(raw: Column) -> Column:
    s = clean_text(raw)
    has = lambda w: F.contains(F.lower(s), F.lit(w))
    return (
        F.when(s == "", F.lit(None))
        .when(has("đã đối chiếu") | has("chưa đối chiếu"), s)
        .when(has("hết hiệu lực") & ~has("một phần") & ~has("áp dụng"), "Hết hiệu lực")
        .when(has("chưa có hiệu lực") | has("chưa hiệu lực"), "Chưa có hiệu lực")
        .when(has("còn hiệu lực") | has("còn áp dụng") | has("một phần") | has("đang có hiệu lực"), "Còn hiệu lực")
        .when(F.length(s) > 80, F.concat(F.substring(s, 1, 77), F.lit("…"))).otherwise(s))


def citation_body(quote: Column, summary: Column, has_evidence: Column) -> Column:
    """``text, kind, gist``: the quote; the summary beside it only when neither holds the other."""
    q, s = F.nullif(strip(quote), F.lit("")), F.nullif(strip(summary), F.lit(""))
    norm = lambda t: F.lower(strip(F.regexp_replace(t, r"(?U)\s+", " ")))
    same = F.contains(norm(q), norm(s)) | F.contains(norm(s), norm(q))
    kind = F.when(has_evidence, "verbatim").otherwise("gist")
    none = F.lit(None).cast("string")
    row = lambda t, k, g: F.struct(t.alias("text"), k.alias("kind"), g.alias("gist"))
    return (
        F.when(q.isNotNull() & s.isNotNull() & ~same, row(q, F.lit("verbatim"), s))
        .when(q.isNotNull(), row(q, kind, none)).when(s.isNotNull(), row(s, F.lit("gist"), none)).otherwise(row(none, none, none)))
