"""Legal grounds cited at the head of a contract, checked against the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import status as S
from provisio.functions.let import bind, strip
from provisio.functions.metadata import parse_local_date
from provisio.operators.retrieve import lookup_doc_number

# Forms of a cited ground.
NUMBER = r"(?<!\d)(\d{1,4}/\d{4}/[A-ZĐ0-9.\-]+)"
INSTRUMENT = (
    r"(?:Thông\s*tư\s*liên\s*tịch|Thông\s*tư|Nghị\s*định|Quyết\s*định|Bộ\s*luật|Luật|Pháp\s*lệnh|Nghị\s*quyết|Chỉ\s*thị|Lệnh)"
)
GROUND_LINE = rf"(?iuU)(?:^|\n)\s*[-•*]?\s*Căn\s*cứ\s+({INSTRUMENT}[^;\n]{{0,200}})"
CITED_DATE = r"ngày\s+\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{4}|ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
BODY_START = r"(?iuU)(?:^|\n)\s*(?:Hôm\s*nay\s*ngày|Người\s*sử\s*dụng\s*lao\s*động|Điều\s*1\b)"


def extract_preamble(text: Column) -> Column:
    return F.when(text.rlike(BODY_START), F.get(F.split(text, BODY_START, 2), F.lit(0))).otherwise(F.substring(text, 1, 2500))


def preamble_citations(texts: DataFrame) -> DataFrame:
    """``contract_id, text`` -> ``contract_id, pos, raw, doc_num, name_hint, cited_date``; first of equal ones."""
    lines = F.regexp_extract_all(extract_preamble(F.col("text")), F.lit(GROUND_LINE), F.lit(1))

    def parse(raw: Column) -> Column:
        num = F.nullif(F.regexp_extract(raw, f"(?iu){NUMBER}", 1), F.lit(""))
        after = strip(F.regexp_replace(raw, f"(?iuU)^{INSTRUMENT}", ""))
        day = parse_local_date(F.regexp_replace(F.lower(F.regexp_extract(raw, f"(?iuU){CITED_DATE}", 0)), r"\s*/\s*", "/"))

        def row(x: Column) -> Column:
            named = F.when(x["num"].isNotNull() & F.contains(F.lower(x["after"]), F.lit("số")), F.get(
                F.split(x["after"], r"(?iuU)\bsố\b", 2), F.lit(0))).otherwise(F.substring(x["after"], 1, 80))
            return F.struct(
                raw.alias("raw"), x["num"].alias("doc_num"), F.nullif(F.trim(named, F.lit(" ,.-")), F.lit("")).alias("name_hint"),
                x["day"].alias("cited_date"), F.lower(F.coalesce(x["num"], raw)).alias("key"))

        return bind(F.struct(num.alias("num"), after.alias("after"), day.alias("day")), row)

    parsed = F.transform(lines, lambda line: bind(F.rtrim(strip(line), F.lit(".;,")), parse))
    out = texts.select("contract_id", F.posexplode(parsed).alias("pos", "c")).select("contract_id", "pos", "c.*")
    first = out.groupBy("contract_id", "key").agg(F.min_by(F.struct("pos", "raw", "doc_num", "name_hint", "cited_date"), "pos").alias("c"))
    return first.select("contract_id", "c.*")


def validate_preamble(citations: DataFrame, docs: DataFrame, as_of) -> DataFrame:
    """One finding per contract whose grounds have a problem."""
    day = S.as_date(as_of)
    j = lookup_doc_number(citations, docs)
    d = F.col("d")
    found = d.isNotNull()
    j = j.withColumn("eff", S.evaluate_effect(found, d["status_flag"], d["eff_from"], d["eff_to"], day))
    words = F.filter(F.split(F.lower("name_hint"), r"(?U)\s+"), lambda w: F.length(w) > 3)
    title = F.lower(d["title"])
    named = F.exists(F.slice(words, 1, 3), lambda w: F.contains(title, w))
    dead = found & ~F.col("eff.ok_to_cite")
    over = dead & ((d["status_flag"] == 2) | (F.col("eff.detail") == "expired"))
    soft = found & F.col("eff.ok_to_cite") & F.col("eff.detail").isin("partial", "unclear")
    bad_date = F.coalesce(F.col("cited_date") != d["issue_date"], F.lit(False)) & found
    bad_name = found & (F.size(words) > 0) & ~named
    say = lambda cond, *parts: F.when(cond, F.concat(*parts))
    text = F.lit
    problems = F.array_compact(F.array(
        say(F.col("doc_num").isNull(), text("Câu căn cứ «"), F.substring("raw", 1, 80), text("» không có số hiệu văn bản để đối chiếu trong kho.")),
        say(F.col("doc_num").isNotNull() & ~found, text("Không tìm thấy văn bản số "), F.col("doc_num"), text(" trong kho pháp điển.")),
        say(dead, F.col("doc_num"), text(" — "), F.coalesce(d["title"], text("")), text(": "), F.col("eff.status_label"), text(". Không nên nêu làm căn cứ tại "), day.cast("string")),
        say(bad_date, F.col("doc_num"), text(": ngày ghi trên HĐ ("), F.col("cited_date").cast("string"), text(") không khớp "), d["issue_date"].cast("string")),
        say(bad_name, F.col("doc_num"), text(": tên gọi trên HĐ («"), F.col("name_hint"), text("») không khớp tiêu đề trong kho"))))
    per = j.select(
        "contract_id", "pos", problems.alias("p"), F.when(soft, F.concat("doc_num", text(": "), F.col("eff.status_label"))).alias("soft"),
        over.alias("over"), (dead | (F.col("doc_num").isNotNull() & ~found)).alias("hard"), found.alias("found"),
        F.when(found, F.concat_ws(": ", d["doc_num"], F.col("eff.status_label"))).alias("basis"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda x: x["v"])
    agg = per.groupBy("contract_id").agg(
        ordered("p").alias("ps"), F.array_compact(ordered("soft")).alias("softs"), F.bool_or("over").alias("over"), F.bool_or("hard").alias("hard"),
        F.bool_or("found").alias("found"), F.array_compact(ordered("basis")).alias("basis"))
    reasons = F.concat(F.flatten("ps"), "softs")
    severity = F.when(F.col("over") & ~((F.size("softs") > 0) & ~F.col("hard")), "critical").otherwise("warning")
    return agg.filter(F.size(reasons) > 0).select(
        "contract_id", F.lit("Phần căn cứ (đầu hợp đồng)").alias("clause_ref"), F.lit("Căn cứ pháp lý đầu HĐ cần rà soát").alias("title"),
        severity.alias("severity"), reasons.alias("reasons"), F.nullif(F.array_join("basis", "; "), F.lit("")).alias("legal_basis"),
        F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("- "), r)), "\n").alias("recommendation"),
        F.when(F.col("found"), 0.8).otherwise(0.55).alias("confidence"))
