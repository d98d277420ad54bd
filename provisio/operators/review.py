"""Rule findings over contracts: completeness, red flags, merge, review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import status as S
from provisio.functions.contract import is_labor_contract
from provisio.functions.labor_rules import MANDATORY, RED_FLAGS
from provisio.functions.paths import path_location
from provisio.functions.text import clause_excerpt
from provisio.operators.rules import any_match, missing_groups, values_of

FINDING_SCHEMA = (
    "contract_id string, clause_ref string, title string, issue string, severity string, summary_topics array<string>, "
    "reasons array<string>, impact array<string>, actions array<string>, legal_basis string, recommendation string, "
    "original_clause string, revised_clause string, confidence double"
)
CITATION_SCHEMA = (
    "array<struct<title:string,summary:string,doc_number:string,location:string,article:string,quote:string,evidence_path:string,source_url:string,status:string>>"
)
# The instrument that the rules cite, and the status of one that is not in the tables.
CODE_TITLE, CODE_NUMBER = "Bộ luật Lao động", "45/2019/QH14"
UNCHECKED = "Chưa đối chiếu kho — chưa xác nhận hiệu lực"


def _governed(rows: DataFrame, governing: DataFrame) -> DataFrame:
    """``rows`` with the state ``law`` and verdict ``eff`` of the instrument in force on their own day (``as_of``).

    ``governing``: at most one row per ``as_of`` (``effect.resolve_governing_doc`` of one kind).
    """
    law = governing.select("as_of", F.struct("doc_id", "doc_num", "title", "source_url", "status_flag", "eff_from", "eff_to").alias("law"))
    j = rows.join(law, "as_of", "left")
    state = S.evaluate_effect(F.col("law").isNotNull(), F.col("law.status_flag"), F.col("law.eff_from"), F.col("law.eff_to"), F.col("as_of"))
    return j.withColumn("eff", state)


def _citation(**parts: Column) -> Column:
    names = ("title", "summary", "doc_number", "location", "article", "quote", "evidence_path", "source_url", "status")
    return F.struct(*[parts.get(n, F.lit(None).cast("string")).alias(n) for n in names])


def _citable() -> Column:
    """No instrument found (cited as unchecked), or one that may be cited."""
    return F.col("law").isNull() | F.col("eff.ok_to_cite")


def _hint_number(rule) -> str:
    return "".join(ch for ch in rule.clause_hint if ch.isdigit())


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda a: F.concat(F.lit("- "), a)), "\n")


# -- H9, H10 ------------------------------------------------------------------

# Wording of the completeness finding.
WHOLE_TEXT = "Hợp đồng (toàn văn)"
RESIDENCE_KEY, RESIDENCE_TOPIC = "employee_residence", "Thiếu địa chỉ / nơi cư trú NLĐ"
TITLE_RESIDENCE = "Thiếu địa chỉ / nơi cư trú NLĐ và nội dung bắt buộc khác"
TITLE_MISSING = "Thiếu nội dung chủ yếu bắt buộc của HĐLĐ"
ARTICLE = 21
MISSING_ISSUE = "Hợp đồng lao động chưa thể hiện đủ các nội dung chủ yếu theo Điều 21 Bộ luật Lao động ("
MISSING_RESIDENCE = "Đặc biệt: chưa ghi nơi cư trú / địa chỉ hiện tại của NLĐ. "
MISSING_REST = "Các mục sau không tìm thấy hoặc không đủ rõ trong văn bản."
MISSING_SUMMARY = "Nội dung chủ yếu bắt buộc của hợp đồng lao động."
MISSING_TOPICS = ("Thiếu nội dung bắt buộc", "Điều 21 BLLĐ")
MISSING_IMPACT = (
    "Hợp đồng có nguy cơ bị coi là không đầy đủ nội dung chủ yếu theo pháp luật lao động.",
    "Rủi ro khi thanh tra / tranh chấp về quyền lợi NLĐ chưa được thỏa thuận rõ.",
)
MISSING_ACTIONS = (
    "Bổ sung nơi cư trú / địa chỉ hiện tại của NLĐ (nếu đang thiếu).",
    "Bổ sung từng mục còn thiếu theo Điều 21 khoản 1 Bộ luật Lao động.",
    "Đối chiếu Thông tư hướng dẫn nội dung HĐLĐ (nếu áp dụng) để ghi đủ thông tin định danh và chế độ.",
)


def missing_fields(texts: DataFrame, rules=MANDATORY) -> DataFrame:
    """``contract_id, text`` -> ``contract_id, missing`` (keys in rule order)."""
    return texts.select("contract_id", missing_groups(F.col("text"), rules).alias("missing"))


def completeness_findings(
    contracts: DataFrame, governing: DataFrame, snippets: DataFrame | None = None, rules=MANDATORY, labor_only: bool = True
) -> DataFrame:
    """One finding per contract with missing contents, cited from the law of its own day.

    ``contracts``: ``contract_id, text, contract_type, as_of``; ``governing``: one row per
    ``as_of`` at most; ``snippets``: ``doc_id, article_no, quote`` (see ``retrieve.article_snippet``).
    """
    rows = contracts.filter(is_labor_contract(F.col("text"), F.col("contract_type"))) if labor_only else contracts
    keys = rows.withColumn("missing", missing_groups(F.col("text"), rules)).filter("size(missing) > 0").select("contract_id", "as_of", "missing")
    j = _governed(keys, governing)
    if snippets is None:
        j = j.withColumn("quote", F.lit(None).cast("string"))
    else:
        own = snippets.filter(F.col("article_no") == ARTICLE).select(F.col("doc_id").alias("law_id"), "quote")
        j = j.join(own, F.col("law.doc_id") == F.col("law_id"), "left")
    labels = values_of(F.col("missing"), rules, lambda r: r.label)
    topics = values_of(F.col("missing"), rules, lambda r: r.label.split("(")[0].strip())
    residence = F.array_contains("missing", RESIDENCE_KEY)
    others = F.filter(topics, lambda t: ~F.lower(t).rlike("cư trú|địa chỉ"))
    listed = F.when(residence, F.concat(F.array(F.lit(RESIDENCE_TOPIC)), others)).otherwise(topics)
    number = F.coalesce("law.doc_num", F.lit(CODE_NUMBER))
    article = f"Điều {ARTICLE}"
    cited = _citation(
        title=F.concat(F.lit(f"{article} "), F.coalesce("law.title", F.lit(CODE_TITLE))), article=F.lit(article), doc_number=number,
        summary=F.substring(F.coalesce(F.nullif("quote", F.lit("")), F.lit(MISSING_SUMMARY)), 1, 500),
        quote=F.nullif(F.substring("quote", 1, 280), F.lit("")), source_url=F.col("law.source_url"),
        status=F.when(F.col("law").isNull(), UNCHECKED).otherwise(F.col("eff.status_label")),
    )
    fixed = lambda xs: F.array(*[F.lit(x) for x in xs])
    none = F.lit(None).cast("string")
    issue = F.concat(
        F.lit(MISSING_ISSUE), F.size("missing").cast("string"), F.lit(" mục thiếu). "), F.when(residence, MISSING_RESIDENCE).otherwise(""), F.lit(MISSING_REST))
    return j.select(
        "contract_id", F.lit(WHOLE_TEXT).alias("clause_ref"), F.when(residence, TITLE_RESIDENCE).otherwise(TITLE_MISSING).alias("title"),
        issue.alias("issue"), F.lit("warning").alias("severity"),
        F.concat(fixed(MISSING_TOPICS), F.slice(listed, 1, 4)).alias("summary_topics"), labels.alias("reasons"),
        fixed(MISSING_IMPACT).alias("impact"), fixed(MISSING_ACTIONS).alias("actions"),
        F.concat(F.lit(f"{article} {CODE_TITLE} ("), number, F.lit(") — "), F.col("eff.status_label")).alias("legal_basis"),
        F.when(_citable(), F.array(cited)).alias("legal_citations"),
        _bullets(labels).alias("recommendation"), none.alias("original_clause"), none.alias("revised_clause"),
        F.when(F.col("law").isNotNull() & F.col("eff.verified"), 0.75).otherwise(0.55).alias("confidence"))


# -- H11..H18 -------------------------------------------------------------------


def red_flag_hits(texts: DataFrame, flags=RED_FLAGS) -> DataFrame:
    """``contract_id, text`` -> one row per matching rule, in rule order."""
    keys = any_match(F.col("text"), flags)
    return texts.select("contract_id", F.posexplode(keys).alias("pos", "key"))


def revise_clause(original: Column, keys: Column, flags=RED_FLAGS) -> Column:
    """Rule edits in rule order; text that barely changes gets the list of actions."""
    text = original
    for f in flags:
        for pattern, repl in f.edits:
            text = F.when(F.array_contains(keys, f.key), F.regexp_replace(text, f"(?iuUs){pattern}", repl.replace("$", r"\$"))).otherwise(text)
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s{2,}", " ")), r"\s+([,.;:])", "$1")
    plain = F.trim(original)
    listed = F.concat(plain, F.lit("\n\n[Đề xuất chỉnh sửa bắt buộc]\n"), _bullets(values_of(keys, flags, lambda f: f.action)))
    return F.when(original.isNotNull() & (original != "") & (F.size(keys) > 0),
                  F.when((text == plain) | (F.length(text) < 40), listed).otherwise(text))


def original_clauses(wanted: DataFrame, chunks: DataFrame, contracts: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """``contract_id, clause_number`` -> stored parts, else the excerpt, else the clause summary."""
    from provisio.operators.upsert import clause_text

    stored = clause_text(chunks.join(wanted.select("contract_id", "clause_number").distinct(), ["contract_id", "clause_number"], "left_semi"))
    j = wanted.join(stored.withColumnRenamed("text", "stored"), ["contract_id", "clause_number"], "left").join(
        contracts.select("contract_id", F.col("text").alias("full")), "contract_id", "left")
    n = F.col("clause_number").try_cast("int")
    choices = [F.nullif("stored", F.lit("")), F.when(n.isNotNull(), clause_excerpt(F.col("full"), n))]
    if clauses is not None:
        j = j.join(clauses.select("contract_id", "clause_number", "summary"), ["contract_id", "clause_number"], "left")
        choices.append(F.nullif(F.trim("summary"), F.lit("")))
    return j.withColumn("original_clause", F.coalesce(*choices)).drop("stored", "full", "summary")


def hydrate_flag_citation(days: DataFrame, governing: DataFrame, snippets: DataFrame, flags=RED_FLAGS) -> DataFrame:
    """``as_of, key, citation`` of every rule on every day asked for (``as_of``).

    Article text of that day's instrument (``snippets``: ``doc_id, article_no, quote, path``) when long
    enough, else the rule's blurb.  A day whose instrument may not be cited has no rows.
    """
    rules = F.array(*[
        F.struct(F.lit(f.key).alias("key"), F.lit(f.law_blurb).alias("blurb"), F.lit(f.article_hint.split(",")[0].strip()).alias("hint"),
                 F.array(*[F.lit(n).cast("bigint") for n in f.articles]).alias("articles"))
        for f in flags
    ])
    each = _governed(days.select("as_of").distinct(), governing).filter(_citable()).select("as_of", "law", "eff", F.explode(rules).alias("rule"))
    asked = each.select("as_of", "rule.key", F.col("law.doc_id").alias("doc_id"), F.posexplode("rule.articles").alias("ord", "article_no"))
    found = asked.join(snippets.select("doc_id", "article_no", "quote", "path"), ["doc_id", "article_no"]).filter("quote <> ''")
    held = found.groupBy("as_of", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "quote", "path", "article_no"))).alias("qs"))
    j = each.join(held, (each["as_of"] == held["as_of"]) & (each["rule.key"] == held["key"]), "left").select(each["*"], "qs")
    joined = F.array_join(F.transform("qs", lambda x: x["quote"]), "\n\n")
    blurb = F.col("rule.blurb")
    long = F.coalesce(F.length(joined) >= 80, F.lit(False))
    apart = ~F.contains(joined, blurb) & ~F.contains(blurb, F.substring(joined, 1, 60))
    short = F.when(F.length(blurb) <= 180, blurb).otherwise(F.concat(F.substring(blurb, 1, 177), F.lit("…")))
    path = F.get(F.filter("qs", lambda x: x["path"].isNotNull()), F.lit(0))
    number = F.coalesce(path["article_no"], F.get("rule.articles", F.lit(0)))
    article = F.concat(F.lit("Điều "), number.cast("string"))
    return j.select(
        "as_of", "rule.key", _citation(
            title=F.concat(F.coalesce(article, F.col("rule.hint")), F.lit(" — "), F.coalesce("law.title", F.lit(CODE_TITLE))),
            summary=F.when(long & apart, short).otherwise(""), doc_number=F.coalesce("law.doc_num", F.lit(CODE_NUMBER)),
            location=path_location(path["path"])["location"], article=article,
            quote=F.when(long, F.substring(joined, 1, 2800)).otherwise(blurb), evidence_path=path["path"], source_url=F.col("law.source_url"),
            status=F.when(F.col("law").isNull(), UNCHECKED).otherwise(F.col("eff.status_label"))).alias("citation"))


def clause_groups(hits: DataFrame, flags=RED_FLAGS) -> DataFrame:
    """Hits by the clause a rule points at: ``contract_id, clause_number, keys`` (rule order)."""
    number = F.create_map(*[F.lit(x) for f in flags for x in (f.key, _hint_number(f))])
    tagged = hits.withColumn("clause_number", F.try_element_at(number, F.col("key")))
    return tagged.groupBy("contract_id", "clause_number").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("keys"))


def cite_groups(groups: DataFrame, citations: DataFrame) -> DataFrame:
    """``groups`` (with ``as_of``) and the citations of their keys in rule order; keys without one add nothing."""
    # A citation depends on the day and the key only: one map per day, looked up in the row.
    known = citations.groupBy("as_of").agg(F.map_from_entries(F.collect_list(F.struct("key", "citation"))).alias("__cited"))
    found = F.filter(F.transform("keys", lambda k: F.try_element_at("__cited", k)), lambda c: c.isNotNull())
    return groups.join(known, "as_of", "left").withColumn("legal_citations", F.when(F.size(found) > 0, found)).drop("__cited")


def merge_by_clause(groups: DataFrame, flags=RED_FLAGS) -> DataFrame:
    """One finding per contract clause.

    ``groups``: ``contract_id, clause_number, keys, original_clause``, and ``legal_citations`` where
    :func:`cite_groups` gave them.
    """
    if "legal_citations" not in groups.columns:
        groups = groups.withColumn("legal_citations", F.lit(None).cast(CITATION_SCHEMA))
    groups = groups.withColumn("legal_citations", F.coalesce("legal_citations", F.array().cast(CITATION_SCHEMA)))
    of = lambda value: values_of(F.col("keys"), flags, value)
    shorts = of(lambda f: f.short)
    title = F.array_join(shorts, " · ")
    cut = F.concat(F.rtrim(F.substring(title, 1, 97), F.lit(" ·")), F.lit("…"))
    actions = F.array_distinct(of(lambda f: f.action))
    revised = revise_clause(F.col("original_clause"), F.col("keys"), flags)
    rows = groups.withColumn("revised_clause", revised)
    return rows.select(
        "contract_id", F.concat(F.lit("Điều "), "clause_number").alias("clause_ref"),
        F.when(F.length(title) > 100, cut).otherwise(title).alias("title"), F.array_join(of(lambda f: f.reason), " ").alias("issue"),
        F.when(F.array_contains(of(lambda f: f.severity), "critical"), "critical").otherwise("warning").alias("severity"),
        F.array_distinct(shorts).alias("summary_topics"), of(lambda f: f.reason).alias("reasons"),
        F.array_distinct(of(lambda f: f.impact)).alias("impact"), actions.alias("actions"),
        F.array_join(F.array_distinct(of(lambda f: f.article_hint)), "; ").alias("legal_basis"), "legal_citations",
        F.concat_ws("\n", _bullets(actions), F.concat(F.lit("«"), "revised_clause", F.lit("»"))).alias("recommendation"),
        "original_clause", "revised_clause", F.lit(0.9).alias("confidence"))


def clause_number_of(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"(\d+)", 1), F.lit(""))


def covered_clauses(findings: DataFrame) -> DataFrame:
    """Clauses that already have a critical finding."""
    return findings.filter("severity = 'critical'").select("contract_id", clause_number_of(F.col("clause_ref")).alias("clause_number")).filter(
        "clause_number is not null").distinct()


def law_blurbs(texts: DataFrame, limit: int = 4, flags=RED_FLAGS) -> DataFrame:
    """First ``limit`` blurbs of matching rules (soft patterns included), in rule order."""
    keys = F.slice(any_match(F.col("text"), flags, soft=True), 1, limit)
    return texts.select("contract_id", values_of(keys, flags, lambda f: f"[BLLĐ · {f.article_hint}] {f.law_blurb}").alias("blurbs"))


def topic_keys(findings: DataFrame, flags=RED_FLAGS) -> DataFrame:
    """Clause -> rule keys found back in titles and reasons."""
    blob = F.lower(F.concat_ws(" ", "title", F.array_join("reasons", " ")))
    number = clause_number_of(F.col("clause_ref"))

    def test(f) -> Column:
        strong = F.contains(blob, F.lit(f.title.lower())) | F.contains(blob, F.lit(f.reason.lower()))
        weak = reduce(lambda a, b: a | b, [F.contains(blob, F.lit(t.lower())) for t in f.topics])
        return strong | (weak & (number == _hint_number(f)))

    keys = F.array_compact(F.array(*[F.when(test(f), F.lit(f.key)) for f in flags]))
    return findings.select("contract_id", number.alias("clause_number"), F.explode(keys).alias("key")).filter("clause_number is not null").distinct()


# -- H21..H24 ---------------------------------------------------------------------


def judge_worklist(clauses: DataFrame, covered: DataFrame, contracts: DataFrame) -> DataFrame:
    """Clauses still to judge with the context of their contract."""
    return clauses.join(covered, ["contract_id", "clause_number"], "left_anti").join(
        contracts.select("contract_id", "contract_type", "as_of", "job_context"), "contract_id")


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def apply_review(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reviews``: ``contract_id, decision, edits`` (array of findings).

    Approved with edits: the edits replace the draft; rejected: nothing is kept;
    no review yet: the draft is held back.
    """
    approved = reviews.filter("decision = 'approved'")
    edited = approved.filter("size(edits) > 0")
    replaced = edited.select("contract_id", F.explode("edits").alias("e")).select("contract_id", "e.*")
    kept = findings.join(approved.filter("coalesce(size(edits), 0) <= 0").select("contract_id"), "contract_id", "left_semi")
    return kept.unionByName(replaced, allowMissingColumns=True)


# Wording of the finding without law.
NO_LAW_TITLE = "Thiếu căn cứ pháp luật để đối chiếu"
NO_LAW_ISSUE = "Không tìm thấy căn cứ pháp luật đủ liên quan trong kho dữ liệu để đối chiếu điều khoản này."


def no_grounding_findings(clauses: DataFrame, hits: DataFrame) -> DataFrame:
    """A fixed warning for clauses without a single legal hit."""
    bare = clauses.join(hits.select("contract_id", "clause_number").distinct(), ["contract_id", "clause_number"], "left_anti")
    return bare.select(
        "contract_id", F.concat(F.lit("Điều "), "clause_number").alias("clause_ref"), F.lit(NO_LAW_TITLE).alias("title"),
        F.lit(NO_LAW_ISSUE).alias("issue"), F.lit("warning").alias("severity"), F.lit(0.35).alias("confidence"))
