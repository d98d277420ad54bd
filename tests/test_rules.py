"""The fixed Vietnamese rule tables through the evaluators."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions.labor_rules import MANDATORY, RED_FLAGS
from provisio.operators import citations, preamble, report, review
from provisio.operators.rules import any_match, missing_groups

BASE = (
    "Hợp đồng lao động. Người sử dụng lao động: Công ty A. Địa chỉ: 1 Nguyễn Huệ, Q1. Người lao động: Nguyễn Văn B. "
    "Ngày sinh: 01/01/1990. Số CCCD: 001."
)


def test_residence_is_not_the_employers_address(value):
    miss = lambda t: value(missing_groups(F.lit(t), MANDATORY))
    assert "employee_residence" in miss(BASE)
    assert "employee_residence" not in miss(BASE + " Nơi cư trú: 2 Lê Lợi.")
    assert "employee_residence" not in miss(BASE + " ĐỊA CHỈ HIỆN TẠI: 3 Hai Bà Trưng.")


def test_red_flags_fold_case_and_marks(value):
    hits = lambda t: value(any_match(F.lit(t), RED_FLAGS))
    assert hits("CÔNG TY KHÔNG ĐÓNG BHXH cho NLĐ") == ["no_bhxh"]
    assert hits("được chấm dứt hợp đồng khi NLĐ mang thai") == ["terminate_pregnancy"]
    assert hits("NLĐ không được quyền khởi kiện") == ["ban_lawsuit"]
    assert hits("hợp đồng bình thường") == []


def test_revise_clause(value):
    original = "Điều 2: NLĐ có trách nhiệm làm thêm giờ bất cứ khi nào quản lý yêu cầu và sẽ không được tính thêm tiền lương làm thêm giờ."
    out = value(review.revise_clause(F.lit(original), F.array(F.lit("ot_unpaid"))))
    assert "không được tính thêm tiền lương làm thêm giờ" not in out.lower() and "hệ số" in out
    same = value(review.revise_clause(F.lit("Không có gì để sửa trong điều khoản dài này."), F.array(F.lit("ot_unpaid"))))
    assert "[Đề xuất chỉnh sửa bắt buộc]" in same


def test_findings_merge_per_clause(spark):
    t = spark.createDataFrame([("c", "Điều 3. Công ty không đóng BHXH. Điều này: giữ bản gốc CCCD.\nĐiều 4. x")], "contract_id string, text string")
    groups = review.clause_groups(review.red_flag_hits(t))
    none = spark.createDataFrame([], "contract_id string, clause_number string, chunk_index int, content string")
    f = review.merge_by_clause(review.original_clauses(groups, none, t)).collect()
    assert len(f) == 1 and f[0]["clause_ref"] == "Điều 3" and f[0]["severity"] == "critical"
    assert f[0]["title"] == "Không đóng BHXH/BHYT · Giữ CCCD / bằng cấp gốc" and "Điều 3" in f[0]["original_clause"]
    assert [r["clause_number"] for r in review.covered_clauses(review.merge_by_clause(review.original_clauses(groups, none, t))).collect()] == ["3"]


def test_preamble(spark):
    t = spark.createDataFrame([("c", "Căn cứ Bộ luật Lao động số 45/2019/QH14 ngày 20/11/2019;\nCăn cứ Nghị định số 1/2001/NĐ-CP;\nCăn cứ nhu cầu;\nĐiều 1. x")], "contract_id string, text string")
    docs = spark.sql("""select 'a' doc_id, '45/2019/QH14' doc_num, 'Bộ luật Lao động' title, 'Bộ luật' doc_type, 2 status_flag, date'2021-01-01' eff_from,
                        cast(null as date) eff_to, date'2019-11-20' issue_date""")
    c = preamble.preamble_citations(t)
    assert {r["doc_num"] for r in c.collect()} == {"45/2019/QH14", "1/2001/NĐ-CP"}
    f = preamble.validate_preamble(c, docs, "2024-01-01").collect()
    assert len(f) == 1 and f[0]["severity"] == "critical" and len(f[0]["reasons"]) == 2


def test_model_json(value):
    ok = lambda raw: value(citations.parse_model_json(F.lit(raw)))
    assert ok('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert ok("{“a”: 1,}") == '{"a": 1}'
    assert ok('x {"a": {"b": 2}} y') == '{"a": {"b": 2}}'
    assert ok("[1]") is None and ok("không") is None
    conf = lambda v: value(citations.confidence(F.lit(v)))
    assert conf("85") == 0.85 and conf("-1") == 0.0 and conf("x") is None


def test_issue_and_recommendation(value):
    p = value(report.parse_issue(F.lit("Kết luận: **Sai** luật\nLý do:\n- một\n- hai\nRủi ro: ba")))
    assert p["conclusion"] == "Sai luật" and p["reasons"] == ["một", "hai", "ba"]
    assert value(report.parse_issue(F.lit("")))["conclusion"] == "Chưa có mô tả vấn đề."
    r = value(report.parse_recommendation(F.lit("Về lương:\n- trả đủ\nĐề xuất câu thay thế:\n«Bên A trả đủ»")))
    assert [(s["title"], s["items"]) for s in r["sections"]] == [("Về lương", ["trả đủ"])] and r["draft"] == "Bên A trả đủ"
    assert value(report.changed_tokens(F.lit("Bên A trả"), F.lit("Bên A trả đủ lương"))) == ["lương"]


def test_governing_document_by_brute_force(spark):
    """Best document of a kind on a day: open windows, ties, days outside all windows, unknown kinds, null days."""
    import datetime
    import random

    from provisio.operators import effect

    rng = random.Random(5)
    day = lambda: None if rng.random() < 0.2 else datetime.date(1990, 1, 1) + datetime.timedelta(rng.randrange(4000))
    docs = [(str(i), f"n{i}", rng.choice("abc"), day(), day(), day(), rng.choice([0, 1, 2, 3, 4, 5])) for i in range(300)]
    asked = [(rng.choice("abcd"), day() or datetime.date(1995, 5, 5)) for _ in range(150)] + [("a", datetime.date(2400, 1, 1)), ("a", datetime.date(1600, 2, 3)), (None, datetime.date(1995, 1, 1))]
    rank = {1: 0, 5: 1, 4: 2, 0: 3}
    least = datetime.date.min
    want = set()
    for kind, at in asked:
        fits = [d for d in docs if at and d[2] == kind and d[6] in rank and (d[4] is None or d[4] <= at) and (d[5] is None or d[5] > at)]
        if fits:
            best = max(fits, key=lambda d: (-rank[d[6]], d[3] or d[4] or least, d[1], d[0]))
            want.add((kind, at, best[0]))
    table = spark.createDataFrame(docs, "doc_id string, doc_num string, doc_type string, issue_date date, eff_from date, eff_to date, status_flag int")
    out = effect.resolve_governing_doc(spark.createDataFrame(asked, "kind string, as_of date"), table)
    assert {(r["kind"], r["as_of"], r["doc_id"]) for r in out.collect()} == want and len(want) > 40
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_ancestors_over_edges_with_cycles(spark):
    from provisio.operators import tree

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", None), ("a", "b"), ("s", "s")]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    out = tree.ancestors_by_edges(edges.select("child"), edges, 3)
    found = {(r["child"], r["ancestor"], r["hops"]) for r in out.collect()}
    assert found == {
        ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "a", 2), ("b", "d", 2), ("b", "e", 3),
        ("c", "a", 1), ("c", "d", 1), ("c", "b", 2), ("c", "e", 2), ("d", "e", 1)}
