"""Golden cases of the column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from provisio.functions import contract, metadata, paths, rank, references, rewrite, scope, status, text  # noqa: F401
from provisio.operators import citations, relations, tree


@pytest.mark.parametrize(("level", "title", "want"), [
    ("Part", "Phần Thứ Nhất", "P1"), ("Part", "Phần Thứ Hai", "P2"), ("Part", "Phần Thứ Ba", "P3"),
    ("Chapter", "Chương I", "C1"), ("Chapter", "Chương IX", "C9"), ("Chapter", "Chương XIII", "C13"), ("Chapter", "CHƯƠNG XXVI", "C26"),
    ("Section", "Mục 1", "M1"), ("Section", "Mục I", "M1"), ("SubSection", "Tiểu mục 2", "TM2"), ("SubSection", "Tiểu mục II", "TM2"),
    ("Article", "Điều 12", "D12"), ("Article", "Điều", None), ("Clause", "Khoản 3", "K3"), ("Clause", "Khoản", None),
    ("Point", "Điểm a", "a"), ("Point", "Điểm đ", "dd"), ("Point", "Điểm khoan", None), ("Other", "Điều 1", None),
])
def test_segment_token(value, level, title, want):
    assert value(paths.segment_token(F.lit(level), F.lit(title))) == want


def test_paths(value):
    lit = F.lit
    assert value(paths.path_sanitize(lit("168/2024/NĐ-CP"))) == "168_2024_N__CP"
    assert value(paths.path_sanitize(lit(""))) == "doc"
    assert value(paths.path_build(lit("a-1"), lit(".C1.D1"))) == "a_1.C1.D1"
    assert value(paths.path_build(lit("a-1"), lit(None).cast("string"))) == "a_1"
    assert value(paths.ref_to_path(lit("a-1:C1.D1.K1.a"))) == "a_1.C1.D1.K1.a"
    assert value(paths.ref_to_path(lit("a-1:"))) is None
    assert value(paths.article_root(lit("x.C1.D1.K1.a"))) == "x.C1.D1"
    assert value(paths.article_root(lit("x.PREAMBLE"))) is None
    assert value(paths.nearest_clause(lit("x.C1.D1.K12.a"))) == "x.C1.D1.K12"
    assert value(paths.path_prefixes(lit("a.b.c"), proper=True)) == ["a", "a.b"]
    assert value(paths.path_is_descendant(lit("x.D11"), lit("x.D1"))) is False
    loc = value(paths.path_location(lit("1.C2.TM3.D4.K5.dd")))
    assert loc["location"] == "Chương 2 > Tiểu mục 3 > Điều 4 > Khoản 5 > Điểm dd" and loc["section"] == "Tiểu mục 3"
    assert value(paths.title_to_path(lit("Điểm b, Khoản 1, Điều 177, Phần Thứ Năm"))) == "P5.D177.K1.b"
    assert value(paths.title_to_path(lit("Chương XII, Phần Thứ Nhất"))) == "P1.C12"
    anc = value(paths.resolve_ancestors(lit("x.P1.C2.M3.D4.K1")))
    assert (anc["part"], anc["section"], anc["sub_section"]) == ("x.P1", "x.P1.C2.M3", None)


def test_labels(value):
    none = F.lit(None).cast("string")
    norm = lambda f, s, c: value(status.normalize_effect_label(F.lit(f) if f else none, F.lit(s) if s else none, F.lit(c) if c else none))
    assert norm(None, None, "CHL") == "Còn hiệu lực"
    assert norm("đã bãi bỏ toàn phần", None, None) == "Hết hiệu lực toàn bộ"
    assert norm("x", "Hết hiệu lực 1 phần", None) == "Hết hiệu lực một phần"
    assert norm(None, None, None) == "Chưa xác định"
    for label, want in (("Ngưng hiệu lực", 2), ("Ngưng hiệu lực một phần", 4), ("Có hiệu lực một phần", 5)):
        assert value(status.label_to_status(F.lit(label))) == want


def test_effect_quirk_past_start_revives_label(value):
    d = lambda s: F.lit(s).cast("date")
    got = value(status.insert_status(F.lit(2), F.lit(status.EXPIRED), d("2020-01-01"), d(None), "2024-01-01"))
    assert (got["status_flag"], got["eff_flag"]) == (1, status.IN_FORCE)
    kept = value(status.insert_status(F.lit(1), F.lit(status.SUSPENDED), d("2020-01-01"), d("2021-01-01"), "2024-01-01"))
    assert (kept["status_flag"], kept["eff_flag"]) == (2, status.SUSPENDED)
    future = value(status.insert_status(F.lit(1), F.lit(status.IN_FORCE), d("2030-01-01"), d(None), "2024-01-01"))
    assert future["status_flag"] == 3


def test_dates(value):
    day = lambda s: value(metadata.parse_local_date(F.lit(s)))
    assert day("Hà Nội, ngày 5 tháng 2 năm 2019") == dt.date(2019, 2, 5)
    assert day("ký 05/02/2019 tại") == dt.date(2019, 2, 5)
    assert day("2019-2-5") == dt.date(2019, 2, 5)
    assert day("31/2/2019") is None
    today = F.lit("2024-01-01").cast("date")
    assert value(metadata.parse_as_of(F.lit("15/07/26"), today)) == dt.date(2026, 7, 15)
    assert value(metadata.parse_as_of(F.lit("bậy"), today)) == dt.date(2024, 1, 1)


def test_effect_date_rules(value):
    issued = F.lit("2020-01-10").cast("date")
    eff = lambda s: value(metadata.effective_date(F.lit(s), issued))
    assert eff("Điều 9. Hiệu lực thi hành\n1. Luật này có hiệu lực thi hành từ ngày 01 tháng 7 năm 2020.") == dt.date(2020, 7, 1)
    assert eff("Quyết định này có hiệu lực kể từ ngày ký.") == dt.date(2020, 1, 10)
    assert eff("Thông tư có hiệu lực sau 45 ngày kể từ ngày ký.") == dt.date(2020, 2, 24)
    body = "Điều 9. Hiệu lực thi hành\n1. Luật có hiệu lực từ ngày 1/7/2020.\n2. Các văn bản sau đây hết hiệu lực kể từ ngày 1/8/2020."
    assert value(metadata.expiry_date(F.lit(body))) is None
    assert value(metadata.expiry_date(F.lit("Điều 9. Hiệu lực thi hành\n1. Luật này hết hiệu lực kể từ ngày 1/8/2021."))) == dt.date(2021, 8, 1)
    assert value(metadata.doc_type_from_title(F.lit("Bộ  luật Lao động"))) == "Bộ luật"
    assert value(metadata.slug(F.lit("Luật Đất đai (sửa đổi)"))) == "luat-dat-dai-sua-doi"


def refs(value, s):
    number = lambda v: v if v is None else int(v)
    found = value(references.spelled_out(references.internal_refs(F.lit(s))))
    return [(number(r["article"]), number(r["clause"]), r["point"], number(r["chapter"]), r["this_article"]) for r in found]


def test_internal_refs(value):
    got = refs(value, "quy định tại Điều 109, điểm a khoản 2 Điều 113 hoặc điểm đ khoản 2 Điều 299 của Bộ luật này.")
    assert got == [(109, None, None, None, False), (113, 2, "a", None, False), (299, 2, "dd", None, False)]
    assert [r[3] for r in refs(value, "tại Chương XIII và CHƯƠNG XXVI của Bộ luật này")] == [13, 26]
    assert [r[0] for r in refs(value, "các điều từ Điều 73 đến Điều 70 của Bộ luật này")] == [70, 71, 72, 73]
    assert [r[0] for r in refs(value, "các điều 123, 134 và 141")] == [123, 134, 141]
    assert refs(value, "khoản 1 Điều này")[0][1:] == (1, None, None, True)
    assert refs(value, "theo Điều 5 của Luật Doanh nghiệp số 59/2020/QH14.") == []
    assert [r[0] for r in refs(value, "của Luật thi hành án hình sự số 41/2019/QH14 và Điều 56 của Bộ luật này.")] == [56]


def test_long_numbers_and_ranges(spark):
    """Article numbers of 10, 19 and 30 digits, leading zeros, and a range of two billion."""
    long = "123456789012345678901234567890"
    nodes = [("Article", f"r.C1.D{n}", i) for i, n in enumerate(("1234567890", "123456789", "1234567890123456789", long, "7", "12", "3000000000"))]
    nodes = spark.createDataFrame([(lv, p, i) for lv, p, i in nodes] + [("Clause", "r.C1.D12.K3", 9)], "level string, path string, sort_order int")
    texts = [
        ("r.C1.D1.K1", "Xem Điều 123456789", {"r.C1.D123456789"}), ("r.C1.D1.K2", "Xem Điều 1234567890123456789", {"r.C1.D1234567890123456789"}),
        ("r.C1.D1.K3", f"Xem Điều {long}", {f"r.C1.D{long}"}), ("r.C1.D1.K4", "khoản 3 Điều 0012", {"r.C1.D12.K3"}), ("r.C1.D1.K5", "Xem Điều 99", {"r.D99"}),
        ("r.C1.D1.K6", "các điều từ 10 đến 2000000000", {"r.C1.D12", "r.C1.D123456789", "r.C1.D1234567890"}),
        ("r.C1.D3000000000.K1", "khoản 5 Điều này", {"r.C1.D3000000000.K5"}),
    ]
    chunks = spark.createDataFrame([(p, "body", x) for p, x, _ in texts], "path string, chunk_type string, chunk_text string")
    found = {}
    for r in relations.path_relations(chunks, nodes).collect():
        found.setdefault(r["source_path"], set()).add(r["target_path"])
    assert found == {p: want for p, _, want in texts}


def test_fallback_labels_are_unique(spark):
    """Siblings whose ids share ten characters get different labels."""
    rows = [("s", 1, "Article", "Điều 1. A", "n1"), ("s", 2, "Article", "no number", "abcdefghij1"), ("s", 3, "Article", "none", "abcdefghij2"), ("t", 4, "Article", "none", "abcdefghij3"), ("s", 5, "X", "x", "y")]
    got = tree.allocate_tokens(spark.createDataFrame(rows, "scope string, pos long, level string, title string, node_id string")).collect()
    assert {r["pos"]: r["token"] for r in got} == {1: "D1", 2: "D_abcdefghij", 3: "D_abcdefghij_2", 4: "D_abcdefghij", 5: None}


def test_amendment_types(value):
    kind = lambda v: value(relations.amendment_type(F.lit(v).cast("string")))
    assert [kind("1"), kind("10"), kind("99"), kind(None)] == ["bai_bo", "sua_doi", "loai_99", "sua_doi"]
    assert value(relations.number_in_title(F.lit("Luật Tư pháp số 59/2024/QH15"))) == "59/2024/QH15"


@pytest.mark.parametrize(("title", "yes"), [
    ("Điều 53. Hiệu lực thi hành", True), ("Điều 10. Tổ chức thực hiện", True), ("Điều 5. Hiệu lực của Bộ luật hình sự", False),
    ("Điều 60. Thời hiệu thi hành bản án", False), ("ĐIỀU KHOẢN THI HÀNH", False), ("có hiệu lực thi hành từ ngày", False),
])
def test_effectivity_title(value, title, yes):
    assert value(text.is_effectivity_title(F.lit(title))) is yes


def test_split_text_overlap_of_every_level():
    parts = text.split_text("aaa bbb ccc ddd", size=7, overlap=2)
    # every level of separators adds the overlap once more
    assert parts == ["aaa bbb", "bb" * 4 + "ccc ddd"]
    assert text.split_text("", 5, 1) == [] and text.split_text("A" * 12, 5, 0) == ["AAAAA", "AAAAA", "AA"]


def test_citations_from_text(value):
    raw = "20/2023/TT-BCT: Phải có sự đồng ý của NLĐ. 12/2022/TT-BCT: Quy định khác. Nghị định 145/2020/NĐ-CP: Giới hạn."
    got = value(citations.citations_from_text(F.lit(raw)))
    assert [c["title"] for c in got] == ["20/2023/TT-BCT", "12/2022/TT-BCT", "Nghị định 145/2020/NĐ-CP"]
    assert got[0]["summary"] == "Phải có sự đồng ý của NLĐ"
    assert value(citations.citations_from_text(F.lit("không rõ")))[0]["title"] == "Căn cứ pháp lý"
    assert value(text.strip_internal_refs(F.lit("[20/2023/TT-BCT | 163444:C2.D6]: Làm thêm"))) == "20/2023/TT-BCT: Làm thêm"


def test_deep_link(value):
    link = value(text.deep_link(F.lit("https://vbpl.vn/x?tabs=thuoc-tinh&id=1"), F.lit("el 1"), F.lit("q")))
    assert link == "https://vbpl.vn/x?id=1&tabs=toan-van#el%201"
    frag = value(text.deep_link(F.lit("https://vbpl.vn/x"), F.lit(None).cast("string"), F.lit("**Điều 1.** a")))
    assert frag.startswith("https://vbpl.vn/x?tabs=toan-van#:~:text=%C4%90i%E1%BB%81u%201")
    assert value(text.deep_link(F.lit("ftp://x/y"), F.lit("e"), F.lit("q"))) is None


def test_rank_and_scope(value):
    r = lambda t, s: value(rank.normative_rank(F.lit(t), F.lit(s)))
    assert r("Bộ luật", "x") > r("Luật", "x") > r("Nghị định", "x") > r("Thông tư", "x")
    assert r("Nghị định", "hướng dẫn Bộ luật Lao động") == 0.95
    assert value(rank.normative_rank(F.lit("Nghị định"), F.lit("hướng dẫn Bộ luật"), doc_type_first=True)) == 0.60
    bad = lambda law, c: value(scope.sector_mismatch(F.lit(law), F.lit(c)))
    assert bad("Thông tư về DẦU KHÍ trên biển", "Hợp đồng lập trình viên AI")
    assert not bad("Thông tư về dầu khí trên biển", "Kỹ sư giàn khoan dầu khí")
    assert not bad("Bộ luật Lao động", "bất kỳ")


def test_rewrite(value):
    assert value(rewrite.rewrite_query(F.lit("Các quyền của người lao động, là gì?"))) == "quyền người lao động là gì"
    q = value(rewrite.expand_topics(F.lit("Công ty đuổi việc tôi khi mang thai")))
    assert "cấm đơn phương chấm dứt" in q
    c = value(rewrite.rewrite_clause_query(F.lit("Lương"), F.lit("Lương"), F.lit("HỢP ĐỒNG LAO ĐỘNG Số: 2/2026/HĐLĐ")))
    assert c == "Hợp đồng lao động Lương"
    h = F.array(F.struct(F.lit("user").alias("role"), F.lit("mang thai bị sa thải theo Điều 4").alias("text")))
    follow = value(rewrite.resolve_followup(F.lit("đúng luật không?"), h))
    assert follow.startswith("Bộ luật Lao động mang thai thai sản") and "Điều 4 hợp đồng" in follow


def test_contract_fields(value):
    t = F.lit("HỢP ĐỒNG LAO ĐỘNG\nBên A: (NSDLĐ)\nCông ty: ACME\nMã số thuế: 0312345678\nĐịa chỉ: 1 Lê Lợi\nBên B: (NLĐ)\nHọ và tên: Bình\nCCCD số: 012345678901\nĐiều 1. x")
    p = value(contract.extract_parties(t))
    assert [(x["name"], x["role"]) for x in p] == [("ACME", "NSDLĐ"), ("Bình", "NLĐ")] and p[0]["tax_id"] == "0312345678"
    assert value(contract.contract_type(t)) == "Hợp đồng LAO ĐỘNG"


def test_sql_functions_equal_the_columns(spark):
    from provisio.functions import sql

    assert len(sql.register(spark)) == 6
    paths_ = [None, "", "12/2020/NĐ-CP", "a:b.C1", "a:", ":x", "x:..D1.K2", "r.C1.D12.K3", "D7", "r.D1x.K2", "d:D5 "]
    marks = [(s, w) for s in (None, 0, 1, 2, 3, 4, 5, 9) for w in (None, "", " Còn hiệu lực ", *status.LABEL_STATUS, "khác")]
    p = spark.createDataFrame([(x,) for x in paths_], "p string")
    by_sql = p.selectExpr("path_sanitize(p) a", "ref_to_path(p) b", "article_root(p) c").collect()
    c = F.col("p")
    assert by_sql == p.select(paths.path_sanitize(c).alias("a"), paths.ref_to_path(c).alias("b"), paths.article_root(c).alias("c")).collect()
    m = spark.createDataFrame(marks, "s int, w string")
    by_sql = m.selectExpr("status_to_label(s) a", "label_to_status(w) b", "is_partial_effect(s, w) c").collect()
    s, w = F.col("s"), F.col("w")
    assert by_sql == m.select(status.status_to_label(s).alias("a"), status.label_to_status(w).alias("b"), status.is_partial(s, w).alias("c")).collect()
