"""A crawled folder, hand-made, through discovery, tree, chunks and relations."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from provisio.operators import ingest, tree
from provisio.sources import folders

BODY = """**NGHỊ ĐỊNH**
*Căn cứ Luật Tổ chức Chính phủ ngày 19 tháng 6 năm 2015;*

## **Điều 1. Phạm vi điều chỉnh**
<!-- article_id: d1 -->

1. Nghị định này quy định về: <!-- clause_id: d1k1 -->

a) Xử phạt vi phạm về trật tự;

b) Mức trừ điểm theo khoản 2 Điều này và Điều 53.

2. Các hành vi khác áp dụng nghị định chuyên ngành. <!-- clause_id: d1k2 -->

## **Điều 53. Hiệu lực thi hành**
<!-- article_id: d53 -->

1. Nghị định này có hiệu lực từ ngày 01 tháng 01 năm 2025. <!-- clause_id: d53k1 -->

**Phụ lục I**

| Hành vi | Mức phạt |
| --- | --- |
| Không đội mũ bảo hiểm | 400.000 |
| Vượt đèn đỏ | 6.000.000 |

Nơi nhận:
- Lưu: VT.
"""


def node(i, title, level, *children):
    return {"id": i, "title": title, "level": level, "isLeaf": not children, "children": list(children)}


TOC = [
    node("ch1", "Chương I", "Chapter",
         node("d1", "Điều 1", "Article",
              node("d1k1", "Khoản 1", "Clause", node("pa", "Điểm a", "Point"), node("pb", "Điểm b", "Point")), node("d1k2", "Khoản 2", "Clause")),
         node("w", "Nhóm lạ", "Strange", node("d53", "Điều 53", "Article", node("d53k1", "Khoản 1", "Clause")))),
    node("pl", "Phụ lục I", "Appendix", node("n1", "Nhóm 1", "Group")),
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    doc = base / "nd-168"
    doc.mkdir()
    (doc / "thuoc_tinh.json").write_text(json.dumps({
        "doc_id": "f-168", "doc_num": "168/2024/NĐ-CP", "title": "Nghị định 168", "doc_type": "Nghị định", "eff_from": "2025-01-01T00:00:00",
        "eff_status_code": "CHL", "signers": [{"name": " A ", "title": "B"}]}, ensure_ascii=False))
    (doc / "muc_luc.json").write_text(json.dumps(TOC, ensure_ascii=False))
    (doc / "van_ban.md").write_text(BODY)
    (doc / "luoc_do.json").write_text(json.dumps({
        "doc_id": "f-168", "relations": {"can_cu_ban_hanh": {"count": 1, "documents": [{"doc_id": "70821", "doc_num": "76/2015/QH13"}]}},
        "relations_incoming": {"van_ban_bi_bai_bo": {"count": 1, "documents": [{"doc_id": "185666", "title": "NĐ 336"}]}}}))
    inner = doc / "inner"
    inner.mkdir()
    hidden = base / ".x"
    hidden.mkdir()
    for d in (inner, hidden):
        for name in folders.REQUIRED:
            (d / name).write_text("{}")
    (base / "empty").mkdir()
    (base / "empty" / "van_ban.md").write_text("x")
    return str(base)


def test_discover_outermost_only(spark, root):
    assert [r["folder"] for r in folders.discover_doc_folders(spark, root).collect()] == ["nd-168"]


def test_corpus_tables(spark, root):
    t = ingest.corpus_tables(spark, root, "2025-06-01")
    docs = {r["doc_id"]: r for r in t["documents"].collect()}
    assert docs["f-168"]["status_flag"] == 1 and docs["f-168"]["signer_name"] == "A"
    assert docs["70821"]["doc_num"] == "76/2015/QH13" and docs["185666"]["title"] == "NĐ 336" and docs["185666"]["status_flag"] == 0
    assert {r["path"] for r in t["nodes"].collect()} >= {"168_2024_N__CP.C1.D1.K1.a", "168_2024_N__CP.C1.D1.K2", "168_2024_N__CP.C1.D53.K1"}
    chunks = {r["path"]: r for r in t["chunks"].collect()}
    a = chunks["f_168.C1.D1.K1.a"]["chunk_text"]
    assert a.startswith("Điều 1. Phạm vi điều chỉnh\n1. Nghị định này quy định về:") and a.endswith("a) Xử phạt vi phạm về trật tự;")
    assert "f_168.C1.D1.K1" not in chunks and "chuyên ngành" in chunks["f_168.C1.D1.K2"]["chunk_text"]
    assert chunks["f_168.C1.D53.K1"]["chunk_type"] == "effectivity" and chunks["f_168.PREAMBLE"]["chunk_type"] == "preamble"
    rows = sorted((p, c["chunk_text"]) for p, c in chunks.items() if c["chunk_type"] == "appendix")
    assert rows[0] == ("f_168.PL1.N1", "Phụ lục I\n| Hành vi | Mức phạt |\n| Không đội mũ bảo hiểm | 400.000 |") or len(rows) == 2
    edges = {(r["from_doc_id"], r["to_doc_id"], r["relation_type"]) for r in t["doc_edges"].collect()}
    assert edges == {("f-168", "70821", "can_cu_ban_hanh"), ("185666", "f-168", "van_ban_bi_bai_bo")}
    path_edges = {(r["source_path"], r["target_path"]) for r in t["path_edges"].collect()}
    assert ("f_168.C1.D1.K1.b", "f_168.C1.D1.K2") in path_edges and ("f_168.C1.D1.K1.b", "f_168.C1.D53") in path_edges


def test_tree_tokens_collide_to_ids(spark):
    toc = json.dumps([node("a1", "Điều 1", "Article"), node("b-2", "Điều 1", "Article"), node("c3", "Điều", "Article"), node("z", "Nhóm", "Group")])
    got = {r["node_id"]: r["path"] for r in tree.flatten_tree(spark.createDataFrame([("d", toc)], "doc_id string, toc string")).collect()}
    assert got == {"a1": "D1", "b-2": "D_b2", "c3": "D_c3", "z": "N1"}


def test_deep_tree_is_not_cut(spark):
    deep = node("n0", "Chương 1", "Chapter")
    for i in range(1, 40):
        deep = node(f"n{i}", f"Chương {i + 1}", "Chapter", deep)
    rows = tree.flatten_tree(spark.createDataFrame([("d", json.dumps([deep]))], "doc_id string, toc string"))
    assert rows.agg(F.max(F.size(F.split("path", r"\.")))).collect()[0][0] == 40


def test_contract_without_text_is_kept(spark):
    files = spark.createDataFrame([("a", "u", "Điều 1. x\nĐiều 2. y"), ("b", "u", " "), ("c", "u", "A" * 2000)], "contract_id string, user_id string, text string")
    contracts, chunks = ingest.contract_ingest(files)
    got = {r["contract_id"]: (r["status"], r["chunk_count"]) for r in contracts.collect()}
    assert got == {"a": ("parsed", 2), "b": ("uploaded", 0), "c": ("parsed", 2)}
    assert [r["clause_number"] for r in chunks.filter("contract_id = 'a'").orderBy("chunk_index").collect()] == ["1", "2"]


def test_sinks_and_joined_blocks(spark, root, tmp_path):
    """Partitions that are touched are replaced, others stay; exports have a header; blocks of a page join again; folders give node rows."""
    from pyspark.sql import functions as F

    from provisio.functions import paths
    from provisio.operators import embed, upsert
    from provisio.sources import exports, html

    at = str(tmp_path / "parts")
    for rows in ([("a", 1), ("a", 2), ("b", 3)], [("a", 9)]):
        upsert.write_partitions(spark.createDataFrame(rows, "k string, v int"), at, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(at).collect()} == {("a", 9), ("b", 3)}
    exports.write_csv(spark.createDataFrame([("x,y", 1)], "t string, n int"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()] == [("x,y", "1")]
    blocks = spark.createDataFrame([(1, 2, "clause", "c2"), (1, 0, "article", "## A"), (1, 1, "clause", "c1"), (1, 3, "text", "end")], "page_id long, pos int, kind string, markdown string")
    assert html.blocks_to_markdown(blocks).first()["markdown"] == "## A\n\nc1\nc2\n\nend\n"
    nodes = folders.artifact_nodes(folders.read_doc_artifacts(spark, root, folders.discover_doc_folders(spark, root)))
    assert "168_2024_N__CP.C1.D1.K2" in {r["path"] for r in nodes.collect()}
    titles = spark.createDataFrame([(" Điều 1 ", "r.D1", 4), ("", "r.D2", 5), (None, "", 6)], "l string, p string, n int")
    assert [r[0] for r in titles.select(paths.node_title(F.col("l"), F.col("p"), F.col("n"))).collect()] == ["Điều 1", "D2", "6"]
    texts = spark.createDataFrame([("1", "aa b c"), ("2", None)], "id string, text string")
    unit = {r["id"]: r["embedding"] for r in embed.embed_batches(texts, lambda b: [[len(t), 0.0] for t in b], max_tokens=2).collect()}
    assert unit == {"1": [1.0, 0.0], "2": [0.0, 0.0]}
