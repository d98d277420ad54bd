"""Findings of the fourth review."""

from __future__ import annotations

import inspect

import duckdb
from pyspark.sql import functions as F

from provisio.operators import citations, effect, retrieve, search, segment
from provisio.plans import catalog
from provisio.plans.projections import Tables
from tools.check import TABLES, compare

SMALL = "/root/testdata/sf0.001"


def test_long_document_numbers_are_represented(spark):
    """an old citation of a number of five digits, already found by its path, is not listed again."""
    chunk = ("R1.D12345.K1", "Luật", "12345/1997/NĐ-CP", "Điều 1. x", "https://x.example/a", "e1")
    chunks = spark.createDataFrame([chunk], "path string, title string, doc_num string, chunk_text string, source_url string, source_element_id string")
    docs = spark.createDataFrame([("12345/1997/NĐ-CP", "https://x.example/a"), ("23456/1998/NĐ-CP", "https://x.example/b")], "doc_num string, source_url string")
    cited = [("tên", "", "12345/1997/NĐ-CP", None), ("tên", "", "23456/1998/NĐ-cp", None), ("tên", "", "9/1998/QĐ", None)]
    findings = spark.createDataFrame(
        [("f", "theo [Luật | R1.D12345.K1]", cited)],
        "finding_id string, legal_basis string, citations array<struct<title:string,summary:string,doc_number:string,evidence_path:string>>")
    got = sorted((r["doc_number"], r["evidence_path"], r["source_url"]) for r in citations.backfill_risk_citations(findings, chunks, docs).collect())
    assert got == [("12345/1997/NĐ-CP", "R1.D12345.K1", "https://x.example/a"), ("23456/1998/NĐ-CP", None, "https://x.example/b"), ("9/1998/QĐ", None, None)]


def test_contracts_follow_the_sql_on_odd_texts(spark, tmp_path):
    """contracts without a line, lines that begin with blanks, other line ends and lines of over a million characters."""
    odd = [None, "", " ", " \n\n ", "a\n b\nc", "a\n\xa0b\n\t\n\u3000\nc", "a\rb\u2028c\x85d\r\ne", ("x" * 600_000 + " ") * 2 + "\nz"]
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if t == "documents":
            held = df.limit(len(odd)).collect()
            df = spark.createDataFrame([{**r.asDict(), "doc_id": i, "text": x} for i, (r, x) in enumerate(zip(held, odd))], df.schema)
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "contract_ingest"
    text, ok = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))
    assert ok and text == "ok 4", text


def test_only_line_feeds_end_a_line(spark):
    """a heading starts after a line feed, not after other line separators."""
    texts = spark.createDataFrame([("a", "Điều 1. x\rĐiều 2. y\nĐiều 3. z\u2028Điều 4. u")], "contract_id string, text string")
    got = [r["clause_number"] for r in segment.chunk_by_heading(texts, r"^Điều (\d+)").orderBy("chunk_index").collect()]
    assert got == ["1", "3"]


def test_fuzzy_keys_are_choices_of_the_rarest_grams(spark):
    """a set shows the choices of its rarest grams once for all other sizes, and candidates are cut by their signs."""
    rows = spark.createDataFrame([(1, [7, 5, 9, 3], 4, 0), (2, [9, 5, 7, 8], 4, 1), (3, [3], 0, 1)], "id long, grams array<long>, deep int, flat int")
    got = {}
    for r in search._probes(rows, [5, 7], 3).collect():
        got.setdefault(r["id"], set()).add(r["probe"])
    assert [len(got[i]) for i in (1, 2, 3)] == [4, 5, 1]
    assert len(got[1] & got[2]) == 1 and not got[3] & (got[1] | got[2])  # 5, 7 and 9 in any order
    asked, stored = spark.createDataFrame([(1, "1234/1997/A")], "query_id int, text string"), spark.createDataFrame([(2, "1235/1997/A"), (3, "1234/1997/A"), (4, None)], "doc_id int, doc_num string")
    out = search.fuzzy_doc_search(asked, stored, 5, 0.75)
    assert [r["doc_id"] for r in out.collect()] == [3]
    assert "bit_count" in out._jdf.queryExecution().optimizedPlan().toString()


def _counted(spark, df, column):
    """``df`` and how often a row of it was worked out."""
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda v: (seen.add(1), v)[1], df.schema[column].dataType).asNondeterministic()
    return df.withColumn(column, note(column)), seen


def test_sweep_works_its_rows_out_once(spark):
    """F8: depth, cuts, what is carried and the sweep itself read stored rows; a line meets both document joins after one shuffle."""
    nodes, seen = _counted(spark, spark.createDataFrame([("R1", 1), ("R1.C1", 2), ("R1.C1.D1", 1)], "path string, status_flag int"), "status_flag")
    chunks = spark.createDataFrame([("R1.C1.D1.K1", 1), ("R1.C1.K9", 1), ("X.K1", 5)], "path string, status_flag int")
    got = {r["path"]: r["is_effective"] for r in effect.chunk_effective_sweep(chunks, nodes).collect()}
    assert got == {"R1.C1.D1.K1": True, "R1.C1.K9": False, "X.K1": True} and seen.value == 3
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    kept = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        plan = Tables(spark, SMALL).chunks()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning(doc_id") == 3


def test_expansion_works_nodes_out_once(spark):
    """the joins of the expansion read stored nodes."""
    nodes, seen = _counted(spark, spark.createDataFrame(
        [("R1", None, "Part"), ("R1.D1", "R1", "Article"), ("R1.D1.K1", "R1.D1", "Clause"), ("R1.D1.K2", "R1.D1", "Clause")], "path string, parent_path string, level string"), "level")
    seeds = spark.createDataFrame([("q", "R1.D1.K1", "1")], "query_id string, path string, doc_id string")
    edges = spark.createDataFrame([("1", "2", "dan_chieu")], "from_doc_id string, to_doc_id string, relation_type string")
    out = retrieve.expand_seeds(seeds, nodes.select("path"), nodes, edges, "graph").collect()
    assert {(r["kind"], r["key"]) for r in out} == {("ancestor", "R1"), ("ancestor", "R1.D1"), ("related", "2")} and seen.value == 4


def test_vectors_are_stored_once_for_all_tiers(spark):
    """several sets of queries scan the same stored vectors, with the result of the whole search."""
    corpus = spark.createDataFrame([(f"p{i}", [float(i), 1.0]) for i in range(9)], "path string, embedding array<double>")
    held = search.stored(search.by_vector(corpus, 3))
    for vector in ([1.0, 0.0], [0.0, 2.0]):
        q = spark.createDataFrame([("q", vector)], "query_id string, embedding array<double>")
        assert sorted(search.nearest(q, held, 3).collect()) == sorted(search.knn(q, corpus, 3).collect())
    assert inspect.getsource(retrieve.seed_fallback).count("by_vector") == 1
