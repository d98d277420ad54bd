"""Findings of the third review."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from provisio.functions import metadata
from provisio.operators import citations, search, segment
from provisio.plans import catalog
from tools.check import TABLES, compare

SMALL = "/root/testdata/sf0.001"


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """a table can be one file or a folder of files."""
    for name in ("documents", "events"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_ingest", "stream_memory"):
        got, want = (sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect())) for folder in (str(tmp_path), SMALL))
        assert got == want and got


def test_second_citation_follows_the_sql(spark, tmp_path):
    """finding 9999 cites one document only, as in the SQL."""
    ids = (9998, 9999, 10000)
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        key = {"documents": "doc_id", "orders": "o_orderkey"}.get(t)
        if key:
            held = df.orderBy(key).limit(3).collect()
            df = spark.createDataFrame([{**r.asDict(), key: i} for r, i in zip(held, ids)], df.schema)
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "backfill_risk_citations"
    text, ok = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))
    assert ok and not text.startswith("ok 0"), text


def test_preamble_ends_before_the_line_break(spark):
    """F8: the break before the first heading neither counts nor stays."""
    docs = spark.createDataFrame([("a", "x" * 40 + "\n## Điều 1. M\n"), ("b", "x" * 41 + "  \n## Điều 1. M\n"), ("c", "y" * 12_100)], "doc_id string, body string")
    got = {r["doc_id"]: r["chunk_text"] for r in segment.preamble_chunks(docs).collect()}
    assert got == {"b": "x" * 41, "c": "y" * 12_000}


def test_text_search_writes_no_pairs(spark):
    """Texts are read once and grouped nowhere by query; equal to the pairwise search, ties and half-way scores included."""
    words = ["a", "b", "c", "d"]
    rows = [(f"p{i:03d}", " ".join(words[(i * k) % 4] for k in range(i % 9)) + (" a" + " x" * 126 + " b" if i % 50 == 0 else "")) for i in range(300)]
    corpus = spark.createDataFrame([*rows, ("none", None)], "path string, chunk_text string").repartition(5)
    asked = [(f"q{i}", t) for i, t in enumerate(["a b", "B a", "a", "c d a", "zzz a", "", None, "x b"])]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    want = search._merge(search.fts_matches(queries, corpus), 12)
    got = search.fts(queries, corpus, 12)
    listed = lambda df: sorted(map(tuple, df.select("query_id", "path", "score", "rank0").collect()))
    assert listed(got) == listed(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Join") == 1


def test_equal_vectors_are_scored_once(spark):
    """a vector that many chunks share is one row with the first n of them."""
    kinds = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]
    corpus = spark.createDataFrame([(f"p{i:03d}", kinds[i % 3]) for i in range(300)] + [("none", None)], "path string, embedding array<double>")
    once = search.by_vector(corpus, 4).collect()
    assert sorted(len(r["paths"]) for r in once) == [4, 4, 4]
    queries = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 3.0])], "query_id string, embedding array<double>")
    want = sorted([("a", f"p{3 * i:03d}", 1.0, i) for i in range(4)] + [("b", f"p{3 * i + 2:03d}", 1.0, i) for i in range(4)])
    centers = search.train_cells(corpus, 2)
    for got in (search.knn(queries, corpus, 4), search.knn_blocks(queries, corpus, 4, block=1, cell_rows=2), search.knn_ann(queries, corpus, 4, centers, probes=2)):
        assert sorted((r["query_id"], r["path"], r["score"], r["rank0"]) for r in got.collect()) == want


def test_rules_bind_what_they_repeat(spark):
    """a date rule names its costly source once, however many patterns read it."""
    plan = spark.range(3).select(F.col("id").cast("string").alias("text")).select(metadata.parse_local_date(F.regexp_replace("text", "costly", "source")).alias("d"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("costly") == 1
    text = "Điều 1. " + "A " * 300 + "\n\nĐiều 2. Hiệu lực\n1. Có hiệu lực.\n2. Văn bản hết hiệu lực kể từ ngày 3/4/2001."
    days = spark.createDataFrame([(text,), (None,), ("Điều 2. Hiệu lực\n2. hết hiệu lực",)], "text string").select(metadata.expiry_date(F.col("text")).cast("string").alias("d"))
    assert [r["d"] for r in days.collect()] == ["2001-04-03", None, None]


def test_citations_bind_what_they_repeat(spark):
    """the cleaned basis is named once."""
    plan = spark.range(3).select(F.col("id").cast("string").alias("text")).select(citations.citations_from_text(F.regexp_replace("text", "costly", "source")).alias("d"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("costly") == 1
