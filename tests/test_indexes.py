"""Stored indexes: what they read, what they find, and how much of the exact result."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.operators import indexes, search
from provisio.plans.projections import Tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Clustered vectors, one cluster with half of them, and the folder of their index."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    kind = np.where(rng.random(6000) < 0.5, 0, rng.integers(0, 12, 6000))
    rows = [(f"p{i:05d}", [float(x) for x in middles[k] + 0.4 * rng.normal(size=16)]) for i, k in enumerate(kind)]
    rows += [("zero", [0.0] * 16), ("none", None)]
    corpus = spark.createDataFrame(rows, "path string, embedding array<double>").repartition(6).cache()
    folder = str(tmp_path_factory.mktemp("index"))
    indexes.write_vector_index(corpus, folder, n_cells=24)
    queries = corpus.filter("path like 'p%00'").select(F.col("path").alias("query_id"), "embedding")
    return corpus, queries, folder


def listed(df):
    return sorted((r["query_id"], r["path"], r["score"], r["rank0"]) for r in df.collect())


def test_every_row_is_stored(spark, stored):
    corpus, _, folder = stored
    assert spark.read.parquet(f"{folder}/vectors").select("path").distinct().count() == corpus.filter("embedding is not null").count()


def test_all_cells_are_exact(stored):
    corpus, queries, folder = stored
    want = listed(search.knn(queries, corpus, 10))
    assert listed(indexes.knn_index(queries, folder, 10, 24, group_rows=300, block=16)) == want


def test_recall_and_files(stored):
    """A sixth of the cells finds at least 0.9 of the exact result; folders of other cells are not read."""
    corpus, queries, folder = stored
    exact = search.knn(queries, corpus, 10)
    assert indexes.recall(indexes.knn_index(queries, folder, 10, 4), exact).first()[0] >= 0.9
    one = indexes.probes(queries.limit(1), folder, 2)
    read = indexes.probed_vectors(one, folder)
    cells = {r["cell"] for r in one.collect()}
    assert {int(f.split("cell=")[1].split("/")[0]) for f in read.inputFiles()} >= cells
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() == len(cells) < 24


def test_recall_on_the_tables(spark):
    """The registered query's two fifths of the cells, measured on the text tables."""
    t = Tables(spark, "/root/testdata/sf0.01")
    from provisio.plans.catalog import QUERIES

    exact = QUERIES["knn_legal"](spark, t.folder)
    share = indexes.recall(QUERIES["knn_index"](spark, t.folder), exact).first()[0]
    print("recall", share)
    assert share >= 0.9


def test_empty_vectors(spark, tmp_path):
    none = spark.createDataFrame([("a", None)], "path string, embedding array<double>")
    indexes.write_vector_index(none, str(tmp_path))
    q = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    assert indexes.knn_index(q, str(tmp_path), 3).count() == 0
    indexes.write_text_index(spark.createDataFrame([("a", None)], "path string, chunk_text string"), str(tmp_path))
    assert indexes.fts_index(spark.createDataFrame([("q", "a b")], "query_id string, text string"), str(tmp_path), 3).count() == 0


def test_text_index_equals_search(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = ["the", "a", "luật", "Điều", "x1", "rare", "of"]
    rows = [(f"c{i}", " ".join(rng.choice(words, rng.integers(0, 25), p=[0.4, 0.25, 0.1, 0.1, 0.05, 0.02, 0.08]))) for i in range(400)] + [("none", None)]
    corpus = spark.createDataFrame(rows, "path string, chunk_text string").repartition(4)
    asked = [("q1", "the a"), ("q2", "rare THE the"), ("q3", "missing the"), ("q4", ""), ("q5", "luật điều of a"), ("q6", None), ("q7", "x1")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    indexes.write_text_index(corpus, str(tmp_path), 8)
    want = listed(search.fts(queries, corpus, 15))
    assert want and listed(indexes.fts_index(queries, str(tmp_path), 15, 8)) == want
    plan = indexes.fts_index(queries, str(tmp_path), 15, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_text" not in plan
