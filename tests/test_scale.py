"""Hot groups, exactness against brute force, plans without pair blow-ups."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from provisio.operators import effect, memory, retrieve, search, skew, upsert
from provisio.plans import catalog
from provisio.plans.projections import AS_OF
from provisio.streaming import jobs


def hot(spark, n=3000):
    """One key holds a third of all rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), ((F.col("id") * 7919) % n).alias("pos"), (F.col("id") % 11).alias("v"))


def _numbered(df, most):
    return skew.row_number_in_blocks(df, ["k"], F.col("pos"), ["pos"], "out", most)


def _next(df, most):
    return skew.next_in_blocks(df, ["k"], F.col("pos"), ["pos"], "v", "out", most)


def _summed(df, most):
    return skew.running_in_blocks(df, ["k"], F.col("pos"), ["pos"], F.col("v"), "sum", "out", most=most)


def _summed_down(df, most):
    return skew.running_in_blocks(df, ["k"], F.col("pos"), ["pos"], F.col("v"), "sum", "out", descending=True, most=most)


def _last(df, most):
    return skew.running_in_blocks(df, ["k"], F.col("pos"), ["pos"], F.when(F.col("v") > 8, F.col("v")), "last", "out", most=most)


def _up():
    return Window.partitionBy("k").orderBy("pos")


PLAIN = {
    _numbered: lambda: F.row_number().over(_up()), _next: lambda: F.lead("v").over(_up()),
    _summed: lambda: F.sum("v").over(_up().rowsBetween(Window.unboundedPreceding, 0)),
    _summed_down: lambda: F.sum("v").over(Window.partitionBy("k").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)),
    _last: lambda: F.last(F.when(F.col("v") > 8, F.col("v")), ignorenulls=True).over(_up().rowsBetween(Window.unboundedPreceding, 0)),
}


@pytest.mark.parametrize("fn", [_numbered, _next, _summed, _summed_down, _last])
def test_block_windows_equal_plain_windows(spark, fn):
    """One hot key with sparse places, a null key, and the plain window as the measure."""
    df = hot(spark).withColumn("k", F.nullif("k", F.lit(7))).withColumn("pos", F.col("pos") * 1_000_003)
    want = sorted(map(repr, df.withColumn("out", PLAIN[fn]()).select("k", "pos", "v", "out").collect()))
    for most in (500, 1 << 20):
        assert sorted(map(repr, fn(df, most).select("k", "pos", "v", "out").collect())) == want


def test_hot_groups_of_sparse_places_make_few_blocks(spark):
    df = hot(spark).withColumn("pos", F.col("pos") * 1_000_003)
    cut = skew._blocked(df, ["k"], F.col("pos"), 500)
    sizes = cut.filter("k = 0").groupBy("__b").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 20 and sizes[1] <= skew.BLOCKS
    assert cut.filter("k <> 0 and __b is not null").isEmpty() and skew._blocked(df, ["k"], F.col("pos"), 5000) is None


def test_top_k_is_pruned_before_the_shuffle(spark):
    plan = skew.top_k(hot(spark), ["k"], [F.asc("pos")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_knn_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 8)).astype(np.float32)
    vecs[100:200] = vecs[0]  # a third of all rows are copies
    corpus = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(vecs)], "path string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(str(i), vecs[i].tolist()) for i in (0, 5, 250)], "query_id string, embedding array<float>")
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    want = set()
    for i in (0, 5, 250):
        s = np.round(unit @ unit[i], 6)
        for r, j in enumerate(sorted(range(300), key=lambda j: (-s[j], f"p{j:03d}"))[:7]):
            want.add((str(i), f"p{j:03d}", r))
    for got in (search.knn(q, corpus, 7), search.knn_blocks(q, corpus, 7, block=2, cell_rows=50)):
        assert {(r["query_id"], r["path"], r["rank0"]) for r in got.collect()} == want
    assert search.knn(q.filter("1 = 0"), corpus, 3).count() == 0
    many = spark.createDataFrame([(str(i), vecs[i % 300].tolist()) for i in range(5000)], "query_id string, embedding array<float>")
    small = corpus.limit(40)
    whole = {tuple(r) for r in search.knn(many, small, 2, block=10_000).collect()}
    assert {tuple(r) for r in search.knn(many, small, 2, block=2000).collect()} == whole and len(whole) == 10_000
    centers = search.train_cells(small, 3)
    assert {tuple(r) for r in search.knn_ann(many, small, 2, centers, probes=3, block=2000).collect()} == whole


def test_ann_recall(spark, tables):
    pool = search.searchable(tables.chunks())
    exact = {(r["query_id"], r["path"]) for r in search.knn(tables.queries(), pool, 10).collect()}
    centers = search.train_cells(pool, 8)
    full = {(r["query_id"], r["path"]) for r in search.knn_ann(tables.queries(), pool, 10, centers, probes=8).collect()}
    some = {(r["query_id"], r["path"]) for r in search.knn_ann(tables.queries(), pool, 10, centers, probes=3).collect()}
    assert full == exact and len(some & exact) / len(exact) > 0.4


def test_fts_common_and_rare_words(spark):
    rows = [(f"p{i}", "the common words" if i % 3 else "the common rare words the rare") for i in range(30)] + [("x", "words rare the common")]
    corpus = spark.createDataFrame(rows, "path string, chunk_text string")
    q = spark.createDataFrame([("1", "rare The"), ("2", "absent the"), ("3", "!!")], "query_id string, text string")
    got = search.fts_matches(q, corpus).collect()
    assert {r["query_id"] for r in got} == {"1"} and len(got) == 11
    by = {r["path"]: r["score"] for r in got}
    assert by["x"] == 0.5 and by["p0"] == round(1 / 3 + 1 / 3 + 1 / 2, 6)


def test_no_cross_join_in_search_plans(spark):
    for name in ("hybrid_search", "fts_legal", "expand_seeds_path", "chunk_effective", "path_is_descendant", "graph_related_2hop"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_cascade_is_idempotent(tables):
    n = tables.nodes()
    once = effect.refresh_hierarchy_status(n, AS_OF)
    twice = effect.refresh_hierarchy_status(once, AS_OF)
    cols = ["path", "status_flag"]
    assert once.select(cols).exceptAll(twice.select(cols)).isEmpty()


def test_on_change_expires_partly_expired_targets(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 4), ("c", 1)], "doc_id string, status_flag int").selectExpr(
        "*", "cast(null as string) eff_flag", "cast(null as date) eff_from", "cast(null as date) eff_to")
    edges = spark.createDataFrame([("a", "b", "thay_the"), ("a", "c", "sua_doi_bo_sung")], "from_doc_id string, to_doc_id string, relation_type string")
    live = {r["doc_id"]: r["status_flag"] for r in effect.cascade_document_status(docs, edges, docs.filter("doc_id = 'a'"), "2024-01-01").collect()}
    assert live == {"a": 1, "b": 2, "c": 4}
    batch = {r["doc_id"]: r["new_flag"] for r in effect.refresh_document_status(docs, edges, "2024-01-01").collect()}
    assert batch == {"c": 4}


def test_qa_pairs_rules(spark):
    rows = [(0, "system", "s"), (1, "user", "q1"), (2, "user", "q2"), (3, "system", "x"), (4, "assistant", "a2"), (5, "assistant", "more"), (6, "user", "open")]
    m = spark.createDataFrame([(1, t, r, x) for t, r, x in rows], "conv_id long, turn long, role string, text string")
    got = memory.qa_pairs(m).collect()
    assert [(r["question"], r["answer"]) for r in got] == [("q2", "a2")]
    assert [r["turn"] for r in memory.trim_history(m, limit=3).orderBy("turn").collect()] == [4, 5, 6]


def test_fuzzy_search_equals_brute_force(spark, tables):
    def grams(text):
        padded = "  " + "  ".join(re.findall(r"[^\W_]+", text.lower())) + " "
        return {padded[i:i + 3] for i in range(len(padded) - 2)}

    docs = {r["doc_id"]: grams(r["doc_num"]) for r in tables.documents().collect()}
    want = set()
    for (key,) in tables.raw("customer").select("c_custkey").collect():
        q = grams(f"{key}/1997/NĐ-CP")
        found = [(-round(len(q & d) / len(q | d), 6), i) for i, d in docs.items() if len(q & d) / len(q | d) >= 0.75 - 1e-7]
        want |= {(key, i, -s) for s, i in sorted(found)[:5]}
    got = catalog.QUERIES["fuzzy_doc_search"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["query_id"], r["doc_id"], r["similarity"]) for r in got} == want


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    """Four files in order; a row of a closed window comes too late (Spark drops it one batch after the window closed)."""
    source = tmp_path / "in"
    rows = [[("2024-01-01 00:10:00", "a")] * 3, [("2024-01-01 03:00:00", "a")], [("2024-01-01 03:05:00", "a")], [("2024-01-01 00:20:00", "a"), ("2024-01-01 05:30:00", "b")]]
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "ts string, severity string").select(F.col("ts").cast("timestamp").alias("ts"), "severity")
        df.coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1.1)  # files are read by their time
    stream = spark.readStream.schema("ts timestamp, severity string").option("maxFilesPerTrigger", 1).parquet(str(source))
    target = str(tmp_path / "out")
    jobs.run(jobs.stream_counts(stream), "late", jobs.epoch_sink(target))
    out = spark.read.option("basePath", target).parquet(f"{target}/epoch=*")
    got = sorted((r["w"].hour, r["severity"], r["n"]) for r in out.select(F.col("window.start").alias("w"), "severity", "n").collect())
    assert got == [(0, "a", 3), (3, "a", 2)]


def test_expansion_runs_the_search_for_its_seeds_once(spark):
    """The plan behind the seeds is run once, however many joins read them."""
    ran = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            ran.add(len(batch))
            yield batch

    seeds = spark.createDataFrame([("q", "A.B.C", "1")], "query_id string, path string, doc_id string").coalesce(1).mapInPandas(run, "query_id string, path string, doc_id string")
    nodes = spark.createDataFrame([("A.B", "A", "Clause"), ("A.B.C", "A.B", "Point"), ("A.B.D", "A.B", "Point")], "path string, parent_path string, level string")
    edges = spark.createDataFrame([("1", "2", "dan_chieu"), ("1", "2", "dan_chieu"), ("3", "2", "can_cu_ban_hanh")], "from_doc_id string, to_doc_id string, relation_type string")
    got = {(r["kind"], r["key"]) for r in retrieve.expand_seeds(seeds, nodes.select("path"), nodes, edges).collect()}
    assert got == {("sibling", "A.B.D"), ("ancestor", "A.B"), ("parent_clause", "A.B"), ("related", "2"), ("related", "3")}
    assert ran.value <= 2  # a checkpoint runs its plan once or twice


def test_graph_edges_work_out_nodes_once(tables):
    t = tables
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    e = upsert.graph_edges(t.documents(), t.nodes(), t.chunks(), t.doc_edges(), t.path_edges())
    assert plan(e).count("row_number") == plan(t.path_edges()).count("row_number") > 0
