"""Steps that grew faster than their input."""

from __future__ import annotations

import random
import re

import pytest

from pyspark.sql import functions as F

from provisio.operators import relations, search
from provisio.plans.projections import Tables
from provisio.streaming import jobs


def _grams(text):
    padded = "  " + "  ".join(re.findall(r"[^\W_]+", text.lower())) + " "
    return {padded[i:i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("least", [0.3, 0.6, 0.75])
def test_fuzzy_candidates_agree_in_sizes_and_choices_of_grams(spark, least):
    rng = random.Random(5)
    texts = lambda n, top: [(i, f"{rng.randrange(top)}/{rng.choice((1997, 1998))}/NĐ-CP") for i in range(n)]
    asked, stored = [*texts(30, 3000), (90, ""), (91, "1")], [*texts(200, 3000), (900, ""), (901, "1 1"), (902, "đ")]
    want = set()
    for key, q in asked:
        a = _grams(q)
        found = [(-round(len(a & b) / len(a | b), 6), i) for i, b in ((i, _grams(d)) for i, d in stored) if round(len(a & b) / len(a | b), 6) >= least]
        want |= {(key, i, -s) for s, i in sorted(found)[:5]}
    out = search.fuzzy_doc_search(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(stored, "doc_id int, doc_num string"), 5, least)
    assert {(r["query_id"], r["doc_id"], r["similarity"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*probe#\d+L? = probe#\d+", plan)


def test_references_without_a_target_do_not_share_a_partition(spark):
    """Articles that the table does not have: null keys in the lookups of clauses and points."""
    chunks = spark.range(4000).select(
        F.concat(F.lit("R1.D"), "id", F.lit(".K1")).alias("path"), F.lit("body").alias("chunk_type"), F.concat(F.lit("Xem Điều "), F.col("id") + 9000).alias("chunk_text"))
    nodes = spark.createDataFrame([("R1", "Part", 1), ("R1.D1", "Article", 1), ("R1.D1.K1", "Clause", 1)], "path string, level string, sort_order bigint")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        refs = chunks.select(F.col("path").alias("source_path"), F.explode(relations.internal_refs(F.col("chunk_text"))).alias("ref"))
        out = relations.resolve_refs(refs, nodes).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {(r["source_path"], r["target_path"]) for r in out} == {(f"R1.D{i}.K1", f"R1.D{9000 + i}") for i in range(4000)}
    sizes = [sum(r["part"] == p for r in out) for p in {r["part"] for r in out}]
    assert max(sizes) < 3000


def test_last_items_over_batches_hold_no_group_in_python(spark, tmp_path):
    """Three batches, rows out of order and without a time; the last two per key over all of them."""
    schema = "key string, ts timestamp, event_id bigint, value string"
    for i in range(3):
        rows = spark.range(60).select(
            (F.col("id") % 4).cast("string").alias("key"), F.when(F.col("id") % 7 > 0, F.timestamp_seconds((F.col("id") * 37 + i * 11) % 97)).alias("ts"),
            (F.col("id") + i * 100).alias("event_id"), F.lit("v").alias("value"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    jobs.stream_memory(stream, target, 2)
    stored = spark.read.option("basePath", target).parquet(f"{target}/epoch=*")
    assert stored.select("epoch").distinct().count() == 3
    got = {(r["key"], r["event_id"], r["recency"]) for r in jobs.merge_memory(stored, 2).collect()}
    held, want = spark.read.parquet(str(tmp_path / "in")).collect(), set()
    for key in {r["key"] for r in held}:
        last = sorted((r for r in held if r["key"] == key), key=lambda r: (r["ts"] is not None, r["ts"] and r["ts"].timestamp(), r["event_id"]), reverse=True)[:2]
        want |= {(key, r["event_id"], n) for n, r in enumerate(last, 1)}
    assert got == want


def test_heavy_text_work_is_cut_by_rows(spark, tmp_path):
    """A small file of many rows: more tasks than cores when the rows are many."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    t = Tables(spark, str(tmp_path))
    assert t.spread("orders", rows=10).rdd.getNumPartitions() == 100
    assert t.spread("orders", rows=10).count() == 1000
