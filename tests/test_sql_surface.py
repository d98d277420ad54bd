"""Table functions of SQL, VARIANT readers, and sessions of a hot key."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from provisio.functions import sql
from provisio.operators import effect
from provisio.sources import attributes
from provisio.streaming import jobs

DAY = "2020-06-01"


def corpus(spark, n=300):
    """Documents with every status, open and null dates, and edges of all kinds, to missing documents too."""
    draw = random.Random(5)
    day = lambda: draw.choice([None, *[dt.date(2020, 6, 1) + dt.timedelta(k) for k in (-90, -1, 0, 1, 90)]])
    docs = [(str(i), f"{i}/2020", day(), day(), draw.choice([None, 0, 1, 2, 3, 4, 5])) for i in range(n)]
    kinds = [*effect.REPEALING, *effect.AMENDING, "dan_chieu", None]
    edges = [(str(draw.randrange(n)), str(draw.randrange(n + 9)), draw.choice(kinds)) for _ in range(2 * n)]
    return (spark.createDataFrame(docs, "doc_id string, doc_num string, eff_from date, eff_to date, status_flag int"),
            spark.createDataFrame(edges, "from_doc_id string, to_doc_id string, relation_type string"))


def test_refresh_function_equals_the_operator(spark):
    docs, edges = corpus(spark)
    docs.createOrReplaceTempView("f_docs")
    edges.createOrReplaceTempView("f_edges")
    assert sql.register_tables(spark, "f_docs", "f_edges") == ["refresh_status_flags", "documents_in_force"]
    got = spark.sql(f"SELECT * FROM refresh_status_flags(DATE'{DAY}')")
    labelled = docs.withColumn("eff_flag", F.lit(None).cast("string"))
    want = effect.refresh_document_status(labelled, edges, DAY)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LateralJoin" not in plan and "Join Cross" not in plan
    live = spark.sql(f"SELECT doc_id FROM documents_in_force(DATE'{DAY}')").collect()
    day = dt.date.fromisoformat(DAY)
    inside = [d.doc_id for d in docs.collect() if d.status_flag in (1, 4, 5) and d.eff_from and d.eff_from <= day and (d.eff_to is None or d.eff_to > day)]
    assert sorted(r.doc_id for r in live) == sorted(inside)


def test_free_json(spark):
    texts = ['{"a": {"b": 3}, "l": [{"x": "p"}, 5, null]}', '{"a": 1, "l": []}', '{"a": {"b": "no"}, "l": {"x": 1}}', "no json", "", None]
    raw = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    held = attributes.free_fields(raw, {"b": ("$.a.b", "int")})
    assert [r.b for r in held.orderBy("id").collect()] == [3, None, None, None, None, None]
    rows = attributes.free_entries(held, "$.l").select("id", "pos", F.try_variant_get("entry", "$.x", "string").alias("x")).orderBy("id", "pos").collect()
    assert [tuple(r) for r in rows if r.id == 0] == [(0, 0, "p"), (0, 1, None), (0, 2, None)]
    assert not [r for r in rows if r.id in (1, 3, 4, 5)]


def test_hot_sessions_are_merged_before_the_shuffle(spark, tmp_path):
    """Half of all events have one key; each input task hands on its sessions, not its events."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"),
        (F.timestamp_seconds(1_600_000_000 + (F.col("id") / 500).cast("int") * 7200 + F.col("id") % 500)).alias("ts"))
    end = spark.range(1).select(F.lit("end").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    rows.unionByName(end).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
    query = jobs.stream_sessions(stream).writeStream.format("memory").queryName("hot_sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    steps = [line.strip(" +-*()0123456789") for line in query._jsq.explainInternal(False).splitlines()]
    merges = [i for i, s in enumerate(steps) if s.startswith("MergingSessions")]
    shuffle = next(i for i, s in enumerate(steps) if s.startswith("Exchange"))
    assert merges[-1] > shuffle > merges[0]
    got = {(r.key, r.t): r.n for r in spark.sql("SELECT key, cast(session_window.start AS long) t, n FROM hot_sessions").collect()}
    want = {}
    for r in rows.selectExpr("key", "cast(ts AS long) t").orderBy("t").collect():
        block = (r.t - 1_600_000_000) // 7200
        first = next((k for k in want if k[0] == r.key and k[2] == block), None) or (r.key, r.t, block)
        want[first] = want.get(first, 0) + 1
    assert got == {(k, t): n for (k, t, _), n in want.items()}
