"""Status changes carried down by epochs, against a whole recomputation after every epoch."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from provisio.operators import effect, intervals
from provisio.sources import exports
from provisio.streaming import provisions

CHANGE = "path string, status_flag int, seq long"


def tree(rng):
    """path -> status of nodes on four levels, and chunk paths with the status of their documents."""
    nodes = {}
    for r in range(3):
        nodes[f"R{r}"] = 1
        for c in range(4):
            nodes[f"R{r}.C{c}"] = rng.choice([1, 3])
            for d in range(5):
                nodes[f"R{r}.C{c}.D{d}"] = rng.choice([0, 1, 4, 5])
                nodes[f"R{r}.C{c}.D{d}.K1"] = 1
    chunks = {f"{p}.{x}": rng.choice([1, 2]) for p in nodes if p.count(".") == 2 for x in ("K1", "K2", "K1.a")}
    chunks |= {"R9.C1.D1": 1, "R9": 2, "R1.C1": 1}
    return nodes, chunks


def below(p, up):
    return p.startswith(up + ".")


def apply(nodes, changes):
    """Whole recomputation of one epoch."""
    news = {p: s for p, s, _ in sorted(changes, key=lambda c: c[2]) if p in nodes}
    gone = [p for p, s in news.items() if s == 2 and nodes[p] != 2]
    return {p: 2 if any(below(p, g) for g in gone) else news.get(p, s) for p, s in nodes.items()}


def in_force(nodes, chunks):
    out = {}
    for p, s in chunks.items():
        ups = [u for u in nodes if u == p or below(p, u)]
        out[p] = (nodes[max(ups, key=len)] if ups else s) in (1, 5)
    return out


def test_every_epoch_equals_recomputation(spark, tmp_path):
    rng = random.Random(7)
    nodes, chunks = tree(rng)
    target = str(tmp_path)
    as_df = lambda d: spark.createDataFrame(list(d.items()), "path string, status_flag int")
    provisions.start(as_df(nodes), as_df(chunks), target)
    batches = [
        [("R1.C2.D3", 2, 1), ("R1.C2.D3", 1, 0), ("R1.C2.D4.K1", 5, 2)], [("R0.C1", 2, 3), ("R0.C1.D1", 1, 4), ("unknown.X", 2, 5)],
        [], [("R1.C2.D3", 1, 6), ("R1.C2.D3.K1", 1, 7)], [("R2", 2, 8), ("R1", 2, 9)], [("R2", 1, 10)],
    ]
    for epoch, batch in enumerate(batches, 1):
        for _ in range(2 if epoch in (2, 5) else 1):  # a replayed batch changes nothing
            provisions.apply_changes(spark.createDataFrame(batch, CHANGE), target, epoch)
        nodes = apply(nodes, batch)
        assert {r["path"]: r["status_flag"] for r in provisions.state(spark, target, "nodes").collect()} == nodes, epoch
        assert {r["path"]: r["is_effective"] for r in provisions.state(spark, target, "chunks").collect()} == in_force(nodes, chunks), epoch
    # A later replay of an early epoch reads what was there before it.
    before = sorted(map(str, provisions.state(spark, target, "nodes", None, 3).collect()))
    provisions.apply_changes(spark.createDataFrame(batches[1], CHANGE), target, 2)
    assert sorted(map(str, provisions.state(spark, target, "nodes", None, 3).collect())) == before


def test_only_touched_shelves_are_read_and_written(spark, tmp_path):
    nodes, chunks = tree(random.Random(1))
    as_df = lambda d: spark.createDataFrame(list(d.items()), "path string, status_flag int")
    provisions.start(as_df(nodes), as_df(chunks), str(tmp_path))
    provisions.apply_changes(spark.createDataFrame([("R1.C2.D3", 2, 1)], CHANGE), str(tmp_path), 1)
    written = {p.name for p in (tmp_path / "nodes" / "epoch=1").iterdir() if p.is_dir()}
    (own,) = spark.range(1).select(provisions.shelf(F.lit("R1.C2.D3"))).first()
    assert written == {f"shelf={own}"}
    read = provisions.state(spark, str(tmp_path), "nodes", [own])
    assert read._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().partitionCount() == 1


def test_sweep_and_chunks_read_what_is_stored(spark, tmp_path, monkeypatch):
    """The join with the changes and the view of the nodes are worked out once, not for every step."""
    nodes, chunks = tree(random.Random(2))
    as_df = lambda d: spark.createDataFrame(list(d.items()), "path string, status_flag int")
    plans, sweep, force = [], intervals.mark_below, effect.chunk_effective
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(intervals, "mark_below", lambda rows, *a: plans.append(plan(rows)) or sweep(rows, *a))
    monkeypatch.setattr(effect, "chunk_effective", lambda c, n: plans.append(plan(n)) or force(c, n))
    provisions.start(as_df(nodes), as_df(chunks), str(tmp_path))
    provisions.apply_changes(spark.createDataFrame([("R1", 2, 1)], CHANGE), str(tmp_path), 1)
    assert len(plans) == 3 and not any("Join" in p or "LogicalRDD" in p for p in plans)


def test_sample_is_exact_and_merges(spark):
    rows = spark.createDataFrame([(i, i % 3, "x" * 200) for i in range(3000)], "id long, kind int, title string")
    draw = lambda df: {(r["kind"], r["id"]) for r in exports.sample_export(df, 5, F.col("kind"), key=["id"]).collect()}
    whole = draw(rows)
    assert len(whole) == 15 and draw(rows.repartition(7)) == whole
    halves = draw(rows.filter("id < 1500")) | draw(rows.filter("id >= 1500"))
    assert draw(rows.join(spark.createDataFrame(list(halves), "kind int, id long"), ["kind", "id"], "left_semi")) == whole
    other = {(r["kind"], r["id"]) for r in exports.sample_export(rows, 5, F.col("kind"), seed=1, key=["id"]).collect()}
    assert other != whole and max(len(r["title"]) for r in exports.sample_export(rows, 5, key=["id"]).collect()) == 120
