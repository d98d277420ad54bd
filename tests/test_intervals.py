"""Sweeps over subtree intervals against brute force over path prefixes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provisio.operators import effect, intervals


def tree(seed: int, n: int = 400) -> list[str]:
    """Paths with labels that are prefixes of each other, gaps in the levels and one large subtree."""
    draw = random.Random(seed)
    made = {"D1", "D10", "D1_a", "D1.K1", "D10.K1"}
    while len(made) < n:
        depth = draw.randint(1, 6)
        labels = [draw.choice(["D1", "D10", "D1_a", "K2", "K", "a", "A9"]) for _ in range(depth)]
        made.add(".".join(["D1" if draw.random() < 0.4 else "D10", *labels]))
    return sorted(made, key=lambda _: draw.random())


def above(path: str, proper: bool) -> list[str]:
    parts = path.split(".")
    return [".".join(parts[:i]) for i in range(len(parts) - proper, 0, -1)]


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_mark_below_equals_brute_force(spark, blocks):
    paths = tree(blocks)
    top = {p for i, p in enumerate(paths) if i % 9 == 0}
    rows = [(p, p in top, i) for i, p in enumerate([*paths, *paths[:20], None])]
    df = spark.createDataFrame(rows, "path string, top boolean, path_no int").withColumnRenamed("path_no", "hit_no").repartition(5)
    got = sorted((r.hit_no, r.hit) for r in intervals.mark_below(df, F.col("top"), "hit", blocks).collect())
    assert got == [(i, p is not None and any(a in top for a in above(p, True))) for p, _, i in rows]


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_nearest_above_equals_brute_force(spark, blocks):
    paths = tree(100 + blocks)
    held = {p: (None if i % 13 == 0 else i % 6) for i, p in enumerate(paths) if i % 3}
    nodes = spark.createDataFrame([*held.items(), (None, 1)], "path string, status_flag int")
    asked = [*paths, "D9.K1", None]
    out = intervals.nearest_above(spark.createDataFrame([(p,) for p in asked], "path string"), nodes, "status_flag", "v", blocks)
    want = {p: next((held[a] for a in above(p, False) if a in held), None) if p else None for p in asked}
    assert {r.path: r.v for r in out.collect()} == want and out.count() == len(asked)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, status_flag int")
    one = spark.createDataFrame([("D1",)], "path string")
    assert intervals.mark_below(none, F.lit(True), "hit").count() == 0
    assert [r.v for r in intervals.nearest_above(one, none, "status_flag", "v").collect()] == [None]
    assert intervals.nearest_above(one.limit(0), none, "status_flag", "v").count() == 0


def test_plans_hold_no_prefixes(spark, tables):
    """No generated row per ancestor; windows are dealt by block, not by a label."""
    nodes = tables.nodes()
    for df in (effect.refresh_hierarchy_status(nodes, "1999-01-01"), effect.cascade_hierarchy_status(nodes, nodes.filter("eff_to < '1999-01-01'"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
    cut = intervals._in_blocks(nodes, nodes, 64)[0].groupBy("__b").count().collect()
    assert len(cut) == 64 and max(r["count"] for r in cut) < 4 * nodes.count() / 64
