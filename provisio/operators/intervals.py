"""Subtrees as intervals of the reading order.

With the dots of a path replaced by the lowest character, plain string order is
the order in which a tree is read, and a node's subtree lies between its label and that
label with the next character behind it.  Intervals of a tree nest or
lie apart, so one sweep in that order answers what is above a row, without a row
for each ancestor and without a key that a whole document or part shares.

The sweep is a window per block of the order.  The blocks are cut by a bounded sample of
labels, and a row per block carries the state across them.  Paths are keys of nodes;
rows with a null path are in no subtree and have no ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions import paths as P

#: Most blocks of an order, and sampled labels for each of them.
BLOCKS, SAMPLED = 1 << 14, 16
INSIDE, BEHIND, BETWEEN = "\x01", "\x02", "\x03"
ALL = (Window.unboundedPreceding, Window.currentRow)


def begin(path: Column) -> Column:
    """Label whose string order is the reading order."""
    return F.translate(path, ".", INSIDE)


def end(path: Column) -> Column:
    """Label behind all of the subtree and before whatever follows it."""
    return F.concat(begin(path), F.lit(BEHIND))


def cuts(rows: DataFrame, blocks: int) -> list[str]:
    """Labels that cut ``rows`` (path) into about equal blocks.

    The sample holds the labels of lowest hash, at most ``SAMPLED`` for each block, so a
    task that runs again draws the same.
    """
    label = begin(F.col("path")).alias("b")
    drawn = rows.filter("path IS NOT NULL").select(label).orderBy(F.xxhash64("b"), "b").limit(blocks * SAMPLED)
    held = sorted({r.b for r in drawn.collect()})
    return sorted({held[len(held) * i // blocks] for i in range(1, blocks)}) if held else []


def block_of(label: Column, at: list[str]) -> Column:
    """How many of the sorted cuts are not above the label, by binary search."""
    if not at:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(at).bit_length()))])
    held = F.split(F.lit(BETWEEN.join(at)), BETWEEN)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) <= label, low + step).otherwise(low))


def _in_blocks(rows: DataFrame, of: DataFrame, blocks: int | None) -> tuple[DataFrame, int]:
    """``rows`` with their label ``__at`` and block ``__b``, cut by the paths of ``of``; how many blocks."""
    at = cuts(of, blocks or min(BLOCKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.withColumn("__at", begin(F.col("path"))).withColumn("__b", block_of(F.col("__at"), at)), len(at) + 1


def _carried(rows: DataFrame, having: Column, parts: dict[str, Column], pick, blocks: int) -> DataFrame:
    """``rows`` with what the rows of all blocks before theirs leave behind.

    Only rows ``having`` a state are read for it; one row per block is broadcast.
    """
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    left = rows.filter(having).groupBy("__b").agg(*[c.alias(name) for name, c in parts.items()])
    every = rows.sparkSession.range(blocks).select(F.col("id").cast("int").alias("__b"))
    state = every.join(left, "__b", "left").select("__b", *[pick(F.col(name)).over(before).alias(name) for name in parts])
    return rows.join(F.broadcast(state), "__b", "left")


def mark_below(rows: DataFrame, top: Column, out: str, blocks: int | None = None) -> DataFrame:
    """``out``: whether a row with ``top`` is a proper ancestor of the row.

    A running maximum of the ends of the intervals that ``top`` opens passes a row's own end
    if and only if one of them holds the row's interval.
    """
    cut, n = _in_blocks(rows, rows, blocks)
    cut = cut.withColumn("__end", F.when(top, end(F.col("path"))))
    here = F.max("__end").over(Window.partitionBy("__b").orderBy("__at").rowsBetween(*ALL))
    swept = _carried(cut, top, {"__far": F.max("__end")}, F.max, n).withColumn("__here", here)
    hit = F.greatest("__here", "__far") > end(F.col("path"))
    return swept.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__at", "__b", "__end", "__here", "__far")


def nearest_above(asked: DataFrame, nodes: DataFrame, value: str, out: str, blocks: int | None = None) -> DataFrame:
    """``asked`` (path, once each) with ``out``: ``value`` of the deepest node at or above it.

    Of all nodes on one level only the last before a row can hold it, so the state
    is one node per level.  Of repeated node paths the largest value counts.
    """
    depth = P.path_depth(F.col("path"))
    levels = nodes.agg(F.max(depth)).first()[0] or 0
    if not levels:
        return asked.withColumn(out, F.lit(None).cast(nodes.schema[value].dataType))
    both = asked.withColumn("__v", F.lit(None).cast(nodes.schema[value].dataType)).withColumn("__asked", F.lit(True)).unionByName(
        nodes.filter("path IS NOT NULL").select("path", F.col(value).alias("__v"), F.lit(False).alias("__asked")), allowMissingColumns=True)
    cut, n = _in_blocks(both, asked.select("path").unionByName(nodes.select("path")), blocks)
    cut = cut.withColumn("__depth", depth)
    order = ["__at", "__asked", "__v"]
    run = Window.partitionBy("__b").orderBy(*order).rowsBetween(*ALL)
    at = {f"__l{i}": F.when(~F.col("__asked") & (F.col("__depth") == i), F.struct("path", F.col("__v").alias("v"))) for i in range(1, levels + 1)}
    swept = _carried(cut, ~F.col("__asked"), {f"{name}c": F.max_by(c, F.when(c.isNotNull(), F.struct(*order))) for name, c in at.items()}, lambda c: F.last(c, ignorenulls=True), n)
    swept = swept.select("*", *[F.last(c, ignorenulls=True).over(run).alias(name) for name, c in at.items()]).filter("__asked")
    holds = []
    for name in reversed(list(at)):
        last = F.coalesce(name, f"{name}c")
        holds.append(F.when((last["path"] == F.col("path")) | F.startswith(F.col("path"), F.concat(last["path"], F.lit("."))), last))
    return swept.withColumn(out, F.coalesce(*holds)["v"]).select(*asked.columns, out)
