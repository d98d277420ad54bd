"""Group-wise ordering that does not put one hot group into one task.

A plain window sorts each group inside a single task.  That is right for groups of
ordinary size.  Groups with more than ``most`` rows are found by a count that is
aggregated before it is shuffled; only their rows are cut into blocks, at quantiles of a
``place`` that grows with the order, and one summary row per block carries across
them.  Sparse places make no more blocks than dense ones.  Results are exactly
those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a group counts as hot, and the blocks that it is cut into.
HOT_ROWS, BLOCKS = 1 << 20, 256


def _blocked(df: DataFrame, keys: list[str], place: Column, most: int) -> DataFrame | None:
    """``df`` with the block ``__b`` of each row of a hot group (null elsewhere); None where no group is hot.

    At most one row in ``most`` names a hot group.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).drop("__n")
    if hot.isEmpty():
        return None
    at = df.withColumn("__at", place.cast("double"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    cuts = (
        at.alias("d").join(hot.alias("h"), same, "left_semi").groupBy(*keys)
        .agg(F.percentile_approx("__at", [i / BLOCKS for i in range(1, BLOCKS)], 10_000).alias("__cuts"))
    )
    joined = at.alias("d").join(cuts.alias("h"), same, "left").select("d.*", F.col("h.__cuts").alias("__cuts"))
    passed = F.size(F.filter("__cuts", lambda c: c < F.col("__at")))
    return joined.withColumn("__b", F.when(F.col("__cuts").isNotNull(), F.coalesce(passed, F.lit(0)))).drop("__at", "__cuts")


def _carried(df: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    """Summary rows joined to the blocks of hot groups; other rows get nulls."""
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "__b")]
    return df.alias("d").join(carry.alias("c"), same, "left").select("d.*", *[F.col(f"c.{c}").alias(c) for c in carry.columns if c not in (*keys, "__b")])


def row_number_in_blocks(
    df: DataFrame, keys: list[str], place: Column, order: list, out: str = "rn", most: int = HOT_ROWS
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``place`` must grow with the order."""
    cut = _blocked(df, keys, place, most)
    if cut is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    by = [*keys, "__b"]
    counts = cut.filter("__b IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = cut.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return _carried(inner, keys, offsets).withColumn(out, F.col("__rn") + F.coalesce("__off", F.lit(0))).drop("__b", "__rn", "__off")


def running_in_blocks(
    df: DataFrame, keys: list[str], place: Column, order: list[str], value: Column, agg: str, out: str,
    descending: bool = False, most: int = HOT_ROWS,
) -> DataFrame:
    """Running ``sum`` or ``last`` (nulls ignored) up to and including each row.

    With ``descending`` the scan runs from the highest place and order down.
    """
    turn = F.desc if descending else F.asc
    df = df.withColumn("__v", value)

    def running(by: list[str]) -> Column:
        rows = Window.partitionBy(*by).orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        return F.sum("__v").over(rows) if agg == "sum" else F.last("__v", ignorenulls=True).over(rows)

    cut = _blocked(df, keys, place, most)
    if cut is None:
        return df.withColumn(out, running(keys)).drop("__v")
    by = [*keys, "__b"]
    before = Window.partitionBy(*keys).orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
    if agg == "sum":
        part, carried = F.sum("__v"), F.sum("__p").over(before)
        total = F.when(F.col("__here").isNotNull() | F.col("__c").isNotNull(), F.coalesce("__here", F.lit(0)) + F.coalesce("__c", F.lit(0)))
    else:
        pick = F.min_by if descending else F.max_by
        part = pick("__v", F.when(F.col("__v").isNotNull(), F.struct(*order)))
        carried, total = F.last("__p", ignorenulls=True).over(before), F.coalesce(F.col("__here"), F.col("__c"))
    carry = cut.filter("__b IS NOT NULL").groupBy(*by).agg(part.alias("__p")).withColumn("__c", carried).drop("__p")
    return _carried(cut.withColumn("__here", running(by)), keys, carry).withColumn(out, total).drop("__b", "__v", "__here", "__c")


def next_in_blocks(
    df: DataFrame, keys: list[str], place: Column, order: list[str], value: str, out: str, most: int = HOT_ROWS
) -> DataFrame:
    """``lead(value)`` over the order: inside the block, else the first row of the next block."""
    cut = _blocked(df, keys, place, most)
    if cut is None:
        return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
    by = [*keys, "__b"]
    first = cut.filter("__b IS NOT NULL").groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias("__first"))
    after = first.withColumn("__c", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__b"))).drop("__first")
    inside = Window.partitionBy(*by).orderBy(*order)
    here = cut.withColumn("__here", F.lead(value).over(inside)).withColumn("__last", F.lead(F.lit(1)).over(inside).isNull())
    return _carried(here, keys, after).withColumn(out, F.when(F.col("__last"), F.col("__c")).otherwise(F.col("__here"))).drop("__b", "__here", "__last", "__c")


def top_k(df: DataFrame, keys: list[str], order: list, k: int | Column, out: str = "rn") -> DataFrame:
    """First k rows of each group.

    ``row_number() <= k`` is pruned to k rows per group in every input task
    before the shuffle (WindowGroupLimit), so a hot group never reaches one task whole.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)


def left_join_filled(df: DataFrame, other: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Left equi-join whose rows with a null among ``keys`` meet nothing, wherever they lie.

    They would all hash to one partition; ``place`` spreads them over many.
    """
    lacks = F.lit(False)
    for k in keys:
        lacks = lacks | F.col(k).isNull()
    # Not a constant on either side, as the optimizer would take that out of the keys.
    own = df.withColumn("__place", F.when(lacks, F.xxhash64(place)).otherwise(F.xxhash64(*keys)))
    return own.join(other.withColumn("__place", F.xxhash64(*keys)), [*keys, "__place"], "left").drop("__place")
