r"""Exact duplicates by content sort.

Sampled splitters cut the order of normalised texts into ranges; every range is
sorted (Spark's external sort), so equal texts are neighbours, and each text is
compared in full with the one before it.  The order key goes on with length,
id and a random number, so a large group of copies spreads over many ranges, repeated rows
and rows without an id too; a run that crosses a splitter is joined again from one row per range.

Normalised: every character of ``[\x20\x09-\x0D]`` deleted.  Of equal texts the
one with most code points, then the least ``doc_id`` stays.  Null text counts as
empty.  A null ``doc_id`` comes last in ties.  Of repeated rows one is kept.  Empty
table: no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, settle

BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of the text that lead the order key; texts alike so far are ordered by their digest.
LEAD = 24
#: Sampled rows for each range.
SAMPLED = 20
#: Most ranges, so most splitters that a plan carries (about 9 MB).
MOST_RANGES = 1 << 16


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _key(norm: Column, digest: Column, length: Column, doc_id: Column) -> Column:
    """Text whose byte order is (text, digest, longest first, least id first, no id, at random)."""
    lead = F.rpad(F.hex(F.substring(F.encode(norm, "utf-8"), 1, LEAD)), 2 * LEAD, "0")
    long_first = F.lpad(F.hex(F.lit(1 << 40) - length), 11, "0")
    least_first = F.coalesce(F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("~"))
    # Rows alike so far are told apart at random, so that many of them spread over ranges.
    return F.concat(lead, digest, long_first, least_first, F.lpad(F.hex((F.rand(11) * (1 << 32)).cast("bigint")), 8, "0"))


def _prepared(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", *carry, F.char_length("text").alias("length"), normal(F.col("text")).alias("norm"))
    rows = rows.withColumn("digest", F.sha2("norm", 256))
    return rows.withColumn("key", _key(F.col("norm"), F.col("digest"), F.col("length"), F.col("doc_id")))


def _splitters(docs: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` order keys from a sample of bounded size."""
    rows = docs.count()
    if not rows or ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLED / rows)
    keys = _prepared(docs.filter(F.rand(7) < share)).select("key")
    step = Window.orderBy("key")
    sampled = keys.withColumn("n", F.row_number().over(step))
    found = sampled.filter(F.col("n") % SAMPLED == 0).select("key").distinct().orderBy("key")
    return [r["key"] for r in found.collect()]


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or before the key, by binary search."""
    if not splitters:
        return F.lit(0)
    table = F.split(F.lit(",".join(splitters)), ",")
    n = len(splitters)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.get(table, low + step - 1) <= key), low + step).otherwise(low),
    )


def duplicates(docs: DataFrame, ranges: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) and the columns ``carry`` of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = _splitters(docs, ranges)
    rows = _prepared(docs, carry).withColumn("range", _range_of(F.col("key"), splitters))
    order = Window.partitionBy("range").orderBy("key")
    edge = F.lag("key").over(order).isNull() | F.lead("key").over(order).isNull()
    # One full comparison with the text before; only the first and last text of a range are carried on.
    pairs = settle(rows.select(
        "range", "key", "doc_id", "digest", *carry,
        F.coalesce(F.col("norm") == F.lag("norm").over(order), F.lit(False)).alias("same"),
        F.when(edge, F.col("norm")).alias("edge_text"),
    ))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = pairs.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(upto)).drop("same")
    own = Window.partitionBy("range", "run")
    runs = runs.select(
        "range", "run", "key", "doc_id", "digest", *carry,
        F.min("key").over(own).alias("first_key"), F.min_by("doc_id", "key").over(own).alias("first_id"),
        F.count(F.lit(1)).over(own).alias("here"),
        F.row_number().over(own.orderBy("key")).alias("place"),
    )
    # One row per range: does its first run go on from the range before, and which run does it end with?
    edge_key = F.when(F.col("edge_text").isNotNull(), F.col("key"))
    ends = pairs.groupBy("range").agg(
        # Rows between the edges can have the key of an edge, but no text.
        F.min_by("edge_text", edge_key).alias("first_text"), F.max_by("edge_text", edge_key).alias("last_text"),
        F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("runs"),
    )
    across = Window.orderBy("range")
    ends = ends.select(
        "range", "runs", F.coalesce(F.col("first_text") == F.lag("last_text").over(across), F.lit(False)).alias("goes_on"),
    )
    # A chain starts where the last run of a range starts: at a new run, or in a range that does not go on.
    starts = F.when((F.col("runs") > 1) | ~F.col("goes_on"), F.col("range"))
    ends = ends.withColumn("chain", F.last(starts, ignorenulls=True).over(across))
    ends = ends.withColumn("from", F.when(F.col("goes_on"), F.lag("chain").over(across)).otherwise(F.col("range")))
    ends = ends.select("range", "runs", "goes_on", "chain", "from")
    # Runs at the ends of ranges, summed along their chains; a run in the middle is its own chain.
    tails = runs.filter("place = 1").select("range", "run", "here", "first_id").join(ends, "range")
    tails = tails.filter("run = 1 OR run = runs").withColumn("chain", F.when(F.col("run") == 1, F.col("from")).otherwise(F.col("range")))
    start = F.struct(F.col("range"), F.col("run"))
    whole = (
        tails.withColumn("last_run", F.col("run") == F.col("runs")).withColumn("first_run", F.col("run") == 1)
        # A first run that does not go on and is not the last run of its range stands alone.
        .withColumn("chain_key", F.when(F.col("first_run") & ~F.col("goes_on") & ~F.col("last_run"), -F.col("range") - 1).otherwise(F.col("chain")))
    )
    sums = whole.groupBy("chain_key").agg(F.sum("here").alias("total"), F.min_by("first_id", start).alias("head"))
    joined = whole.join(sums, "chain_key").select("range", "run", "total", "head", (F.col("goes_on") & F.col("first_run")).alias("later"))
    # The join side has at most two rows for each range.
    out = runs.join(F.broadcast(joined), ["range", "run"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("total").isNull(), F.col("first_id")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("total", "here").alias("group_size"),
        ((F.col("place") == 1) & ~F.coalesce("later", F.lit(False))).alias("kept"),
        F.col("digest").alias("text_sha256"), *carry,
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; of wholly equal rows one stays."""
    rows, number = numbered(docs)
    gone = duplicates(rows, carry=(number,)).filter("NOT kept").select(number)
    return rows.join(gone, number, "left_anti").select(*docs.columns)
