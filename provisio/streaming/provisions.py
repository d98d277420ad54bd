"""Status changes of provisions carried to the provisions and chunks below them, epoch by epoch.

The state of nodes and chunks lies in folders by epoch and shelf (a bucket of the first two labels of
a path; nodes above that have a shelf of their own).  A batch of changes reads the newest version of the
shelves that it touches, applies the changes, lets descendants of expired nodes expire (E6),
works out again which chunks are in force (E8), and writes those shelves as a new epoch.  A batch
reads only epochs before its own and writes in overwrite mode, so a replay gives the same state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.operators import effect, intervals, upsert
from provisio.streaming import jobs

#: Buckets of paths; the shelf of nodes with one label only.
SHELVES, TOP = 64, -1
TABLES = ("nodes", "chunks")


def shelf(path: Column) -> Column:
    below = F.pmod(F.xxhash64(F.substring_index(path, ".", 2)), F.lit(SHELVES)).cast("int")
    return F.when(F.instr(path, ".") > 0, below).otherwise(F.lit(TOP))


def _store(rows: DataFrame, target: str, table: str, epoch: int) -> None:
    rows.withColumn("shelf", shelf(F.col("path"))).write.mode("overwrite").partitionBy("shelf").parquet(f"{target}/{table}/epoch={epoch}")


def _stored(spark: SparkSession, target: str, table: str, epoch: int) -> DataFrame:
    return spark.read.schema("path string, status_flag int, shelf int").parquet(f"{target}/{table}/epoch={epoch}").drop("shelf")


def _log(spark: SparkSession, target: str, shelves: list[int], epoch: int) -> None:
    """Which shelves an epoch holds; written last, so an epoch without it does not count."""
    spark.createDataFrame([(s,) for s in shelves], "shelf int").coalesce(1).write.mode("overwrite").parquet(f"{target}/log/epoch={epoch}")


def start(nodes: DataFrame, chunks: DataFrame, target: str) -> None:
    """First state: ``nodes`` (path, status_flag), ``chunks`` (path, status_flag of the document)."""
    spark = nodes.sparkSession
    _store(nodes.select("path", "status_flag"), target, "nodes", 0)
    # From what is stored, as the view of the nodes would be worked out again.
    known = effect.chunk_effective(chunks.select("path", "status_flag"), _stored(spark, target, "nodes", 0))
    _store(known, target, "chunks", 0)
    _log(spark, target, [TOP, *range(SHELVES)], 0)


def state(spark: SparkSession, target: str, table: str, shelves: list[int] | None = None, before: int | None = None) -> DataFrame:
    """Newest version of each shelf (of epochs below ``before``); folders of other versions and shelves are not read."""
    log = spark.read.option("basePath", f"{target}/log").parquet(f"{target}/log/epoch=*")
    if before is not None:
        log = log.filter(F.col("epoch") < before)
    if shelves is not None:
        log = log.filter(F.col("shelf").isin(shelves))
    newest = log.groupBy("shelf").agg(F.max("epoch").alias("epoch")).collect()  # at most SHELVES + 1
    kept = [(F.col("shelf") == r["shelf"]) & (F.col("epoch") == r["epoch"]) for r in newest]
    rows = spark.read.option("basePath", f"{target}/{table}").parquet(f"{target}/{table}/epoch=*")
    return rows.filter(reduce(Column.__or__, kept, F.lit(False))).drop("shelf", "epoch")


def apply_changes(batch: DataFrame, target: str, epoch: int) -> None:
    """One batch of ``path, status_flag, seq`` (the greatest ``seq`` of a path counts) as epoch ``epoch``."""
    spark = batch.sparkSession
    news = upsert.keep_latest(batch.select("path", "status_flag", "seq"), ["path"], "seq").select("path", F.col("status_flag").alias("new_flag"))
    touched = sorted(r[0] for r in news.select(shelf(F.col("path"))).distinct().collect())  # at most SHELVES + 1
    if not touched:
        return
    shelves = [TOP, *range(SHELVES)] if TOP in touched else touched
    old = state(spark, target, "nodes", [*shelves, TOP], epoch).join(news, "path", "left")
    # Joined and written once, as the sweep reads its rows three times: for the cuts, for what blocks carry, for itself.
    placed = f"{target}/placed/epoch={epoch}"
    old.write.mode("overwrite").parquet(placed)
    old = spark.read.schema("path string, status_flag int, new_flag int").parquet(placed)
    gone = F.coalesce((F.col("new_flag") == 2) & (F.col("status_flag") != 2), F.lit(False))
    below = intervals.mark_below(old, gone, "__hit")
    now = below.select("path", F.when(F.col("__hit"), 2).otherwise(F.coalesce("new_flag", "status_flag")).alias("status_flag"))
    _store(now.filter(shelf(F.col("path")).isin(shelves)), target, "nodes", epoch)
    above = state(spark, target, "nodes", [TOP], epoch) if TOP not in shelves else None
    written = _stored(spark, target, "nodes", epoch)
    nodes = written if above is None else written.unionByName(above)
    chunks = state(spark, target, "chunks", shelves, epoch).select("path", "status_flag")
    _store(effect.chunk_effective(chunks, nodes), target, "chunks", epoch)
    _log(spark, target, shelves, epoch)


def stream_changes(changes: DataFrame, target: str, checkpoint: str | None = None) -> None:
    """Every batch of the stream ``path, status_flag, seq`` becomes the next epoch of the state below ``target``."""
    jobs.run(changes, "provisions", lambda batch, epoch: apply_changes(batch, target, epoch + 1), "append", checkpoint)
