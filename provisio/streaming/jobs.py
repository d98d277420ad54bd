"""Structured Streaming jobs built on the batch operators.

Every sink writes one folder per epoch in overwrite mode, so a replayed epoch
after a failure replaces itself.  State tables are read back as the newest
epoch or as keep-latest over all epochs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.operators import effect, upsert
from provisio.operators.skew import top_k
from provisio.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A parquet table, one file or a folder of files, as a file stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # A pattern, as a stream's plain path must be a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def run(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process all available data and stop; a later run with the same ``checkpoint`` goes on from there."""
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint or new_folder(stream.sparkSession, f"{name}-checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()


def epoch_sink(target: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def read_epochs(spark: SparkSession, target: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/epoch=*")


# -- L1 ---------------------------------------------------------------------------


def stream_ingest(documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], target: str, version: str) -> None:
    """New document versions -> chunks.

    Each epoch writes its chunks with the version column; :func:`current_chunks`
    keeps the newest version per document.  The stream checkpoint is the resume list.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        latest = upsert.keep_latest(batch, ["doc_id"], version)
        chunks = chunker(latest).join(latest.select("doc_id", version), "doc_id")
        chunks.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    run(documents, "ingest", write)


def current_chunks(chunks: DataFrame, version: str) -> DataFrame:
    """All chunks of the newest version of each document (newest epoch for equal versions)."""
    newest = chunks.groupBy("doc_id").agg(F.max(F.struct(version, "epoch")).alias("v"))
    pick = newest.select("doc_id", F.col(f"v.{version}").alias(version), F.col("v.epoch").alias("epoch"))
    return chunks.join(pick, ["doc_id", version, "epoch"], "left_semi")


# -- L2 ---------------------------------------------------------------------------


def stream_status_changes(changes: DataFrame, docs: DataFrame, edges: DataFrame, as_of, target: str) -> None:
    """Documents coming into force -> status of what they repeal or amend (stream-static join)."""

    def write(batch: DataFrame, epoch: int) -> None:
        came = batch.filter("new_status = 1 and old_status <> 1").select("doc_id").distinct()
        # Only what the batch points at is read on: edges from it, then their targets.
        own = edges.join(came.withColumnRenamed("doc_id", "from_doc_id"), "from_doc_id", "left_semi")
        hit = docs.join(own.select(F.col("to_doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        after = effect.cascade_document_status(hit, own, came, as_of)
        before = hit.select("doc_id", F.col("status_flag").alias("old_flag"))
        out = after.select("doc_id", F.col("status_flag").alias("new_flag")).join(before, "doc_id").filter("old_flag <> new_flag")
        out.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    run(changes, "status", write)


# -- L3 ---------------------------------------------------------------------------


def stream_memory(items: DataFrame, target: str, n: int = 5) -> None:
    """Rolling last ``n`` per key (``key, ts, event_id, value``): every batch writes its last ``n`` as one epoch.

    What is last over all batches is last in its own; :func:`merge_memory` takes it from the epochs.  A hot key
    is cut to ``n`` rows in every input task, and no group is held in Python.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("key", "ts", "event_id", "value")
        top_k(rows, ["key"], [F.desc("ts"), F.desc("event_id")], n).drop("rn").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    run(items, "memory", write)


def merge_memory(epochs: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` per key over all epochs."""
    return top_k(epochs.select("key", "ts", "event_id", "value"), ["key"], [F.desc("ts"), F.desc("event_id")], n, "recency")


# -- L4, L5 -------------------------------------------------------------------------


def stream_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Findings per severity in tumbling or sliding windows, for append mode.

    A window comes out once, when the watermark has passed its end, and its state is freed; rows later
    than ``late`` are dropped.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "severity").agg(F.count(F.lit(1)).alias("n"))


def stream_sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions per key, for append mode: each comes out when the watermark has passed its gap.

    Events of a key are merged to sessions inside every input task before the shuffle, so the task of a
    hot key gets a row per session and input task, not per event.  The setting holds for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", True)
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.count(F.lit(1)).alias("n"))


def stream_dedupe(versions: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Repeated document versions within the watermark are dropped."""
    return versions.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
