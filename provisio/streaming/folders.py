"""Document folders as a stream: files arrive one by one, in any order and over many batches.

State holds the names and places of the files of each folder, not their texts.  A folder
whose required files are all there comes out, and again whenever one of its files is new or
changed; only the files of those folders are read.  Every batch writes the parsed files of its
folders into one partition per epoch in overwrite mode, so a replayed batch
replaces itself.  When a run has read all that is there, :func:`build` makes the base tables of its
folders, once for all its batches.  :func:`current` keeps the newest epoch of each folder and leaves out
folders inside other ones; :func:`tables` derives edges, stubs and warnings with the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provisio.operators import ingest
from provisio.sources import folders
from provisio.streaming import jobs

FILES = "path string, modificationTime timestamp, length long, content binary"
READY = "folder string, names array<string>, paths array<string>, version timestamp"
STATE = "names array<string>, paths array<string>, modified array<timestamp>"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
NAMES = (*folders.REQUIRED, folders.RELATIONS, folders.AMENDMENTS)


def place(root: str) -> tuple[Column, Column]:
    """Folder below ``root`` and name of a file, from its path."""
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return F.regexp_replace(rel, r"/?[^/]*$", ""), F.substring_index(rel, "/", -1)


def file_stream(spark: SparkSession, root: str, per_batch: int) -> DataFrame:
    """``path, modified`` of new and changed files below ``root``, at most ``per_batch`` at once; contents are not read."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", per_batch).load(root).select("path", F.col("modificationTime").alias("modified"))


def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Files of one folder so far; the folder comes out while it is complete and something came in."""
    held = {n: (p, m) for n, p, m in zip(*state.get)} if state.exists else {}
    for frame in frames:
        for name, path, modified in zip(frame["name"], frame["path"], frame["modified"]):
            if name not in held or pd.Timestamp(held[name][1]) <= modified:
                held[name] = (path, modified)
    state.update(([*held], [p for p, _ in held.values()], [m for _, m in held.values()]))
    if all(name in held for name in folders.REQUIRED):
        yield pd.DataFrame({"folder": [key[0]], "names": [[*held]], "paths": [[p for p, _ in held.values()]], "version": [max(m for _, m in held.values())]})


def complete_folders(files: DataFrame, folder: Column, name: Column) -> DataFrame:
    """``folder, files, version`` of folders that are complete and have news."""
    known = files.select(folder.alias("folder"), name.alias("name"), "path", "modified")
    known = known.filter(F.col("name").isin(*NAMES) & ~F.col("folder").rlike(r"(^|/)\."))
    return known.groupBy("folder").applyInPandasWithState(gather, READY, STATE, "update", GroupStateTimeout.NoTimeout)


def read_artifacts(ready: DataFrame) -> DataFrame:
    """Artifacts of the folders of one batch; a batch lists at most ``per_batch`` new files, so few folders."""
    spark = ready.sparkSession
    files = ready.select("folder", F.explode(F.arrays_zip("names", "paths")).alias("f")).select("folder", F.col("f.names").alias("name"), F.col("f.paths").alias("path"))
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        text = files.select("path", F.lit(None).cast("string").alias("value"))
    else:
        text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # Listed and read paths can be written with one slash or three after the scheme.
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    text = files.withColumn("path", plain("path")).join(text.withColumn("path", plain("path")), "path", "left")
    return folders.parse_artifacts(text.select("folder", "name", "value"))


def stream_folders(
    spark: SparkSession, root: str, target: str, as_of, per_batch: int = 1000, where: tuple[Column, Column] | None = None, checkpoint: str | None = None
) -> None:
    """Read all files that are new since ``checkpoint`` and write the base tables of their folders below ``target``.

    ``where``: folder and name of a file, from its ``path`` (default: the parent folder and the file name).
    """
    folder, name = where or place(root)

    def write(batch: DataFrame, epoch: int) -> None:
        def keep(table: str, rows: DataFrame) -> DataFrame:
            path = f"{target}/{table}/epoch={epoch}"
            rows.write.mode("overwrite").parquet(path)
            return rows.sparkSession.read.schema(rows.schema).parquet(path)

        ready = keep("folders", batch)
        if not ready.isEmpty():
            keep("artifacts", read_artifacts(ready))

    # Every file is a path of its own; by default Spark lists up to 10 000 paths with a task each.
    listing = spark.conf.get(LISTING)
    spark.conf.set(LISTING, 4 * spark.sparkContext.defaultParallelism)
    try:
        jobs.run(complete_folders(file_stream(spark, root, per_batch), folder, name), "folders", write, "update", checkpoint)
    finally:
        spark.conf.set(LISTING, listing)
    build(spark, target, as_of)


def _stored(spark: SparkSession, target: str, table: str, part: str = "epoch") -> DataFrame:
    return spark.read.option("basePath", f"{target}/{table}").parquet(f"{target}/{table}/{part}=*")


def _last_built(spark: SparkSession, target: str) -> int:
    """Last epoch whose folders are in the base tables."""
    try:
        return _stored(spark, target, "built", "run").agg(F.max("run")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def build(spark: SparkSession, target: str, as_of) -> None:
    """Base tables of the folders in all epochs that are not built yet, in one pass.

    A run is named by its last epoch and logged at its end; a run that broke off is not
    in the log, does not count and is built again.
    """
    done = _last_built(spark, target)
    try:
        news = _stored(spark, target, "folders").filter(F.col("epoch") > done)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    newest = news.groupBy("folder").agg(F.max("epoch").alias("epoch"))
    last = newest.agg(F.max("epoch")).first()[0]
    if last is None:
        return

    def keep(table: str, rows: DataFrame) -> DataFrame:
        path = f"{target}/{table}/run={last}"
        rows.join(newest, "folder").write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    art = _stored(spark, target, "artifacts").filter(F.col("epoch") > done).join(newest, ["folder", "epoch"], "left_semi").drop("epoch")
    ingest.base_tables(art, as_of, keep)
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{target}/built/run={last}")


def current(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """Base tables of the newest epoch of every folder that lies in no other complete folder."""
    newest = _stored(spark, target, "folders").groupBy("folder").agg(F.max("epoch").alias("epoch"))
    newest = folders.outermost(newest)
    runs = _stored(spark, target, "built", "run").select("run").distinct()
    built = lambda t: _stored(spark, target, t, "run").join(F.broadcast(runs), "run", "left_semi")
    return {t: built(t).join(newest, ["folder", "epoch"], "left_semi").drop("run", "epoch") for t in ingest.BASE}


def tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The corpus tables as they stand, equal to ``ingest.corpus_tables`` over the files so far."""
    return ingest.derived_tables(current(spark, target))
