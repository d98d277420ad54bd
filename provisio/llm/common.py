"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.session import shared_folder

#: Spark drops the shuffle files of a finished execution under this setting; a settled table does not need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors: every later read
    finds the files in the folder that ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a settled table with a number for every row, and the name of that column, which ``df`` has not."""
    name = "__row"
    while name in df.columns:
        name += "_"
    return settle(df.withColumn(name, F.monotonically_increasing_id())), name


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def in_batches(
    df: DataFrame, columns: list[str], schema: str, fn: Callable[[dict[str, list]], Iterable[pa.RecordBatch] | pa.RecordBatch]
) -> DataFrame:
    """``mapInArrow`` over some columns; ``fn`` gets each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.select(*columns).mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def lower_ascii(text: bytes) -> bytes:
    """A-Z lower-cased and nothing else (``bytes.lower`` knows ASCII only)."""
    return text.lower()


def words_of(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` (``bytes.split`` parts at just these)."""
    return text.split()


def vocabulary(name: str) -> str:
    """Place of an installed public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
