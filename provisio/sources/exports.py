"""Sample export with masking and truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provisio.operators.skew import top_k

# Hidden columns and width limits.
HIDDEN = ("password_hash", "embedding")
WIDTHS = {"full_text": 200, "chunk_text": 200, "content": 200, "title": 120}
JSON_WIDTH, OTHER_WIDTH = 300, 500


def _shown(field: T.StructField) -> Column:
    c = F.col(field.name)
    if field.name in HIDDEN:
        return F.lit("[hidden]").alias(field.name)
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.substring(F.to_json(c), 1, JSON_WIDTH).alias(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.substring(c, 1, WIDTHS.get(field.name, OTHER_WIDTH)).alias(field.name)
    return c


def sample_export(table: DataFrame, n: int, stratum: Column | None = None, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """``n`` rows per stratum, masked for display.

    With ``key`` columns the sample is the ``n`` rows of least priority, the MD5 of seed and key: the same rows whatever
    the partitions, and the samples of two parts hold the sample of both.  Without a key rows are drawn at random.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key or []]
    priority = F.md5(F.concat_ws(":", F.lit(str(seed)), *text)) if key else F.rand(seed)
    drawn = table.withColumn("__s", F.lit(1) if stratum is None else stratum).withColumn("__r", priority)
    kept = top_k(drawn, ["__s"], ["__r", *(key or [])], n).drop("__s", "__r", "rn")
    return kept.select(*[_shown(f) for f in table.schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)
