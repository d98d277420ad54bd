"""From raw documents to packed sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
All but the last return the columns of ``documents``; the last returns the pieces of
the sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

1. toxicity: rows that score 0.5 or more go.
2. exact dedup: of texts that are equal but for white space one row stays.
3. near-dedup: of each component of texts whose sets of five-word shingles have a Jaccard
   similarity of at least 0.8 the row with the least id stays.
4. benchmark decontamination: rows that hold ten consecutive words of a benchmark item go.
5. best-fit packing: the rest is tokenised and packed.

Nulls, empty texts, ties, repeated rows and extra columns are treated as each operator says;
an empty table makes an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provisio.llm import decontaminate, exact_dedup, near_copies, packing, toxicity
from provisio.llm.common import read, settle, vocabulary

#: No SQL engine tokenises or votes; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
