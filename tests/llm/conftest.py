from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows(spark):
    """Documents of a small table as (doc_id, text)."""

    def get(folder="/root/testdata/sf0.01"):
        return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]

    return get


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table with clashing extra columns from (doc_id, text) pairs."""

    def make(pairs, extra="score double, found string, slot int, hit string, key string, h bigint"):
        names = [c.split()[0] for c in extra.split(", ")]
        schema = f"{DOCS}, {extra}"
        data = [(i, t, None, None, None, *[None] * len(names)) for i, t in pairs]
        return spark.createDataFrame(data, schema).repartition(3)

    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a  b\tc d"), (8, "a b c d"),
    (None, "a b c d"), (9, LONG), (10, LONG + " tail"), (11, "x " * 400), (12, "é ü 漢字 😀 \x1c z"), (12, "é ü 漢字 😀 \x1c z"),
]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties, repeated rows and a null id."""
    return list(ODD)
