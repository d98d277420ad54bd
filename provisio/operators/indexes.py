"""Stored indexes: vectors by cell and postings by word, so that a search reads only what it needs.

Both are plain parquet folders, written once and read by partition.  The vector index keeps one
folder per cell of a coarse quantiser; a search reads the cells that its queries probe.  The text
index keeps the positions of every word of every chunk in buckets of words, sorted by
word; a search reads the postings of its words and never the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions.text import tokens
from provisio.operators import search, wordsets

#: Vectors that the quantiser is fitted on, most cells (their centres go to every task), and rows of one group of a search.
SAMPLE, MOST_CELLS, GROUP_ROWS = 100_000, 4096, 50_000
BUCKETS = 64


def _write(rows: DataFrame, folder: str, table: str, by: str) -> None:
    """A table in one folder per value of ``by``; its schema lies beside it, as it may have no rows."""
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/{table}-schema")
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{folder}/{table}")


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/{table}-schema").schema).parquet(f"{folder}/{table}")


# -- G3: vectors by cell -----------------------------------------------------------


def write_vector_index(corpus: DataFrame, folder: str, n_cells: int | None = None, sample: int = SAMPLE, seed: int = 42) -> None:
    """Index every row of ``corpus`` (path, embedding) with a vector; cells grow with the root of the rows.

    The centres are fitted on at most about ``sample`` vectors, drawn by the hash of their paths.
    """
    spark = corpus.sparkSession
    rows = corpus.select("path", "embedding").filter("embedding is not null")
    total = rows.count()
    cells = min(MOST_CELLS, n_cells or max(4, math.isqrt(total) // 2), max(1, total))
    share = F.pmod(F.xxhash64("path"), F.lit(1_000_000)) < math.ceil(min(1.0, sample / max(total, 1)) * 1_000_000)
    centers = search._unit(search.train_cells(rows.filter(share), cells, seed)) if total else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = search._unit(np.stack(b["embedding"].to_numpy()).astype(np.float64))
                yield b.assign(cell=np.argmax(v @ shared.value.T, axis=1).astype("int32"))

    placed = rows.mapInPandas(assign, f"path string, embedding {corpus.schema['embedding'].dataType.simpleString()}, cell int")
    # A large cell is written by several tasks.
    spread = F.pmod(F.xxhash64("path"), F.lit(max(1, total // cells // GROUP_ROWS)))
    _write(placed.repartition("cell", spread), folder, "vectors", "cell")
    _read(spark, folder, "vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/sizes")
    named = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(named, "cell int, center array<double>").write.mode("overwrite").parquet(f"{folder}/centers")


def probes(queries: DataFrame, folder: str, n: int) -> DataFrame:
    """``query_id, embedding, cell``: the ``n`` cells nearest to every query."""
    known = sorted((r["cell"], r["center"]) for r in queries.sparkSession.read.parquet(f"{folder}/centers").collect())  # at most MOST_CELLS rows
    shared = queries.sparkSession.sparkContext.broadcast(np.asarray([c for _, c in known]))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                q = search._unit(np.stack(b["embedding"].to_numpy()).astype(np.float64))
                cells = np.argsort(-(q @ shared.value.T), axis=1, kind="stable")[:, :n]
                yield b.assign(cells=[c.astype("int32").tolist() for c in cells])

    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding").filter("embedding is not null")
    kind = queries.schema["embedding"].dataType.simpleString()
    found = rows.mapInPandas(near, f"query_id string, embedding {kind}, cells array<int>")
    return found.select("query_id", "embedding", F.explode("cells").alias("cell"))


def probed_vectors(asked: DataFrame, folder: str) -> DataFrame:
    """The stored vectors of the cells in ``asked``; folders of other cells are not opened."""
    cells = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # at most MOST_CELLS
    return _read(asked.sparkSession, folder, "vectors").filter(F.col("cell").isin(cells))


def knn_index(queries: DataFrame, folder: str, n: int, n_probes: int = 4, group_rows: int = GROUP_ROWS, block: int = search.QUERY_BLOCK) -> DataFrame:
    """Top-n within the probed cells: ``query_id, path, score, rank0``; with all cells probed the exact result.

    Queries and vectors are dealt to groups of bounded size by the shuffle: a large cell is cut into slices,
    the queries of a cell into blocks, and each (cell, slice, block) yields the best ``n`` per query.
    """
    asked = probes(queries, folder, n_probes)
    sizes = queries.sparkSession.read.parquet(f"{folder}/sizes").select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / group_rows)).cast("int").alias("slices"))
    met = asked.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    plan = sizes.join(met, "cell")  # one row per cell
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = asked.join(F.broadcast(plan), "cell").withColumn("b", part("query_id", "blocks")).withColumn("s", span("slices"))
    right = probed_vectors(asked, folder).join(F.broadcast(plan), "cell").withColumn("s", part("path", "slices")).withColumn("b", span("blocks"))

    def cell(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        ids = a["query_id"].tolist()
        best = search._Best(len(ids), n)
        if len(a) and len(c):
            paths = c["path"].map(lambda path: [path]).to_numpy()
            search._add_all(best, search._units(a["embedding"]), search._units(c["embedding"]), paths)
        return best.frame(ids)

    by = ["cell", "s", "b"]
    pairs = left.select("query_id", "embedding", *by).groupBy(*by).cogroup(right.select("path", "embedding", *by).groupBy(*by))
    return search._merge(pairs.applyInPandas(cell, search.HIT_SCHEMA), n)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``recall``: share of the exact (query_id, path) rows that were found."""
    both = exact.select("query_id", "path").join(found.select("query_id", "path", F.lit(1).alias("hit")), ["query_id", "path"], "left")
    return both.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


# -- G4: postings by word ----------------------------------------------------------


def postings(words: DataFrame) -> DataFrame:
    """``word, path, at`` of ``path, body``: the places of each word of a text, grouped inside its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, list[int]]] = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places: dict[str, list[int]] = {}
                for at, word in enumerate(body or ()):
                    places.setdefault(word, []).append(at)
                rows += [(word, path, at) for word, at in places.items()]
            if rows:
                kinds = (pa.string(), pa.string(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["word", "path", "at"])

    return words.select("path", "body").mapInArrow(run, "word string, path string, at array<int>")


def write_text_index(corpus: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Postings ``word, path, at`` of ``corpus`` (path, chunk_text) in buckets of words, and ``word, df``."""
    spark = corpus.sparkSession
    posts = postings(corpus.select("path", tokens(F.col("chunk_text")).alias("body")))
    posts = posts.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    # A frequent word's postings spread over tasks by path; files are sorted, so statistics tell words apart.
    dealt = posts.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8))).sortWithinPartitions("bucket", "word")
    _write(dealt, folder, "postings", "bucket")
    count = _read(spark, folder, "postings").groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("df"))
    _write(count, folder, "words", "bucket")


def _of(asked: DataFrame, folder: str, table: str, buckets: int) -> DataFrame:
    """The stored rows of the asked words' buckets."""
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    held = sorted(r[0] for r in asked.select(bucket).distinct().collect())  # at most ``buckets``
    return _read(asked.sparkSession, folder, table).filter(F.col("bucket").isin(held)).drop("bucket")


def fts_index(queries: DataFrame, folder: str, n: int, buckets: int = BUCKETS) -> DataFrame:
    """Top-n chunks that hold all words of a query, from the postings alone: ``query_id, path, score, rank0``.

    Queries with a word that no chunk holds have no match.  The postings of the other queries' words are
    gathered by chunk, as many rows as they are, and each chunk meets the word sets that it holds.
    """
    asked = wordsets.keyed(search.query_words(queries))
    words = asked.select("key", F.explode(F.split("key", " ")).alias("word")).distinct()
    known = words.join(_of(words, folder, "words", buckets), "word", "left")
    whole = known.groupBy("key").agg(F.count("df").alias("held"), F.count(F.lit(1)).alias("m")).filter("held = m").select("key")
    parts = []
    for keys in wordsets.key_blocks(whole):
        wanted = queries.sparkSession.createDataFrame([(w,) for w in sorted({w for key in keys for w in key.split(" ")})], "word string")
        posts = _of(wanted, folder, "postings", buckets).join(F.broadcast(wanted), "word", "left_semi")
        texts = posts.groupBy("path").agg(F.collect_list(F.struct("word", "at")).alias("held"))
        parts.append(wordsets.search_places(texts, keys, n, search.DIGITS))
    return wordsets.merged(parts, asked, n)
