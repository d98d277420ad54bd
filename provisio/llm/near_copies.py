r"""Near copies by SimHash fingerprints and exact Jaccard similarity of word shingles.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of at least 0.8; near copies of near copies are one component.  First
the fingerprints of ``simhash`` that lie within ``LIMIT`` bits are probed and linked, and the links whose texts are
similar join components.  No Hamming limit finds all such pairs (at 0.8 fingerprints of 64 bits
lie ten bits apart on average, and more by chance), so the candidates that fingerprints miss come from prefixes:
with the shingles of every text in one order, rare ones first, two texts as
similar as that share a shingle among the first fifth of each.  The order
needs no exact counts; it takes counts of hashed cells.

Then come a few rounds of stars: every shingle has some leaders, drawn by hash, and every component
meets a few of the leaders of its prefix shingles and joins them if the texts are similar.  So a large group of copies costs
rows by its size, not by its square.  What is then still in different components and shares a
prefix shingle is joined on it under three bounds that no near copy can miss: the sizes,
the places of the shingle in both orders, and the Hamming distance of parity
fingerprints (every shingle flips one bit, so two fingerprints differ in at most as many bits as
the sets in shingles).  What passes is compared on the whole sets of shingles.

Words and lower case as in ``simhash``; a text of fewer words is one shingle.
Nulls, empty texts: no shingle, alike among themselves.  Repeated rows are near copies.  Of a
component the row with the least ``doc_id`` stays; rows without an id stay.
Empty table: no rows.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import as_bytes, in_batches, lower_ascii, numbered, settle, words_of
from .graph import components

SHINGLE = 5
#: Most bits in which linked fingerprints differ.
LIMIT = 3
#: Least similarity as a fraction of whole numbers.
NEAR = (4, 5)
#: Cells of the counts that order the shingles.
CELLS = 1 << 18
#: Bits of a parity fingerprint; rounds of stars before the join, which finds whatever they leave, and leaders that a component meets in each.
PARITY, ROUNDS, LEADERS = 1024, 2, 4
TURNS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes are near."""
    if min(len(a), len(b)) * NEAR[1] < max(len(a), len(b)) * NEAR[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR[1] >= (len(a) + len(b) - both) * NEAR[0]


def hashes(text: bytes) -> np.ndarray:
    """Different hashes of the shingles; the hash of no word for an empty text."""
    words = words_of(lower_ascii(text)) or [b""]
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += h[i:len(out) + i] * TURNS[i]
    out ^= out >> np.uint64(32)
    return np.unique(out * TURNS[0])


def cell_counts(rows: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                np.add.at(total, (hashes(text) % np.uint64(CELLS)).astype(np.int64), 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    counted = rows.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return out


def marks(rows: DataFrame) -> DataFrame:
    """(row, n, tokens, parity) of every text.

    n: size of its set of shingles; tokens: the rarest ones in order, as many as a near copy cannot
    miss; parity: the fingerprint, as whole numbers of 64 bits.
    """
    shared = rows.sparkSession.sparkContext.broadcast(cell_counts(rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = shared.value
        sizes, tokens, parities = [], [], []
        for text in as_bytes(batch.column(1)):
            h = hashes(text)
            held = len(h) + (-len(h) * NEAR[0] // NEAR[1]) + 1
            sizes.append(len(h))
            tokens.append(h[np.lexsort((h, counts[(h % np.uint64(CELLS)).astype(np.int64)]))[:held]].view(np.int64))
            bits = np.bincount((h >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) % 2
            parities.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
        lists = [pa.array(c, pa.list_(pa.int64())) for c in (tokens, parities)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["row", "n", "tokens", "parity"])

    return in_batches(rows, ["row", "text"], "row bigint, n int, tokens array<bigint>, parity array<bigint>", run)


def _verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in held:
                if len(held) > 64:
                    held.clear()
                held[text] = hashes(text)
            return held[text]

        near = [similar(of(a), of(b)) for a, b in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = rows.select(F.col("row").alias("a"), F.col("text").alias("left"))
    right = rows.select(F.col("row").alias("b"), F.col("text").alias("right"))
    return in_batches(pairs.join(left, "a").join(right, "b"), ["a", "b", "left", "right"], "a bigint, b bigint", run)


#: Bounds of a pair (x, y): sizes and parity fingerprints, and places of its first common shingle.
ALIKE = f"""
x.n * {NEAR[1]} >= y.n * {NEAR[0]} AND y.n * {NEAR[1]} >= x.n * {NEAR[0]}
AND aggregate(zip_with(x.parity, y.parity, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c) * {sum(NEAR)} <= (x.n + y.n) * {NEAR[1] - NEAR[0]}
"""
PLACED = f"least(x.n - x.at, y.n - y.at) * {sum(NEAR)} >= (x.n + y.n) * {NEAR[0]}"


def _alike(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) within the bounds of sizes and parity fingerprints."""
    return pairs.join(prints.alias("x"), F.col("a") == F.col("x.row")).join(prints.alias("y"), F.col("b") == F.col("y.row")).filter(ALIKE).select("a", "b")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): rows whose fingerprints lie within ``LIMIT`` bits, enough of them to span every component."""
    own = settle(simhash.fingerprints(rows.select(F.col("row").alias("doc_id"), "text")))
    first = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    same = own.join(first, "fp").filter("doc_id != least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    x, y = (first.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_row")) for end in "ab")
    near = simhash.links(first, LIMIT).join(x, "a").join(y, "b")
    return same.unionByName(near.select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"))).distinct()


def _with_roots(held: DataFrame, roots: DataFrame) -> DataFrame:
    """Prefix rows with the component of their text."""
    return held.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def links(rows: DataFrame) -> DataFrame:
    """(a, b): near copies among ``rows`` (row, text), enough of them to span every component."""
    marked = settle(marks(rows))
    prints = marked.select("row", "n", "parity")
    pairs = settle(_alike(fingerprint_pairs(rows), prints))
    found, tried = [settle(_verified(rows, pairs))], pairs
    held = marked.select("row", F.posexplode("tokens").alias("at", "token"))
    shared = held.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1").select("token")
    held = settle(held.join(shared, "token"))
    placed = _with_roots(held, components(found[0], "a", "b"))
    for turn in range(ROUNDS):
        drawn = [F.struct(F.xxhash64("root", F.lit(turn), F.lit(i)).alias("h"), "root", "row") for i in range(LEADERS)]
        leaders = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), *[F.min(d).alias(f"l{i}") for i, d in enumerate(drawn)])
        met = placed.join(leaders.filter("low != high"), "token")
        # Of the leaders that its shingles have, a component meets the least of each draw.
        least = [F.min(F.when(F.col(f"l{i}.root") != F.col("root"), F.struct(f"l{i}", "row"))).alias(f"m{i}") for i in range(LEADERS)]
        one = F.explode(F.array(*[F.struct(F.col(f"m{i}.l{i}.row").alias("to"), F.col(f"m{i}.row").alias("row")) for i in range(LEADERS)]))
        pairs = met.groupBy("root").agg(*least).select(one.alias("pair")).filter("pair.to IS NOT NULL")
        pairs = pairs.select(F.least("pair.to", "pair.row").alias("a"), F.greatest("pair.to", "pair.row").alias("b")).distinct()
        pairs = settle(_alike(pairs, prints).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        found.append(settle(_verified(rows, pairs)))
        if found[-1].isEmpty():
            break
        placed = settle(_with_roots(held, components(reduce(DataFrame.unionByName, found), "a", "b")))
    # What is left: rows that share a prefix shingle but no component.
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("token")
    left = settle(placed.join(mixed, "token").join(prints, "row"))
    x, y = left.alias("x"), left.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & F.expr(PLACED) & F.expr(ALIKE))
    pairs = pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return reduce(DataFrame.unionByName, [*found, _verified(rows, settle(pairs))])


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one with the least id."""
    rows, number = numbered(docs)
    roots = components(links(rows.select(F.col(number).alias("row"), "text")), "a", "b")
    ids = rows.select("doc_id", F.col(number).alias("node")).join(roots, "node")
    # A component's rows without an id stay as well, but stand for no other.
    least = ids.filter("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    gone = ids.filter("doc_id IS NOT NULL").join(least, "root").filter("node != least.node").select(F.col("node").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)
