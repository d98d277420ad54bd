r"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits.  Correlated bits are grouped into partitions; every
fingerprint gets its own threshold for each partition (-1: not probed, 0: equal
values, 1: values one bit apart) by dynamic programming over estimated candidate
counts, such that the thresholds sum to ``limit - partitions + 1``.  Whatever
lies within ``limit`` bits then meets it in some probed partition; candidates
are verified on all bits, and the links make components.

Nulls, empty texts: no words, fingerprint zero, linked like any other.  Repeated
rows and ties: equal fingerprints are one node.  A null ``doc_id`` keeps its row;
it names a component only where no other id is there (then null).  Empty table:
no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_batches, lower_ascii, settle, words_of
from .graph import components

BITS = 64
PARTS = 4
WIDTH = BITS // PARTS
CELLS = 1 << WIDTH
#: Rows of one side of a comparison block.
BLOCK = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 18


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included."""
    words = words_of(lower_ascii(text))
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(line)]
    ends = ends[min(shingle, len(words)) - 1:]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, CHUNK):
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return in_batches(docs, ["doc_id", "text"], "doc_id bigint, fp bigint", run)


def _bits(column: pa.Array) -> np.ndarray:
    fp = column.to_numpy(zero_copy_only=False).astype("<i8")
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_order(distinct: DataFrame) -> list[int]:
    """Bits in an order whose runs of ``WIDTH`` belong together.

    Co-occurrence counts of all fingerprints (64 x 64 sums, whatever the
    size) give correlations; each partition grows greedily around the bit with the
    most correlation left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            bits = _bits(batch.column(0)).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        values = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "v"])

    sums = distinct.select("fp").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return list(range(BITS))
    values = np.zeros(BITS * BITS + 1)
    for row in sums:
        values[row["cell"]] = row["v"]
    n = max(values[-1], 1)
    both = values[:-1].reshape(BITS, BITS) / n
    one = np.diag(both)
    spread = np.sqrt(np.maximum(np.outer(one * (1 - one), one * (1 - one)), 1e-12))
    tie = np.abs((both - np.outer(one, one)) / spread)
    np.fill_diagonal(tie, 0)
    left, order = set(range(BITS)), []
    for _ in range(PARTS):
        group: list[int] = []
        while len(group) < WIDTH:
            pool = sorted(left)
            score = tie[np.ix_(pool, group)].sum(axis=1) if group else tie[np.ix_(pool, pool)].sum(axis=1)
            group.append(pool[int(np.argmax(score))])
            left.discard(group[-1])
        order += group
    return order


def _values(column: pa.Array, order: list[int]) -> np.ndarray:
    """n x PARTS partition values."""
    packed = np.ascontiguousarray(np.packbits(_bits(column)[:, order], axis=1, bitorder="little"))
    return packed.view("<u2").astype(np.int64)


def cell_counts(distinct: DataFrame, order: list[int]) -> np.ndarray:
    """How many fingerprints have each value of each partition: PARTS x 65 536 numbers at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PARTS * CELLS, np.int64)
        for batch in batches:
            total += np.bincount((_values(batch.column(0), order) + np.arange(PARTS) * CELLS).ravel(), minlength=PARTS * CELLS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["cell", "n"])

    out = np.zeros(PARTS * CELLS, np.int64)
    counted = distinct.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return out.reshape(PARTS, CELLS)


def allocate(values: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Thresholds (n x PARTS) of least estimated cost whose sum is ``limit - PARTS + 1``.

    A threshold costs the candidates it is expected to bring and the probes it takes.
    """
    near = np.stack([sum(c[np.arange(CELLS) ^ (1 << b)] for b in range(WIDTH)) for c in counts])
    n, levels = len(values), (-1, 0, 1)
    top = limit - PARTS + 1
    if not -PARTS <= top <= PARTS:
        raise ValueError(f"limit {limit} needs thresholds beyond -1, 0 and 1 in {PARTS} partitions")
    low = -PARTS
    best = np.full((n, 2 * PARTS + 1), np.inf)
    best[:, -low] = 0
    picks = []
    for p in range(PARTS):
        own, around = counts[p, values[:, p]], near[p, values[:, p]]
        costs = {-1: np.zeros(n), 0: own + 1.0, 1: own + around + 1.0 + WIDTH}
        reach = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int8)
        for t in levels:
            moved = np.full_like(best, np.inf)
            span = best.shape[1]
            lo, hi = max(0, t), min(span, span + t)
            moved[:, lo:hi] = best[:, lo - t:hi - t] + costs[t][:, None]
            better = moved < reach
            reach[better] = moved[better]
            pick[better] = t
        best = reach
        picks.append(pick)
    at = np.full(n, top - low)
    out = np.zeros((n, PARTS), np.int64)
    for p in reversed(range(PARTS)):
        out[:, p] = picks[p][np.arange(n), at]
        at = at - out[:, p]
    return out


def probes(distinct: DataFrame, limit: int) -> DataFrame:
    """(cell, block, asks, fp): fingerprints dealt to comparison blocks of bounded size.

    A cell with many fingerprints is cut into slices of about ``BLOCK``; each
    stored slice meets each asking slice in a block of its own.
    """
    order = bit_order(distinct)
    counts = cell_counts(distinct, order)
    shared = distinct.sparkSession.sparkContext.broadcast(counts)
    flips = np.array([0, *(1 << b for b in range(WIDTH))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        values = _values(batch.column(0), order)
        limits = allocate(values, counts, limit)
        lot = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        for p in range(PARTS):
            v = values[:, p]
            slices = -(-counts[p] // BLOCK)
            sides = [(v, np.arange(len(fp)), 0)]
            for t in (0, 1):
                rows = np.flatnonzero(limits[:, p] >= t)
                for flip in flips[:1] if t == 0 else flips[1:]:
                    sides.append((v[rows] ^ flip, rows, 1))
            for cell, rows, asks in sides:
                full = counts[p, cell] > 0
                cell, rows = cell[full], rows[full]
                # stored slices (asks = 0) meet asking slices; both sides are cut by the number stored
                cut = np.maximum(slices[cell], 1)
                for other in range(int(cut.max(initial=0))):
                    on = other < cut
                    own = (lot[rows[on]] % cut[on].astype(np.uint64)).astype(np.int64)
                    stored, asking = (own, np.full(len(own), other)) if asks == 0 else (np.full(len(own), other), own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p * CELLS + cell[on]), pa.array(stored * (1 << 20) + asking), pa.array(np.full(len(own), asks, np.int8)), pa.array(fp[rows[on]])],
                        ["cell", "block", "asks", "fp"],
                    )

    return in_batches(distinct, ["fp"], "cell bigint, block bigint, asks tinyint, fp bigint", run)


def _compare(fp: np.ndarray, asks: np.ndarray, group: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between askers and stored rows of each group (sorted by group)."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    at = np.arange(len(fp) - 1)
    step = 1
    while True:
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return a, b
        x, y = fp[at], fp[at + step]
        near = (np.bitwise_count(x ^ y) <= limit) & (x != y) & (asks[at] != asks[at + step])
        for i in at[near].tolist():
            p, q = root(i), root(i + step)
            if p != q:
                parent[q] = p
                a.append(i)
                b.append(i + step)
        step += 1


def links(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b): fingerprints within ``limit`` bits, enough of them to span every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: np.ndarray | None = None  # rows of the block that may go on in the next batch

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            key = np.cumsum(np.r_[False, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            fp = rows[3].view(np.uint64)
            a, b = _compare(fp, rows[2], key, limit)
            return pa.RecordBatch.from_arrays([pa.array(rows[3][a]), pa.array(rows[3][b])], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = rows if kept is None else np.concatenate([kept, rows], axis=1)
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            done, kept = rows[:, ~last], rows[:, last]
            if done.shape[1]:
                yield solve(done)
        if kept is not None and kept.shape[1]:
            yield solve(kept)

    blocks = probes(distinct, limit).repartition("cell", "block").sortWithinPartitions("cell", "block")
    return blocks.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    own = settle(fingerprints(docs, shingle))
    distinct = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct, limit), "a", "b")
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one whose id names it.

    Rows whose ``doc_id`` repeats or is null are no other than their texts: the
    first of equal ids stays, and rows without an id stay.
    """
    found = near_duplicates(docs, shingle, limit).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
