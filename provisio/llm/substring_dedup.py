r"""Repeated spans by compaction of a word de Bruijn graph.

Edges are windows of ``span`` consecutive words.  A run of windows of one document
that share their minimizer (the least hashed ``KMER`` words in them, leftmost in
ties) is one path; equal windows have equal minimizers at equal places, so equal
windows always lie on paths of one minimizer.  Paths of a minimizer that are all
the same do not branch: they are compacted and counted whole.  Where different
paths meet in a minimizer, one copy of each different path is read again at its
source coordinates and its edges are counted one by one.  Joins bring the
repeated edges back to every document, whose words are then checked off.

A window is repeated if its words also start anywhere else, in the same document
too; all its words go, in every place.  Windows are judged on the input.  Paths and
edges are told apart by 128 bits: those of the minimizer and of the words.

Words are ``[^\x20\x09-\x0D]+``.  Null and empty texts: no words, nothing removed,
digest of the empty text.  Texts with fewer words than a window: nothing removed.
Repeated rows repeat each other's windows.  Null ids are a value like others.  Empty
table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, settle, words_of

KMER = 8
#: Words of several documents that are hashed together.
CHUNK = 400_000
#: Odd multipliers of the rolling hashes.
BASE_KMER, BASE_PATH = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
INVERSE = pow(BASE_PATH, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hash of any range of one array of word hashes."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(BASE_PATH, len(h)), dtype=np.uint64)])
        self.back = _powers(INVERSE, len(h) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _minimizers(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers, and for each window the place of its least one."""
    k = min(KMER, span)
    kmer = np.zeros(len(h) - k + 1, np.uint64)
    for power, j in zip(_powers(BASE_KMER, k), range(k)):
        kmer += h[j:j + len(kmer)] * power
    kmer = _mix(kmer)
    value, place, width, wide = kmer, np.arange(len(kmer)), 1, span - k + 1
    while width < wide:
        step = min(width, wide - width)
        left, right = value[:-step], value[step:]
        first = left <= right
        value, place = np.where(first, left, right), np.where(first, place[:-step], place[step:])
        width += step
    return kmer, place


def paths(h: np.ndarray, bounds: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, minimizer, path hash) of every path.

    ``bounds``: where documents begin and end in ``h``.
    """
    if len(h) < span:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    kmer, place = _minimizers(h, span)
    at = np.arange(len(h) - span + 1)
    doc = np.searchsorted(bounds, at, side="right") - 1
    at = at[at + span <= bounds[doc + 1]]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place, doc = place[at], doc[at]
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    start = at[first]
    return doc[first], start - bounds[doc[first]], count, kmer[place[first]].view(np.int64), Ranges(h).of(start, start + count + span - 1).view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first document, words, bounds) of runs of documents with about CHUNK words."""
    first, words, bounds = 0, [], [0]
    for i, text in enumerate(texts):
        words += words_of(text)
        bounds.append(len(words))
        if len(words) >= CHUNK or i + 1 == len(texts):
            yield first, words, np.array(bounds)
            first, words, bounds = i + 1, [], [0]


def _path_table(rows: DataFrame, span: int) -> DataFrame:
    """One row per document: its key and its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for first, words, bounds in _chunks(as_bytes(batch.column(2))):
                n = len(bounds) - 1
                doc, start, count, mini, path = paths(_hashes(words), bounds, span)
                cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                arrays = [batch.column(0).slice(first, n), batch.column(1).slice(first, n)]
                arrays += [
                    pa.ListArray.from_arrays(cuts, pa.array(v, t))
                    for v, t in ((mini, pa.int64()), (path, pa.int64()), (start, pa.int32()), (count, pa.int16()))
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "h", "mini", "path", "start", "n"])

    return rows.select("id", "h", "text").mapInArrow(
        run, "id bigint, h bigint, mini array<bigint>, path array<bigint>, start array<int>, n array<smallint>"
    )


def _edges(rows: DataFrame, span: int) -> DataFrame:
    """(mini, path, at, edge): every window of the paths listed in ``todo``, read at its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, todo in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                ranges = Ranges(_hashes(words_of(text)))
                mini, path, start, n = (np.array([x[c] for x in todo], np.int64) for c in ("mini", "path", "start", "n"))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(start, n) + at
                edge = ranges.of(begin, begin + span).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(mini, n)), pa.array(np.repeat(path, n)), pa.array(at, pa.int32()), pa.array(edge)],
                    ["mini", "path", "at", "edge"],
                )

    return rows.select("text", "todo").mapInArrow(run, "mini bigint, path bigint, at int, edge bigint")


def _checked(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` (doc_id, text, gone) with the words of repeated windows taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total, removed, digest = [], [], []
            for text, gone in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = words_of(text)
                lost = np.zeros(len(words) + 1, np.int64)
                for start, mask in ((x["start"], x["mask"]) for x in gone or ()):
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        lost[start + low] += 1
                        lost[start + low + span] -= 1
                        mask &= mask - 1
                keep = np.cumsum(lost[:-1]) == 0
                kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return rows.select("doc_id", "text", "gone").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )


def repeated_paths(docs: DataFrame, span: int = 35) -> DataFrame:
    """(id, h, gone): the repeated windows of each row that has any; ``gone`` holds start and mask of each path."""
    table = settle(_path_table(docs, span))
    every = table.select("id", "h", F.explode(F.arrays_zip("mini", "path", "start", "n")).alias("p")).select("id", "h", "p.*")
    # Minimizers met at least twice; they branch where their paths differ.  Tables that hot keys are joined
    # with are settled first: both sides of the join are then plain shuffles, whose hot partitions Spark splits.
    met = settle(
        every.groupBy("mini").agg(F.count("*").alias("times"), F.min("path").alias("a"), F.max("path").alias("b"))
        .filter("times > 1").select("mini", (F.col("a") != F.col("b")).alias("branches"))
    )
    found = settle(every.join(met, "mini"))
    straight = found.filter("NOT branches").select("id", "h", "start", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    # One copy of each path that shares its minimizer with another.
    crossing = found.filter("branches")
    source = F.struct("id", "h", "start", "n")
    one = crossing.groupBy("mini", "path").agg(F.count("*").alias("times"), F.min(source).alias("s"))
    one = settle(one.select("mini", "path", "times", "s.*"))
    todo = one.groupBy("id", "h").agg(F.collect_list(F.struct("mini", "path", "start", "n")).alias("todo"))
    edges = settle(_edges(docs.dropDuplicates(["id", "h"]).join(todo, ["id", "h"]), span))
    twice = settle(edges.groupBy("mini", "edge").agg(F.count("*").alias("times")).filter("times > 1").select("mini", "edge"))
    masks = edges.join(twice, ["mini", "edge"]).groupBy("mini", "path").agg(F.expr("bit_or(shiftleft(1L, at))").alias("part"))
    masks = settle(one.join(masks, ["mini", "path"], "left").select(
        "mini", "path", F.when(F.col("times") > 1, F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("part")).alias("mask"),
    ).filter("mask IS NOT NULL"))
    crossed = crossing.join(masks, ["mini", "path"]).select("id", "h", "start", "mask")
    return straight.unionByName(crossed).groupBy("id", "h").agg(F.collect_set(F.struct("start", "mask")).alias("gone"))


def remove_repeats(docs: DataFrame, span: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 62))).cast("bigint").alias("id"), F.xxhash64("text").alias("h"),
    )
    gone = settle(repeated_paths(rows, span))
    return _checked(rows.join(gone, ["id", "h"], "left"), span)
