"""Packing of tokenised documents into sequences by vector best-fit.

A bin has three capacities: tokens, documents, and attention cost (the sum of
squared lengths).  Pieces differ by their length alone, so bins are chosen on the
counts of lengths of the whole corpus (at most ``tokens`` numbers whatever its
size): the longest piece left opens a bin; then the length is added that fits
every residual capacity and has the largest weighted dot product with them (or
leaves the smallest weighted residual norm), where a length, or two together, that
fills the tokens exactly goes first.  The bin is repeated as often as the counts
allow.  Every piece then finds its place by its rank among the pieces of its
length, by binary search in the list of bins.

Only documents longer than a sequence are cut.  Null and empty texts are the end
token alone.  Repeated rows are packed each for itself.  Empty table: no rows.  Other
columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Chunks and words that a worker remembers in each of two generations, and the longest chunk of them.
REMEMBERED, LONGEST = 300_000, 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"

#: Chunks for which the tokenizer's own steps are plain: composed Latin letters, printable ASCII.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]{1,64}")
# Fixed value: how the vocabulary's file parts such chunks into words, in lower case.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
SPECIAL = "<|"

_encoders: dict[str, Encoder] = {}


class Recent(dict):
    """A memory of at most two generations: what is asked for stays, the rest is forgotten."""

    def __init__(self, make: Callable, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        if len(key) <= LONGEST:
            self[key] = value
        return value


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    White space of ASCII never lies inside a token of this vocabulary, nor does a
    step of the tokenizer look across it, so the chunks between are encoded each for itself
    and remembered.  Plain chunks fall into words, which the tokenizer's model splits; all others
    take the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: letters.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))})
        self.words = Recent(self._word)
        self.chunks = Recent(self._chunk)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "surrogatepass")
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One for each worker process."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def tokenised(docs: DataFrame, tokenizer: str, tokens: int, end: int = 0) -> DataFrame:
    """Pieces of at most ``tokens`` ids; ``place`` counts the pieces of equal length in the task."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out: list[list] = [[] for _ in range(7)]
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = encoder.encode(text or "") + tail
                    for piece, start in enumerate(range(0, len(ids), 4 * tokens)):
                        own = ids[start:start + 4 * tokens]
                        n = len(own) // 4
                        for column, v in zip(out, (doc_id, piece, start // 4, n, zlib.crc32(own), part, int(seen[n]))):
                            column.append(v)
                        seen[n] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan_bins(
    counts: dict[int, int], tokens: int, documents: int, cost: float, rule: str = "dot", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(length, copies), ...]) of every bin, for ``counts`` of lengths.

    Raises ValueError for a piece that no empty bin can hold.
    """
    left = np.zeros(tokens + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= tokens or length * length > cost or documents < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left[length] = n
    sizes = np.arange(tokens + 1, dtype=np.float64)
    full = np.array([tokens, documents, cost], np.float64)
    demand = np.stack([sizes, np.ones_like(sizes), sizes * sizes], axis=1) / full
    w = np.array(weights)
    out = []
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return out
        used: dict[int, int] = {}
        rest = full.copy()
        free = left.copy()

        def put(length: int) -> None:
            used[length] = used.get(length, 0) + 1
            free[length] -= 1
            rest[:] -= (length, 1, length * length)

        put(int(some[-1]))
        while rest[0] >= 1 and rest[1] >= 1:
            room = int(rest[0])
            fits = np.flatnonzero(free[:room + 1])
            fits = fits[sizes[fits] ** 2 <= rest[2]]
            if not len(fits):
                break
            if fits[-1] == room:
                put(room)
                continue
            if rest[1] >= 2:
                pair = room - fits
                good = fits[(free[pair] > (pair == fits)) & (sizes[fits] ** 2 + (room - sizes[fits]) ** 2 <= rest[2])]
                if len(good):
                    put(int(good[-1]))
                    put(room - int(good[-1]))
                    continue
            now = rest / full
            if rule == "dot":
                best = int(np.argmax((demand[fits] * now * w).sum(axis=1)))
            elif rule == "norm":
                best = int(np.argmin((((now - demand[fits]) ** 2) * w).sum(axis=1)))
            else:
                raise ValueError(rule)
            put(int(fits[best]))
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        out.append((times, sorted(used.items(), reverse=True)))


def _lots(bins: list, tokens: int) -> dict[str, np.ndarray]:
    """Bins by length: which ranks of a length lie in which bin, and where."""
    rows, begun, sequence = [], {}, 0
    for times, held in bins:
        offset = 0
        for length, n in held:
            rank = begun.get(length, 0)
            rows.append((length, rank, n, sequence, offset))
            begun[length] = rank + n * times
            offset += length * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "copies": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def pack(
    docs: DataFrame, tokenizer: str, tokens: int = 2048, documents: int | None = None, cost: float | None = None,
    rule: str = "dot", weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    ``documents`` and ``cost`` bind where they are given; else a sequence may hold as
    many pieces and as much attention cost as its tokens allow.
    """
    pieces = settle(tokenised(docs, tokenizer, tokens))
    counted = settle(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = plan_bins(totals, tokens, documents or tokens, cost or float(tokens) ** 2, rule, weights)
    shared = docs.sparkSession.sparkContext.broadcast(_lots(bins, tokens))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = shared.value
        edges = lots["length"] * (1 << 48) + lots["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(edges, length * (1 << 48) + rank, side="right") - 1
            turn, place = np.divmod(rank - lots["rank"][at], lots["copies"][at])
            arrays = [*batch.columns[:5], pa.array(lots["sequence"][at] + turn), pa.array(lots["offset"][at] + place * length)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
