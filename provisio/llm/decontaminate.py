r"""Benchmark decontamination by a prefix-filtered containment join.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.  A window
is ``size`` consecutive words of a benchmark item; an item with fewer words, but
not none, is one window.  A window's tokens are its word shingles, ordered by how
often the documents hold them; as containment must be whole, the rarest token
alone is its necessary prefix.  Where a document holds that token, the window can
only lie at the token's own offset (positional bound) and inside the document
(length bound); there all words are compared.

Null text: no words.  Empty documents or items: not hit.  Repeated rows are judged
each for itself; an item id that repeats counts once.  A null item id hits words
but is not listed.  An empty benchmark hits nothing.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_batches, settle

#: Byte to byte: A-Z lower-cased, every other ASCII byte that is no letter or digit to a blank.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes of window texts that one broadcast piece of the benchmark may hold.
PIECE_BYTES = 8 << 20


def words_in(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(win, items): the different windows and the items that hold them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = words_in(text)
            if words:
                found = sorted({b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "win"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return in_batches(rows, ["item", "text"], "item string, win binary", run).groupBy("win").agg(F.collect_set("item").alias("items"))


def _tokens(words: list[bytes], width: int) -> list[bytes]:
    width = min(width, len(words))
    return [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]


def token_counts(docs: DataFrame, wins: list[list[bytes]], width: int) -> dict[bytes, int]:
    """Occurrences in all documents of the tokens of one piece of the benchmark."""
    tokens = sorted({t for w in wins for t in _tokens(w, width)})
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        firsts = _by_first(place)
        counts = np.zeros(len(place), np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                words = words_in(text)
                for at in [i for i, w in enumerate(words) if w in firsts]:
                    for n in firsts[words[at]]:
                        i = place.get(b" ".join(words[at:at + n]))
                        if i is not None and at + n <= len(words):
                            counts[i] += 1
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["token", "n"])

    found = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    return {tokens[i]: n for i, n in zip(found.column("token").to_pylist(), found.column("n").to_pylist())}


def _by_first(tokens) -> dict[bytes, tuple[int, ...]]:
    """First word of a token to the word counts that tokens with it have."""
    out: dict[bytes, set[int]] = {}
    for t in tokens:
        parts = t.split()
        out.setdefault(parts[0], set()).add(len(parts))
    return {k: tuple(sorted(v)) for k, v in out.items()}


def prefixes(wins: list[list[bytes]], counts: dict[bytes, int], width: int) -> dict[bytes, list[tuple[int, int]]]:
    """Rarest token of each window to (window, offset of the token); windows whose rarest token no document holds are gone."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    for k, w in enumerate(wins):
        tokens = _tokens(w, width)
        n, offset = min((counts.get(t, 0), i) for i, t in enumerate(tokens))
        if n:
            out.setdefault(tokens[offset], []).append((k, offset))
    return out


def _hits(words: list[bytes], firsts: dict, index: dict, wins: list[list[bytes]]) -> tuple[list[tuple[int, int]], set[int]]:
    """Covered spans and windows of one document."""
    spans, found = [], set()
    total = len(words)
    for at in [i for i, w in enumerate(words) if w in firsts]:
        for n in firsts[words[at]]:
            for k, offset in index.get(b" ".join(words[at:at + n]), ()):
                win, start = wins[k], at - offset
                if 0 <= start and start + len(win) <= total and words[start:start + len(win)] == win:
                    spans.append((start, start + len(win)))
                    found.add(k)
    return spans, found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, width: int = 3, piece_bytes: int = PIECE_BYTES, out: str = "hit"
) -> DataFrame:
    """All columns of ``docs`` and ``out``: struct(n_words, spans array<int> (start, end, ...), items array<string>).

    A column that is already called ``out`` gives way.

    The benchmark's windows go to the tasks in pieces of at most about ``piece_bytes``;
    a benchmark of any size takes as many passes as it has pieces.
    """
    wins = settle(windows(benchmark, size))
    held = wins.agg(F.sum(F.length("win") + F.size("items") * 16)).first()[0] or 0
    pieces = max(1, -(-int(held) // piece_bytes))
    names = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(*names).withColumn("__hit", F.lit(None).cast("struct<n_words:bigint,spans:array<int>,items:array<string>>"))
    for piece in range(pieces):
        part = wins.filter(F.pmod(F.xxhash64("win"), F.lit(pieces)) == piece).orderBy("win").toArrow()
        words = [w.split() for w in part.column("win").to_pylist()]
        items = part.column("items").to_pylist()
        rows = _marked(rows, words, items, prefixes(words, token_counts(docs, words, width), width))
        if piece % 4 == 3:
            rows = settle(rows)
    return rows.select(*names, F.col("__hit").alias(out))


def _marked(rows: DataFrame, wins: list, items: list, index: dict) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((wins, items, index))
    text_at, hit_at = rows.columns.index("text"), rows.columns.index("__hit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins, items, index = shared.value
        firsts = _by_first(index)
        for batch in batches:
            out = []
            for text, before in zip(as_bytes(batch.column(text_at)), batch.column(hit_at).to_pylist()):
                words = words_in(text)
                spans, found = _hits(words, firsts, index, wins)
                names = {i for k in found for i in items[k]}
                if before is not None:
                    spans += zip(before["spans"][::2], before["spans"][1::2])
                    names.update(before["items"])
                out.append({"n_words": len(words), "spans": _merged(spans), "items": sorted(names)})
            arrays = list(batch.columns)
            arrays[hit_at] = pa.array(out, batch.schema.field(hit_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping spans joined, as one flat list."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    hit = decontaminate(docs.select("doc_id", "text"), benchmark, size).select("doc_id", "hit.*")
    spans = F.transform("spans", lambda v, i: F.when(i % 2 == 1, v).otherwise(-v))
    hit = hit.withColumn("n_hit", F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, v: s + v))
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    return decontaminate(docs, benchmark, size, out="__found").filter(F.size("__found.spans") == 0).select(*docs.columns)
