r"""Phrase collocations by HAT-trie counting.

Words are numbered by falling count.  Every task counts its word sequences in a trie:
hash containers that hold the rest of many sequences lie under a shallow trie of word ids; a container
that outgrows ``BURST`` entries bursts into containers over ranges of the next word.  When a task
holds more than ``HELD`` entries it spills its largest subtrees whole, as sorted runs; every run
belongs to one prefix partition (a range of the first two words), where Spark brings the runs
together and they are merged.

Only words that a language holds at least ``LEAST`` times can be in a phrase; all others
part phrases.  The ``WORDS`` commonest words go to every task by number; should there be more, sequences that hold
one of the others (known by a bit table of fixed size, so with harmless false alarms) are counted by
their text in the same partitions, so nothing is left out.

A-Z are lower-cased, pieces are parted by ``[.,;:!?\x0A-\x0D]``, words are ``[^\x20\x09]+``.
Counts are per ``lang``; null is ``und``.  Null and empty texts hold no words; texts of any
length are read in chunks.  Repeated rows count as often as they stand.  Ties in rank go by count, then
phrase in UTF-8 byte order.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, settle

LEAST, LONGEST = 30, 4
#: Numbered words; bits of an id; bits of the table of other frequent words.
WORDS, BITS, OTHERS = 1 << 18, 21, 1 << 23
#: Entries of a container before it bursts, its children, and entries of a task before it spills.
BURST, FAN, HELD = 1 << 16, 16, 1 << 21
#: Rows of a batch whose texts are taken out of it at once.
ROWS = 1 << 10
#: Bytes of text taken at once; words in a prefix partition, about; most partitions.
CHUNK, PART_WORDS, MOST_PARTS = 1 << 20, 1 << 20, 1 << 18
MASK = np.int64((1 << BITS) - 1)
#: A-Z lower-cased, tabs to blanks, everything that parts pieces to full stops.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
CODEC = "zstd"


def tokens(chunk: bytes) -> list[bytes]:
    """Words, and ``.`` where a piece ends; no word holds a full stop."""
    # Bytes such as \x1c are part of words: after the translation blanks are the only white space.
    return chunk.translate(TABLE).replace(b".", b" . ").split()


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[bytes, bool]]:
    """Texts joined by full stops and cut at blanks; whether a chunk goes on with the text of the one before."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        if len(text) <= size:
            held.append(text)
            total += len(text)
            if total > size:
                yield b".".join(held), False
                held, total = [], 0
            continue
        start = 0
        while start < len(text):
            end = start + size
            if end < len(text):
                # A word longer than the chunk is not cut.
                blank = max(text.rfind(b" ", start, end), text.rfind(b"\n", start, end))
                blank = blank if blank > start else text.find(b" ", end)
                end = blank if blank > start else len(text)
            yield text[start:end], start > 0
            start = end
    if held:
        yield b".".join(held), False


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                left = iter(own.items())
                while held := list(islice(left, BURST)):
                    words, n = zip(*held)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(held)), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, texts in _by_lang(batch):
                own = counts.setdefault(lang, Counter())
                for chunk, _ in chunks(texts):
                    size -= len(own)
                    own.update(tokens(chunk))
                    own.pop(b".", None)
                    size += len(own)
                    if size > HELD // 4:
                        yield from rows()
                        own.clear()
                        counts.clear()
                        counts[lang], size = own, 0
        yield from rows()

    partial = _texts(docs).mapInArrow(run, "lang string, word binary, n bigint")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of each language, those of ``ROWS`` rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        langs: dict[str, list[bytes]] = {}
        rows = batch.slice(at, ROWS)
        for lang, text in zip(rows.column(0).to_pylist(), as_bytes(rows.column(1))):
            langs.setdefault(lang, []).append(text)
        yield from langs.items()


class Container:
    """Hash table of (hi, lo) to counts: two words each, 0 for none."""

    def __init__(self, room: int = 1024):
        self.size, self.hi, self.lo, self.n = 0, np.full(room, -1, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)

    def add(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
        """Keys must be different from each other."""
        room = len(self.hi)
        while 2 * (self.size + len(hi)) > room:
            room *= 2
        if room > len(self.hi):
            old = self.hi >= 0
            kept = self.hi[old], self.lo[old], self.n[old]
            Container.__init__(self, room)
            self.add(*kept)
        mixed = (hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (lo.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        slot = ((mixed ^ (mixed >> np.uint64(29))) & np.uint64(room - 1)).astype(np.int64)
        todo = np.arange(len(hi))
        while len(todo):
            at = slot[todo]
            free = self.hi[at] < 0
            # Of several keys for one free place the last one gets it.
            self.hi[at[free]], self.lo[at[free]] = hi[todo[free]], lo[todo[free]]
            same = (self.hi[at] == hi[todo]) & (self.lo[at] == lo[todo])
            self.size += int((same & free).sum())
            self.n[at[same]] += n[todo[same]]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (room - 1)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held = np.flatnonzero(self.hi >= 0)
        order = held[np.lexsort((self.lo[held], self.hi[held]))]
        if len(order):
            yield self.hi[order], self.lo[order], self.n[order]


class Node:
    """Children over ranges of one word of the path; ``shift`` takes it from ``hi``."""

    def __init__(self, shift: int, starts: np.ndarray, children: list):
        self.shift, self.starts, self.children = shift, starts, children

    @property
    def size(self) -> int:
        return sum(c.size for c in self.children)

    def add(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
        """``hi`` must be sorted."""
        cuts = [0, *np.searchsorted(hi, self.starts[1:]).tolist(), len(hi)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                self.children[i] = grown(self.children[i], self.shift, hi[a:b], lo[a:b], n[a:b])

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for child in self.children:
            yield from child.runs()


def grown(part: Container | Node, shift: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Container | Node:
    """``part`` with more counts; a container that is too large bursts at words of the path."""
    part.add(hi, lo, n)
    if isinstance(part, Node) or part.size <= BURST:
        return part
    (hi, lo, n), = part.runs()
    # By the first word while it differs, else by the second; one pair of words is not parted.
    for step in range(shift, -1, -BITS):
        picked = np.unique(hi[np.arange(FAN) * len(hi) // FAN] >> step)
        if hi[0] >> step < hi[-1] >> step:
            starts = np.unique(np.concatenate([hi[:1] >> step, picked])) << np.int64(step)
            cuts = [0, *np.searchsorted(hi, starts[1:]).tolist(), len(hi)]
            if len(starts) == 1:
                starts = np.append(starts, (hi[-1] >> step) << step)
                cuts = [0, int(np.searchsorted(hi, starts[1])), len(hi)]
            children = []
            for a, b in zip(cuts, cuts[1:]):
                child = Container(1 << max(10, (2 * (b - a)).bit_length()))
                child.add(hi[a:b], lo[a:b], n[a:b])
                children.append(child)
            return Node(step, starts, children)
    return part


class Trie:
    """Counts of one language."""

    def __init__(self):
        self.root: Container | Node = Container()

    @property
    def size(self) -> int:
        return self.root.size

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        first = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else order
        if len(first):
            self.root = grown(self.root, BITS, hi[first], lo[first], np.diff(np.append(first, len(hi))))

    def spill(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Largest subtrees, whole and sorted, until at most ``most`` entries are left."""
        if isinstance(self.root, Container) or not most:
            if self.size > most:
                yield from self.root.runs()
                self.root = Container()
            return
        for i in sorted(range(len(self.root.children)), key=lambda i: -self.root.children[i].size):
            if self.size <= most:
                return
            yield from self.root.children[i].runs()
            self.root.children[i] = Container()


def pack(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """A sorted run as compressed columns."""
    columns = (np.diff(hi, prepend=0), (lo >> BITS).astype(np.int32), (lo & MASK).astype(np.int32), n)
    data = b"".join(c.tobytes() for c in columns)
    return len(hi).to_bytes(8, "little") + pa.compress(data, codec=CODEC, asbytes=True)


def unpack(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(run[:8], "little")
    data = pa.decompress(run[8:], 24 * k, codec=CODEC, asbytes=True)
    high, low = np.frombuffer(data, np.int32, k, 8 * k).astype(np.int64), np.frombuffer(data, np.int32, k, 12 * k)
    return np.cumsum(np.frombuffer(data, np.int64, k)), high << BITS | low, np.frombuffer(data, np.int64, k, 16 * k)


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs merged into one."""
    hi, lo, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
    return hi[first], lo[first], np.add.reduceat(n, first)


def bounds(counts: np.ndarray, parts: int) -> np.ndarray:
    """First key (hi) of each prefix partition, so that words drawn by their counts fall into all alike."""
    share = np.cumsum(counts / counts.sum())
    at = np.arange(parts) / parts
    first = np.minimum(np.searchsorted(share, at, "right"), len(counts) - 1)
    before = np.where(first > 0, share[first - 1], 0.0)
    second = np.searchsorted(share, (at - before) / (share[first] - before), "right")
    out = (first.astype(np.int64) + 1) << BITS | np.minimum(second, len(counts) - 1).astype(np.int64) + 1
    out[0] = 0
    return np.unique(out)


def _place(word: bytes) -> int:
    return zlib.crc32(word) % OTHERS


class Task:
    """Counting in one task; ``run`` yields (lang, part, run, phrase, n) rows."""

    def __init__(self, words: list[bytes], starts: np.ndarray, others: np.ndarray | None, held: int):
        self.ids, self.starts, self.others, self.held = {w: i + 1 for i, w in enumerate(words)}, starts, others, held
        self.tries: dict[str, Trie] = {}
        self.texts: Counter = Counter()
        self.carry = (np.zeros(0, np.int64), [])

    def count(self, lang: str, chunk: bytes, goes_on: bool) -> None:
        words = tokens(chunk)
        get = self.ids.get
        ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        if self.others is not None:
            # -1: a frequent word without a number, perhaps.
            for i in np.flatnonzero(ids == 0).tolist():
                if words[i] != b"." and self.others[_place(words[i])]:
                    ids[i] = -1
        before, tail = self.carry if goes_on else (np.zeros(0, np.int64), [])
        ids, words = np.concatenate([before, ids]), tail + words if self.others is not None else []
        self.carry = ids[-LONGEST + 1:], words[-LONGEST + 1:]
        his, los = [], []
        for k in range(2, LONGEST + 1):
            start = max(0, len(before) - k + 1)
            if len(ids) - k < start:
                continue
            columns = [ids[start + j:len(ids) - k + 1 + j] for j in range(k)]
            whole = np.logical_and.reduce([c > 0 for c in columns])
            columns = [c[whole] for c in columns] + [np.zeros(int(whole.sum()), np.int64)] * (LONGEST - k)
            his.append(columns[0] << BITS | columns[1])
            los.append(columns[2] << BITS | columns[3])
            if self.others is not None:
                parts = [ids[start + j:len(ids) - k + 1 + j] for j in range(k)]
                mixed = np.logical_and.reduce([c != 0 for c in parts]) & ~whole
                self.texts.update((lang, b" ".join(words[i:i + k])) for i in (np.flatnonzero(mixed) + start).tolist())
        if his:
            self.tries.setdefault(lang, Trie()).add(np.concatenate(his), np.concatenate(los))

    def spill(self, most: int) -> Iterator[tuple]:
        """Rows of what is spilled until at most ``most`` entries are left in all."""
        total = sum(t.size for t in self.tries.values())
        for lang, trie in sorted(self.tries.items(), key=lambda x: -x[1].size):
            if total > most or not most:
                size = trie.size
                for hi, lo, n in trie.spill(max(0, size - total + most) if most else 0):
                    part = np.searchsorted(self.starts, hi, "right") - 1
                    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
                    for a, b in zip(cuts, [*cuts[1:], len(part)]):
                        yield lang, int(part[a]), pack(hi[a:b], lo[a:b], n[a:b]), None, None
                total -= size - trie.size
        if self.texts and (not most or len(self.texts) > self.held // 8):
            for (lang, phrase), n in self.texts.items():
                yield lang, zlib.crc32(b" ".join(phrase.split(b" ")[:2])) % len(self.starts), None, phrase, n
            self.texts.clear()

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for chunk, goes_on in chunks(texts):
                    self.count(lang, chunk, goes_on)
                    if sum(t.size for t in self.tries.values()) > self.held or len(self.texts) > self.held // 8:
                        yield from _rows(self.spill(self.held // 2))
        yield from _rows(self.spill(0))


RUNS = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("run", pa.binary()), ("phrase", pa.binary()), ("n", pa.int64())])
FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])


def _rows(found: Iterator[tuple], schema: pa.Schema = RUNS, at_once: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _merged(words: list[bytes], least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, phrase, k, f) of the phrases of sorted partitions that stand often enough."""
    key, runs, texts, size = None, [], Counter(), 0

    def ended() -> Iterator[tuple]:
        if runs:
            hi, lo, n = summed(runs)
            often = n >= least
            columns = [hi[often] >> BITS, hi[often] & MASK, lo[often] >> BITS, lo[often] & MASK]
            for *ids, f in zip(*(c.tolist() for c in columns), n[often].tolist()):
                held = [words[i - 1] for i in ids if i]
                yield key[0], b" ".join(held).decode("utf-8", "replace"), len(held), f
        for phrase, f in texts.items():
            if f >= least:
                yield key[0], phrase.decode("utf-8", "replace"), phrase.count(b" ") + 1, f

    for batch in batches:
        for lang, part, run, phrase, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, part) != key:
                yield from ended()
                key, runs, texts, size = (lang, part), [], Counter(), 0
            if run is None:
                texts[phrase] += n
                continue
            runs.append(unpack(run))
            size += len(runs[-1][0])
            if size > HELD and size > 2 * len(runs[0][0]):
                runs = [summed(runs)]
                size = len(runs[0][0])
    yield from ended()


def phrase_counts(docs: DataFrame, counts: DataFrame, words: int = WORDS, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of two words or more that a language holds at least ``least`` times.

    ``counts``: a written table of (lang, word, n), as ``word_counts`` gives it.
    """
    spark = docs.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(F.col("most") >= least)
    top = often.orderBy(F.desc("n"), "word").limit(words).select("word", "n").toArrow()  # at most ``words`` rows
    known = top.column("word").to_pylist()
    if not known:
        return spark.createDataFrame([], "lang string, phrase string, k int, f bigint")
    parts = int(min(MOST_PARTS, max(16, total // PART_WORDS)))
    starts = bounds(top.column("n").to_numpy().astype(float), parts)
    others = None
    if len(known) == words:
        # Bits of the frequent words that have no number: as many rows as the table has bits, at most.
        last = (top.column("n")[-1].as_py(), known[-1])
        left = often.filter((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > F.lit(last[1]))))
        bits = left.select((F.crc32("word") % OTHERS).alias("bit")).distinct().toArrow()
        if bits.num_rows:
            others = np.zeros(OTHERS, bool)
            others[bits.column("bit").to_numpy()] = True
    shared = spark.sparkContext.broadcast((known, starts, others))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Task(*shared.value, held).run(batches)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(_merged(shared.value[0], least, batches), FOUND, 4096)

    runs = _texts(docs).mapInArrow(count, "lang string, part bigint, run binary, phrase binary, n bigint")
    dealt = runs.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(merge, "lang string, phrase string, k int, f bigint")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def collocations(
    docs: DataFrame, first: int = 2000, least: int = LEAST, words: int = WORDS, held: int = HELD
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language.

    The score of a phrase is that of its weakest cut, floor(2000000 * a / (l + r)).  A phrase
    inside a longer one that stands at least 0.8 times as often is left out.
    """
    counts = settle(word_counts(docs))
    found = settle(phrase_counts(docs, counts, words, least, held))
    single = counts.filter(F.col("n") >= least).select("lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("f"))
    every = found.select("lang", "phrase", "f").unionByName(single)
    # Every cut of every candidate, with the counts of both sides.
    cut = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    own = _words(F.col("phrase"))
    cut = cut.select("*", F.array_join(F.slice(own, F.lit(1), F.col("at")), " ").alias("left"), F.array_join(F.slice(own, F.col("at") + 1, F.size(own)), " ").alias("right"))
    cut = cut.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = "CAST({} AS DECIMAL(25, 0))".format
    score = F.expr(f"CAST(({wide('a')} * 2000000) DIV ({wide('l')} + {wide('r')}) AS BIGINT)")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "at", "l", "r")).alias("cut"))
    # Shorter phrases inside longer candidates: the greatest count of those around them.
    own = _words(F.col("phrase"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("k") - k + 1), lambda i: F.array_join(F.slice(own, i, k), " "))))
    inside = found.filter("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
    around = inside.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left").filter(F.expr(f"around IS NULL OR {wide('around')} * 100 < {wide('a')} * 80"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= first)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )
