"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting: a bounded sample of labelled rows, each of which counts, gives the
terms, their inverse document frequencies and
the examples; rows with equal vectors are one example with counts.  A term is any word whose presence
goes with the label by a likelihood-ratio test that lets about one word of the whole vocabulary of the sample
pass by chance; the rule is the same for every number of rows.  The
examples lie in an inverted index in blocks; each block keeps the largest weight
of every term.  A text visits the blocks by falling bound and stops when no block
can beat its k-th neighbour, so its neighbours are exact.  Similarities weigh the
votes; leave-one-out votes of the examples give the calibration.

Only words of the text enter a score.  Null and empty texts, and texts without
a term, get the share of toxic examples among those without a term.  Ties between neighbours
go to the example with the lower number.  Repeated rows are scored each for itself; of different texts of one
id the least is its example;
labels that disagree for one id count as toxic, null labels not at all.  With no labels every score is 0.
Empty table: no rows.  Columns other than doc_id and text pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

#: Labelled rows that a fit reads.
SAMPLE = 20_000
NEIGHBOURS = 24
BLOCK = 64
EVIDENCE = 3
#: Everything in ASCII but letters and digits parts words.
PARTS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCORES = "score double, predicted int, evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def words_in(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(PARTS).split() if text else []


@dataclass
class Index:
    """Examples in blocks, their postings by term, and the calibration."""

    terms: dict[bytes, int]
    idf: np.ndarray
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list = field(default_factory=list)
    posts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    tops: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    steps: tuple[list[float], list[float]] = field(default_factory=lambda: ([], []))
    none: float = 0.0

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit TF-IDF weights of a text."""
        counts = Counter(filter(self.terms.__contains__, words))
        at = np.array(sorted(self.terms[w] for w in counts), np.int64)
        if not len(at):
            return at, np.zeros(0)
        by = {self.terms[w]: n for w, n in counts.items()}
        weight = (1 + np.log([by[t] for t in at.tolist()])) * self.idf[at]
        return at, weight / math.sqrt(float(weight @ weight))

    def load(self, vectors: list[tuple[np.ndarray, np.ndarray]], rows: list[int], toxic: list[int], ids: list) -> None:
        """Number the examples so that like ones share blocks, and fill postings and block maxima."""
        lead = [tuple(t[np.argsort(-w, kind="stable")].tolist()) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], i))
        self.rows = np.array([rows[i] for i in order], np.float64)
        self.toxic = np.array([toxic[i] for i in order], np.float64)
        self.ids = [ids[i] for i in order]
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        blocks = -(-len(order) // BLOCK)
        self.tops = np.zeros((len(self.terms), blocks))
        np.maximum.at(self.tops, (term, example // BLOCK), weight)
        by = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[by], np.arange(len(self.terms) + 1))
        for t in range(len(self.terms)):
            own = by[cuts[t]:cuts[t + 1]]
            where = np.searchsorted(example[own], np.arange(blocks + 1) * BLOCK)
            self.posts.append((example[own], weight[own], where))

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the k nearest examples that share a term."""
        bounds = weight @ self.tops[at]
        found_i, found_s = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(found_s) >= k and bounds[b] < found_s[-1] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(at.tolist(), weight.tolist()):
                example, own, where = self.posts[t]
                lo, hi = where[b], where[b + 1]
                if lo < hi:
                    scores[example[lo:hi] - b * BLOCK] += w * own[lo:hi]
            some = np.flatnonzero(scores)
            found_i = np.concatenate([found_i, some + b * BLOCK])
            found_s = np.concatenate([found_s, scores[some]])
            best = np.lexsort((found_i, -np.round(found_s, 12)))[:k]
            found_i, found_s = found_i[best], found_s[best]
        return found_i, found_s

    def vote(self, near: tuple[np.ndarray, np.ndarray], without: tuple[int, int] | None = None) -> float:
        """Distance-weighted share of toxic rows among the neighbours, drawn a little to the share of texts without a term.

        ``without``: an example and the label of one row of it that shall not vote.
        """
        weight = near[1] ** 2
        bad, every = float(weight @ self.toxic[near[0]]), float(weight @ self.rows[near[0]])
        if without is not None:
            own = float(weight[near[0] == without[0]].sum())
            bad, every = bad - own * without[1], every - own
        return (bad + 0.05 * self.none) / (every + 0.05)

    def calibrate(self, votes: list[tuple[float, int, int]]) -> None:
        """Isotonic regression on leave-one-out votes: (vote, toxic rows, rows)."""
        pools: list[list[float]] = []
        for vote, bad, rows in sorted(votes):
            pools.append([vote, bad, rows])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, y, n = pools.pop()
                pools[-1][1] += y
                pools[-1][2] += n
        # Half an example of doubt on either side keeps scores off 0 and 1.
        self.steps = [p[0] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps)) if self.steps[0] else self.none


def _words_of(rows: DataFrame) -> DataFrame:
    """(word, n, toxic): in how many sampled rows, and toxic ones, a word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every: Counter = Counter()
            bad: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(words_in(text))
                every.update(own)
                if toxic:
                    bad.update(own)
            words = list(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([every[w] for w in words], pa.int64()), pa.array([bad[w] for w in words], pa.int64())],
                ["word", "n", "toxic"],
            )

    return rows.select("text", "toxic").mapInArrow(run, "word binary, n bigint, toxic bigint")


def _strength(a: Column, held: Column, bad: float, n: float) -> Column:
    """Likelihood ratio of a word in ``held`` of ``n`` rows, ``a`` of the ``bad`` ones: twice the sum of observed x ln(observed / expected)."""
    cells = [(a, held * bad), (held - a, held * (n - bad)), (bad - a, (n - held) * bad), (n - bad - held + a, (n - held) * (n - bad))]
    terms = [F.when(seen > 0, seen * F.log(seen * n / product)).otherwise(0.0) for seen, product in cells]
    return 2 * (terms[0] + terms[1] + terms[2] + terms[3])


def _left_out(
    spark: SparkSession, index: Index, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list, held: list[int], toxic: list[int], k: int
) -> list[tuple[float, int, int]]:
    """(vote, toxic rows, rows) of every example and label, voted on by the others; a Spark job."""
    back = {doc_id: i for i, doc_id in enumerate(ids)}
    order = [back[doc_id] for doc_id in index.ids]
    shared = spark.sparkContext.broadcast((index, order, vectors, held, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, order, vectors, held, toxic = shared.value
        for batch in batches:
            out = []
            for number in batch.column(0).to_pylist():
                i = order[number]
                near = index.nearest(*vectors[i], k)
                for label, rows in ((1, toxic[i]), (0, held[i] - toxic[i])):
                    if rows:
                        out.append((index.vote(near, (number, label)), label * rows, rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                ["vote", "toxic", "held"],
            )

    parts = max(1, min(len(vectors) // 64, 8 * spark.sparkContext.defaultParallelism))
    votes = spark.range(0, len(vectors), 1, parts).mapInArrow(run, "vote double, toxic bigint, held bigint")
    return [tuple(r) for r in votes.collect()]  # at most two for each example


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = NEIGHBOURS) -> Index:
    """Index of at most ``sample`` labelled rows of ``labels`` (doc_id, toxic)."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids: small enough for every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = settle(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    n, bad = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return Index({}, np.zeros(0))
    words = _words_of(rows).groupBy("word").agg(F.sum("n").cast("double").alias("n"), F.sum("toxic").cast("double").alias("a"))
    words = settle(words)
    strength = _strength(F.col("a"), F.col("n"), float(bad), float(n))
    # A word without any bond to the label exceeds this once in about as many words as there are.
    kept = words.filter(strength >= 2 * math.log(max(words.count(), 1))).orderBy("word").collect()
    index = Index({bytes(r["word"]): i for i, r in enumerate(kept)}, np.array([math.log((n + 1) / (r["n"] + 1)) + 1 for r in kept]))
    empty: Counter = Counter()

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = [index.vector(words_in(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([t for t, _ in vector], pa.list_(pa.int64())), pa.array([w for _, w in vector], pa.list_(pa.float64()))],
                ["doc_id", "toxic", "terms", "weights"],
            )

    small = rows.select("doc_id", "text", "toxic").mapInArrow(shrink, "doc_id bigint, toxic int, terms array<bigint>, weights array<double>")
    examples: dict[tuple, list] = {}
    for r in small.orderBy("doc_id").collect():  # at most the sample, a few terms each
        if r["terms"]:
            examples.setdefault((tuple(r["terms"]), tuple(r["weights"])), [r["doc_id"], 0, 0])
            own = examples[tuple(r["terms"]), tuple(r["weights"])]
            own[1] += 1
            own[2] += r["toxic"]
        else:
            empty[r["toxic"]] += 1
    index.none = (empty[1] + 0.5) / (empty.total() + 1) if empty.total() else bad / n
    vectors = [(np.array(t, np.int64), np.array(w)) for t, w in examples]
    ids, held, toxic = ([e[i] for e in examples.values()] for i in range(3))
    index.load(vectors, held, toxic, ids)
    index.calibrate(_left_out(rows.sparkSession, index, vectors, ids, held, toxic, k))
    return index


def score(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with score, predicted (score >= 0.5) and the nearest examples as evidence."""
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted", "evidence")]
    docs = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        seen: dict[bytes, tuple] = {}
        schema = pa.schema([("score", pa.float64()), ("predicted", pa.int32()), ("evidence", EVIDENCE_TYPE)])
        for batch in batches:
            out = []
            for text in batch.column(at_text).to_pylist():
                at, weight = index.vector(words_in(text))
                if not len(at):
                    out.append((index.none, int(index.none >= 0.5), []))
                    continue
                key = at.tobytes() + weight.tobytes()
                if key not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    near = index.nearest(at, weight, k)
                    value = index.score(index.vote(near)) if len(near[0]) else index.none
                    shown = [{"doc_id": index.ids[i], "similarity": float(s), "toxic": int(2 * index.toxic[i] >= index.rows[i])} for i, s in zip(near[0][:EVIDENCE], near[1])]
                    seen[key] = (value, int(value >= 0.5), shown)
                out.append(seen[key])
            new = [pa.array([o[i] for o in out], schema.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *schema]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {SCORES}")


EVIDENCE_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


def held_out(doc_id: Column) -> Column:
    """Every fifth row by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, training(labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"{c}__own") if c.lower() in ("score", "predicted", "evidence") else F.col(c) for c in names])
    scored = score(inner, fit(docs, training(labels))).filter("predicted = 0")
    return scored.select(*[F.col(f"{c}__own").alias(c) if c.lower() in ("score", "predicted", "evidence") else F.col(c) for c in names])
