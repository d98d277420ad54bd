"""Vector, text and hybrid search for whole sets of queries.

No query-by-chunk pair is ever written out: the vector search multiplies blocks
inside Arrow batches and keeps the best ``n`` per query and task, and so does the text
search (``wordsets``); inside a scope it meets the documents listed per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.let import bind
from provisio.functions.text import tokens
from provisio.operators import wordsets
from provisio.operators.skew import top_k
from provisio.session import shared_folder

# Search sizes.
THRESHOLD, RRF_K, MIN_FETCH, FETCH_FACTOR = 0.6, 60, 12, 4
EXCLUDED_TYPES = ("signature",)
DIGITS = 6

# At most this many query rows are shipped to every task (x 1024 doubles = 32 MB).
QUERY_BLOCK = 4096
CELL_ROWS = 200_000
# Rows of each side of one group of the shuffled search, at least.
GROUP = 16_384
# Largest word list that is shipped to every task.
SHIPPED_BYTES = 32 * 1024 * 1024
HIT_SCHEMA = "query_id string, path string, score double"


def searchable(chunks: DataFrame, hint: Column | None = None) -> DataFrame:
    """Filters shared by both searches: in force, no signature, document not expired."""
    kept = chunks.filter(
        F.col("is_effective") & ~F.col("chunk_type").isin(*EXCLUDED_TYPES) & ~F.col("status_flag").eqNullSafe(2))
    return kept if hint is None else kept.filter(hint)


def type_hint(text: str) -> Column:
    """Case-insensitive containment in type, title or number."""
    like = f"%{text}%"
    return F.col("doc_type").ilike(like) | F.col("title").ilike(like) | F.col("doc_num").ilike(like)


# -- G2: exact vector search ---------------------------------------------------


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


class _Best:
    """Best ``n`` (score, path) per query seen so far in one task."""

    def __init__(self, n_queries: int, n: int):
        self.n = n
        self.bound = np.full(n_queries, -np.inf)
        empty = {"q": np.empty(0, np.int64), "score": np.empty(0), "path": np.empty(0, dtype=object)}
        self.held, self.new, self.waiting = pd.DataFrame(empty), [], 0

    def add(self, asked: np.ndarray, raw: np.ndarray, paths: np.ndarray) -> None:
        """``raw`` scores (asked queries x vectors); ``paths``: a list of paths for each vector."""
        if not raw.size:
            return
        bound = self.bound[asked]
        if raw.shape[1] > self.n:
            bound = np.maximum(bound, np.partition(raw, -self.n, axis=1)[:, -self.n]) if (bound == -np.inf).any() else bound
        # Rounding moves a score by half a step at most.
        at, vector = np.nonzero(raw >= (bound - 10.0 ** -DIGITS)[:, None])
        if not len(at):
            return
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))[vector]
        self.new.append(pd.DataFrame({
            "q": np.repeat(asked[at], sizes), "score": np.repeat(np.round(raw[at, vector], DIGITS), sizes),
            "path": np.concatenate([np.asarray(paths[v], dtype=object) for v in vector])}))
        self.waiting += int(sizes.sum())
        if self.waiting > max(100_000, 4 * self.n * len(self.bound)):
            self._cut()

    def _cut(self) -> None:
        rows = pd.concat([self.held, *self.new]) if len(self.held) else pd.concat(self.new) if self.new else self.held
        rows = rows.sort_values(["q", "score", "path"], ascending=[True, False, True], kind="stable")
        place = rows.groupby("q").cumcount()
        self.held, self.new, self.waiting = rows[place < self.n], [], 0
        last = rows[place == self.n - 1]
        self.bound[last["q"].to_numpy()] = last["score"].to_numpy()

    def frame(self, ids: list[str]) -> pd.DataFrame:
        self._cut()
        # object columns: an empty Arrow-backed string column cannot be shipped back
        return pd.DataFrame({
            "query_id": pd.Series(np.asarray(ids, dtype=object)[self.held["q"].to_numpy()] if len(self.held) else [], dtype=object),
            "path": pd.Series(self.held["path"].to_numpy(), dtype=object),
            "score": pd.Series(self.held["score"].to_numpy(), dtype="float64"),
        })


#: Scores that a task holds at a time (queries x vectors).
TILE = 1 << 21


def _add_all(best: _Best, queries: np.ndarray, vectors: np.ndarray, paths: np.ndarray, asked: np.ndarray | None = None) -> None:
    """Scores of (asked) queries and vectors, a tile at a time."""
    asked = np.arange(len(queries)) if asked is None else asked
    step = max(1, TILE // max(1, len(asked)))
    for i in range(0, len(vectors), step):
        best.add(asked, queries[asked] @ vectors[i:i + step].T, paths[i:i + step])


def _units(vectors: pd.Series) -> np.ndarray:
    return _unit(np.stack(vectors.to_numpy()).astype(np.float64))


def by_vector(corpus: DataFrame, n: int) -> DataFrame:
    """``embedding, paths``: equal vectors once with their first ``n`` paths; no more of them can be among the best ``n``."""
    rows = corpus.select("path", "embedding", F.xxhash64("embedding").alias("h")).filter("embedding is not null")
    first = top_k(rows, ["h", "embedding"], ["path"], n)
    return first.groupBy("h", "embedding").agg(F.collect_list("path").alias("paths")).select("embedding", "paths")


def stored(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder, as every block of queries reads it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _merge(partial: DataFrame, n: int) -> DataFrame:
    return top_k(partial, ["query_id"], [F.desc("score"), F.asc("path")], n, "rank1").withColumn(
        "rank0", F.col("rank1") - 1).drop("rank1")


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Ids and unit vectors of the queries in blocks of at most ``block`` rows, one on the driver at a time."""
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding").filter("embedding is not null")
    lots = max(1, -(-rows.count() // max(1, block // 2)))
    lot = F.pmod(F.xxhash64("query_id"), F.lit(lots))
    for i in range(lots):
        own = rows.filter(lot == i).collect() if lots > 1 else rows.collect()
        for at in range(0, len(own), block):
            some = own[at:at + block]
            yield [r[0] for r in some], _unit(np.asarray([r[1] for r in some], dtype=np.float64))


def _union(parts: list[DataFrame], rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], HIT_SCHEMA)


def knn(queries: DataFrame, corpus: DataFrame, n: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-n: ``query_id, path, score, rank0``.

    ``queries``: ``query_id, embedding``; ``corpus``: ``path, embedding``.  Queries
    go to every task in blocks of bounded size; each block scans the different
    vectors of the corpus once, without a shuffle, whatever the number of queries.
    """
    return nearest(queries, stored(by_vector(corpus, n)), n, block)


def nearest(queries: DataFrame, rows: DataFrame, n: int, block: int = QUERY_BLOCK) -> DataFrame:
    """As :func:`knn`, over vectors that are stored already (:func:`by_vector`), for several sets of queries."""

    def scanned(ids: list[str], vectors: np.ndarray) -> DataFrame:
        matrix = rows.sparkSession.sparkContext.broadcast(vectors)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = matrix.value
            best = _Best(len(ids), n)
            for b in batches:
                if len(b):
                    _add_all(best, q, _units(b["embedding"]), b["paths"].to_numpy())
            found = best.frame(ids)
            if len(found):
                yield found

        return rows.mapInPandas(scan, HIT_SCHEMA)

    return _merge(_union([scanned(*q) for q in query_blocks(queries, block)], rows), n)


def knn_blocks(queries: DataFrame, corpus: DataFrame, n: int, block: int = QUERY_BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact top-n where queries and chunks are both dealt to groups by the shuffle.

    Queries fall into blocks and different vectors into cells by key hash; each (block, cell) pair is one
    group that yields the best ``n`` per query.  A group holds up to ``GROUP`` rows of each side, so the
    copies of a row grow with the other side's rows by ``GROUP`` only; ``block`` and ``cell_rows`` bound the
    tile of scores inside.
    """
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding").filter("embedding is not null")
    rows = stored(by_vector(corpus, n))
    n_blocks = max(1, -(-q.count() // max(block, GROUP)))
    n_cells = max(1, -(-rows.count() // max(cell_rows, GROUP)))
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).withColumn("c", spread(n_cells))
    right = rows.withColumn("c", F.pmod(F.xxhash64(F.col("paths")[0]), F.lit(n_cells)).cast("int")).withColumn("b", spread(n_blocks))

    def cell(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        ids = a["query_id"].tolist()
        best = _Best(len(ids), n)
        if len(a) and len(c):
            asked, vectors, paths = _units(a["embedding"]), _units(c["embedding"]), c["paths"].to_numpy()
            for i in range(0, len(ids), block):
                for j in range(0, len(vectors), cell_rows):
                    _add_all(best, asked, vectors[j:j + cell_rows], paths[j:j + cell_rows], np.arange(i, min(i + block, len(ids))))
        return best.frame(ids)

    return _merge(left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(cell, HIT_SCHEMA), n)


# -- G3: approximate vector search ---------------------------------------------


def train_cells(corpus: DataFrame, n_cells: int = 16, seed: int = 42) -> np.ndarray:
    """Centroids of a coarse quantiser, fitted on all vectors, equal ones as one with their number as weight; give more cells to a larger corpus."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    counted = corpus.filter("embedding is not null").groupBy("embedding").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = counted.select(array_to_vector("embedding").alias("features"), "weight")
    return np.asarray(KMeans(k=n_cells, seed=seed, maxIter=10, weightCol="weight").fit(rows).clusterCenters())


def knn_ann(queries: DataFrame, corpus: DataFrame, n: int, centers: np.ndarray, probes: int = 4, block: int = QUERY_BLOCK) -> DataFrame:
    """Approximate top-n: a chunk meets only the queries that probe its cell; any number of queries, in blocks."""
    rows = stored(by_vector(corpus, n))
    cells = _unit(centers)

    def scanned(ids: list[str], q: np.ndarray) -> DataFrame:
        near = np.argsort(-(q @ cells.T), axis=1)[:, :probes]
        asked = [np.flatnonzero((near == c).any(axis=1)) for c in range(len(cells))]
        shipped = rows.sparkSession.sparkContext.broadcast((q, cells, asked))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matrix, cells, who = shipped.value
            best = _Best(len(ids), n)
            for b in batches:
                if not len(b):
                    continue
                v = _units(b["embedding"])
                home, paths = np.argmax(v @ cells.T, axis=1), b["paths"].to_numpy()
                for c in np.unique(home):
                    at = np.flatnonzero(home == c)
                    if len(who[c]):
                        _add_all(best, matrix, v[at], paths[at], who[c])
            found = best.frame(ids)
            if len(found):
                yield found

        return rows.mapInPandas(scan, HIT_SCHEMA)

    return _merge(_union([scanned(*q) for q in query_blocks(queries, block)], rows), n)


# -- G1, G7: search inside one contract or a set of documents --------------------


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)

    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), DIGITS)


def knn_scoped(queries: DataFrame, corpus: DataFrame, key: str, n: int) -> DataFrame:
    """Cosine top-n among the rows that share ``key`` with the query (contract or document)."""
    q = queries.select("query_id", key, F.col("embedding").alias("qv"))
    joined = q.join(corpus.select(key, "path", "embedding").filter("embedding is not null"), key)
    scored = joined.select("query_id", "path", cosine(F.col("qv"), F.col("embedding")).alias("score"))
    return _merge(scored, n)


# -- G4: text search -------------------------------------------------------------


def cover_rank(words: Column, query: Column) -> Column:
    """Sum of 1/length over the minimal windows that hold every query token."""
    hits = F.filter(
        F.transform(words, lambda w, i: F.struct(F.array_position(query, w).cast("int").alias("k"), i.alias("at"))),
        lambda h: h["k"] > 0)
    return cover_of(hits, F.transform(query, lambda _: F.lit(-1)))


def cover_of(hits: Column, never: Column) -> Column:
    """As :func:`cover_rank`, from the places ``at`` of the query's tokens ``k`` (from 1) in order; ``never``: -1 for each token."""
    start = F.struct(never.alias("last"), F.lit(-1).alias("seen"), F.lit(0.0).alias("rank"))

    def step(acc, h):
        last = F.transform(acc["last"], lambda p, i: F.when(i + 1 == h["k"], h["at"]).otherwise(p))
        return F.get(F.transform(F.array(last), lambda now: F.struct(
            now.alias("last"), F.greatest(acc["seen"], F.array_min(now)).alias("seen"),
            (acc["rank"] + F.when(F.array_min(now) > acc["seen"], F.lit(1.0) / (h["at"] - F.array_min(now) + 1)).otherwise(0.0)).alias("rank"),
        )), F.lit(0))

    return F.aggregate(hits, start, step, lambda acc: acc["rank"])


def query_words(queries: DataFrame) -> DataFrame:
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("words")
    ).filter("size(words) > 0")


def _is_small(words: DataFrame) -> bool:
    """Whether a word list is small enough for every task, by its measured size."""
    return (words.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) <= SHIPPED_BYTES


def fts_matches(queries: DataFrame, corpus: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Chunks holding all tokens of a query: ``query_id, path, score``.

    The rarest token of each query picks the candidates (one narrow join on the
    token); only those are read in full to test the other tokens and to rank.
    """
    q = query_words(queries)
    words = corpus.select("path", *([] if scope is None else ["doc_id"]), tokens(F.col("chunk_text")).alias("body"))
    if scope is None:
        entries = words.select("path", F.explode(F.array_distinct("body")).alias("word"))
        asked = q.select("query_id", F.explode("words").alias("word"))
        ship = F.broadcast if _is_small(asked) else (lambda df: df)
        frequency = (
            entries.join(ship(asked.select("word").distinct()), "word", "left_semi")
            .groupBy("word").agg(F.count(F.lit(1)).alias("df")))
        rarest = (
            asked.join(frequency, "word", "left").groupBy("query_id")
            .agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min_by("word", F.struct("df", "word")).alias("word"))
            .filter("least > 0").select("query_id", "word"))
        full = entries.join(ship(rarest), "word").select("query_id", "path").join(words, "path")
    else:
        full = scope.select(F.col("query_id").cast("string").alias("query_id"), "doc_id").distinct().join(words, "doc_id")
    hit = full.join(q, "query_id").filter(F.size(F.array_except("words", "body")) == 0)
    return hit.select("query_id", "path", F.round(cover_rank(F.col("body"), F.col("words")), DIGITS).alias("score"))


def fts(queries: DataFrame, corpus: DataFrame, n: int, scope: DataFrame | None = None) -> DataFrame:
    """Top-n text matches: ``query_id, path, score, rank0``.

    Without a scope the texts are read once for each block of word sets and no pair is written.
    """
    if scope is not None:
        return _merge(fts_matches(queries, corpus, scope), n)
    asked = wordsets.keyed(query_words(queries))
    words = corpus.select("path", tokens(F.col("chunk_text")).alias("body"))
    return wordsets.merged([wordsets.search_texts(words, keys, n, DIGITS) for keys in wordsets.key_blocks(asked)], asked, n)


# -- G5, G6 ----------------------------------------------------------------------


def rrf_fuse(lists: list[DataFrame], key: str = "path", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (``query_id, key, rank0``)."""
    ranked = [x.select("query_id", key, "rank0") for x in lists]
    both = ranked[0]
    for other in ranked[1:]:
        both = both.unionByName(other)
    return both.groupBy("query_id", key).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank0") + k + 1)), DIGITS).alias("rrf_score"))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, min_score: float, parity: bool = False) -> DataFrame:
    """Fused top-k seeds with both scores kept.

    A chunk weak in the vector list stays only if it is in the text list.
    ``parity`` scores a chunk of both lists by its text score.
    """
    mark = lambda df, name: df.select("query_id", "path", F.col("score").alias(name), F.col("rank0").alias(f"{name}_rank"))
    j = mark(vector_hits, "vec").join(mark(text_hits, "fts"), ["query_id", "path"], "full_outer")
    share = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RRF_K + 1), F.lit(0.0))
    rrf = F.round(share("vec_rank") + share("fts_rank"), DIGITS)
    base = F.coalesce("fts", "vec") if parity else F.coalesce("vec", "fts")
    kept = j.withColumn("rrf_score", rrf).filter((base >= min_score) | F.col("fts").isNotNull())
    scored = kept.withColumn("score", F.greatest(base, F.col("rrf_score")))
    best = top_k(scored, ["query_id"], [F.desc("rrf_score"), F.asc("path")], k, "position")
    return best.select(
        "query_id", "path", "score", F.col("vec").alias("vec_score"), F.col("fts").alias("fts_score"), "rrf_score",
        F.lit("seed").alias("role"), "position")


def fetch_size(k: int) -> int:
    return max(FETCH_FACTOR * k, MIN_FETCH)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int, min_score: float = THRESHOLD, hint: Column | None = None, parity: bool = False) -> DataFrame:
    """``query_id, text, embedding`` -> fused top-k chunks per query."""
    pool = searchable(chunks, hint)
    n = fetch_size(k)
    return fuse(knn(queries, pool, n), fts(queries, pool, n), k, min_score, parity)


def search_in_docs(queries: DataFrame, scope: DataFrame, chunks: DataFrame, k: int = 2) -> DataFrame:
    """Hybrid search inside the documents listed per query (``query_id, doc_id``), no threshold."""
    pool = searchable(chunks)
    n = fetch_size(k)
    q = queries.withColumn("query_id", F.col("query_id").cast("string"))
    scoped = scope.select(F.col("query_id").cast("string").alias("query_id"), "doc_id").distinct()
    vec = knn_scoped(scoped.join(q.select("query_id", "embedding"), "query_id"), pool, "doc_id", n)
    return fuse(vec, fts(q, pool, n, scoped), k, 0.0)


# -- G25 ---------------------------------------------------------------------------


def trigrams(c: Column) -> Column:
    """Distinct three-letter windows of the padded lower-case words."""
    padded = F.concat(F.lit("  "), F.array_join(tokens(c), "  "), F.lit(" "))
    return bind(padded, lambda p: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substr(p, i, F.lit(3)))))


def gram_codes(c: Column) -> Column:
    """The trigrams as whole numbers: three code points of 21 bits, so equal numbers are equal trigrams."""
    point = lambda g, i: F.ascii(F.substr(g, F.lit(i), F.lit(1))).cast("bigint")
    return F.transform(trigrams(c), lambda g: point(g, 1) * (1 << 42) + point(g, 2) * (1 << 21) + point(g, 3))


def _least_common(a: Column, b: Column, least: float) -> Column:
    """Elements that sets of sizes ``a`` and ``b`` share at least when their similarity is ``least``."""
    return F.ceil((a + b) * (least / (1 + least)) - 1e-9).cast("int")


#: So many of the most frequent grams are ordered by their number of documents; all others count as rarer.
FREQUENT = 65_536
PROBE_SCHEMA = "id long, size int, sign long, probe long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, well spread (SplitMix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probes(rows: DataFrame, frequent: list[int], m: int) -> DataFrame:
    """``id, grams, deep, flat`` -> a row for every choice of ``m`` of the ``deep`` rarest grams and for each of the ``flat`` rarest.

    ``sign`` has a bit for each of 64 classes of grams, set if the class holds an odd number: signs differ in no more
    bits than sets in grams.
    """
    order = np.asarray(frequent, np.int64)  # rarest first
    at = np.argsort(order)
    sorted_codes, place = order[at], at.astype(np.int64)

    def rarest_first(codes: np.ndarray) -> np.ndarray:
        if not len(order):
            return np.sort(codes, axis=1)
        i = np.minimum(np.searchsorted(sorted_codes, codes), len(order) - 1)
        known = np.where(sorted_codes[i] == codes, place[i], -1)
        return np.take_along_axis(codes, np.lexsort((codes, known), axis=-1), axis=1)

    def chosen(codes: np.ndarray, width: int, k: int) -> np.ndarray:
        picks = np.asarray(list(combinations(range(width), k)), dtype=np.int64).reshape(-1, k)
        key = np.full((len(codes), len(picks)), k, np.uint64)
        for c in range(k):
            key = _mixed(key ^ _mixed(codes[:, picks[:, c]]))
        return key.view(np.int64)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(size=batch["grams"].map(len))
            for (size, deep, flat), part in batch.groupby(["size", "deep", "flat"]):
                step = max(1, (1 << 20) // (comb(deep, m) + flat + size))
                for i in range(0, len(part), step):
                    own = part.iloc[i:i + step]
                    codes = rarest_first(np.stack(own["grams"].to_numpy()))
                    sign = np.bitwise_xor.reduce(np.uint64(1) << (_mixed(codes) & np.uint64(63)), axis=1).view(np.int64)
                    keys = np.concatenate([chosen(codes, n, k) for n, k in ((deep, m), (flat, 1)) if n], axis=1)
                    yield pd.DataFrame({
                        "id": np.repeat(own["id"].to_numpy(), keys.shape[1]), "size": np.int32(size),
                        "sign": np.repeat(sign, keys.shape[1]), "probe": keys.ravel()})

    return rows.mapInPandas(some, PROBE_SCHEMA)


def fuzzy_doc_search(queries: DataFrame, docs: DataFrame, n: int = 5, least: float = 0.3) -> DataFrame:
    """Trigram similarity of document numbers, best ``n`` per query.

    Sets of sizes *a* and *b* of similarity ``least`` share at least *o* grams, so the *a - o + m* rarest
    of one and the *b - o + m* rarest of the other share *m*.  Candidates agree in a choice of ``m`` such grams, and
    their signs differ in no more bits than the sets may in grams.  A document that lacks too many of
    the grams that every query holds meets none.  All candidates are compared, so the result is exact.
    """
    m = 3 if least >= 0.6 else 1  # below that the choices would be too many
    bound = least - 1e-6  # similarities are rounded before they are compared
    near = lambda a, b: _least_common(a, b, bound) <= F.least(a, b)
    numbered = lambda df, key, text: stored(df.select(F.monotonically_increasing_id().alias("id"), key, gram_codes(F.col(text)).alias("grams")))
    q = numbered(queries, "query_id", "text").filter("grams is not null")
    asked = q.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # One row: sizes of the queries, and the grams of all of them (no more than the shortest holds).
    sizes = q.agg(F.collect_set(F.size("grams")).alias("a"), F.count("grams").alias("total"))
    every = asked.join(F.broadcast(sizes.select("total")), F.col("n") == F.col("total")).agg(F.collect_list("g").alias("every"))
    known = F.broadcast(sizes.select("a").crossJoin(F.broadcast(every)))
    b = F.size("grams")
    able = lambda a: near(a, b) & (a - F.size(F.array_except("every", "grams")) >= _least_common(a, b, bound))
    d = docs.select("doc_id", "doc_num").crossJoin(known).withColumn("grams", gram_codes(F.col("doc_num")))
    d = stored(d.select(F.monotonically_increasing_id().alias("id"), "doc_id", "grams", F.filter("a", able).alias("others")).filter(F.size("others") > 0))
    present = F.broadcast(d.agg(F.collect_set(F.size("grams")).alias("b")))
    rarity = d.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    frequent = [r["g"] for r in rarity.orderBy(F.desc("df"), "g").limit(FREQUENT).collect()][::-1]

    def keyed(rows: DataFrame, names: list[str]) -> DataFrame:
        """How many of its rarest grams a set shows: together with others, or alone where the sets share fewer than ``m``."""
        own = F.size("grams")
        common = lambda x: _least_common(own, x, bound)
        shown = lambda k, fits: F.coalesce(F.array_max(F.transform(F.filter("others", fits), lambda x: own - common(x) + k)), F.lit(0))
        wide = rows.select("id", "grams", shown(m, lambda x: common(x) >= m).alias("deep"), (shown(1, lambda x: common(x) < m) if m > 1 else F.lit(0)).alias("flat"))
        return _probes(wide.filter("deep + flat > 0"), frequent, m).toDF(*names, "probe")

    left = keyed(q.crossJoin(present).withColumn("others", F.filter("b", lambda x: near(F.size("grams"), x))), ["qid", "a", "qs"])
    right = keyed(d, ["did", "b", "ds"])
    apart = F.col("a") + F.col("b") - 2 * _least_common(F.col("a"), F.col("b"), bound)
    met = left.join(right.hint("merge"), "probe").filter(F.bit_count(F.col("qs").bitwiseXOR(F.col("ds"))) <= apart)
    pairs = met.select("qid", "did").distinct()
    full = pairs.join(q.select(F.col("id").alias("qid"), "query_id", "grams").hint("merge"), "qid").join(
        d.select(F.col("id").alias("did"), "doc_id", F.col("grams").alias("doc_grams")).hint("merge"), "did")
    common = F.size(F.array_intersect("grams", "doc_grams"))
    sim = F.round(common / (F.size("grams") + F.size("doc_grams") - common), DIGITS)
    scored = full.select("query_id", "doc_id", sim.alias("similarity")).filter(F.col("similarity") >= least)
    return top_k(scored, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], n)
