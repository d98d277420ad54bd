"""Search queries (family G, first part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import indexes, search
from provisio.plans.registry import query
from provisio.streaming.jobs import new_folder

MIN_SCORE = 0.35

POOL = "pool AS (SELECT * FROM chunks WHERE is_effective AND chunk_type <> 'signature' AND status_flag <> 2)"
VEC = """vec AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) - 1 AS rank0 FROM (
   SELECT query_id, path, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM q, pool p) QUALIFY rank0 < {n})"""
HITS = """toks AS (SELECT path, doc_id, regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{N}]+') AS body FROM pool),
 qw AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS words FROM q),
 found AS (SELECT query_id, path, doc_id, body, words FROM qw, toks WHERE len(words) > 0 AND list_has_all(body, words)),
 occ AS (SELECT query_id, path, len(words) AS m, w, i FROM (SELECT query_id, path, words, unnest(body) AS w, unnest(range(len(body))) AS i FROM found) WHERE list_contains(words, w)),
 ends AS (SELECT a.query_id, a.path, a.i AS e, a.m, b.w, max(b.i) AS last FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.path = b.path AND b.i <= a.i GROUP BY 1, 2, 3, 4, 5),
 covers AS (SELECT query_id, path, e, min(last) AS s FROM ends GROUP BY query_id, path, e, m HAVING count(*) = m),
 ranked AS (SELECT query_id, path, round(sum(1.0::DOUBLE / (e - s + 1)), 6) AS score FROM (SELECT query_id, path, s, min(e) AS e FROM covers GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
FTS = "fts AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) - 1 AS rank0 FROM ranked QUALIFY rank0 < {n})"
FUSED = """fused AS (SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.path, f.path) AS path, v.score AS vec_score, f.score AS fts_score,
   round(coalesce(1.0::DOUBLE / (61 + v.rank0), 0) + coalesce(1.0::DOUBLE / (61 + f.rank0), 0), 6) AS rrf_score FROM vec v FULL JOIN fts f ON f.query_id = v.query_id AND f.path = v.path)"""
FINAL = """SELECT query_id, path, greatest(coalesce(vec_score, fts_score), rrf_score) AS score, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, path) AS position
  FROM fused WHERE coalesce(vec_score, fts_score) >= {m} OR fts_score IS NOT NULL QUALIFY position <= {k}"""


@query("knn_legal", "SELECT query_id, path, score, rank0 FROM vec", views="chunks q", ctes=f"{POOL}, {VEC.format(n=12)}")
def _(t):
    return search.knn(t.queries(), search.searchable(t.chunks()), 12)


@query("knn_legal_hint", """SELECT query_id, path, score, rank0 FROM vec""", views="chunks q",
       ctes=f"{POOL.replace('status_flag <> 2', chr(39) + 'x' + chr(39) + ' = ' + chr(39) + 'x' + chr(39) + ' AND status_flag <> 2 AND (doc_type ILIKE ' + chr(39) + '%luật%' + chr(39) + ' OR title ILIKE ' + chr(39) + '%luật%' + chr(39) + ')')}, {VEC.format(n=12)}")
def _(t):
    return search.knn(t.queries(), search.searchable(t.chunks(), search.type_hint("luật")), 12)


ALL_VECTORS = """q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding FROM embeddings)"""


@query("knn_all_vectors", "SELECT query_id, path, score, rank0 FROM vec", views="chunks", ctes=f"{ALL_VECTORS}, {POOL}, {VEC.format(n=5)}")
def _(t):
    q = t.vectors().select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return search.knn(q, search.searchable(t.chunks()), 5)


@query("knn_blocks", "SELECT query_id, path, score, rank0 FROM vec", views="chunks", ctes=f"{ALL_VECTORS}, {POOL}, {VEC.format(n=5)}")
def _(t):
    q = t.vectors().select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return search.knn_blocks(q, search.searchable(t.chunks()), 5, block=128, cell_rows=2000)


@query("knn_ann")
def _(t):
    pool = search.searchable(t.chunks())
    return search.knn_ann(t.queries(), pool, 12, search.train_cells(pool))


def vector_index(t, pool):
    folder = new_folder(t.spark, "vector-index")
    indexes.write_vector_index(pool, folder)
    return folder


@query("knn_index")
def _(t):
    """From the stored index, two fifths of its cells probed; tests measure the recall."""
    folder = vector_index(t, search.searchable(t.chunks()))
    cells = t.spark.read.parquet(f"{folder}/centers").count()
    return indexes.knn_index(t.queries(), folder, 12, -(-2 * cells // 5))


@query("knn_index_whole", "SELECT query_id, path, score, rank0 FROM vec", views="chunks q", ctes=f"{POOL}, {VEC.format(n=12)}")
def _(t):
    return indexes.knn_index(t.queries(), vector_index(t, search.searchable(t.chunks())), 12, indexes.MOST_CELLS, group_rows=2000, block=64)


@query("knn_contract", """SELECT doc_id AS query_id, path, score, rank0 FROM (SELECT q.doc_id, c.path, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score,
   row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.path) - 1 AS rank0
  FROM chunks q JOIN chunks c ON c.doc_id = q.doc_id WHERE q.chunk_type = 'preamble') WHERE rank0 < 5""")
def _(t):
    c = t.chunks()
    q = c.filter("chunk_type = 'preamble'").select(F.col("doc_id").alias("query_id"), "doc_id", "embedding")
    return search.knn_scoped(q, c, "doc_id", 5)


@query("fts_legal", "SELECT query_id, path, score, rank0 FROM fts", views="chunks q", ctes=f"{POOL}, {HITS}, {FTS.format(n=12)}")
def _(t):
    return search.fts(t.queries(), search.searchable(t.chunks()), 12)


SHORT = """q AS (SELECT vec_id AS query_id, w1 || ' ' || w2 AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS vec_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1] AS w1,
   regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[2] AS w2 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) WHERE w2 IS NOT NULL)"""


@query("fts_short_queries", "SELECT query_id, path, score, rank0 FROM fts", views="chunks", ctes=f"{SHORT}, {POOL}, {HITS}, {FTS.format(n=12)}")
def _(t):
    return search.fts(short_queries(t), search.searchable(t.chunks()), 12)


@query("fts_index", "SELECT query_id, path, score, rank0 FROM fts", views="chunks", ctes=f"{SHORT}, {POOL}, {HITS}, {FTS.format(n=12)}")
def _(t):
    folder = new_folder(t.spark, "text-index")
    indexes.write_text_index(search.searchable(t.chunks()), folder)
    return indexes.fts_index(short_queries(t), folder, 12)


def short_queries(t):
    low = t.raw("labels").filter("quality = 0").select("doc_id")
    pair = r"([\p{L}\p{N}]+)[^\p{L}\p{N}]+([\p{L}\p{N}]+)"
    first = F.regexp_extract_all(F.regexp_extract(F.lower("text"), pair, 0), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    w = t.spread("documents").join(low, "doc_id", "left_semi").select(F.col("doc_id").cast("string").alias("query_id"), F.array_join(first, " ").alias("text"))
    return w.filter("text <> ''")


@query("rrf_fuse", """SELECT query_id, path, round(sum(1.0::DOUBLE / (61 + rank0)), 6) AS rrf_score FROM (SELECT query_id, path, rank0 FROM vec UNION ALL SELECT query_id, path, rank0 FROM fts) GROUP BY 1, 2""",
       views="chunks q", ctes=f"{POOL}, {VEC.format(n=12)}, {HITS}, {FTS.format(n=12)}")
def _(t):
    pool = search.searchable(t.chunks())
    q = t.queries()
    return search.rrf_fuse([search.knn(q, pool, 12), search.fts(q, pool, 12)])


@query("hybrid_search", FINAL.format(m=MIN_SCORE, k=5), views="chunks q", ctes=f"{POOL}, {VEC.format(n=20)}, {HITS}, {FTS.format(n=20)}, {FUSED}")
def _(t):
    return search.hybrid_search(t.queries(), t.chunks(), 5, MIN_SCORE).select("query_id", "path", "score", "rrf_score", "position")


IN_DOCS = """scope AS (SELECT DISTINCT v.query_id, doc_id FROM vec0 v JOIN pool p ON p.path = v.path),
 vec AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) - 1 AS rank0 FROM (
   SELECT s.query_id, p.path, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM scope s JOIN q ON q.query_id = s.query_id JOIN pool p ON p.doc_id = s.doc_id) QUALIFY rank0 < 12)"""


@query("search_in_docs", FINAL.format(m=0.0, k=2), views="chunks q",
       ctes=f"{POOL}, {VEC.format(n=5).replace('vec AS', 'vec0 AS', 1)}, {IN_DOCS}, {HITS.replace('FROM qw, toks WHERE', 'FROM qw JOIN scope USING (query_id) JOIN toks USING (doc_id) WHERE')}, {FTS.format(n=12)}, {FUSED}")
def _(t):
    chunks, q = t.chunks(), t.queries()
    pool = search.searchable(chunks)
    scope = search.knn(q, pool, 5).join(pool.select("path", "doc_id"), "path").select("query_id", "doc_id")
    return search.search_in_docs(q, scope, chunks).select("query_id", "path", "score", "rrf_score", "position")


# In SQL every customer meets every document; tests/test_scale.py compares this one with brute force instead.
@query("fuzzy_doc_search")
def _(t):
    q = t.raw("customer").select(F.col("c_custkey").alias("query_id"), F.concat("c_custkey", F.lit("/1997/NĐ-CP")).alias("text"))
    return search.fuzzy_doc_search(q, t.documents(), 5, 0.75).select("query_id", "doc_id", "similarity")
