"""Rewriting, expansion, ordering and the clause retrieval job (family G, second part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import rank as R
from provisio.functions import rewrite as W
from provisio.operators import embed, retrieve, search
from provisio.plans.catalog.retrieval import POOL, VEC
from provisio.plans.oracle import AS_OF as DAY
from provisio.plans.projections import AS_OF
from provisio.plans.registry import query
from provisio.streaming.jobs import new_folder

# Topic rules in the languages of the texts.
TOPICS = ((r"tion\b", "topic tion"), (r"heit\b", "topic heit"), (r"ción\b", "topic cion"))
FILL = "'^(the|and|or|a|an|to|of|for|with)$'"
REWRITE_SQL = """left(coalesce(nullif(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace({0}, '[!?.,;:()"''«»–—]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
   lambda w: length(w) > 1 AND NOT regexp_matches(lower(w), """ + FILL + """)), ' '), ''), trim(regexp_replace(regexp_replace({0}, '[!?.,;:()"''«»–—]+', ' ', 'g'), '\\s+', ' ', 'g'))), {1})"""


@query("rewrite_query", f"SELECT doc_id, line_no, {REWRITE_SQL.format('chunk_text', 400)} AS q FROM lines")
def _(t):
    return t.lines().select("doc_id", "line_no", W.rewrite_query(F.col("chunk_text")).alias("q"))


BOOSTS = """array_to_string(list_filter([CASE WHEN regexp_matches(lower({0}), 'tion([^\\p{{L}}\\p{{N}}_]|$)') THEN 'topic tion' END,
  CASE WHEN regexp_matches(lower({0}), 'heit([^\\p{{L}}\\p{{N}}_]|$)') THEN 'topic heit' END, CASE WHEN regexp_matches(lower({0}), 'ción([^\\p{{L}}\\p{{N}}_]|$)') THEN 'topic cion' END], lambda x: x IS NOT NULL), ' ')"""


@query("expand_topics", f"""SELECT doc_id, line_no, CASE WHEN b = '' THEN {REWRITE_SQL.format('chunk_text', 420)}
  ELSE left(trim(regexp_replace(trim(chunk_text, ' ') || ' ' || b, '\\s+', ' ', 'g')), 420) END AS q FROM (SELECT *, {BOOSTS.format('chunk_text')} AS b FROM lines)""")
def _(t):
    return t.lines().select("doc_id", "line_no", W.expand_topics(F.col("chunk_text"), boosts=TOPICS, split_terms=("no such", "word")).alias("q"))


@query("rewrite_clause_query", f"""SELECT doc_id, line_no, {REWRITE_SQL.format("'src ' || source || ' ' || trim(chunk_text)", 400).replace('[!?.,;:()"' + "''" + '«»–—]+', '[!?.,;:()"' + "''" + '«»–—]+')} AS q
  FROM lines""")
def _(t):
    kind = F.concat(F.lit("src Số: 12/2020 "), "source", F.lit(" 204/2026/HDLD"))
    return t.lines().select("doc_id", "line_no", W.rewrite_clause_query(F.col("chunk_text"), F.col("chunk_text"), kind).alias("q"))


@query("resolve_followup")
def _(t):
    c = t.raw("conversations")
    prior = c.select("conv_id", F.struct("turn", "role", "text").alias("m"), F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + 4)).alias("turn"))
    history = prior.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("m")).alias("h"))
    asked = c.filter("role = 'user'").join(history, ["conv_id", "turn"], "left")
    h = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    labels = ((r"\bthe\b", "english"), (r"\bder\b", "deutsch"), (r"\bles\b", "français"))
    return asked.select("conv_id", "turn", W.resolve_followup(F.col("text"), h, labels=labels).alias("q"))


SEEDS = "seeds AS (SELECT v.query_id, v.path, p.doc_id, v.score FROM vec v JOIN pool p ON p.path = v.path)"


def seeds(t):
    c = t.chunks()
    hits = search.knn(t.queries(), search.searchable(c), 4)
    return c, hits.join(c.select("path", "doc_id"), "path")


PATH_EXPANSION = f"""docs_of AS (SELECT DISTINCT query_id, doc_id FROM seeds),
 sib AS (SELECT query_id, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path) AS rn FROM (SELECT DISTINCT s.query_id, c.path FROM seeds s JOIN chunks c
    ON regexp_replace(c.path, '\\.[^.]*$', '') = regexp_replace(s.path, '\\.[^.]*$', '') WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = s.query_id AND x.path = c.path))) WHERE rn <= 24),
 anc AS (SELECT query_id, a AS path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a) AS rn FROM (SELECT DISTINCT query_id, array_to_string(list_slice(string_split(path, '.'), 1, n), '.') AS a
    FROM seeds, (SELECT unnest(range(1, 5)) AS n))) WHERE rn <= 16),
 rel AS (SELECT query_id, o AS path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rn FROM (SELECT DISTINCT query_id, to_doc_id AS o FROM docs_of JOIN doc_edges ON from_doc_id = doc_id
    WHERE relation_type IN ('can_cu_ban_hanh','dan_chieu','sua_doi_bo_sung'))) WHERE rn <= 8),
 rep AS (SELECT query_id, o AS path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rn FROM (SELECT DISTINCT query_id, from_doc_id AS o FROM docs_of JOIN doc_edges ON to_doc_id = doc_id
    WHERE relation_type IN ('thay_the','van_ban_bi_bai_bo'))) WHERE rn <= 8)"""
EXPANDED = """SELECT query_id, 'sibling' AS kind, path AS key FROM sib UNION ALL SELECT query_id, 'ancestor', path FROM anc
  UNION ALL SELECT DISTINCT query_id, 'parent_clause', path FROM seeds UNION ALL SELECT query_id, 'related', path FROM rel UNION ALL SELECT query_id, 'repealed_by', path FROM rep"""


@query("expand_seeds_path", EXPANDED, views="chunks doc_edges q", ctes=f"{POOL}, {VEC.format(n=4)}, {SEEDS}, {PATH_EXPANSION}")
def _(t):
    c, s = seeds(t)
    return retrieve.expand_seeds(s, c, t.nodes(), t.doc_edges(), "path").select("query_id", "kind", "key")


@query("expand_seeds_graph", """SELECT query_id, 'ancestor' AS kind, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key) AS rn FROM (SELECT DISTINCT query_id, array_to_string(list_slice(string_split(path, '.'), 1, n), '.') AS key
    FROM seeds, (SELECT unnest(range(1, 5)) AS n) WHERE path IN (SELECT path FROM nodes))) WHERE rn <= 16
  UNION ALL SELECT query_id, 'related', b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b) AS rn FROM (SELECT query_id, b FROM docs_of JOIN und ON a = doc_id
     UNION SELECT query_id, y.b FROM docs_of JOIN und x ON x.a = doc_id JOIN und y ON y.a = x.b WHERE y.b <> doc_id)) WHERE rn <= 8
  UNION ALL SELECT query_id, 'repealed_by', path FROM rep""", views="chunks nodes doc_edges q", ctes=f"""{POOL}, {VEC.format(n=4)}, {SEEDS}, {PATH_EXPANSION},
  und AS (SELECT from_doc_id AS a, to_doc_id AS b FROM doc_edges WHERE relation_type IN ('can_cu_ban_hanh','dan_chieu','sua_doi_bo_sung')
   UNION SELECT to_doc_id, from_doc_id FROM doc_edges WHERE relation_type IN ('can_cu_ban_hanh','dan_chieu','sua_doi_bo_sung'))""")
def _(t):
    c, s = seeds(t)
    return retrieve.expand_seeds(s, c, t.nodes(), t.doc_edges(), "graph").select("query_id", "kind", "key")


@query("hydrate_paths", """SELECT c.path, c.doc_num, md5(chunk_text) AS text_md5 FROM chunks c""")
def _(t):
    c = t.chunks()
    ref = F.concat(F.substring_index("path", ".", 1), F.lit(":"), F.regexp_replace("path", r"^[^.]*\.", ""))
    return retrieve.hydrate_paths(c.select(ref.alias("path")), c).select("path", "doc_num", F.md5("chunk_text").alias("text_md5"))


@query("assign_roles", """SELECT query_id, path, role FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY pri) AS rn FROM (
  SELECT query_id, path, 'seed' AS role, 0 AS pri FROM seeds UNION ALL SELECT query_id, path, 'sibling', 1 FROM sib UNION ALL SELECT query_id, path, 'ancestor', 2 FROM anc)
  WHERE path IN (SELECT path FROM chunks)) WHERE rn = 1""", views="chunks doc_edges q", ctes=f"{POOL}, {VEC.format(n=4)}, {SEEDS}, {PATH_EXPANSION}")
def _(t):
    c, s = seeds(t)
    e = retrieve.expand_seeds(s, c, t.nodes(), t.doc_edges(), "path")
    none = s.filter("1 = 0").select("query_id", "path", "score")
    return retrieve.assign_roles(s, e, none, none, c).select("query_id", "path", "role")


SECTORS = (("luật", "tion"), ("thông tư", "heit"))


@query("sector_filter", """SELECT path, NOT (title NOT ILIKE '%bộ luật%' AND ((title ILIKE '%luật%' AND chunk_text NOT ILIKE '%tion%') OR (title ILIKE '%thông tư%' AND chunk_text NOT ILIKE '%heit%'))) AS kept FROM chunks""")
def _(t):
    kept, dropped = retrieve.sector_filter(t.chunks(), F.col("chunk_text"), SECTORS, "bộ luật")
    return kept.select("path", F.lit(True).alias("kept")).unionByName(dropped.select("path", F.lit(False).alias("kept")))


NORM = "CAST(CASE doc_type WHEN 'Bộ luật' THEN 0.95 WHEN 'Luật' THEN 0.92 WHEN 'Quyết định' THEN 0.68 WHEN 'Nghị định' THEN 0.60 ELSE 0.48 END AS DOUBLE)"


@query("normative_rank", f"SELECT doc_id, {NORM} AS level_rank FROM docs")
def _(t):
    return t.documents().select("doc_id", R.normative_rank(F.col("doc_type"), F.col("title")).alias("level_rank"))


ORDERED = f"""ordered AS (SELECT query_id, path, b, row_number() OVER (PARTITION BY query_id ORDER BY b, {NORM} DESC, CASE WHEN b = 99 THEN 0 WHEN status_flag = 1 THEN 1 ELSE 0.5 END DESC,
   year(issue_date) DESC, score DESC, path) AS position FROM (SELECT s.query_id, s.score, c.*, CASE WHEN status_flag = 2 OR eff_to <= {DAY} THEN 99 WHEN eff_from > {DAY} THEN 50 ELSE 0 END AS b
   FROM vec s JOIN chunks c ON c.path = s.path))"""
ALL_POOL = "pool AS (SELECT * FROM chunks)"


def ranked_rows(t):
    c = t.chunks()
    hits = search.knn(t.queries(), c, 30).withColumn("role", F.lit("seed"))
    return retrieve.order_for_prompt(hits.join(c.drop("embedding"), "path"), AS_OF)


@query("order_for_prompt", "SELECT query_id, path, position FROM ordered", views="chunks q", ctes=f"{ALL_POOL}, {VEC.format(n=30)}, {ORDERED}")
def _(t):
    return ranked_rows(t).select("query_id", "path", "position")


@query("prefer_effective", """SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY position) AS position FROM (SELECT *, min(b) OVER (PARTITION BY query_id) AS m FROM ordered)
  WHERE b = 0 OR m > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 10""", views="chunks q", ctes=f"{ALL_POOL}, {VEC.format(n=30)}, {ORDERED}")
def _(t):
    return retrieve.prefer_effective(ranked_rows(t)).select("query_id", "path", "position")


@query("pack_context")
def _(t):
    packed = retrieve.pack_context(retrieve.prefer_effective(ranked_rows(t)).withColumn("note", F.lit(None).cast("string")))
    return packed.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


@query("retrieval_route", """SELECT query_id, round(max_score, 6) AS max_score, CASE WHEN max_score IS NULL THEN CASE WHEN attempts < 2 THEN 'rewrite' ELSE 'refusal' END WHEN max_score < 0.4 AND attempts < 2 THEN 'rewrite' ELSE 'generate' END AS route
  FROM (SELECT q.query_id, CAST(split_part(q.query_id, '.', 1) AS BIGINT) % 4 AS attempts, (SELECT max(score) FROM vec v WHERE v.query_id = q.query_id AND v.score >= 0.3) AS max_score FROM q)""",
       views="chunks q", ctes=f"{POOL}, {VEC.format(n=5)}")
def _(t):
    q = t.queries().select("query_id", (F.substring_index("query_id", ".", 1).cast("bigint") % 4).alias("attempts"))
    hits = search.knn(t.queries(), search.searchable(t.chunks()), 5).filter("score >= 0.3")
    return retrieve.retrieval_route(q, hits, 0.4)


@query("article_snippet", """SELECT doc_id, CAST(doc_id AS BIGINT) AS article_no, md5(string_agg(trim(chunk_text), chr(10) ORDER BY path)) AS quote_md5, min(path) AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rn FROM chunks WHERE is_effective) WHERE rn <= 3 GROUP BY 1, 2""")
def _(t):
    ask = t.documents().select("doc_id", F.col("doc_id").alias("article_no"))
    return retrieve.article_snippet(ask, t.chunks()).select("doc_id", "article_no", F.md5("quote").alias("quote_md5"), "path")


@query("lookup_doc_number", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS found FROM orders")
def _(t):
    num = F.concat_ws("/", F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string"), F.lit("nd-cp"))
    ask = t.raw("orders").select("o_orderkey", num.alias("doc_num"))
    return retrieve.lookup_doc_number(ask, t.documents()).select("o_orderkey", F.col("d.doc_id").alias("found"))


def clause_rows(t):
    """Lines of the reference passages as clauses of a contract."""
    rows = t.raw("benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "summary")).filter("trim(summary) <> ''")
    return rows.select(F.concat_ws(".", "item_id", "pos").alias("query_id"), F.substring_index("summary", " ", 6).alias("title"), "summary",
                       F.lit("Hợp đồng lao động").alias("contract_type"))


def hashed_chunks(t):
    c = t.chunks().drop("embedding")
    e = embed.hashed_vectors(c.select(F.col("path").alias("id"), F.col("chunk_text").alias("text"))).withColumnRenamed("id", "path")
    # Stored once, as every tier of the search reads the vectors.
    target = new_folder(t.spark, "vectors")
    c.join(e, "path").write.parquet(target)
    return t.spark.read.parquet(target)


@query("seed_fallback")
def _(t):
    q = clause_rows(t).withColumn("text", W.rewrite_clause_query(F.col("title"), F.col("summary"), F.col("contract_type")))
    out = retrieve.seed_fallback(q, hashed_chunks(t), embed.hashed_vectors, sectors=SECTORS, general="bộ luật")
    return out.select("query_id", "path", "score", "tier")


@query("retrieve_for_clause")
def _(t):
    out = retrieve.retrieve_for_clause(
        clause_rows(t), hashed_chunks(t), t.nodes(), t.doc_edges(), embed.hashed_vectors, AS_OF, sectors=SECTORS, general="bộ luật")
    return out.select("query_id", "path", "role", "score", "position")
