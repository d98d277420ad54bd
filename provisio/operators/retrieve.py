"""From seeds to a packed context: expansion, roles, ordering, fallback tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.functions import rank as R
from provisio.functions import scope as SC
from provisio.functions import status as S
from provisio.functions.rewrite import LABOR_CODE, rewrite_clause_query
from provisio.operators import search
from provisio.operators.relations import RELATED_BY_GRAPH, RELATED_BY_PATH, REPEAL_TYPES, relation_type_map
from provisio.operators.skew import top_k
from provisio.operators.tree import siblings_of
from provisio.session import shared_folder, written

# Caps of the expansion.
SIBLINGS, ANCESTORS, RELATED, REPEALED = 24, 16, 8, 8
META = ("doc_id", "doc_num", "doc_type", "title", "issue_date", "eff_from", "eff_to", "status_flag", "chunk_type", "chunk_text")


def _neighbours(query_docs: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """``edges``: ``doc_id, other``.  First ``limit`` neighbours by id per query.

    A document can give at most ``limit`` of them, so its list is cut to that
    before the join; a document named by most edges stays small.
    """
    asked = edges.join(query_docs.select("doc_id").distinct(), "doc_id", "left_semi")
    few = top_k(asked.distinct(), ["doc_id"], ["other"], limit).drop("rn")
    found = query_docs.join(few, "doc_id").select("query_id", "other").distinct()
    return top_k(found, ["query_id"], ["other"], limit).drop("rn")


def expand_seeds(seeds: DataFrame, chunks: DataFrame, nodes: DataFrame, doc_edges: DataFrame, backend: str = "graph") -> DataFrame:
    """``query_id, path, doc_id`` -> ``query_id, kind, key, source``.

    Kinds: sibling, ancestor, parent_clause (paths), related, repealed_by
    (documents).  Backends: ``graph`` (node tree, two undirected hops), ``path``
    (path prefixes, one outgoing hop) or ``both`` (graph first).
    """
    if backend == "both":
        rows = expand_seeds(seeds, chunks, nodes, doc_edges, "graph").unionByName(
            expand_seeds(seeds, chunks, nodes, doc_edges, "path"))
        return rows.groupBy("query_id", "kind", "key").agg(F.min("source").alias("source"))
    # Seven joins read the seeds, and the search that found them would run for each.
    q = _settle(seeds.select(F.col("query_id").cast("string").alias("query_id"), "path", "doc_id"))
    if backend == "graph":  # five of them read the nodes
        nodes = written(nodes.select("path", "parent_path", "level"), "seed-nodes")
    docs = q.select("query_id", "doc_id").distinct()
    ups = q.select("query_id", "path", F.explode(P.path_prefixes(F.col("path"), proper=True)).alias("key"))
    repeal_codes = [*REPEAL_TYPES, "REPEALS", "SUPERSEDES"]
    repeals = doc_edges.filter(F.col("relation_type").isin(*repeal_codes)).select(
        F.col("to_doc_id").alias("doc_id"), F.col("from_doc_id").alias("other"))
    if backend == "graph":
        known = nodes.select(F.col("path").alias("key"))
        on_node = q.join(nodes.select("path", "parent_path"), "path")
        near = ups.filter(P.path_depth(F.col("path")) - P.path_depth(F.col("key")) <= 4).join(known, "key", "left_semi")
        near = near.join(on_node.select("query_id", "path"), ["query_id", "path"], "left_semi")
        clause = nodes.filter("level = 'Clause'").select(F.col("path").alias("parent_path"))
        under = on_node.join(clause, "parent_path", "left_semi").select("query_id", "path")
        sib = siblings_of(under, nodes, SIBLINGS).select("query_id", F.col("path").alias("key"))
        parents = on_node.join(clause, "parent_path", "left_semi").select("query_id", F.col("parent_path").alias("key"))
        kinds = doc_edges.filter(relation_type_map(F.col("relation_type")).isin(*RELATED_BY_GRAPH))
        both = kinds.select(F.col("from_doc_id").alias("a"), F.col("to_doc_id").alias("b")).unionByName(
            kinds.select(F.col("to_doc_id").alias("a"), F.col("from_doc_id").alias("b"))).filter("a <> b")
        # Only the edges of what is reached are made distinct and ordered.
        first = docs.join(both.withColumnRenamed("a", "doc_id"), "doc_id").select("query_id", "doc_id", F.col("b").alias("other")).distinct()
        reached = both.join(first.select(F.col("other").alias("a")).distinct(), "a", "left_semi")
        few = top_k(reached.distinct(), ["a"], ["b"], RELATED + 1).drop("rn")
        second = first.join(few, F.col("other") == F.col("a")).filter("b <> doc_id").select("query_id", F.col("b").alias("other"))
        rel = top_k(first.select("query_id", "other").unionByName(second).distinct(), ["query_id"], ["other"], RELATED)
    else:
        near = ups
        sib = siblings_of(q.select("query_id", "path"), chunks, SIBLINGS).select("query_id", F.col("path").alias("key"))
        parents = q.select("query_id", P.nearest_clause(F.col("path")).alias("key")).filter("key is not null")
        codes = [*RELATED_BY_PATH, "BASED_ON", "CITES", "AMENDS"]
        out = doc_edges.filter(F.col("relation_type").isin(*codes)).select(
            F.col("from_doc_id").alias("doc_id"), F.col("to_doc_id").alias("other"))
        rel = _neighbours(docs, out, RELATED)
    anc = top_k(near.select("query_id", "key").distinct(), ["query_id"], ["key"], ANCESTORS)
    tag = lambda df, kind, key="key": df.select("query_id", F.lit(kind).alias("kind"), F.col(key).alias("key"))
    rows = (
        tag(sib, "sibling").unionByName(tag(anc, "ancestor")).unionByName(tag(parents.distinct(), "parent_clause"))
        .unionByName(tag(rel, "related", "other")).unionByName(tag(_neighbours(docs, repeals, REPEALED), "repealed_by", "other")))
    return rows.withColumn("source", F.lit(0 if backend == "graph" else 1))


def hydrate_paths(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text and document metadata by path; ``id:structural`` references are accepted."""
    key = F.coalesce(P.ref_to_path(F.col("path")), F.col("path"))
    return paths.withColumn("path", key).join(chunks.select("path", *META), "path")


def assign_roles(seeds: DataFrame, expansion: DataFrame, related_hits: DataFrame, superseding_hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per query and chunk with its first role and notes."""
    seed_rows = seeds.select("query_id", "path", "score", F.lit(0).alias("pri"), F.lit("seed").alias("role"))
    no_score = F.lit(None).cast("double").alias("score")
    tree_rows = expansion.filter("kind in ('sibling', 'parent_clause', 'ancestor')").select(
        "query_id", F.col("key").alias("path"), no_score,
        F.when(F.col("kind") == "ancestor", 2).otherwise(1).alias("pri"),
        F.when(F.col("kind") == "ancestor", "ancestor").otherwise("sibling").alias("role"))
    hits = lambda df, pri, role: df.select("query_id", "path", "score", F.lit(pri).alias("pri"), F.lit(role).alias("role"))
    rows = seed_rows.unionByName(tree_rows).unionByName(hits(related_hits, 3, "related")).unionByName(hits(superseding_hits, 4, "superseding"))
    first = rows.groupBy("query_id", "path").agg(F.min_by(F.struct("role", "score", "pri"), "pri").alias("r")).select("query_id", "path", "r.role", "r.score")
    full = first.join(chunks.select("path", *META), "path")
    repealing = expansion.filter("kind = 'repealed_by'").select("query_id", F.col("key").alias("doc_id"), F.lit(True).alias("repealing"))
    replaced = (
        seeds.select("query_id", "path").join(chunks.select("path", "doc_id"), "path").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("doc_id")), ", ").alias("replaced")))
    noted = full.join(repealing, ["query_id", "doc_id"], "left").join(replaced, "query_id", "left")
    note = F.when(F.col("role") == "superseding", F.concat(F.lit("replaces "), "replaced")).when(
        F.col("repealing") & F.col("role").isin("seed", "related"), "source_doc_may_be_repealed")
    return noted.withColumn("note", note).drop("repealing", "replaced")


def sector_filter(rows: DataFrame, context: Column, sectors=SC.SECTORS, general: str = SC.GENERAL_LABOR) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows by sector of the instrument against the contract's words."""
    law = SC.scope_text(F.col("title"), F.col("doc_num"), F.col("doc_type"), F.col("chunk_text"))
    tagged = rows.withColumn("__out", F.coalesce(SC.sector_mismatch(law, context, sectors, general), F.lit(False)))
    return tagged.filter("not __out").drop("__out"), tagged.filter("__out").drop("__out")


def order_for_prompt(rows: DataFrame, as_of) -> DataFrame:
    """Rank per query: usable first, then level, status, year, role, score, path."""
    bucket = S.validity_bucket(F.col("status_flag"), F.col("eff_from"), F.col("eff_to"), as_of)
    rows = rows.withColumn("bucket", bucket)
    order = [
        F.asc("bucket"), F.desc(R.normative_rank(F.col("doc_type"), F.col("title"))),
        F.desc(S.status_rank(F.col("status_flag"), F.col("bucket"))),
        F.desc(S.ranking_year(F.col("issue_date"), F.col("eff_from"))),
        F.asc(F.coalesce(P.lookup(R.ROLE_RANK, F.col("role")), F.lit(9))), F.desc(F.coalesce("score", F.lit(0.0))), F.asc("path")]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def prefer_effective(ordered: DataFrame, max_total: int = 10) -> DataFrame:
    """Only usable rows where a query has any; then the first ``max_total``."""
    usable = ordered.filter("bucket = 0").select("query_id").distinct()
    live = ordered.filter("bucket = 0")
    rest = ordered.filter("bucket <> 0").join(usable, "query_id", "left_anti")
    return top_k(live.unionByName(rest), ["query_id"], ["position"], max_total, "place").drop("position").withColumnRenamed("place", "position")


# -- G19, G20 -----------------------------------------------------------------


def _settle(df: DataFrame) -> DataFrame:
    """Write a small intermediate (at most k rows per query) to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def seed_fallback(
    queries: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 4, min_score: float = search.THRESHOLD,
    sectors=SC.SECTORS, general: str = SC.GENERAL_LABOR,
) -> DataFrame:
    """Seeds per clause with the tier that found them.

    ``queries``: ``query_id, title, summary, contract_type, text``.  Tiers: 1
    above the threshold, 2 without it, 3-5 type / title / summary alone, 6
    general labour law where the sector filter left nothing.  A later tier runs
    on the queries that are still without a seed.  ``embed`` maps ``id, text``
    to ``id, embedding``.
    """
    pool = search.searchable(chunks)
    n = search.fetch_size(k)
    meta = chunks.select("path", *META)
    held = search.stored(search.by_vector(pool, n))  # every tier scans the same vectors

    def vectors(q: DataFrame) -> DataFrame:
        e = embed(q.select(F.col("query_id").alias("id"), "text"))
        return q.select("query_id", "text").join(e.select(F.col("id").alias("query_id"), "embedding"), "query_id")

    q = _settle(vectors(queries))
    vec, text = _settle(search.nearest(q, held, n)), _settle(search.fts(q, pool, n))
    strict = search.fuse(vec, text, k, min_score).withColumn("tier", F.lit(1))
    loose = search.fuse(vec, text, k, 0.0).withColumn("tier", F.lit(2))
    seeds = strict.unionByName(loose.join(strict.select("query_id").distinct(), "query_id", "left_anti"))
    seeds = _settle(seeds)
    for tier, column in ((3, "contract_type"), (4, "title"), (5, "summary")):
        left = queries.join(seeds.select("query_id").distinct(), "query_id", "left_anti").withColumn("text", F.trim(column)).filter("text <> ''")
        if left.isEmpty():
            continue
        qv = _settle(vectors(left))
        seeds = _settle(seeds.unionByName(search.fuse(search.nearest(qv, held, n), search.fts(qv, pool, n), k, 0.0).withColumn("tier", F.lit(tier))))
    context = queries.select("query_id", F.concat_ws(" ", "contract_type", "title", "summary").alias("context"))
    full = seeds.join(meta, "path").join(context, "query_id")
    kept, dropped = sector_filter(full, F.col("context"), sectors, general)
    emptied = dropped.select("query_id").distinct().join(kept.select("query_id").distinct(), "query_id", "left_anti")
    again = queries.join(emptied, "query_id", "left_semi").withColumn(
        "text", F.concat_ws(" ", F.lit(LABOR_CODE), F.trim("title"), F.substring(F.trim("summary"), 1, 200)))
    if again.isEmpty():
        return kept.select(*seeds.columns)
    qv = _settle(vectors(again))
    found = search.fuse(search.nearest(qv, held, n), search.fts(qv, pool, n), k, 0.0).withColumn("tier", F.lit(6))
    found = found.join(meta, "path").join(context, "query_id")
    kept2, _out = sector_filter(found, F.col("context"), sectors, general)
    recovered = kept2.unionByName(found.join(kept2.select("query_id").distinct(), "query_id", "left_anti"))
    return kept.select(*seeds.columns).unionByName(recovered.select(*seeds.columns))


def retrieve_for_clause(
    clauses: DataFrame, chunks: DataFrame, nodes: DataFrame, doc_edges: DataFrame, embed: Callable[[DataFrame], DataFrame], as_of,
    k_seed: int = 4, max_total: int = 10, min_score: float = search.THRESHOLD, backend: str = "graph",
    sectors=SC.SECTORS, general: str = SC.GENERAL_LABOR,
) -> DataFrame:
    """Law for every clause at once: ``query_id, title, summary, contract_type`` -> ordered chunks."""
    queries = clauses.select(
        F.col("query_id").cast("string").alias("query_id"), "title", "summary", "contract_type",
        rewrite_clause_query(F.col("title"), F.col("summary"), F.col("contract_type")).alias("text"))
    seeds = _settle(seed_fallback(queries, chunks, embed, k_seed, min_score, sectors, general))
    placed = seeds.join(chunks.select("path", "doc_id"), "path")
    expansion = _settle(expand_seeds(placed, chunks, nodes, doc_edges, backend))
    e = embed(queries.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "embedding")
    q = queries.select("query_id", "text").join(e, "query_id")
    scope = lambda kind: expansion.filter(F.col("kind") == kind).select("query_id", F.col("key").alias("doc_id"))
    related = search.search_in_docs(q, scope("related"), chunks)
    pairs = scope("repealed_by").withColumn("pair", F.concat_ws("\u0001", "query_id", "doc_id"))
    per_doc = search.search_in_docs(
        q.join(pairs.select("query_id", "pair"), "query_id").select(F.col("pair").alias("query_id"), "text", "embedding"),
        pairs.select(F.col("pair").alias("query_id"), "doc_id"), chunks)
    superseding = per_doc.withColumn("query_id", F.substring_index("query_id", "\u0001", 1))
    rows = assign_roles(seeds, expansion, related, superseding, chunks)
    context = queries.select("query_id", F.concat_ws(" ", "contract_type", "title", "summary").alias("context"))
    kept, _dropped = sector_filter(rows.join(context, "query_id"), F.col("context"), sectors, general)
    return prefer_effective(order_for_prompt(kept.drop("context"), as_of), max_total)


# -- G21..G24 -------------------------------------------------------------------

# Wording of the packed context.
STATUS_WORDS = {
    0: "chưa xác định", 1: "còn hiệu lực", 2: "hết hiệu lực", 3: "chưa có hiệu lực",
    4: "hết hiệu lực một phần", 5: "có hiệu lực một phần",
}
SECTIONS = (
    ("### Điều luật seed (truy hồi trực tiếp)", ("seed",)),
    ("### Văn bản thay thế / kế thừa (thay cho seed đã hết hiệu lực)", ("superseding",)),
    ("### Cùng khoản / ngữ cảnh cây (hydrate GraphRAG)", ("sibling", "ancestor")),
    ("### Văn bản liên quan (BASED_ON/CITES/AMENDS…)", ("related",)),
)


def pack_context(rows: DataFrame, width: int = 7000) -> DataFrame:
    """``query_id`` -> one text: sections by role, a header line per chunk, cut at ``width``."""
    role = F.when(F.col("role").isin(*R.ROLE_RANK), F.col("role")).otherwise("seed")
    header = F.concat(
        F.lit("["), F.coalesce("doc_num", "title", F.lit("Nguồn")), F.lit(" | "), F.coalesce("path", F.lit("")), F.lit(" | "), role, F.lit("]"),
        F.coalesce(F.concat(F.lit(" ["), P.lookup(STATUS_WORDS, F.col("status_flag")), F.lit("]")), F.lit("")),
        F.coalesce(F.concat(F.lit(" ["), "doc_type", F.lit("]")), F.lit("")),
        F.coalesce(F.concat(F.lit(" ["), F.year("issue_date").cast("string"), F.lit("]")), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), "note", F.lit(")")), F.lit("")))
    item = F.struct("position", role.alias("role"), F.concat_ws("\n", header, "chunk_text").alias("block"))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def section(title: str, roles: tuple[str, ...]) -> Column:
        def of_role(name: str) -> Column:
            return F.transform(F.filter("items", lambda x: x["role"] == name), lambda x: x["block"])

        blocks = F.concat(*[of_role(r) for r in roles])
        return F.when(F.size(blocks) > 0, F.concat(F.lit(title + "\n"), F.array_join(blocks, "\n\n")))

    return grouped.select("query_id", F.substring(F.concat_ws("\n\n", *[section(t, r) for t, r in SECTIONS]), 1, width).alias("context"))


def retrieval_route(queries: DataFrame, hits: DataFrame, min_score: float = search.THRESHOLD, max_attempts: int = 2) -> DataFrame:
    """generate / rewrite / refusal per query from its best score and attempts so far."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n_hits"))
    j = queries.select("query_id", "attempts").join(best, "query_id", "left")
    more = F.col("attempts") < max_attempts
    weak = F.coalesce(F.col("max_score") < min_score, F.lit(False))
    route = F.when(F.col("n_hits").isNull(), F.when(more, "rewrite").otherwise("refusal")).when(weak & more, "rewrite").otherwise("generate")
    return j.select("query_id", "max_score", route.alias("route"))


def article_snippet(requests: DataFrame, chunks: DataFrame, limit: int = 3) -> DataFrame:
    """``doc_id, article_no`` -> joined text of the effective chunks under that article, shallow first."""
    numbers = F.transform(F.filter(P.labels(F.col("path")), lambda x: x.rlike(r"^D\d+$")), lambda x: F.substring(x, 2, 18).cast("bigint"))
    rows = chunks.filter("is_effective").select("doc_id", "path", "chunk_text", F.explode(F.array_distinct(numbers)).alias("article_no"))
    asked = requests.select("doc_id", F.col("article_no").cast("bigint").alias("article_no")).distinct()
    few = top_k(rows.join(asked, ["doc_id", "article_no"], "left_semi"), ["doc_id", "article_no"], [P.path_depth(F.col("path")), F.col("path")], limit)
    parts = F.array_sort(F.collect_list(F.struct("rn", "path", "chunk_text")))
    return few.groupBy("doc_id", "article_no").agg(parts.alias("p")).select(
        "doc_id", "article_no", F.array_join(F.transform("p", lambda x: F.trim(x["chunk_text"])), "\n").alias("quote"),
        F.get("p", F.lit(0))["path"].alias("path"))


def number_key(c: Column) -> Column:
    return F.replace(F.upper(F.trim(c)), F.lit("Đ"), F.lit("D"))


def lookup_doc_number(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_num`` -> best document of that number, any case, Đ equal to D."""
    # Status preference.
    preference = F.coalesce(P.lookup({1: 0, 5: 1, 4: 2, 0: 3}, F.col("status_flag")), F.lit(9))
    rest = [c for c in docs.columns]
    best = docs.groupBy(number_key(F.col("doc_num")).alias("num_key")).agg(
        F.min_by(F.struct(*rest), F.struct(preference, F.col("doc_id"))).alias("d"))
    return requests.withColumn("num_key", number_key(F.col("doc_num"))).join(best, "num_key", "left").drop("num_key")

