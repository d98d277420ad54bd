"""Snapshot upserts: join old and new rows, write a new snapshot.

Parquet has no MERGE, so every operator returns the whole new table (or the
rows to append); the caller writes it beside the old one and swaps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.session import shared_folder


def keep_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row per key by partial aggregation (no window, no hot key)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merge: dict | None = None) -> DataFrame:
    """New rows replace old ones by key.

    ``merge`` maps a column to ``f(new_col, old_col)`` for columns that are not
    simply replaced when the key is present on both sides.
    """
    cols = old.columns
    o = old.select(*[F.col(c).alias(c if c in keys else f"o_{c}") for c in cols], F.lit(True).alias("in_old"))
    n = new.select(*[F.col(c).alias(c if c in keys else f"n_{c}") for c in cols], F.lit(True).alias("in_new"))
    joined = o.join(n, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        fresh, kept = F.col(f"n_{c}"), F.col(f"o_{c}")
        if merge and c in merge:
            fresh = merge[c](fresh, kept)
        return F.when(F.col("in_new"), fresh).otherwise(kept).alias(c)

    return joined.select(*[value(c) for c in cols])


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["doc_id"], {"path": F.coalesce})


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows without a path are dropped; vector, root and element id survive a null."""
    root = F.coalesce("root_path", P.article_root(F.col("path")))
    keep = {c: F.coalesce for c in ("embedding", "root_path", "source_element_id") if c in old.columns}
    return upsert(old, new.filter("path is not null").withColumn("root_path", root), ["path"], keep)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Effect dates survive a null, a status of 0 changes nothing; orphans are dropped.

    A clause needs a known article above it and a point a known clause.
    """
    known = old.select("path").unionByName(new.select("path")).distinct()
    above = F.when(F.col("level") == "Clause", P.article_root(P.path_parent(F.col("path")))).when(
        F.col("level") == "Point", P.nearest_clause(P.path_parent(F.col("path"))))
    free = new.filter("level not in ('Clause', 'Point')")
    bound = new.filter("level in ('Clause', 'Point')").withColumn("__up", above)
    kept = bound.join(known.withColumnRenamed("path", "__up"), "__up", "left_semi").drop("__up")
    merge = {c: F.coalesce for c in ("eff_from", "eff_to", "eff_flag") if c in old.columns}
    merge["status_flag"] = lambda n, o: F.coalesce(F.nullif(n, F.lit(0)), o, F.lit(0))
    return upsert(old, free.unionByName(kept), ["path"], merge)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: one per new key that is not there yet."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def insert_path_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Path edges with default type; ``id:structural`` references become paths."""
    as_path = lambda c: F.coalesce(P.ref_to_path(F.col(c)), F.col(c)).alias(c)
    rows = new.select(as_path("source_path"), as_path("target_path"), F.coalesce("ref_type", F.lit("dan_chieu")).alias("ref_type"))
    return insert_ignore(old, rows, ["source_path", "target_path", "ref_type"])


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys present in ``new`` are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_partitions(new: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions that ``new`` touches."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def resume_anti_join(source: DataFrame, done: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Ids still to do, in id order; ``limit`` counts new ids only."""
    todo = source if force else source.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    return todo if limit is None else todo.orderBy("doc_id").limit(limit)


def stub_documents(edges: DataFrame, docs: DataFrame, stubs: DataFrame | None = None) -> DataFrame:
    """Placeholder rows for edge endpoints without a document."""
    ends = edges.select(F.explode(F.array("from_doc_id", "to_doc_id")).alias("doc_id")).filter("doc_id <> ''").distinct()
    missing = ends.join(docs.select("doc_id"), "doc_id", "left_anti")
    if stubs is None:
        known = missing.withColumns({c: F.lit(None).cast("string") for c in ("doc_num", "title", "doc_type")})
    else:
        known = missing.join(stubs.select("doc_id", "doc_num", "title", "doc_type"), "doc_id", "left")
    return known.select(
        "doc_id", F.coalesce("doc_num", "doc_id").alias("doc_num"),
        F.coalesce("title", F.concat(F.lit("Stub "), F.col("doc_id"))).alias("title"),
        F.coalesce("doc_type", F.lit("Unknown")).alias("doc_type"), F.lit(0).alias("status_flag"))


# -- A14 --------------------------------------------------------------------


def graph_vertices(docs: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    v = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "status_flag")
    return v("Document", docs, "doc_id").unionByName(v("Node", nodes, "path")).unionByName(v("Chunk", chunks, "path"))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def graph_edges(docs: DataFrame, nodes: DataFrame, chunks: DataFrame, doc_edges: DataFrame, path_edges: DataFrame) -> DataFrame:
    """Typed edges of the document / node / chunk graph; a chunk has a node only when the paths are equal."""
    from provisio.operators.relations import relation_type_map

    def edge(df, src, kind, dst):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(F.col(src).alias("src"), kind.alias("kind"), F.col(dst).alias("dst"))

    # Nodes are met three times and chunks twice: each is worked out once.
    nodes, chunks = _written(nodes.select("doc_id", "path", "parent_path")), _written(chunks.select("doc_id", "path"))
    ids = docs.select("doc_id")
    has_node = edge(nodes.join(ids, "doc_id", "left_semi"), "doc_id", "HAS_NODE", "path")
    parents = nodes.filter("parent_path is not null").join(
        nodes.select(F.col("path").alias("parent_path")), "parent_path", "left_semi")
    of_node = chunks.join(nodes.select("path"), "path", "left_semi").withColumn("node", F.col("path"))
    return (
        has_node.unionByName(edge(parents, "parent_path", "PARENT_OF", "path"))
        .unionByName(edge(chunks, "path", "OF_DOC", "doc_id")).unionByName(edge(of_node, "path", "OF_NODE", "node"))
        .unionByName(edge(doc_edges, "from_doc_id", relation_type_map(F.col("relation_type")), "to_doc_id"))
        .unionByName(edge(path_edges, "source_path", "REFERS_TO", "target_path")).distinct()
    )


# -- A18..A24 ---------------------------------------------------------------


def scan_counts(chunks: DataFrame, doc_edges: DataFrame, path_edges: DataFrame) -> DataFrame:
    """Per document: chunks, body, effectivity, relations, path relations."""
    owner = chunks.select(P.article_root(F.col("path")).alias("art"), "doc_id").distinct()
    c = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_type") == "body").alias("body"),
        F.count_if(F.col("chunk_type") == "effectivity").alias("effectivity"))
    r = doc_edges.groupBy(F.col("from_doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("relations"))
    p = (
        path_edges.groupBy(P.article_root(F.col("source_path")).alias("art")).agg(F.count(F.lit(1)).alias("n"))
        .join(owner, "art").groupBy("doc_id").agg(F.sum("n").alias("path_relations"))
    )
    out = c.join(r, "doc_id", "left").join(p, "doc_id", "left")
    return out.fillna(0, ["relations", "path_relations"])


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def contract_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """A null text keeps the stored one; a stored analysis is never touched."""
    return upsert(old, new, ["contract_id"], {"full_text": F.coalesce, "analysis": lambda n, o: o})


def save_analysis(contracts: DataFrame, analyses: DataFrame) -> DataFrame:
    """``contract_id, analysis`` (struct) stored as JSON, status ``analyzed``."""
    a = analyses.select("contract_id", F.to_json("analysis").alias("a_json"))
    return contracts.join(a, "contract_id", "left").withColumns({
        "analysis": F.coalesce("a_json", "analysis"),
        "status": F.when(F.col("a_json").isNotNull(), "analyzed").otherwise(F.col("status")),
    }).drop("a_json")


def list_contracts(contracts: DataFrame, user_id: str | Column) -> DataFrame:
    return contracts.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "contract_id")


def owned_contracts(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts asked for by their owner: a two-key lookup."""
    return contracts.join(requests.select("contract_id", "user_id").distinct(), ["contract_id", "user_id"], "left_semi")


def contract_text(contracts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored text, else the chunks in order, one per line."""
    missing = chunks.join(contracts.filter("full_text is null").select("contract_id"), "contract_id", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    built = missing.groupBy("contract_id").agg(
        F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("joined"))
    return contracts.join(built, "contract_id", "left").select("contract_id", F.coalesce("full_text", "joined").alias("text"))


def clause_text(chunks: DataFrame) -> DataFrame:
    """Text of each clause: its parts in chunk order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("contract_id", "clause_number").agg(
        F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("text"))


def analysis_cache(contracts: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to analyse, served from the cache)."""
    if force:
        return contracts, contracts.limit(0)
    return contracts.filter("analysis is null"), contracts.filter("analysis is not null")
