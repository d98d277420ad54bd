"""Hierarchy construction and navigation as set operations over path columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.operators.skew import next_in_blocks, row_number_in_blocks, top_k

# -- B8 ---------------------------------------------------------------------


def allocate_tokens(siblings: DataFrame) -> DataFrame:
    """Give every sibling a label unique in its scope.

    Input: ``scope, pos, level, title, node_id``.  The first holder of a label
    keeps it; later holders and weak titles get an id-based one, with a number where
    ids of one scope begin alike; appendix and group entries fall back to their ordinal
    first.  Adds ``token`` (null for unknown levels).
    """
    known = P.lookup({**P.LEVEL_PREFIX, "Point": "p"}, F.col("level"))
    numbered = row_number_in_blocks(siblings, ["scope", "level"], F.col("pos"), ["pos"], "__ord")
    natural = P.segment_token(F.col("level"), F.col("title"))
    ordinal = F.when(
        F.col("level").isin("Appendix", "Group"), F.concat(known, F.col("__ord").cast("string"))
    )
    wished = numbered.withColumn("__prefix", known).withColumn("__wish", F.coalesce(natural, ordinal))
    holders = (
        wished.filter("__wish is not null and __prefix is not null")
        .groupBy(F.col("scope").alias("__s"), F.col("__wish").alias("__w")).agg(F.min("pos").alias("__first"))
    )
    joined = wished.join(holders, (F.col("scope") == F.col("__s")) & (F.col("__wish") == F.col("__w")), "left").drop("__s")
    fallback = P.id_token(F.col("__prefix"), F.col("node_id"), F.col("__ord") - 1)
    own = F.coalesce(F.col("__first") == F.col("pos"), F.lit(False))
    token = F.when(own, F.col("__wish")).otherwise(fallback)
    named = joined.withColumn("token", F.when(F.col("__prefix").isNotNull(), token)).withColumn("__own", own)
    named = row_number_in_blocks(named, ["scope", "token"], F.col("pos"), ["pos"], "__same")
    apart = F.when(~F.col("__own") & (F.col("__same") > 1), F.concat_ws("_", "token", "__same")).otherwise(F.col("token"))
    return named.withColumn("token", F.when(F.col("token").isNotNull(), apart)).drop(
        "__ord", "__prefix", "__wish", "__w", "__first", "__own", "__same"
    )


# -- B9 ---------------------------------------------------------------------

_TREE_SCHEMA = (
    "doc_id string, node_no int, raw_parent int, ancestors array<int>, level string, title string, "
    "node_id string, is_leaf boolean"
)


def _walk(text: str | None) -> Iterator[tuple]:
    """Depth-first order of one table of contents, without recursion."""
    roots = json.loads(text) if text else []
    stack = [(node, 0, ()) for node in reversed(roots)]
    number = 0
    while stack:
        node, parent, above = stack.pop()
        number += 1
        children = node.get("children") or []
        yield (
            number, parent, list(above), str(node.get("level") or "Other"), str(node.get("title") or ""),
            str(node.get("id") or node.get("key") or ""), bool(node.get("isLeaf")) or not children,
        )
        stack.extend((child, number, (*above, number)) for child in reversed(children))


def _flatten_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "node_no", "raw_parent", "ancestors", "level", "title", "node_id", "is_leaf"]
    for batch in batches:
        rows = [(d, *r) for d, t in zip(batch["doc_id"], batch["toc"], strict=True) for r in _walk(t)]
        yield pd.DataFrame(rows, columns=names)


def flatten_tree(tocs: DataFrame) -> DataFrame:
    """``doc_id, toc`` (JSON of any depth) -> one row per node with its structural path.

    Nodes of an unknown level vanish; their children join the path of the next
    known ancestor but count as a sibling list of their own.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace("title", "​", ""), r"(?U)\s+", " "))
    raw = tocs.select("doc_id", "toc").mapInPandas(_flatten_batches, _TREE_SCHEMA).withColumn("title", clean)
    scoped = raw.withColumn("scope", F.struct("doc_id", "raw_parent")).withColumn("pos", F.col("node_no"))
    tokens = allocate_tokens(scoped).drop("scope", "pos")
    steps = tokens.filter("token is not null").select(
        "doc_id", "node_no", F.posexplode(F.concat("ancestors", F.array("node_no"))).alias("step", "at")
    )
    labels = tokens.select("doc_id", F.col("node_no").alias("at"), "token")
    paths = (
        steps.join(labels, ["doc_id", "at"]).filter("token is not null")
        .groupBy("doc_id", "node_no")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "token"))),
                                      lambda s: s["token"]), ".").alias("path"))
    )
    return tokens.join(paths, ["doc_id", "node_no"]).select(
        "doc_id", "node_no", "level", "title", "node_id", "is_leaf", "path", P.path_parent(F.col("path")).alias("parent_path")
    )


# -- B10..B13 ---------------------------------------------------------------


def cut_leaves(nodes: DataFrame) -> DataFrame:
    """Points, clauses without a point below, and articles without children."""
    below = nodes.filter("parent_path is not null").select(
        F.col("parent_path").alias("path"), F.col("level").alias("child_level")
    )
    with_children = below.groupBy("path").agg(F.bool_or(F.col("child_level") == "Point").alias("has_point"))
    joined = nodes.filter(F.col("level").isin("Article", "Clause", "Point")).join(with_children, "path", "left")
    return joined.filter(
        (F.col("level") == "Point")
        | ((F.col("level") == "Clause") & ~F.coalesce("has_point", F.lit(False)))
        | ((F.col("level") == "Article") & F.col("has_point").isNull())
    ).drop("has_point")


def hierarchy_nodes(nodes: DataFrame, docs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Node rows with root parents for parts and effect columns inherited from the document.

    ``extra`` holds preamble, signature and appendix rows; those whose path is
    already taken are left out.
    """
    if extra is not None:
        nodes = nodes.unionByName(extra.join(nodes.select("path"), "path", "left_anti"), allowMissingColumns=True)
    own = docs.select(
        "doc_id", F.col("path").alias("doc_path"), F.col("eff_from").alias("d_from"), F.col("eff_to").alias("d_to"),
        F.col("status_flag").alias("d_status"),
    )
    joined = nodes.join(own, "doc_id", "left")
    return joined.select(
        "doc_id", "level", "path",
        F.coalesce("parent_path", F.when(F.col("level") == "Part", F.col("doc_path"))).alias("parent_path"),
        "title", "sort_order",
        F.coalesce("eff_from", "d_from").alias("eff_from"),
        F.coalesce("eff_to", "d_to").alias("eff_to"),
        F.coalesce(F.nullif("status_flag", F.lit(0)), "d_status", F.lit(0)).alias("status_flag"),
    )


def next_sibling(nodes: DataFrame) -> DataFrame:
    """NEXT edges between neighbours under one parent."""
    with_parent = nodes.filter("parent_path is not null")
    out = next_in_blocks(
        with_parent, ["parent_path"], F.col("sort_order"), ["sort_order", "path"], "path", "next_path"
    )
    return out.filter("next_path is not null").select("path", "next_path")


def scaffold_chain(nodes: DataFrame) -> DataFrame:
    """Placeholder part / chapter / section / sub-section rows missing above articles.

    Every step replaces a level that has no row by a label below the level
    above it, so four equi-joins cover the chain whatever the number of articles.
    """
    root = P.path_prefix(F.col("path"), 1)
    articles = nodes.filter("level = 'Article'").select("path", root.alias("root"))
    anc = P.resolve_ancestors(F.col("path"))
    chain = articles.select(
        "root", anc["part"].alias("Part"), anc["chapter"].alias("Chapter"),
        anc["section"].alias("Section"), anc["sub_section"].alias("SubSection"),
    ).distinct()

    parts = nodes.filter("level = 'Part'").select("path", "title", root.alias("root"))
    chosen = parts.groupBy("root").agg(
        F.min_by("path", F.struct((F.col("title") == P.PLACEHOLDER).cast("int"), F.col("path"))).alias("any_part")
    )
    real = parts.select(F.col("path").alias("Part"), F.col("path").alias("real_part"))
    chain = (
        chain.join(real, "Part", "left").join(chosen, "root", "left")
        .withColumn("above", F.coalesce("real_part", "any_part", F.concat("root", F.lit("._P"))))
        .withColumn("made_Part", F.when(F.coalesce("real_part", "any_part").isNull(), F.col("above")))
        .withColumn("under_Part", F.col("root"))
    )
    for level, tail in (("Chapter", "._C"), ("Section", "._M"), ("SubSection", "._TM")):
        rows = nodes.filter(F.col("level") == level).select(
            F.col("path").alias(level), F.col("path").alias("real")
        )
        chain = (
            chain.join(rows, level, "left")
            .withColumn(f"under_{level}", F.col("above"))
            .withColumn(f"made_{level}", F.when(F.col("real").isNull(), F.concat("above", F.lit(tail))))
            .withColumn("above", F.coalesce("real", f"made_{level}")).drop("real")
        )
    made = chain.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(lv).alias("level"), F.col(f"made_{lv}").alias("path"), F.col(f"under_{lv}").alias("parent_path"))
                for lv in ("Part", "Chapter", "Section", "SubSection")
            ])
        ).alias("n")
    )
    return (
        made.select("n.*").filter("path is not null").distinct()
        .join(nodes.select("path"), "path", "left_anti")
        .select("level", "path", "parent_path", F.lit(P.PLACEHOLDER).alias("title"), F.lit(P.PLACEHOLDER).alias("content"))
    )


# -- B18..B20 ---------------------------------------------------------------


def suffix_match_path(guesses: DataFrame, candidates: DataFrame) -> DataFrame:
    """``doc_id, guess`` against ``doc_id, path``: the longest suffix of the guess wins.

    Both sides explode to at most one row per label, and candidates are reduced
    to one path per suffix before the join.
    """
    tries = guesses.select("doc_id", "guess").distinct().select(
        "doc_id", "guess", F.posexplode(P.path_suffixes(F.col("guess"))).alias("rank", "suffix")
    )
    ends = (
        candidates.select("doc_id", "path", F.explode(P.path_suffixes(F.col("path"))).alias("suffix"))
        .groupBy("doc_id", "suffix").agg(F.min("path").alias("path"))
    )
    best = (
        tries.join(ends, ["doc_id", "suffix"]).groupBy("doc_id", "guess")
        .agg(F.min_by("path", "rank").alias("found"))
    )
    return guesses.join(best, ["doc_id", "guess"], "left").withColumn(
        "resolved", F.coalesce("found", "guess")
    ).drop("found")


def ancestors_of(paths: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``path, ancestor`` for every proper prefix, nearest ``max_hops`` only when given."""
    prefixes = P.path_prefixes(F.col("path"), proper=True)
    if max_hops is not None:
        size = F.size(prefixes)
        prefixes = F.slice(prefixes, F.greatest(F.lit(1), size - F.lit(max_hops - 1)), F.lit(max_hops))
    return paths.select("path", F.explode(prefixes).alias("ancestor"))


def siblings_of(seeds: DataFrame, chunks: DataFrame, limit: int = 24) -> DataFrame:
    """Up to ``limit`` chunks per query under the parents of its seeds, seeds excluded.

    A parent can give one query at most ``limit`` rows besides the query's own
    seeds, so its children are cut to ``limit`` plus the largest number of seeds
    one query has under one parent (read first; one aggregated row) before the
    join.  A parent holding most of the corpus costs no more than a small one.
    """
    parent = P.path_parent(F.col("path"))
    wanted = seeds.select("query_id", parent.alias("parent_path")).groupBy("query_id", "parent_path").agg(F.count(F.lit(1)).alias("n"))
    most = wanted.agg(F.max("n")).first()[0] or 0
    children = chunks.select("path", parent.alias("parent_path"))
    asked = children.join(wanted.select("parent_path").distinct(), "parent_path", "left_semi")
    few = top_k(asked, ["parent_path"], ["path"], limit + most).select("parent_path", "path")
    found = wanted.join(few, "parent_path").join(seeds.select("query_id", "path"), ["query_id", "path"], "left_anti")
    return top_k(found.select("query_id", "path").distinct(), ["query_id"], ["path"], limit)


def ancestors_by_edges(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """``child, ancestor, hops``: what is reached over ``edges`` (child, parent) within ``max_hops``, by the fewest hops.

    Works on any edges, without path keys.  A node that was reached before is not gone on from, so
    cycles end, and each hop joins only what the hop before found.
    """
    links = edges.select(F.col("child").alias("__at"), F.col("parent").alias("ancestor")).filter("ancestor IS NOT NULL").distinct()
    last = seeds.select("child", F.col("child").alias("ancestor")).filter("child IS NOT NULL").distinct()
    found = last.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        step = last.withColumnRenamed("ancestor", "__at").join(links, "__at").select("child", "ancestor").distinct()
        last = step.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti")
        found = found.unionByName(last.withColumn("hops", F.lit(hop)))
    return found.filter("hops > 0")
