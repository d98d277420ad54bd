"""Legal-effect state of documents, provisions and chunks as whole-table recomputation.

The per-row triggers of a transactional store become columns over a snapshot;
every function takes ``as_of`` and returns the new state, so a rerun after an
executor loss gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.functions import status as S
from provisio.operators.intervals import mark_below, nearest_above
from provisio.operators.skew import top_k
from provisio.session import written

# Relation types that end or change their target.
REPEALING = ("van_ban_bi_bai_bo", "thay_the")
AMENDING = ("sua_doi_bo_sung",)


def label_status_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status and label after an update or insert, by ``doc_id``."""
    before = old.select("doc_id", F.col("status_flag").alias("o_status"), F.col("eff_flag").alias("o_label"),
                        F.lit(True).alias("seen"))
    joined = new.join(before, "doc_id", "left")
    status, label = F.col("status_flag"), F.col("eff_flag")
    synced = F.when(
        F.col("seen"), S.sync_on_update(F.col("o_status"), F.col("o_label"), status, label)
    ).otherwise(S.sync_on_insert(status, label))
    return _put(joined, synced).drop("o_status", "o_label", "seen")


def _put(df: DataFrame, pair: Column) -> DataFrame:
    return (
        df.withColumn("__s", pair)
        .withColumn("status_flag", F.col("__s.status_flag")).withColumn("eff_flag", F.col("__s.eff_flag")).drop("__s")
    )


def with_window_status(rows: DataFrame, as_of) -> DataFrame:
    return _put(rows, S.status_from_window(
        F.col("status_flag"), F.col("eff_flag"), F.col("eff_from"), F.col("eff_to"), as_of))


def with_insert_status(rows: DataFrame, as_of, short: bool = True) -> DataFrame:
    return _put(rows, S.insert_status(
        F.col("status_flag"), F.col("eff_flag"), F.col("eff_from"), F.col("eff_to"), as_of, short))


def _hits(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per target: is it repealed / amended by one of the source documents?

    Edges are reduced to one row per target by partial aggregation, so a
    document named by a large share of all edges is no hot join key.
    """
    kinds = edges.filter(F.col("relation_type").isin(*REPEALING, *AMENDING) & F.col("to_doc_id").isNotNull())
    return (
        kinds.join(sources.select(F.col("doc_id").alias("from_doc_id")).distinct(), "from_doc_id", "left_semi")
        .groupBy(F.col("to_doc_id").alias("doc_id"))
        .agg(F.bool_or(F.col("relation_type").isin(*REPEALING)).alias("repealed"),
             F.bool_or(F.col("relation_type").isin(*AMENDING)).alias("amended"))
    )


def _write(value: int, as_of) -> Column:
    """Status that a write of ``value`` leaves behind: the dates overrule it."""
    day = S.as_date(as_of)
    return F.when(F.col("eff_from") > day, 3).when(F.col("eff_to") <= day, 2).otherwise(value)


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _cascade(docs: DataFrame, hits: DataFrame, as_of, keep: tuple[int, ...]) -> DataFrame:
    """Apply repeal (not on ``keep``) and then amendment hits (not on 2, 4) to ``status_flag``."""
    status = F.col("status_flag")
    repealed, amended = _yes("repealed") & ~status.isin(*keep), _yes("amended") & ~status.isin(2, 4)
    after_repeal = _write(2, as_of)
    after = (
        F.when(repealed & amended & (after_repeal == 3), _write(4, as_of))
        .when(repealed, after_repeal).when(amended, _write(4, as_of)).otherwise(status)
    )
    return docs.join(hits, "doc_id", "left").withColumn("status_flag", after).drop("repealed", "amended")


def _relabel(df: DataFrame) -> DataFrame:
    """Label follows a changed status; suspended and unsuitable stay at 2, partly suspended at 4."""
    old_label, status = F.trim(F.coalesce("old_label", F.lit(""))), F.col("status_flag")
    kept = ((status == 2) & old_label.isin(*S.KEPT_AT_EXPIRED)) | ((status == 4) & (old_label == S.PARTLY_SUSPENDED))
    return df.withColumn(
        "eff_flag", F.when((status == F.col("old_flag")) | kept, F.col("old_label")).otherwise(S.status_to_label(status))
    )


def _remember(docs: DataFrame) -> DataFrame:
    return docs.withColumn("old_flag", F.col("status_flag")).withColumn("old_label", F.col("eff_flag"))


def cascade_document_status(docs: DataFrame, edges: DataFrame, changed: DataFrame, as_of) -> DataFrame:
    """Effect of documents that just came into force on what they repeal or amend (one hop)."""
    out = _cascade(_remember(docs), _hits(edges, changed), as_of, keep=(2,))
    return _relabel(out).drop("old_flag", "old_label")


def refresh_document_status(docs: DataFrame, edges: DataFrame, as_of, changes_only: bool = True) -> DataFrame:
    """Scheduled refresh: expiry, future, in force (with its cascade), then both batch cascades.

    Returns ``doc_id, old_flag, new_flag`` of changed documents, or all
    documents with their new state.
    """
    day = S.as_date(as_of)
    status = F.col("status_flag")
    inside = (F.col("eff_from") <= day) & (F.col("eff_to").isNull() | (F.col("eff_to") > day))
    by_dates = (
        F.when(status == 2, 2).when((F.col("eff_to") <= day) | (F.col("eff_from") > day), _write(2, day))
        .when(status.isin(4, 5), status).when(inside, 1).otherwise(status)
    )
    cur = _remember(docs).withColumn("status_flag", by_dates)
    came = cur.filter("status_flag = 1 and old_flag <> 1").select("doc_id")
    cur = _cascade(cur, _hits(edges, came), day, keep=(2,))
    for kind in (REPEALING, AMENDING):
        some = edges.filter(F.col("relation_type").isin(*kind))
        cur = _cascade(cur, _hits(some, cur.filter("status_flag = 1").select("doc_id")), day, keep=(2, 4))
    if not changes_only:
        return _relabel(cur).drop("old_flag", "old_label")
    return cur.filter("old_flag <> status_flag").select("doc_id", "old_flag", F.col("status_flag").alias("new_flag"))


def cascade_hierarchy_status(nodes: DataFrame, expired: DataFrame) -> DataFrame:
    """Descendants of newly expired nodes become 2; nothing is revived."""
    tops = expired.select("path", F.lit(True).alias("__top"))
    both = nodes.withColumn("__top", F.lit(False)).unionByName(tops, allowMissingColumns=True)
    below = mark_below(both, F.col("__top"), "__hit").filter("NOT __top")
    return below.withColumn("status_flag", F.when(F.col("__hit"), 2).otherwise(F.col("status_flag"))).drop("__top", "__hit")


def refresh_hierarchy_status(nodes: DataFrame, as_of) -> DataFrame:
    """Expiry with its cascade first, then future and in-force steps of what is left."""
    day = S.as_date(as_of)
    over = F.coalesce((F.col("status_flag") != 2) & (F.col("eff_to") <= day), F.lit(False))
    below = mark_below(nodes, over, "__hit")
    cur = below.withColumn("status_flag", F.when(over | F.col("__hit"), 2).otherwise(F.col("status_flag"))).drop("__hit")
    inside = F.coalesce((F.col("eff_from") <= day) & (F.col("eff_to").isNull() | (F.col("eff_to") > day)), F.lit(False))
    future = F.coalesce(F.col("eff_from") > day, F.lit(False))
    status = F.col("status_flag")
    return cur.withColumn(
        "status_flag",
        F.when(status == 2, 2).when(future, 3).when(~status.isin(4, 5) & inside, 1).otherwise(status),
    )


def chunk_effective(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """In force iff the deepest node above (or at) the chunk has status 1 or 5.

    The node table joins on exploded prefixes (one row per level); partial
    aggregation keeps one governing status per chunk.  Chunks without any node
    keep their document's status.
    """
    ups = chunks.select("path").distinct().select("path", F.explode(P.path_prefixes(F.col("path"))).alias("up"))
    state = nodes.select(F.col("path").alias("up"), F.col("status_flag").alias("node_status"))
    governing = ups.join(state, "up").groupBy("path").agg(F.max_by("node_status", F.length("up")).alias("governing"))
    return chunks.join(governing, "path", "left").withColumn(
        "is_effective", F.coalesce("governing", "status_flag").isin(1, 5)
    ).drop("governing")


def chunk_effective_sweep(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by one sweep over chunks and nodes in reading order.

    It moves every chunk and node once, where :func:`chunk_effective` moves a row for each level of
    every chunk: the better choice where most nodes hold chunks, or chunks outnumber nodes.
    """
    # The sweep reads its rows five times: for the depth, the cuts, what is carried, itself and the result.
    nodes, chunks = written(nodes.select("path", "status_flag"), "sweep-nodes"), written(chunks, "sweep-chunks")
    governing = nearest_above(chunks.select("path").distinct(), nodes, "status_flag", "governing")
    return chunks.join(governing, "path", "left").withColumn(
        "is_effective", F.coalesce("governing", "status_flag").isin(1, 5)
    ).drop("governing")


def with_effect(rows: DataFrame, as_of, present: Column | None = None) -> DataFrame:
    """Citation verdict columns of rows that carry a document state."""
    here = F.col("status_flag").isNotNull() if present is None else present
    return rows.withColumn(
        "effect", S.evaluate_effect(here, F.col("status_flag"), F.col("eff_from"), F.col("eff_to"), as_of)
    )


def resolve_governing_doc(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Instrument of one kind in force on a day.

    ``requests``: ``kind, as_of``.  Documents are cut to the kinds and days
    asked for by the equi-join on ``kind``; the winner per request is a top-1.
    """
    # Status preference.
    preference = P.lookup({1: 0, 5: 1, 4: 2, 0: 3}, F.col("status_flag"))
    asked = requests.select("kind", "as_of").distinct()
    fits = (
        docs.join(asked, docs["doc_type"] == asked["kind"])
        .filter(F.col("status_flag").isin(0, 1, 4, 5))
        .filter((F.col("eff_from").isNull() | (F.col("eff_from") <= F.col("as_of")))
                & (F.col("eff_to").isNull() | (F.col("eff_to") > F.col("as_of"))))
    )
    newest = F.coalesce("issue_date", "eff_from")
    order = [preference, newest.desc_nulls_last(), F.col("doc_num").desc()]
    best = top_k(fits, ["kind", "as_of"], order, 1).drop("rn")
    return best


def effect_date_violations(rows: DataFrame) -> DataFrame:
    return rows.filter("eff_from >= eff_to")
