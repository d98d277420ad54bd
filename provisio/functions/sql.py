"""The scalar path and label functions for SQL texts.

They are SQL functions: the optimizer inlines them, so a query over them plans
like one over the columns of :mod:`paths` and :mod:`status`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from provisio.functions.status import LABEL_STATUS, PARTIAL_LABELS, STATUS_LABEL, UNKNOWN


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cases(subject: str, table: dict, otherwise: str) -> str:
    whens = " ".join(f"WHEN {_text(k) if isinstance(k, str) else k} THEN {_text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {subject} {whens} ELSE {otherwise} END"


BODIES = {
    "path_sanitize(name STRING) RETURNS STRING":
        r"coalesce(nullif(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9_]', '_'), ''), 'doc')",
    "ref_to_path(ref STRING) RETURNS STRING":
        r"CASE WHEN instr(ref, ':') > 0 AND length(substr(ref, instr(ref, ':') + 1)) > 0 THEN concat_ws('.', "
        r"coalesce(nullif(regexp_replace(substr(ref, 1, instr(ref, ':') - 1), '[^A-Za-z0-9_]', '_'), ''), 'doc'), "
        r"nullif(regexp_replace(trim(substr(ref, instr(ref, ':') + 1)), '^[.]+', ''), '')) END",
    "article_root(path STRING) RETURNS STRING":
        r"nullif(regexp_extract(path, '^((?:.*[.])?D[0-9]+)(?:[.]|$)', 1), '')",
    "status_to_label(status INT) RETURNS STRING": _cases("status", STATUS_LABEL, _text(UNKNOWN)),
    "label_to_status(label STRING) RETURNS INT": _cases("trim(coalesce(label, ''))", LABEL_STATUS, "0"),
    "is_partial_effect(status INT, label STRING) RETURNS BOOLEAN":
        f"coalesce(status IN (4, 5), false) OR trim(coalesce(label, '')) IN ({', '.join(map(_text, PARTIAL_LABELS))})",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for the session; returns their names."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in BODIES]


# Relation types that end or change their target.
_REPEALING, _AMENDING = "('van_ban_bi_bai_bo', 'thay_the')", "('sua_doi_bo_sung')"

TABLES = {
    "refresh_status_flags(day DATE) RETURNS TABLE (doc_id STRING, old_flag INT, new_flag INT)": f"""
WITH dated AS (
  SELECT doc_id, status_flag AS old_flag, coalesce(eff_from > day, false) AS future, coalesce(eff_to <= day, false) AS ended,
    coalesce(eff_from <= day AND (eff_to IS NULL OR eff_to > day), false) AS inside FROM {{documents}}),
by_dates AS (
  SELECT *, CASE WHEN old_flag = 2 THEN 2 WHEN future THEN 3 WHEN ended THEN 2 WHEN old_flag IN (4, 5) THEN old_flag
    WHEN inside THEN 1 ELSE old_flag END AS f1 FROM dated),
came AS (
  SELECT to_doc_id, bool_or(relation_type IN {_REPEALING}) AS repealed, bool_or(relation_type IN {_AMENDING}) AS amended
  FROM {{doc_edges}} JOIN by_dates ON doc_id = from_doc_id WHERE f1 = 1 AND old_flag <> 1 GROUP BY to_doc_id),
hit AS (
  SELECT by_dates.*, CASE WHEN f1 <> 2 AND repealed THEN IF(future, 3, 2)
    WHEN f1 NOT IN (2, 4) AND amended THEN CASE WHEN future THEN 3 WHEN ended THEN 2 ELSE 4 END ELSE f1 END AS f2
  FROM by_dates LEFT JOIN came ON to_doc_id = doc_id),
repealed AS (SELECT DISTINCT to_doc_id FROM {{doc_edges}} JOIN hit ON doc_id = from_doc_id WHERE f2 = 1 AND relation_type IN {_REPEALING}),
gone AS (
  SELECT hit.*, CASE WHEN f2 NOT IN (2, 4) AND to_doc_id IS NOT NULL THEN IF(future, 3, 2) ELSE f2 END AS f3
  FROM hit LEFT JOIN repealed ON to_doc_id = doc_id),
amended AS (SELECT DISTINCT to_doc_id FROM {{doc_edges}} JOIN gone ON doc_id = from_doc_id WHERE f3 = 1 AND relation_type IN {_AMENDING}),
partly AS (
  SELECT gone.*, CASE WHEN f3 NOT IN (2, 4) AND to_doc_id IS NOT NULL THEN CASE WHEN future THEN 3 WHEN ended THEN 2 ELSE 4 END ELSE f3 END AS f4
  FROM gone LEFT JOIN amended ON to_doc_id = doc_id)
SELECT doc_id, old_flag, f4 FROM partly WHERE old_flag <> f4""",
    "documents_in_force(day DATE) RETURNS TABLE (doc_id STRING, doc_num STRING, status_flag INT)": """
SELECT doc_id, doc_num, status_flag FROM {documents}
WHERE status_flag IN (1, 4, 5) AND eff_from <= day AND (eff_to IS NULL OR eff_to > day)""",
}


def register_tables(spark: SparkSession, documents: str, doc_edges: str) -> list[str]:
    """Create the table functions over two named tables or views; returns their names.

    ``SELECT * FROM refresh_status_flags(DATE'2025-06-01')`` plans like the batch operator:
    the body is inlined, so filters and columns asked for reach the scans.
    """
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body.format(documents=documents, doc_edges=doc_edges)}")
    return [head.split("(")[0] for head in TABLES]
