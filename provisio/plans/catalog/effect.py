"""Legal-effect queries (families D1-D2 and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import sql
from provisio.functions import status as S
from provisio.operators import effect
from provisio.plans.oracle import AS_OF as DAY
from provisio.plans.projections import AS_OF
from provisio.plans.registry import query


def raw_attributes(t):
    """Order rows as crawled attributes: labels in every spelling, codes, or nothing."""
    pri, st = F.col("o_orderpriority"), F.col("o_orderstatus")

    def pick(f, o, p):
        return F.when(st == "F", f).when(st == "O", o).otherwise(p)

    flag = (
        F.when(pri == "1-URGENT", pick(S.SUSPENDED, S.IN_FORCE, S.PARTLY_IN_FORCE))
        .when(pri == "2-HIGH", pick(" HẾT hiệu lực 1 phần ", "sắp có hiệu lực", "Bãi bỏ"))
        .when(pri == "4-NOT SPECIFIED", pick("văn bản ngưng áp dụng một phần", "chưa rõ", "đã sửa một phần"))
    )
    status = F.when((pri == "5-LOW") & (st == "F"), F.lit("Không còn phù hợp"))
    code = F.when(pri == "3-MEDIUM", pick("hhl1p", "CHL", "XX"))
    return t.raw("orders").select("o_orderkey", flag.alias("flag"), status.alias("status"), code.alias("code"))


LABELS = """attrs AS (SELECT o_orderkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'Ngưng hiệu lực' WHEN 'O' THEN 'Còn hiệu lực' ELSE 'Có hiệu lực một phần' END
  WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'Hết hiệu lực một phần' WHEN 'O' THEN 'Chưa có hiệu lực' ELSE 'Hết hiệu lực toàn bộ' END
  WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'Hết hiệu lực một phần' WHEN 'O' THEN 'Còn hiệu lực' ELSE 'Chưa xác định' END
  WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'Ngưng hiệu lực một phần' WHEN 'O' THEN 'Chưa có hiệu lực' ELSE 'Hết hiệu lực một phần' END
  ELSE CASE o_orderstatus WHEN 'F' THEN 'Không còn phù hợp' ELSE 'Chưa xác định' END END AS label FROM orders)"""
TO_STATUS = """CASE {0} WHEN 'Còn hiệu lực' THEN 1 WHEN 'Hết hiệu lực toàn bộ' THEN 2 WHEN 'Ngưng hiệu lực' THEN 2
  WHEN 'Không còn phù hợp' THEN 2 WHEN 'Chưa có hiệu lực' THEN 3 WHEN 'Hết hiệu lực một phần' THEN 4
  WHEN 'Ngưng hiệu lực một phần' THEN 4 WHEN 'Có hiệu lực một phần' THEN 5 ELSE 0 END"""
TO_LABEL = """CASE {0} WHEN 1 THEN 'Còn hiệu lực' WHEN 2 THEN 'Hết hiệu lực toàn bộ' WHEN 3 THEN 'Chưa có hiệu lực'
  WHEN 4 THEN 'Hết hiệu lực một phần' WHEN 5 THEN 'Có hiệu lực một phần' ELSE 'Chưa xác định' END"""


@query("normalize_effect_label", "SELECT o_orderkey, label FROM attrs", ctes=LABELS)
def _(t):
    label = S.normalize_effect_label(F.col("flag"), F.col("status"), F.col("code"))
    return raw_attributes(t).select("o_orderkey", label.alias("label"))


@query("label_to_status", f"""SELECT o_orderkey, {TO_STATUS.format('label')} AS status_flag,
  {TO_LABEL.format('(' + TO_STATUS.format('label') + ')')} AS status_label FROM attrs""", ctes=LABELS)
def _(t):
    label = S.normalize_effect_label(F.col("flag"), F.col("status"), F.col("code"))
    s = S.label_to_status(label)
    return raw_attributes(t).select("o_orderkey", s.alias("status_flag"), S.status_to_label(s).alias("status_label"))


def updates(t):
    """New versions of the documents: label, status, both or nothing changed, and new rows."""
    key = F.col("doc_id").cast("bigint")
    d = t.documents()
    new_label = F.when(key % 5 == 0, S.SUSPENDED).when(key % 5 == 3, S.PARTLY_SUSPENDED).when(
        key % 5 == 4, F.lit(None)).otherwise(F.col("eff_flag"))
    new_status = F.when(key % 5 == 1, (key % 6).cast("int")).when(key % 5 == 3, 0).otherwise(F.col("status_flag"))
    return d.withColumn("eff_flag", new_label).withColumn("status_flag", new_status)


UPDATES = """ups AS (SELECT doc_id, status_flag AS os, eff_flag AS ol,
  CASE k % 5 WHEN 0 THEN 'Ngưng hiệu lực' WHEN 3 THEN 'Ngưng hiệu lực một phần' WHEN 4 THEN NULL ELSE eff_flag END AS nl,
  CASE k % 5 WHEN 1 THEN k % 6 WHEN 3 THEN 0 ELSE status_flag END AS ns FROM (SELECT *, CAST(doc_id AS BIGINT) AS k FROM docs))"""


@query("sync_label_status", f"""SELECT doc_id, CASE WHEN nl IS NULL THEN (CASE WHEN seen THEN 0 ELSE ns END)
   WHEN NOT seen THEN {TO_STATUS.format('nl')} WHEN nl <> ol THEN {TO_STATUS.format('nl')} WHEN ns <> os THEN ns
   ELSE {TO_STATUS.format('nl')} END AS status_flag,
  CASE WHEN nl IS NULL THEN (CASE WHEN seen THEN NULL ELSE {TO_LABEL.format('ns')} END)
   WHEN NOT seen OR nl <> ol OR ns = os THEN nl ELSE {TO_LABEL.format('ns')} END AS eff_flag
  FROM (SELECT *, CAST(doc_id AS BIGINT) % 4 <> 0 AS seen FROM ups)""", views="docs", ctes=UPDATES)
def _(t):
    old = t.documents().filter(F.col("doc_id").cast("bigint") % 4 != 0)
    return effect.label_status_changes(old, updates(t)).select("doc_id", "status_flag", "eff_flag")


WINDOW = f"""CASE WHEN eff_from > {DAY} THEN 3 WHEN eff_to <= {DAY} THEN 2 WHEN eff_flag = 'Hết hiệu lực một phần' THEN 4 ELSE 1 END"""


@query("status_from_window", f"SELECT doc_id, {WINDOW} AS status_flag, {TO_LABEL.format('(' + WINDOW + ')')} AS eff_flag FROM docs")
def _(t):
    return effect.with_window_status(t.documents(), AS_OF).select("doc_id", "status_flag", "eff_flag")


@query("insert_status", f"SELECT doc_id, {WINDOW} AS status_flag, {TO_LABEL.format('(' + WINDOW + ')')} AS eff_flag FROM docs")
def _(t):
    return effect.with_insert_status(t.documents(), AS_OF).select("doc_id", "status_flag", "eff_flag")


CASCADE = """came AS (SELECT doc_id FROM docs WHERE status_flag = 1),
 hits AS (SELECT to_doc_id AS doc_id, bool_or(relation_type <> 'sua_doi_bo_sung') AS rep, bool_or(relation_type = 'sua_doi_bo_sung') AS am
   FROM doc_edges JOIN came ON doc_id = from_doc_id WHERE relation_type IN ('thay_the','van_ban_bi_bai_bo','sua_doi_bo_sung') GROUP BY 1)"""


@query("cascade_document_status", f"""SELECT d.doc_id,
  CASE WHEN (status_flag <> 2 AND coalesce(rep, false)) OR (status_flag NOT IN (2, 4) AND coalesce(am, false))
   THEN CASE WHEN eff_from > {DAY} THEN 3 WHEN eff_to <= {DAY} THEN 2
     WHEN status_flag <> 2 AND coalesce(rep, false) THEN 2 ELSE 4 END ELSE status_flag END AS status_flag
  FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id""", views="docs doc_edges", ctes=CASCADE)
def _(t):
    d = t.documents()
    came = d.filter("status_flag = 1").select("doc_id")
    return effect.cascade_document_status(d, t.doc_edges(), came, AS_OF).select("doc_id", "status_flag")


REFRESH = f"""s3 AS (SELECT doc_id, eff_from, eff_to, status_flag AS old, CASE WHEN status_flag = 2 THEN 2 WHEN eff_to <= {DAY} THEN (CASE WHEN eff_from > {DAY} THEN 3 ELSE 2 END)
    WHEN eff_from > {DAY} THEN 3 WHEN status_flag IN (4, 5) THEN status_flag ELSE 1 END AS s FROM docs),
 live AS (SELECT from_doc_id, to_doc_id, relation_type, old FROM doc_edges JOIN s3 ON doc_id = from_doc_id WHERE s = 1),
 h AS (SELECT to_doc_id AS doc_id, bool_or(old <> 1 AND relation_type IN ('thay_the','van_ban_bi_bai_bo')) AS rep0,
     bool_or(old <> 1 AND relation_type = 'sua_doi_bo_sung') AS am0 FROM live GROUP BY 1),
 s4 AS (SELECT s3.*, CASE WHEN s <> 2 AND coalesce(rep0, false) THEN (CASE WHEN eff_from > {DAY} THEN 3 ELSE 2 END)
     WHEN s NOT IN (2, 4) AND coalesce(am0, false) THEN (CASE WHEN eff_from > {DAY} THEN 3 ELSE 4 END) ELSE s END AS t
   FROM s3 LEFT JOIN h ON h.doc_id = s3.doc_id),
 r5 AS (SELECT DISTINCT to_doc_id FROM doc_edges JOIN s4 ON doc_id = from_doc_id WHERE t = 1 AND relation_type IN ('thay_the','van_ban_bi_bai_bo')),
 s5 AS (SELECT s4.*, CASE WHEN t NOT IN (2, 4) AND doc_id IN (SELECT to_doc_id FROM r5) THEN (CASE WHEN eff_from > {DAY} THEN 3 ELSE 2 END) ELSE t END AS u FROM s4),
 r6 AS (SELECT DISTINCT to_doc_id FROM doc_edges JOIN s5 ON doc_id = from_doc_id WHERE u = 1 AND relation_type = 'sua_doi_bo_sung'),
 s6 AS (SELECT *, CASE WHEN u NOT IN (2, 4) AND doc_id IN (SELECT to_doc_id FROM r6) THEN (CASE WHEN eff_from > {DAY} THEN 3 ELSE 4 END) ELSE u END AS v FROM s5)"""


@query("refresh_document_status", "SELECT doc_id, old AS old_flag, v AS new_flag FROM s6 WHERE old <> v", views="docs doc_edges", ctes=REFRESH)
def _(t):
    return effect.refresh_document_status(t.documents(), t.doc_edges(), AS_OF)


@query("refresh_status_function", "SELECT doc_id, old AS old_flag, v AS new_flag FROM s6 WHERE old <> v", views="docs doc_edges", ctes=REFRESH)
def _(t):
    """The refresh as a table function of SQL."""
    t.documents().createOrReplaceTempView("refresh_documents")
    t.doc_edges().createOrReplaceTempView("refresh_edges")
    sql.register_tables(t.spark, "refresh_documents", "refresh_edges")
    return t.spark.sql(f"SELECT * FROM refresh_status_flags({DAY})")


EXPIRED = f"""gone AS (SELECT DISTINCT path AS ended FROM nodes WHERE status_flag <> 2 AND eff_to <= {DAY})"""


@query("cascade_hierarchy_status", """SELECT n.path, CASE WHEN gone.ended IS NOT NULL THEN 2 ELSE status_flag END AS status_flag
  FROM nodes n LEFT JOIN gone ON gone.ended = n.parent_path""", ctes=EXPIRED, views="nodes")
def _(t):
    n = t.nodes()
    gone = n.filter((F.col("status_flag") != 2) & (F.col("eff_to") <= S.as_date(AS_OF)))
    return effect.cascade_hierarchy_status(n, gone).select("path", "status_flag")


@query("refresh_hierarchy_status", f"""SELECT n.path, CASE WHEN status_flag = 2 OR eff_to <= {DAY} OR gone.ended IS NOT NULL THEN 2
  WHEN eff_from > {DAY} THEN 3 WHEN status_flag NOT IN (4, 5) AND eff_from <= {DAY} THEN 1 ELSE status_flag END AS status_flag
  FROM nodes n LEFT JOIN gone ON gone.ended = n.parent_path""", ctes=EXPIRED, views="nodes")
def _(t):
    return effect.refresh_hierarchy_status(t.nodes(), AS_OF).select("path", "status_flag")


GOVERNED = """SELECT c.path, coalesce(k.status_flag, a.status_flag, c.status_flag) IN (1, 5) AS is_effective FROM chunks c
  LEFT JOIN nodes k ON k.path = c.path LEFT JOIN nodes a ON a.path = regexp_replace(c.path, '\\.K[0-9]+$', '')"""


@query("chunk_effective", GOVERNED)
def _(t):
    return effect.chunk_effective(t.chunks(), t.nodes()).select("path", "is_effective")


@query("chunk_effective_sweep", GOVERNED)
def _(t):
    return effect.chunk_effective_sweep(t.chunks(), t.nodes()).select("path", "is_effective")


@query("evaluate_effect", f"""SELECT e.to_doc_id, e.from_doc_id, CASE WHEN d.doc_id IS NULL THEN 'Chưa đối chiếu kho' WHEN status_flag = 2 THEN 'Hết hiệu lực'
    WHEN eff_from > {DAY} THEN 'Chưa có hiệu lực' WHEN eff_to <= {DAY} THEN 'Hết hiệu lực'
    WHEN status_flag = 4 THEN 'Đã đối chiếu · Còn hiệu lực (có sửa đổi) · 1999-01-01' ELSE 'Đã đối chiếu · Còn hiệu lực · 1999-01-01' END AS status_label,
  coalesce(status_flag <> 2 AND eff_from <= {DAY} AND (eff_to IS NULL OR eff_to > {DAY}), false) AS ok_to_cite
  FROM doc_edges e LEFT JOIN docs d ON d.doc_id = e.to_doc_id""")
def _(t):
    joined = t.doc_edges().join(t.documents().withColumnRenamed("doc_id", "to_doc_id"), "to_doc_id", "left")
    out = effect.with_effect(joined, AS_OF)
    return out.select("to_doc_id", "from_doc_id", F.col("effect.status_label").alias("status_label"),
                      F.col("effect.ok_to_cite").alias("ok_to_cite"))


@query("validity_key", f"""SELECT doc_id, b AS bucket, CAST(CASE WHEN b = 99 THEN 0 WHEN status_flag = 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS status_rank, year(issue_date) AS year
  FROM (SELECT *, CASE WHEN status_flag = 2 OR eff_to <= {DAY} THEN 99 WHEN eff_from > {DAY} THEN 50 ELSE 0 END AS b FROM docs)""")
def _(t):
    b = S.validity_bucket(F.col("status_flag"), F.col("eff_from"), F.col("eff_to"), AS_OF)
    return t.documents().select("doc_id", b.alias("bucket"), S.status_rank(F.col("status_flag"), b).alias("status_rank"),
                                S.ranking_year(F.col("issue_date"), F.col("eff_from")).alias("year"))


@query("resolve_governing_doc", """SELECT kind, as_of, doc_id FROM (SELECT d.doc_type AS kind, q.as_of, d.doc_id, row_number() OVER (PARTITION BY d.doc_type, q.as_of
   ORDER BY CASE status_flag WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 4 END, issue_date DESC, doc_num DESC) AS rn
  FROM docs d JOIN (SELECT DISTINCT doc_type AS kind, date_trunc('year', issue_date)::DATE AS as_of FROM docs) q ON q.kind = d.doc_type
   AND eff_from <= q.as_of AND (eff_to IS NULL OR eff_to > q.as_of) AND status_flag IN (0, 1, 4, 5)) WHERE rn = 1""")
def _(t):
    d = t.documents()
    asked = d.select(F.col("doc_type").alias("kind"), F.trunc("issue_date", "year").alias("as_of"))
    return effect.resolve_governing_doc(asked, d).select("kind", "as_of", "doc_id")


@query("effect_date_violations", """SELECT event_id FROM (SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + CAST(floor(value) AS INTEGER) - 10 AS b FROM events) WHERE a >= b""")
def _(t):
    begin = F.to_date("ts")
    rows = t.raw("events").select("event_id", begin.alias("eff_from"), F.date_add(begin, (F.floor("value") - 10).cast("int")).alias("eff_to"))
    return effect.effect_date_violations(rows).select("event_id")
