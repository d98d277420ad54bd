"""Sources, upserts (A), metadata (D) and relations (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import metadata as M
from provisio.functions import references as R
from provisio.functions import status as S
from provisio.operators import relations, upsert
from provisio.plans.projections import AS_OF
from provisio.plans.registry import query
from provisio.sources import attributes, exports
from provisio.sources.html import html_to_blocks


def doc_key():
    return F.col("doc_id").cast("bigint")


# -- A ----------------------------------------------------------------------


@query("resume_anti_join", "SELECT doc_id FROM docs WHERE CAST(doc_id AS BIGINT) NOT IN (SELECT l_partkey FROM lineitem)")
def _(t):
    done = t.raw("lineitem").select(F.col("l_partkey").cast("string").alias("doc_id"))
    return upsert.resume_anti_join(t.documents().select("doc_id"), done)


def old_docs(t):
    return t.documents().filter("status_flag <> 2").select("doc_id", "title", "doc_type", "path")


def new_docs(t):
    path = F.when(doc_key() % 2 == 0, F.concat(F.lit("n_"), "path"))
    return t.documents().filter("eff_to is not null").select(
        "doc_id", F.concat(F.lit("v2 "), "title").alias("title"), "doc_type", path.alias("path"))


@query("upsert_documents", """SELECT doc_id, CASE WHEN eff_to IS NULL THEN title ELSE 'v2 ' || title END AS title, doc_type,
  CASE WHEN eff_to IS NULL THEN path WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 'n_' || path WHEN status_flag <> 2 THEN path END AS path
  FROM docs WHERE status_flag <> 2 OR eff_to IS NOT NULL""")
def _(t):
    return upsert.upsert_documents(old_docs(t), new_docs(t))


@query("upsert_chunks", """SELECT path, CASE WHEN t.c_custkey IS NULL THEN a.t ELSE 'v2 ' || a.t END AS chunk_text, root AS root_path, e AS source_element_id FROM (
    SELECT c.path, chunk_text AS t, regexp_replace(c.path, '\\.K[0-9]+$', '') AS root, 'el' || doc_id AS e, CAST(doc_id AS BIGINT) AS k FROM chunks c) a
  LEFT JOIN customer t ON t.c_custkey = a.k AND c_acctbal < 3000""", views="chunks")
def _(t):
    c = t.chunks()
    old = c.select("path", "chunk_text", F.regexp_replace("path", r"\.K[0-9]+$", "").alias("root_path"),
                   F.concat(F.lit("el"), "doc_id").alias("source_element_id"))
    poor = t.raw("customer").filter("c_acctbal < 3000").select(F.col("c_custkey").cast("string").alias("doc_id"))
    new = c.join(poor, "doc_id", "left_semi").select(
        "path", F.concat(F.lit("v2 "), "chunk_text").alias("chunk_text"), F.lit(None).cast("string").alias("root_path"),
        F.lit(None).cast("string").alias("source_element_id"))
    return upsert.upsert_chunks(old, new)


@query("upsert_nodes", """SELECT path, eff_from, eff_to, CASE WHEN level = 'Clause' AND status_flag = 1 THEN 5 ELSE status_flag END AS status_flag FROM nodes
  LEFT JOIN (SELECT path AS live FROM nodes WHERE level = 'Article' AND status_flag <> 2) a ON live = parent_path WHERE level <> 'Clause' OR live IS NOT NULL""")
def _(t):
    n = t.nodes().select("path", "level", "eff_from", "eff_to", "status_flag")
    old = n.filter("level <> 'Clause' and not (level = 'Article' and status_flag = 2)")
    late = n.filter("level = 'Article' and status_flag = 2")
    clauses = n.filter("level = 'Clause'").withColumn("status_flag", F.when(F.col("status_flag") == 1, 5).otherwise(0))
    same = old.filter("level = 'Article'").withColumns({
        "eff_from": F.lit(None).cast("date"), "eff_to": F.lit(None).cast("date"), "status_flag": F.lit(0)})
    out = upsert.upsert_nodes(old, clauses.unionByName(same)).unionByName(late)
    return out.select("path", "eff_from", "eff_to", "status_flag")


@query("insert_ignore_edges", """SELECT DISTINCT to_doc_id AS from_doc_id, from_doc_id AS to_doc_id, relation_type FROM doc_edges e
  WHERE NOT EXISTS (SELECT 1 FROM doc_edges x WHERE x.from_doc_id = e.to_doc_id AND x.to_doc_id = e.from_doc_id AND x.relation_type = e.relation_type)""")
def _(t):
    e = t.doc_edges()
    turned = e.select(F.col("to_doc_id").alias("from_doc_id"), F.col("from_doc_id").alias("to_doc_id"), "relation_type")
    return upsert.insert_ignore(e, turned.unionByName(e), ["from_doc_id", "to_doc_id", "relation_type"])


@query("insert_path_edges", """SELECT DISTINCT l_suppkey || '.D' || l_partkey AS source_path, l_partkey || '.K' || l_linenumber AS target_path,
  CASE WHEN l_returnflag = 'R' THEN 'bai_bo' ELSE 'dan_chieu' END AS ref_type FROM lineitem""")
def _(t):
    li = t.raw("lineitem")
    new = li.select(
        F.concat("l_suppkey", F.lit(":D"), "l_partkey").alias("source_path"),
        F.concat("l_partkey", F.lit(".K"), "l_linenumber").alias("target_path"),
        F.when(F.col("l_returnflag") == "R", "bai_bo").alias("ref_type"))
    return upsert.insert_path_edges(new.filter("ref_type = 'none'"), new)


@query("replace_partition", """SELECT doc_id, line_no, CASE WHEN lang = 'fr' THEN 'new' ELSE lang END AS tag FROM lines WHERE lang <> 'fr' OR line_no % 2 = 1""")
def _(t):
    rows = t.lines().select("doc_id", "line_no", F.col("lang").alias("tag"))
    new = rows.filter("tag = 'fr' and line_no % 2 = 1").withColumn("tag", F.lit("new"))
    # every French text keeps its first line, so each of their partitions is replaced
    return upsert.replace_partition(rows, new, "doc_id")


@query("stub_documents", """SELECT DISTINCT to_doc_id AS doc_id, to_doc_id AS doc_num, 'Stub ' || to_doc_id AS title, 'Unknown' AS doc_type, 0 AS status_flag
  FROM doc_edges WHERE to_doc_id NOT IN (SELECT doc_id FROM docs)""")
def _(t):
    return upsert.stub_documents(t.doc_edges(), t.documents())


@query("backfill_source_urls", """SELECT doc_id, CASE WHEN eff_to IS NULL THEN 'https://vbpl.vn/van-ban/chi-tiet/' ||
   CASE doc_type WHEN 'Bộ luật' THEN 'bo-luat' WHEN 'Luật' THEN 'luat' WHEN 'Nghị định' THEN 'nghi-dinh' WHEN 'Thông tư' THEN 'thong-tu' ELSE 'quyet-dinh' END
   || '-so-' || doc_id || '-' || year(issue_date) || '-nd-cp--' || doc_id || '?tabs=toan-van' ELSE source_url END AS source_url FROM docs""")
def _(t):
    d = t.documents().withColumn("full_text", F.col("title")).withColumn(
        "source_url", F.when(F.col("eff_to").isNotNull(), F.col("source_url")).when(doc_key() % 2 == 0, "  "))
    return attributes.backfill_source_urls(d).select("doc_id", "source_url")


@query("sample_export", """SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY status_flag = 1 ORDER BY md5('42:' || doc_id), doc_id) <= 2""")
def _(t):
    return exports.sample_export(t.documents(), 2, F.col("status_flag") == 1, key=["doc_id"])


GRAPH_KIND = """CASE relation_type WHEN 'thay_the' THEN 'SUPERSEDES' WHEN 'sua_doi_bo_sung' THEN 'AMENDS' WHEN 'dan_chieu' THEN 'CITES'
  WHEN 'can_cu_ban_hanh' THEN 'BASED_ON' ELSE 'REPEALS' END"""


@query("graph_mirror", f"""SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (
  SELECT doc_id AS src, 'HAS_NODE' AS kind, path AS dst FROM nodes WHERE doc_id IS NOT NULL
  UNION SELECT parent_path, 'PARENT_OF', path FROM nodes WHERE parent_path IS NOT NULL
  UNION SELECT path, 'OF_DOC', doc_id FROM chunks
  UNION SELECT path, 'OF_NODE', path FROM chunks WHERE path IN (SELECT path FROM nodes)
  UNION SELECT from_doc_id, {GRAPH_KIND}, to_doc_id FROM doc_edges
  UNION SELECT source_path, 'REFERS_TO', target_path FROM path_edges) GROUP BY 1""", views="nodes chunks doc_edges path_edges")
def _(t):
    e = upsert.graph_edges(t.documents(), t.nodes(), t.chunks(), t.doc_edges(), t.path_edges())
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("graph_vertices", """SELECT kind, count(*) AS n, CAST(sum(status_flag) AS BIGINT) AS flags FROM (SELECT 'Document' AS kind, status_flag FROM docs
  UNION ALL SELECT 'Node', status_flag FROM nodes UNION ALL SELECT 'Chunk', status_flag FROM chunks) GROUP BY 1""")
def _(t):
    v = upsert.graph_vertices(t.documents(), t.nodes(), t.chunks())
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("status_flag").alias("flags"))


@query("html_to_blocks")
def _(t):
    return html_to_blocks(t.spread("pages")).select("page_id", "pos", "kind", "text")


def api_json(t):
    """Orders with their line items as portal JSON."""
    item = F.struct(
        (F.col("l_linenumber") % 4).alias("referenceType"),
        F.struct(F.col("l_partkey").cast("string").alias("id"), F.col("l_returnflag").alias("status")).alias("targetDocument"))
    refs = t.numbered_items().groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_no", item.alias("x")))), lambda s: s["x"]).alias("references"))
    o = t.raw("orders").join(refs, "o_orderkey", "left")
    majors = F.array(F.struct(F.col("o_orderpriority").alias("name")))
    issues = F.when(F.col("o_orderstatus") != "P", F.array(F.struct(F.concat(F.lit("C"), "o_custkey").alias("personName"))))
    return o.select("o_orderkey", F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("N"), "o_orderkey").alias("docNum"),
        majors.alias("documentMajors"), issues.alias("documentIssues"),
        F.struct(F.col("o_orderstatus").alias("code")).alias("effStatus"), "references")).alias("json"))


@query("project_attributes", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'N' || o_orderkey AS doc_num, o_orderpriority AS majors,
  CASE WHEN o_orderstatus <> 'P' THEN 'C' || o_custkey END AS signer_name, o_orderstatus AS eff_status_code FROM orders""")
def _(t):
    return attributes.project_attributes(api_json(t)).select(
        "doc_id", "doc_num", F.array_join("majors", ",").alias("majors"), "signer_name", "eff_status_code")


@query("group_references", """SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CASE l_linenumber % 4 WHEN 1 THEN 'van_ban_bi_bai_bo' WHEN 3 THEN 'can_cu_ban_hanh'
   ELSE 'reference_type_' || (l_linenumber % 4) END AS category, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY item_no) AS ids
  FROM items WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2""")
def _(t):
    g = attributes.group_references(api_json(t))
    return g.select("doc_id", "category", F.array_join(F.transform("documents", lambda d: d["id"]), ",").alias("ids"))


@query("variant_attributes", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS major, o_orderstatus AS eff_status_code FROM orders""")
def _(t):
    return attributes.free_fields(api_json(t), {
        "doc_id": ("$.id", "string"), "major": ("$.documentMajors[0].name", "string"), "eff_status_code": ("$.effStatus.code", "string"),
    }).select("doc_id", "major", "eff_status_code")


@query("variant_references", """SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber % 4 AS kind, CAST(l_partkey AS VARCHAR) AS target, count(*) AS n
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2, 3""")
def _(t):
    held = attributes.free_fields(api_json(t), {"doc_id": ("$.id", "string")})
    one = lambda path, kind: F.try_variant_get("entry", path, kind)
    rows = attributes.free_entries(held, "$.references").select("doc_id", one("$.referenceType", "int").alias("kind"), one("$.targetDocument.id", "string").alias("target"))
    return rows.groupBy("doc_id", "kind", "target").agg(F.count(F.lit(1)).alias("n"))


@query("scan_counts", """SELECT c.doc_id, chunks, body, effectivity, coalesce(relations, 0) AS relations, coalesce(pr, 0) AS path_relations FROM
  (SELECT doc_id, count(*) AS chunks, count(*) FILTER (chunk_type = 'body') AS body, 0 AS effectivity FROM chunks GROUP BY 1) c
  LEFT JOIN (SELECT from_doc_id, count(*) AS relations FROM doc_edges GROUP BY 1) r ON r.from_doc_id = c.doc_id
  LEFT JOIN (SELECT split_part(split_part(source_path, '.D', 2), '.', 1) AS d, count(*) AS pr FROM path_edges GROUP BY 1) p ON p.d = c.doc_id""")
def _(t):
    return upsert.scan_counts(t.chunks(), t.doc_edges(), t.path_edges())


@query("count_chunks", "SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1")
def _(t):
    return upsert.count_chunks(t.chunks())


def contracts(t):
    d = t.raw("documents")
    key = F.col("doc_id")
    return d.select(
        key.cast("string").alias("contract_id"), F.col("source").alias("user_id"), F.col("n_chars").alias("created_at"),
        F.when(F.col("lang") != "de", F.col("text")).alias("full_text"),
        F.when(F.col("lang") == "es", F.lit('{"a":1}')).alias("analysis"),
        F.when(F.col("lang") == "es", "analyzed").otherwise("parsed").alias("status"))


@query("contract_upsert", """SELECT CAST(doc_id AS VARCHAR) AS contract_id, CASE WHEN lang = 'de' THEN NULL ELSE md5(text) END AS text_md5,
  CASE WHEN lang = 'es' THEN '{"a":1}' END AS analysis, 'uploaded' AS status FROM documents""")
def _(t):
    old = contracts(t)
    new = old.withColumns({"full_text": F.lit(None).cast("string"), "analysis": F.lit("x"), "status": F.lit("uploaded")})
    return upsert.contract_upsert(old, new).select("contract_id", F.md5("full_text").alias("text_md5"), "analysis", "status")


@query("save_analysis", """SELECT CAST(d.doc_id AS VARCHAR) AS contract_id, CASE WHEN quality IS NOT NULL THEN '{"quality":' || quality || ',"toxic":' || toxic || '}'
    WHEN lang = 'es' THEN '{"a":1}' END AS analysis, CASE WHEN quality IS NOT NULL OR lang = 'es' THEN 'analyzed' ELSE 'parsed' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    a = t.raw("labels").select(F.col("doc_id").cast("string").alias("contract_id"), F.struct("quality", "toxic").alias("analysis"))
    return upsert.save_analysis(contracts(t), a).select("contract_id", "analysis", "status")


@query("list_contracts", "SELECT CAST(doc_id AS VARCHAR) AS contract_id, n_chars AS created_at FROM documents WHERE source = 'src3'")
def _(t):
    return upsert.list_contracts(contracts(t), "src3").select("contract_id", "created_at")


@query("owned_contracts", """SELECT CAST(doc_id AS VARCHAR) AS contract_id FROM documents WHERE source = 'src' || (doc_id % 20)""")
def _(t):
    ask = t.raw("documents").select(F.col("doc_id").cast("string").alias("contract_id"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("user_id"))
    return upsert.owned_contracts(ask, contracts(t)).select("contract_id")


@query("contract_text", """SELECT CAST(d.doc_id AS VARCHAR) AS contract_id, md5(CASE WHEN lang <> 'de' THEN text ELSE j END) AS text_md5 FROM documents d
  LEFT JOIN (SELECT doc_id, string_agg(chunk_text, chr(10) ORDER BY line_no) AS j FROM lines GROUP BY 1) l ON l.doc_id = CAST(d.doc_id AS VARCHAR)""")
def _(t):
    ch = t.lines().select(F.col("doc_id").alias("contract_id"), F.col("line_no").alias("chunk_index"), F.col("chunk_text").alias("content"))
    return upsert.contract_text(contracts(t), ch).select("contract_id", F.md5("text").alias("text_md5"))


@query("clause_text", """SELECT doc_id AS contract_id, 'c' || (line_no % 3) AS clause_number, md5(string_agg(chunk_text, chr(10) ORDER BY line_no)) AS text_md5
  FROM lines GROUP BY 1, 2""")
def _(t):
    ch = t.lines().select(F.col("doc_id").alias("contract_id"), F.col("line_no").alias("chunk_index"), F.col("chunk_text").alias("content"),
                          F.concat(F.lit("c"), F.col("line_no") % 3).alias("clause_number"))
    return upsert.clause_text(ch).select("contract_id", "clause_number", F.md5("text").alias("text_md5"))


@query("analysis_cache", "SELECT CAST(doc_id AS VARCHAR) AS contract_id, lang = 'es' AS cached FROM documents")
def _(t):
    todo, cached = upsert.analysis_cache(contracts(t))
    return todo.select("contract_id", F.lit(False).alias("cached")).unionByName(cached.select("contract_id", F.lit(True).alias("cached")))


# -- D ----------------------------------------------------------------------


@query("map_attributes", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'Hết hiệu lực toàn bộ' WHEN 'O' THEN 'Còn hiệu lực' ELSE 'Hết hiệu lực một phần' END AS eff_flag,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 6 ELSE CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 4 END END AS status_flag,
  CAST(o_orderdate AS DATE) AS issue_date, CASE WHEN o_custkey % 2 = 0 THEN 'S' || o_custkey ELSE 'first ' || o_custkey END AS signer_name FROM orders""")
def _(t):
    cust = F.col("o_custkey")
    none = F.lit(None).cast("string")
    code = F.when(F.col("o_orderstatus") == "F", "BB").when(F.col("o_orderstatus") == "O", "chl").otherwise("SD")
    signer = F.struct(F.concat(F.lit(" first "), cust).alias("name"), none.alias("personName"), none.alias("title"), none.alias("jobTitleName"))
    rows = t.raw("orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"), none.alias("doc_num"), none.alias("doc_type"), none.alias("title"),
        F.array("o_orderpriority").alias("majors"), F.lit(None).cast("array<string>").alias("fields"),
        F.concat(F.to_date("o_orderdate").cast("string"), F.lit("T00:00:00")).alias("issue_date"), none.alias("eff_from"), none.alias("eff_to"),
        none.alias("eff_flag"), none.alias("eff_status"), code.alias("eff_status_code"), none.alias("eff_code"),
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 6).cast("string")).alias("status_flag"), none.alias("agency"),
        F.when(cust % 2 == 0, F.concat(F.lit("S"), cust)).alias("signer_name"), none.alias("signer_title"), F.array(signer).alias("signers"),
        none.alias("source_url"), none.alias("full_text"))
    return attributes.map_attributes(rows).select("doc_id", "eff_flag", "status_flag", "issue_date", "signer_name")


@query("flatten_relations", """SELECT DISTINCT CASE WHEN inc THEN CAST(l_partkey AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) END AS from_doc_id,
   CASE WHEN inc THEN CAST(l_orderkey AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS to_doc_id, l_returnflag AS relation_type
  FROM (SELECT *, l_linestatus = 'F' AS inc FROM lineitem)""")
def _(t):
    return relations.flatten_relations(relation_lists(t))


def relation_lists(t):
    """Line items as the relation file of their order: status F is the incoming side."""
    li = t.raw("lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_returnflag").alias("rt"), (F.col("l_linestatus") == "F").alias("inc"),
        F.col("l_partkey").cast("string").alias("p"))
    lists = li.groupBy("doc_id", "inc", "rt").agg(F.collect_list("p").alias("ps"))
    docs = F.transform("ps", lambda p: F.struct(p.alias("doc_id")))
    side = lambda v: F.to_json(F.map_from_entries(F.collect_list(F.when(F.col("inc") == v, F.struct("rt", F.struct(docs.alias("documents")))))))
    js = lists.groupBy("doc_id").agg(side(F.lit(False)).alias("o"), side(F.lit(True)).alias("i"))
    return js.select("doc_id", F.from_json("o", relations._RELATED).alias("relations"), F.from_json("i", relations._RELATED).alias("relations_incoming"))


@query("relation_stubs", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS doc_id, CAST(l_partkey AS VARCHAR) AS doc_num, 'Stub ' || l_partkey AS title FROM lineitem")
def _(t):
    return relations.relation_stubs(relation_lists(t)).select("doc_id", "doc_num", "title")


@query("relation_type_map", f"SELECT from_doc_id, {GRAPH_KIND} AS graph_type FROM doc_edges")
def _(t):
    return t.doc_edges().select("from_doc_id", relations.relation_type_map(F.col("relation_type")).alias("graph_type"))


@query("parse_local_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "'ngày 'd' tháng 'M' năm 'yyyy")).when(
        F.col("o_orderkey") % 3 == 1, F.date_format(d, "'ký 'd/M/yyyy' tại'")).otherwise(F.date_format(d, "yyyy-M-d"))
    return t.raw("orders").select("o_orderkey", M.parse_local_date(text).alias("day"))


@query("parse_as_of", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN DATE '1999-01-01' WHEN 2 THEN CAST(o_orderdate AS DATE) + CAST(0 AS INTEGER) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, d.cast("string")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'")).otherwise(F.lit("hôm nay"))
    return t.raw("orders").select("o_orderkey", M.parse_as_of(text, S.as_date(AS_OF)).alias("day"))


def enactment(t):
    """A short enactment text per order: stated date, signing date or a delay."""
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    tail = (
        F.when(k == 0, F.concat(F.lit("Văn bản này có hiệu lực thi hành kể từ ngày "), F.date_format(F.date_add(d, 45), "d' tháng 'M' năm 'yyyy"), F.lit(".")))
        .when(k == 1, F.lit("Văn bản này có hiệu lực kể từ ngày ký."))
        .when(k == 2, F.lit("Văn bản này có hiệu lực sau 15 ngày kể từ ngày ký ban hành."))
        .otherwise(F.lit("Không quy định."))
    )
    over = F.when(k == 0, F.concat(F.lit("\n2. Văn bản hết hiệu lực kể từ ngày "), F.date_format(F.date_add(d, 400), "d/M/yyyy"), F.lit("."))).otherwise("")
    text = F.concat(F.lit("Điều 1. Phạm vi\nNội dung "), F.repeat("o_orderpriority", 70), F.lit("\n\nĐiều 2. Hiệu lực thi hành\n1. "), tail, over)
    return t.spread("orders").select("o_orderkey", d.alias("issued"), text.alias("text"))


@query("effective_date", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d + 45 WHEN 1 THEN d WHEN 2 THEN d + 15 END AS effective_date
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    return enactment(t).select("o_orderkey", M.effective_date(F.col("text"), F.col("issued")).alias("effective_date"))


@query("expiry_date", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d + 400 END AS expiry_date FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    return enactment(t).select("o_orderkey", M.expiry_date(F.col("text")).alias("expiry_date"))


@query("doc_type_from_title", "SELECT doc_id, doc_type FROM docs")
def _(t):
    return t.documents().select("doc_id", M.doc_type_from_title(F.col("title")).alias("doc_type"))


@query("issued_year", "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS day FROM orders")
def _(t):
    head = F.concat(F.lit("Hà Nội, ngày 3 tháng 5 năm "), F.year("o_orderdate"))
    return t.raw("orders").select("o_orderkey", M.issued_year(head, S.as_date("2005-01-01")).alias("day"))


@query("doc_metadata", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d + 45 WHEN 1 THEN d WHEN 2 THEN d + 15 END AS effective_date,
  CASE o_orderkey % 4 WHEN 0 THEN d + 400 END AS expiry_date, 'Thông tư' AS doc_type, d AS issued_date FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    m = M.doc_metadata(F.lit("Thông tư số 1"), F.col("text"), F.col("issued"), S.as_date("2005-01-01"))
    return enactment(t).select("o_orderkey", m.alias("m")).select("o_orderkey", "m.*")


@query("cross_ref_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_custkey < 10000 THEN o_custkey || '/2019/nđ-cp' END AS number FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("từ ngày Nghị định số "), "o_custkey", F.lit("/2019/NĐ-CP về thuế có hiệu lực"))).otherwise("từ ngày ký")
    return t.raw("orders").select("o_orderkey", M.cross_ref_number(text).alias("number"))


# -- F ----------------------------------------------------------------------


def citing_text(t):
    """Line items as clauses citing others in every form."""
    return t.spread("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag",
        F.concat(
            F.lit("Theo điểm a khoản "), "l_linenumber", F.lit(" Điều "), "l_partkey", F.lit("; khoản 2 Điều này; các điều từ 3 đến 5; các điều 7, 8 và "),
            "l_suppkey", F.lit("; Chương IV; Điều 9"),
            F.when(F.col("l_returnflag") == "R", " của Luật Đất đai số 45/2013/QH13").otherwise("."),
        ).alias("text"))


@query("internal_refs", """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_partkey || ':' || l_linenumber || ':a|:2:|3::|4::|5::|7::|8::|' || l_suppkey || '::|C4' ||
  CASE WHEN l_returnflag = 'R' THEN '' ELSE '|9::' END AS refs FROM lineitem""")
def _(t):
    line = F.array_join(F.transform(R.spelled_out(R.internal_refs(F.col("text"))), lambda r: F.coalesce(
        F.concat(F.lit("C"), r["chapter"].cast("string")),
        F.concat(F.coalesce(r["article"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(r["clause"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(r["point"], F.lit(""))))), "|")
    return citing_text(t).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", line.alias("refs"))


@query("path_relations", """SELECT source_path, target_path FROM (SELECT DISTINCT a.path || '.K' || item_no AS source_path,
   coalesce(x.path, split_part(a.path, '.', 1) || '.D' || l_partkey) AS target_path
  FROM items JOIN art a ON a.doc_id = CAST(l_orderkey AS VARCHAR) LEFT JOIN art x ON x.doc_id = CAST(l_partkey AS VARCHAR)
   AND split_part(x.path, '.', 1) = split_part(a.path, '.', 1)) WHERE source_path <> target_path""")
def _(t):
    items = t.numbered_items().withColumn("doc_id", F.col("l_orderkey").cast("string")).join(t.article_paths(), "doc_id")
    ch = items.select(F.concat("path", F.lit(".K"), "item_no").alias("path"), F.lit("body").alias("chunk_type"),
                      F.concat(F.lit("Xem Điều "), "l_partkey").alias("chunk_text"))
    return relations.path_relations(ch, t.nodes()).select("source_path", "target_path")


def amendment_files(t):
    """Line items as amendment entries of their part's document."""
    src = F.struct(
        F.lit(None).cast("string").alias("id"), F.col("l_orderkey").cast("string").alias("documentId"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("Nghị định số "), "l_orderkey", F.lit("/2020/NĐ-CP"))).alias("titleDocument"),
        F.concat(F.lit("Khoản "), "l_linenumber", F.lit(", Điều "), "l_orderkey").alias("title"),
        F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "7").alias("type"), F.lit(None).cast("string").alias("content"))
    entry = F.struct(F.struct(F.col("l_suppkey").cast("string").alias("id"), F.lit(None).cast("string").alias("documentId")).alias("targetProvision"),
                     F.collect_list(src).alias("sourceProvisions"))
    rows = t.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(entry.alias("e"))
    return rows.select(F.col("l_partkey").cast("string").alias("doc_id"), F.create_map(F.col("l_suppkey").cast("string"), "e").alias("amendments"))


def amendment_inputs(t):
    nodes = t.raw("lineitem").filter("l_suppkey > 5").select(
        F.col("l_partkey").cast("string").alias("doc_id"), F.col("l_suppkey").cast("string").alias("toc_id"),
        F.concat(F.lit("D"), "l_suppkey").alias("structural_path")).distinct()
    docs = t.documents().filter("status_flag <> 2").select("doc_id", "doc_num")
    chunks = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("doc_id"),
                                    F.concat("o_orderkey", F.lit(".C1.D"), "o_orderkey").alias("path"))
    return amendment_files(t), nodes, docs, chunks


@query("clause_amendments", """SELECT DISTINCT source_path, target_path, ref_type FROM (SELECT
   regexp_replace(coalesce(d.doc_num, CASE WHEN l_tax > 0.04 THEN l_orderkey || '/2020/NĐ-CP' END), '[^A-Za-z0-9_]', '_', 'g') || '.D' || l_orderkey || '.K' || l_linenumber AS source_path,
   regexp_replace(coalesce(t.doc_num, CAST(l_partkey AS VARCHAR)), '[^A-Za-z0-9_]', '_', 'g') || '.D' || l_suppkey AS target_path,
   CASE l_returnflag WHEN 'R' THEN 'bai_bo' WHEN 'A' THEN 'loai_7' ELSE 'sua_doi' END AS ref_type
  FROM lineitem LEFT JOIN (SELECT * FROM docs WHERE status_flag <> 2) d ON d.doc_id = CAST(l_orderkey AS VARCHAR)
  LEFT JOIN (SELECT * FROM docs WHERE status_flag <> 2) t ON t.doc_id = CAST(l_partkey AS VARCHAR) WHERE l_suppkey > 5) WHERE source_path IS NOT NULL""")
def _(t):
    edges, _w = relations.clause_amendments(*amendment_inputs(t))
    return edges.select("source_path", "target_path", "ref_type")


@query("clause_amendment_warnings", """SELECT doc_id, warning, count(*) AS n FROM (SELECT CAST(l_partkey AS VARCHAR) AS doc_id, 'target toc id not found: ' || l_suppkey AS warning
   FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey <= 5)
  UNION ALL SELECT CAST(l_partkey AS VARCHAR), 'no number for source document ' || l_orderkey FROM lineitem JOIN docs ON doc_id = CAST(l_orderkey AS VARCHAR)
   WHERE l_suppkey > 5 AND status_flag = 2 AND l_tax <= 0.04) GROUP BY 1, 2""")
def _(t):
    _e, warnings = relations.clause_amendments(*amendment_inputs(t))
    return warnings.groupBy("doc_id", "warning").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_doc_number", """SELECT o_orderkey, CASE WHEN status_flag <> 2 THEN doc_num WHEN o_orderkey % 2 = 0 THEN o_custkey || '/2020/TT-BTC' ELSE 'none' END AS resolved_num
  FROM orders JOIN docs ON doc_id = CAST(o_orderkey AS VARCHAR)""")
def _(t):
    rows = t.raw("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("doc_id"), F.when(
        F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Thông tư số "), "o_custkey", F.lit("/2020/TT-BTC hướng dẫn"))).alias("title_document"))
    known = t.documents().filter("status_flag <> 2").select("doc_id", "doc_num")
    return relations.resolve_doc_number(rows, known, F.lit("none")).select("o_orderkey", "resolved_num")


@query("amendment_sources", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS doc_id, CAST(l_orderkey AS VARCHAR) AS source_doc_id FROM lineitem")
def _(t):
    return relations.amendment_sources(amendment_files(t))


@query("related_documents", """SELECT doc_id, related FROM (SELECT from_doc_id AS doc_id, to_doc_id AS related, row_number() OVER (PARTITION BY from_doc_id ORDER BY to_doc_id) AS rn
  FROM (SELECT DISTINCT from_doc_id, to_doc_id FROM doc_edges WHERE relation_type IN ('can_cu_ban_hanh','dan_chieu','sua_doi_bo_sung'))) WHERE rn <= 8""")
def _(t):
    return relations.related_documents(t.documents(), t.doc_edges())


@query("repealed_by", """SELECT to_doc_id AS doc_id, from_doc_id AS by_doc_id FROM (SELECT *, row_number() OVER (PARTITION BY to_doc_id ORDER BY from_doc_id) AS rn
  FROM (SELECT DISTINCT to_doc_id, from_doc_id FROM doc_edges WHERE relation_type IN ('thay_the','van_ban_bi_bai_bo') AND to_doc_id IN (SELECT doc_id FROM docs))) WHERE rn <= 8""")
def _(t):
    return relations.repealed_by(t.documents(), t.doc_edges())


@query("graph_related_2hop", """SELECT doc_id, related FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY related) AS rn FROM (
   SELECT a AS doc_id, b AS related FROM und WHERE a IN (SELECT doc_id FROM docs)
   UNION SELECT x.a, y.b FROM und x JOIN und y ON x.b = y.a WHERE x.a <> y.b AND x.a IN (SELECT doc_id FROM docs))) WHERE rn <= 8""", views="docs doc_edges",
       ctes="""und AS (SELECT from_doc_id AS a, to_doc_id AS b FROM doc_edges WHERE relation_type IN ('can_cu_ban_hanh','dan_chieu','sua_doi_bo_sung')
   UNION SELECT to_doc_id, from_doc_id FROM doc_edges WHERE relation_type IN ('can_cu_ban_hanh','dan_chieu','sua_doi_bo_sung'))""")
def _(t):
    return relations.graph_related_2hop(t.documents(), t.doc_edges())
