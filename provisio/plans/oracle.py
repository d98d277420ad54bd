"""The projections once more as ANSI SQL, for an independent check."""

from __future__ import annotations

AS_OF = "DATE '1999-01-01'"

CTES = {
    "docs": """docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
    CAST(o_orderkey AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) || '/NĐ-CP' AS doc_num,
    k.kind || ' số ' || CAST(o_orderkey AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) || '/NĐ-CP' AS title,
    k.kind AS doc_type, CAST(o_orderdate AS DATE) AS issue_date,
    CAST(o_orderdate AS DATE) + 30 AS eff_from,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 30 + CAST(o_orderkey % 900 + 100 AS INTEGER) END AS eff_to,
    CASE o_orderstatus WHEN 'F' THEN 'Hết hiệu lực toàn bộ' WHEN 'O' THEN 'Còn hiệu lực' ELSE 'Hết hiệu lực một phần' END AS eff_flag,
    CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 4 END AS status_flag,
    CAST(o_custkey AS VARCHAR) AS agency, 'https://vbpl.example/' || CAST(o_orderkey AS VARCHAR) AS source_url,
    regexp_replace(CAST(o_orderkey AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) || '/NĐ-CP', '[^A-Za-z0-9_]', '_', 'g') AS path
  FROM orders JOIN (VALUES ('1-URGENT','Bộ luật'),('2-HIGH','Luật'),('3-MEDIUM','Nghị định'),
    ('4-NOT SPECIFIED','Thông tư'),('5-LOW','Quyết định')) k(pri, kind) ON k.pri = o_orderpriority)""",
    "doc_edges": """doc_edges AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS from_doc_id, CAST(o_orderkey - 1 - o_custkey % 7 AS VARCHAR) AS to_doc_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'thay_the' WHEN '2-HIGH' THEN 'sua_doi_bo_sung' WHEN '3-MEDIUM' THEN 'dan_chieu'
      WHEN '4-NOT SPECIFIED' THEN 'can_cu_ban_hanh' ELSE 'van_ban_bi_bai_bo' END AS relation_type FROM orders)""",
    "cust": """cust AS (
  SELECT c_custkey, c_name, c_acctbal, 'R' || n_regionkey || '.C' || n_nationkey || '.M' || c_custkey AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "art": """art AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, cust.path || '.D' || o_orderkey AS path
  FROM orders JOIN cust ON o_custkey = c_custkey)""",
    "items": """items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_no FROM lineitem)""",
    "nodes": """nodes AS (
  SELECT NULL AS doc_id, 'Part' AS level, 'R' || r_regionkey AS path, NULL AS parent_path, r_name AS title,
    CAST(r_regionkey AS BIGINT) AS sort_order, CAST(NULL AS DATE) AS eff_from, CAST(NULL AS DATE) AS eff_to, 1 AS status_flag FROM region
  UNION ALL SELECT NULL, 'Chapter', 'R' || n_regionkey || '.C' || n_nationkey, 'R' || n_regionkey, n_name, n_nationkey, NULL, NULL, 1 FROM nation
  UNION ALL SELECT NULL, 'Section', path, regexp_replace(path, '\\.[^.]*$', ''), c_name, c_custkey, NULL, NULL,
    CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END FROM cust
  UNION ALL SELECT d.doc_id, 'Article', a.path, regexp_replace(a.path, '\\.[^.]*$', ''), title, CAST(d.doc_id AS BIGINT), eff_from, eff_to, status_flag
    FROM docs d JOIN art a ON a.doc_id = d.doc_id
  UNION ALL SELECT a.doc_id, 'Clause', a.path || '.K' || item_no, a.path, 'Khoản ' || item_no, item_no, CAST(l_shipdate AS DATE),
    CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity * 20 + 1 AS INTEGER) END,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END
    FROM items JOIN art a ON a.doc_id = CAST(l_orderkey AS VARCHAR))""",
    "path_edges": """path_edges AS (
  SELECT a.path || '.K' || item_no AS source_path, t.path AS target_path, 'dan_chieu' AS ref_type
  FROM items JOIN art a ON a.doc_id = CAST(l_orderkey AS VARCHAR) JOIN art t ON t.doc_id = CAST(l_partkey AS VARCHAR))""",
    "lines": """lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, i AS line_no, l AS chunk_text FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l,
      unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(l) <> '')""",
    "chunks": """chunks AS (
  SELECT l.doc_id, a.path || '.K' || line_no AS path, CASE WHEN line_no = 1 THEN 'preamble' ELSE 'body' END AS chunk_type,
    chunk_text, e.embedding, d.doc_num, d.doc_type, d.title, d.issue_date, d.eff_from, d.eff_to, d.status_flag,
    d.status_flag IN (1, 5) AS is_effective
  FROM lines l JOIN art a ON a.doc_id = l.doc_id JOIN docs d ON d.doc_id = l.doc_id
  JOIN embeddings e ON e.vec_id = (CAST(l.doc_id AS BIGINT) + line_no) % (SELECT count(*) FROM embeddings))""",
}
CTES["q"] = """q AS (SELECT item_id || '.' || pos AS query_id, b.text, e.embedding FROM (
   SELECT item_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM benchmark) b
  JOIN embeddings e ON e.vec_id = (item_id + pos) % (SELECT count(*) FROM embeddings) WHERE trim(b.text) <> '')"""
NEEDS = {
    "art": ["cust"],
    "nodes": ["docs", "cust", "art", "items"],
    "path_edges": ["cust", "art", "items"],
    "chunks": ["docs", "cust", "art", "lines"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named views and what they read, in order."""
    wanted: list[str] = []
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    ordered = [n for n in CTES if n in wanted]
    return "WITH " + ",\n".join(CTES[n] for n in ordered)
