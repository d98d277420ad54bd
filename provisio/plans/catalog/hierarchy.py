"""Path algebra and tree queries (family B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.operators import tree
from provisio.plans.registry import query

# Headings of every level written from order rows.
TITLES = {
    "1-URGENT": "Chapter", "2-HIGH": "Section", "3-MEDIUM": "Article", "4-NOT SPECIFIED": "Clause", "5-LOW": "Point",
}
ROMAN40 = "[" + ",".join(f"'{r}'" for r in P.ROMANS) + "]"
LETTERS = "abcdefghijklmnopqrstuvwxy"


def headings(t):
    o = t.raw("orders")
    key = F.col("o_orderkey")
    roman = F.element_at(F.array(*[F.lit(r) for r in P.ROMANS]), (key % len(P.ROMANS) + 1).cast("int"))
    letter = F.substring(F.lit(LETTERS), 1, 25)
    letter = F.substr(letter, (key % 25 + 1).cast("int"), F.lit(1))
    level = P.lookup(TITLES, F.col("o_orderpriority"))
    title = (
        F.when(level == "Chapter", F.concat(F.lit("Chương "), roman))
        .when(level == "Section", F.concat(F.lit("MỤC "), (key % 50).cast("string"), F.lit(". Quy định")))
        .when(level == "Article", F.concat(F.lit("Điều "), key.cast("string"), F.lit(". Nội dung")))
        .when(level == "Clause", F.concat(F.lit("Khoản của đơn "), key.cast("string")))
        .otherwise(F.concat(F.lit("Điểm "), letter, F.when(key % 2 == 0, ") khoan").otherwise("hoan")))
    )
    return o.select(key.alias("doc_id"), level.alias("level"), title.alias("title"))


HEADINGS = f"""headings AS (SELECT o_orderkey AS doc_id, lv AS level,
  CASE lv WHEN 'Chapter' THEN 'Chương ' || {ROMAN40}[o_orderkey % {len(P.ROMANS)} + 1]
    WHEN 'Section' THEN 'MỤC ' || (o_orderkey % 50) || '. Quy định'
    WHEN 'Article' THEN 'Điều ' || o_orderkey || '. Nội dung'
    WHEN 'Clause' THEN 'Khoản của đơn ' || o_orderkey
    ELSE 'Điểm ' || substr('{LETTERS}', o_orderkey % 25 + 1, 1) || CASE WHEN o_orderkey % 2 = 0 THEN ') khoan' ELSE 'hoan' END END AS title
  FROM orders JOIN (VALUES ('1-URGENT','Chapter'),('2-HIGH','Section'),('3-MEDIUM','Article'),('4-NOT SPECIFIED','Clause'),
    ('5-LOW','Point')) k(pri, lv) ON pri = o_orderpriority)"""


@query("path_sanitize", "SELECT doc_id, regexp_replace(doc_num, '[^A-Za-z0-9_]', '_', 'g') AS label FROM docs")
def _(t):
    return t.documents().select("doc_id", P.path_sanitize(F.col("doc_num")).alias("label"))


@query("path_build", "SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') || '.' || p_type AS path FROM part")
def _(t):
    return t.raw("part").select(
        "p_partkey", P.path_build(F.col("p_brand"), F.concat(F.lit(".."), F.col("p_type"))).alias("path")
    )


@query("ref_to_path", """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE user_id || '.' || event_type END AS path
  FROM events""")
def _(t):
    ref = F.when(F.col("event_type") == "view", F.concat("user_id", F.lit(":"))).otherwise(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return t.raw("events").select("event_id", P.ref_to_path(ref).alias("path"))


@query("path_parts", """SELECT path, len(string_split(path, '.')) AS depth, split_part(path, '.', -1) AS leaf,
  array_to_string(list_slice(string_split(path, '.'), 1, 2), '.') AS prefix2 FROM nodes""")
def _(t):
    p = F.col("path")
    return t.nodes().select(
        "path", P.path_depth(p).alias("depth"), P.path_leaf(p).alias("leaf"), P.path_prefix(p, 2).alias("prefix2")
    )


@query("path_is_descendant", """SELECT s.path AS section, count(*) AS below FROM nodes s JOIN
  (SELECT string_split(path, '.') AS p FROM nodes) n ON len(n.p) >= 3 AND s.path = n.p[1] || '.' || n.p[2] || '.' || n.p[3] WHERE s.level = 'Section' GROUP BY 1""")
def _(t):
    n = t.nodes()
    top = n.filter("level = 'Section'").select(F.col("path").alias("section"))
    below = n.select(F.explode(P.path_prefixes(F.col("path"))).alias("section"))
    return below.join(top, "section").groupBy("section").agg(F.count(F.lit(1)).alias("below"))


@query("article_root", """SELECT path, CASE WHEN level IN ('Article') THEN path WHEN level = 'Clause' THEN parent_path END AS article
  FROM nodes""")
def _(t):
    return t.nodes().select("path", P.article_root(F.col("path")).alias("article"))


@query("nearest_clause", "SELECT path, CASE WHEN level = 'Clause' THEN path END AS clause FROM nodes")
def _(t):
    return t.nodes().select("path", P.nearest_clause(F.col("path")).alias("clause"))


SEGMENT = f"""CASE level WHEN 'Chapter' THEN 'C' || CASE (doc_id % {len(P.ROMANS)}) WHEN 40 THEN 50 ELSE doc_id % {len(P.ROMANS)} + 1 END
  WHEN 'Section' THEN 'M' || (doc_id % 50) WHEN 'Article' THEN 'D' || doc_id WHEN 'Clause' THEN 'K' || doc_id
  ELSE CASE WHEN doc_id % 2 = 0 THEN substr('{LETTERS}', doc_id % 25 + 1, 1) END END"""


@query("segment_token", f"SELECT doc_id, {SEGMENT} AS token FROM headings", ctes=HEADINGS)
def _(t):
    h = headings(t)
    return h.select("doc_id", P.segment_token(F.col("level"), F.col("title")).alias("token"))


@query("allocate_tokens", f"""SELECT doc_id, CASE WHEN wish IS NOT NULL AND first = doc_id THEN wish ELSE pre || '_' || left(CAST(doc_id AS VARCHAR), 10) END AS token
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY scope, wish) AS first FROM (
    SELECT h.doc_id, o_custkey AS scope, {SEGMENT} AS wish,
      CASE level WHEN 'Chapter' THEN 'C' WHEN 'Section' THEN 'M' WHEN 'Article' THEN 'D' WHEN 'Clause' THEN 'K' ELSE 'p' END AS pre
    FROM headings h JOIN orders ON o_orderkey = h.doc_id))""", ctes=HEADINGS)
def _(t):
    h = headings(t).join(t.raw("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("scope")), "doc_id")
    sib = h.select("scope", F.col("doc_id").alias("pos"), "level", "title", F.col("doc_id").cast("string").alias("node_id"))
    return tree.allocate_tokens(sib).select(F.col("pos").alias("doc_id"), "token")


@query("flatten_tree")
def _(t):
    c = t.raw("customer")
    o = t.raw("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Điều "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lit("Article").alias("level")))).alias("children"))
    toc = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").cast("string").alias("doc_id"),
        F.to_json(F.array(F.struct(
            F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("Chương "), F.col("c_nationkey") + 1).alias("title"),
            F.lit("Chapter").alias("level"), "children"))).alias("toc"))
    return tree.flatten_tree(toc).select("doc_id", "node_no", "level", "title", "node_id", "path", "parent_path")


@query("cut_leaves", """SELECT path, level FROM nodes n LEFT JOIN (SELECT DISTINCT parent_path AS above FROM nodes) c ON above = path
  WHERE level = 'Clause' OR (level = 'Article' AND above IS NULL)""")
def _(t):
    return tree.cut_leaves(t.nodes()).select("path", "level")


@query("hierarchy_nodes", """SELECT n.path, n.parent_path, coalesce(n.eff_from, d.eff_from) AS eff_from,
  coalesce(n.eff_to, d.eff_to) AS eff_to, coalesce(nullif(n.status_flag, 0), d.status_flag, 0) AS status_flag
  FROM nodes n LEFT JOIN docs d ON d.doc_id = n.doc_id""")
def _(t):
    out = tree.hierarchy_nodes(t.nodes(), t.documents())
    return out.select("path", "parent_path", "eff_from", "eff_to", "status_flag")


@query("next_sibling", """SELECT path, next_path FROM (SELECT path, lead(path) OVER (PARTITION BY parent_path ORDER BY sort_order, path) AS next_path
  FROM nodes WHERE parent_path IS NOT NULL) WHERE next_path IS NOT NULL""")
def _(t):
    return tree.next_sibling(t.nodes())


@query("scaffold_chain", """SELECT DISTINCT level, path, parent_path FROM (
  SELECT 'SubSection' AS level, s || '._TM' AS path, s AS parent_path FROM (
    SELECT CASE WHEN c_acctbal < 0 THEN regexp_replace(path, '\\.M.*$', '') || '._M' ELSE path END AS s
    FROM cust WHERE c_custkey IN (SELECT o_custkey FROM orders))
  UNION ALL SELECT 'Section', regexp_replace(path, '\\.M.*$', '') || '._M', regexp_replace(path, '\\.M.*$', '')
    FROM cust WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders))""")
def _(t):
    kept = t.nodes().filter("not (level = 'Section' and status_flag = 2)")
    return tree.scaffold_chain(kept).select("level", "path", "parent_path")


@query("resolve_ancestors", """SELECT path, 'R' || n_regionkey || '.C' || n_nationkey AS chapter, cp AS section FROM (
  SELECT art.path, cust.path AS cp, n_regionkey, n_nationkey FROM art JOIN orders ON CAST(o_orderkey AS VARCHAR) = doc_id
  JOIN cust ON c_custkey = o_custkey JOIN customer c2 ON c2.c_custkey = o_custkey JOIN nation ON n_nationkey = c2.c_nationkey)""",
       views="art")
def _(t):
    a = P.resolve_ancestors(F.col("path"))
    return t.article_paths().select("path", a["chapter"].alias("chapter"), a["section"].alias("section"))


@query("fill_placeholder", """SELECT event_id, CASE WHEN event_type = 'error' OR value < 5 THEN 'Không có' ELSE event_type END AS title FROM events""")
def _(t):
    title = F.when(F.col("value") < 5, "  ").when(F.col("event_type") != "error", F.col("event_type"))
    return t.raw("events").select("event_id", P.fill_placeholder(title).alias("title"))


@query("path_location", """SELECT path, 'Chương ' || substr(split_part(path, '.', 2), 2) || ' > Mục ' || substr(split_part(path, '.', 3), 2)
  || ' > Điều ' || substr(split_part(path, '.', 4), 2) || ' > Khoản ' || substr(split_part(path, '.', 5), 2) AS location,
  'Điều ' || substr(split_part(path, '.', 4), 2) AS article, 'Khoản ' || substr(split_part(path, '.', 5), 2) AS clause
  FROM nodes WHERE level = 'Clause'""")
def _(t):
    loc = P.path_location(F.col("path"))
    return t.nodes().filter("level = 'Clause'").select(
        "path", loc["location"].alias("location"), loc["article"].alias("article"), loc["clause"].alias("clause"))


@query("title_to_path", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  'P5.C' || (l_suppkey % 40 + 1) || '.D' || l_orderkey || '.K' || l_linenumber || '.' || substr('{LETTERS}', l_partkey % 25 + 1, 1) AS path
  FROM lineitem""")
def _(t):
    key = lambda c: F.col(c).cast("string")
    roman = F.element_at(F.array(*[F.lit(r) for r in list(P.ROMANS)[:40]]), (F.col("l_suppkey") % 40 + 1).cast("int"))
    letter = F.substr(F.lit(LETTERS), (F.col("l_partkey") % 25 + 1).cast("int"), F.lit(1))
    title = F.concat(F.lit("Điểm "), letter, F.lit(", Khoản "), key("l_linenumber"), F.lit(", Điều "), key("l_orderkey"),
                     F.lit(", Chương "), roman, F.lit(", Phần Thứ Năm"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.title_to_path(title).alias("path"))


@query("suffix_match_path", """SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'C99.D' || l_orderkey AS guess, count(*) AS n, max(path) AS resolved
  FROM lineitem JOIN art ON doc_id = CAST(l_orderkey AS VARCHAR) GROUP BY 1, 2""")
def _(t):
    key = F.col("l_orderkey").cast("string")
    guesses = t.raw("lineitem").select(key.alias("doc_id"), F.concat(F.lit("C99.D"), key).alias("guess"))
    return tree.suffix_match_path(guesses, t.article_paths()).groupBy("doc_id", "guess").agg(
        F.count(F.lit(1)).alias("n"), F.max("resolved").alias("resolved"))


@query("ancestors_of", """SELECT ancestor, count(*) AS below FROM (SELECT unnest([split_part(path, '.', 1),
  array_to_string(list_slice(string_split(path, '.'), 1, 2), '.'), array_to_string(list_slice(string_split(path, '.'), 1, 3), '.'),
  array_to_string(list_slice(string_split(path, '.'), 1, 4), '.')]) AS ancestor FROM nodes WHERE level = 'Clause') GROUP BY 1""")
def _(t):
    clauses = t.nodes().filter("level = 'Clause'").select("path")
    return tree.ancestors_of(clauses).groupBy("ancestor").agg(F.count(F.lit(1)).alias("below"))


@query("siblings_of", """SELECT query_id, path, rn FROM (SELECT doc_id AS query_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rn
  FROM chunks WHERE chunk_type <> 'preamble') WHERE rn <= 24""")
def _(t):
    c = t.chunks()
    seeds = c.filter("chunk_type = 'preamble'").select(F.col("doc_id").alias("query_id"), "path")
    with_seed = c.join(seeds.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    return tree.siblings_of(seeds, with_seed).select("query_id", "path", "rn")
