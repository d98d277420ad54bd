"""Legal tables seen through a retail schema.

The operators take any DataFrame with the columns of ``schemas``.  To run them
on whole tables of a given size, these views read the retail and text tables
as a legal corpus: region > nation > customer > order > line item is the
hierarchy, an order is a document, document lines are chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.functions import paths as P
from provisio.functions import status as S

AS_OF = "1999-01-01"
PRIORITY_TYPE = {
    "1-URGENT": "Bộ luật",
    "2-HIGH": "Luật",
    "3-MEDIUM": "Nghị định",
    "4-NOT SPECIFIED": "Thông tư",
    "5-LOW": "Quyết định",
}
PRIORITY_RELATION = {
    "1-URGENT": "thay_the",
    "2-HIGH": "sua_doi_bo_sung",
    "3-MEDIUM": "dan_chieu",
    "4-NOT SPECIFIED": "can_cu_ban_hanh",
    "5-LOW": "van_ban_bi_bai_bo",
}
STATUS_WORD = {"F": S.EXPIRED, "O": S.IN_FORCE, "P": S.PARTLY_EXPIRED}


class Tables:
    """Lazy access to the parquet tables of one folder and their legal views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, rows: int | None = None) -> DataFrame:
        """A table for heavy text work: with fewer input splits than cores it is spread over them.

        A table of many splits (any large one) is read as it is, without a shuffle.  With ``rows``
        a task gets about that many rows at most, for work that is long for every row of a small file.
        """
        df = self.raw(name)
        parts = self.spark.sparkContext.defaultParallelism
        if rows is not None:
            parts = max(parts, -(-df.count() // rows))  # row counts of the file footers
        return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)

    def documents(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        issued = F.to_date("o_orderdate")
        begin = F.date_add(issued, 30)
        kind = P.lookup(PRIORITY_TYPE, F.col("o_orderpriority"))
        num = F.concat_ws("/", key.cast("string"), F.year(issued).cast("string"), F.lit("NĐ-CP"))
        label = P.lookup(STATUS_WORD, F.col("o_orderstatus"))
        return o.select(
            key.cast("string").alias("doc_id"),
            num.alias("doc_num"),
            F.concat_ws(" ", kind, F.lit("số"), num).alias("title"),
            kind.alias("doc_type"),
            issued.alias("issue_date"),
            begin.alias("eff_from"),
            F.when(key % 3 == 0, F.date_add(begin, (key % 900 + 100).cast("int"))).alias("eff_to"),
            label.alias("eff_flag"),
            S.label_to_status(label).alias("status_flag"),
            F.col("o_custkey").cast("string").alias("agency"),
            F.concat(F.lit("https://vbpl.example/"), key.cast("string")).alias("source_url"),
            P.path_sanitize(num).alias("path"),
        )

    def doc_edges(self) -> DataFrame:
        """Each document points at an earlier one; the first few point at missing ids."""
        return self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("from_doc_id"),
            (F.col("o_orderkey") - 1 - F.col("o_custkey") % 7).cast("string").alias("to_doc_id"),
            P.lookup(PRIORITY_RELATION, F.col("o_orderpriority")).alias("relation_type"),
        )

    def customer_paths(self) -> DataFrame:
        """25 nations joined to customers: path of each customer's section."""
        n = self.raw("nation").select("n_nationkey", "n_regionkey", "n_name")
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal")
        return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "c_name", "c_acctbal",
            F.format_string("R%d.C%d.M%d", "n_regionkey", "n_nationkey", "c_custkey").alias("path"),
        )

    def article_paths(self) -> DataFrame:
        """doc_id -> path of the article that stands for the order."""
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        c = self.customer_paths().select("c_custkey", F.col("path").alias("cp"))
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").cast("string").alias("doc_id"),
            F.concat(F.col("cp"), F.lit(".D"), F.col("o_orderkey").cast("string")).alias("path"),
        )

    def numbered_items(self) -> DataFrame:
        """Line items numbered inside their order, a small group, by all columns."""
        order = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        return self.raw("lineitem").withColumn("item_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))

    def nodes(self) -> DataFrame:
        d = self.documents()
        art = self.article_paths()
        none_date = F.lit(None).cast("date")

        def row(doc_id, level, path, title, order, begin, end, status):
            return [
                doc_id.alias("doc_id"), F.lit(level).alias("level"), path.alias("path"),
                P.path_parent(path).alias("parent_path"), title.alias("title"),
                order.cast("bigint").alias("sort_order"), begin.alias("eff_from"), end.alias("eff_to"),
                status.cast("int").alias("status_flag"),
            ]

        none = F.lit(None).cast("string")
        r, n = self.raw("region"), self.raw("nation")
        part = r.select(*row(none, "Part", F.format_string("R%d", "r_regionkey"), F.col("r_name"),
                             F.col("r_regionkey"), none_date, none_date, F.lit(1)))
        chapter = n.select(*row(none, "Chapter", F.format_string("R%d.C%d", "n_regionkey", "n_nationkey"),
                                F.col("n_name"), F.col("n_nationkey"), none_date, none_date, F.lit(1)))
        section = self.customer_paths().select(
            *row(none, "Section", F.col("path"), F.col("c_name"), F.col("c_custkey"), none_date, none_date,
                 F.when(F.col("c_acctbal") < 0, 2).otherwise(1))
        )
        article = d.drop("path").join(art, "doc_id").select(
            *row(F.col("doc_id"), "Article", F.col("path"), F.col("title"), F.col("doc_id").cast("bigint"),
                 F.col("eff_from"), F.col("eff_to"), F.col("status_flag"))
        )
        items = self.numbered_items().withColumn("doc_id", F.col("l_orderkey").cast("string"))
        shipped = F.to_date("l_shipdate")
        clause = items.join(art, "doc_id").select(
            *row(F.col("doc_id"), "Clause", F.concat(F.col("path"), F.lit(".K"), F.col("item_no").cast("string")),
                 F.concat_ws(" ", F.lit("Khoản"), F.col("item_no").cast("string")), F.col("item_no"), shipped,
                 F.when(F.col("l_returnflag") == "R",
                        F.date_add(shipped, (F.col("l_quantity") * 20 + 1).cast("int"))),
                 F.when(F.col("l_linestatus") == "O", 1).otherwise(0))
        )
        return part.unionByName(chapter).unionByName(section).unionByName(article).unionByName(clause)

    def path_edges(self) -> DataFrame:
        """A clause refers to the article numbered like its part."""
        art = self.article_paths()
        items = self.numbered_items().select(
            F.col("l_orderkey").cast("string").alias("doc_id"), "item_no",
            F.col("l_partkey").cast("string").alias("target_doc"),
        )
        source = items.join(art, "doc_id").select(
            F.concat(F.col("path"), F.lit(".K"), F.col("item_no").cast("string")).alias("source_path"), "target_doc"
        )
        target = art.select(F.col("doc_id").alias("target_doc"), F.col("path").alias("target_path"))
        return source.join(target, "target_doc").select(
            "source_path", "target_path", F.lit("dan_chieu").alias("ref_type")
        )

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", "embedding", "label")

    def lines(self) -> DataFrame:
        """Filled lines of every text, numbered within the text."""
        d = self.spread("documents")
        return d.select(
            F.col("doc_id").cast("string").alias("doc_id"), "lang", "source",
            F.posexplode(F.split("text", "\n")).alias("pos", "line"),
        ).filter("trim(line) <> ''").select(
            "doc_id", "lang", "source", (F.col("pos") + 1).alias("line_no"), F.col("line").alias("chunk_text")
        )

    def chunks(self) -> DataFrame:
        """Lines as chunks under the article of the order with the same key, with a vector each."""
        n_vec = self.vectors().count()
        lines = self.lines().withColumn("vec_id", (F.col("doc_id").cast("bigint") + F.col("line_no")) % n_vec)
        docs = self.documents().select(
            "doc_id", "doc_num", "doc_type", "title", "issue_date", "eff_from", "eff_to", "status_flag"
        )
        return (
            # Both joins on the document follow one shuffle of the lines; the vectors come last, so they are moved no more.
            lines.join(self.article_paths(), "doc_id").join(docs, "doc_id")
            .join(self.vectors().select("vec_id", "embedding"), "vec_id")
            .select(
                "doc_id", F.concat(F.col("path"), F.lit(".K"), F.col("line_no").cast("string")).alias("path"),
                F.when(F.col("line_no") == 1, "preamble").otherwise("body").alias("chunk_type"),
                "chunk_text", "embedding", "doc_num", "doc_type", "title", "issue_date", "eff_from", "eff_to",
                "status_flag", (F.col("status_flag").isin(1, 5)).alias("is_effective"),
            )
        )

    def queries(self) -> DataFrame:
        """Lines of the reference passages as text queries with a vector each."""
        n_vec = self.vectors().count()
        rows = self.raw("benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter("trim(text) <> ''")
        return rows.withColumn("vec_id", (F.col("item_id") + F.col("pos")) % n_vec).join(
            self.vectors().select("vec_id", "embedding"), "vec_id"
        ).select(F.concat_ws(".", "item_id", "pos").alias("query_id"), "text", "embedding")
