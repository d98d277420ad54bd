r"""URL filters: a fixed list decides first, mined association rules decide the rest.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or end.  Null or no ``://``: both empty.  A list rule fits its host and
all subdomains if the path starts with the rule's path; the longest rule wins.

Mining: the tokens of labelled URLs (label 0 of ``quality``: block) are transactions
of Spark's FP-growth; token combinations that point at ``block`` with enough
confidence and support, and with more confidence than every part of theirs, are kept.
Matching: each kept rule is filed under its rarest token; URLs meet the rules of their
tokens and must hold all the others.  No rule: allow.

Nulls: a null URL has no tokens and is allowed; null labels and labels that name no
page do not count; labels that disagree count as block.  Repeated rows are judged alike.  Empty tables: no rows, or no mined rule.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html_main import host_of

#: (verdict, host, path), the list of the contract.
LIST = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SUPPORT, CONFIDENCE = 0.002, 0.6
BLOCK, ALLOW = "label=block", "label=allow"


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=LIST) -> Column:
    """struct(n, rule, verdict) of the longest list rule that fits, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def tokens_of(url: Column) -> Column:
    """Different tokens of host, path and query names; numbers are one token."""
    text = F.lower(F.coalesce(url, F.lit("")))
    host = F.transform(F.split(host_of(text), r"\."), lambda t: F.concat(F.lit("host="), t))
    path = F.transform(F.split(path_of(text), r"[/._-]+"), lambda t: F.concat(F.lit("path="), F.regexp_replace(t, r"^\d+$", "#")))
    asked = F.transform(F.regexp_extract_all(text, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda t: F.concat(F.lit("query="), t))
    kept = F.filter(F.concat(host, path, asked), lambda t: ~t.isin("host=", "path=", "query="))
    return F.when(text.contains("://"), F.array_distinct(kept)).otherwise(F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support): rules that block."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = pages.select(F.col("page_id").alias("doc_id"), tokens_of(F.col("url")).alias("tokens")).join(known, "doc_id")
    rows = rows.filter(F.size("tokens") > 0)
    marked = rows.select(F.concat("tokens", F.array(F.when(F.col("quality") == 0, BLOCK).otherwise(ALLOW))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(marked)
    rules = model.associationRules.filter(F.get("consequent", F.lit(0)) == BLOCK).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    # A rule says more than another only with more confidence than each rule on a part of its tokens.
    part = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("least"), F.explode("antecedent").alias("token"))
    wide = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    weaker = (
        wide.join(part, "token")
        .filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("least") >= F.col("confidence")))
        .select("antecedent").distinct()
    )
    return rules.join(weaker, "antecedent", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, because): the different URLs that a mined rule fits, with the strongest rule."""
    every = urls.select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    token = F.explode("antecedent").alias("token")
    common = rules.select(token).groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("antecedent", "confidence", "support", token).join(common, "token")
    rarest = Window.partitionBy("antecedent").orderBy("n", "token")
    filed = filed.withColumn("at", F.row_number().over(rarest)).filter("at = 1").drop("at", "n")
    met = every.withColumn("token", F.explode("tokens")).join(filed, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    strength = F.struct("confidence", "support", "antecedent")
    return met.groupBy("url").agg(F.max(strength).alias("because"))


def judge(pages: DataFrame, labels: DataFrame, rules=LIST, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, because) of every row of ``pages`` (page_id, url)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    open_urls = rows.filter("listed IS NULL AND url IS NOT NULL")
    mined = match(open_urls, mine(pages, labels, support, confidence))
    return rows.join(mined, "url", "left").select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", F.when(F.col("because").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("because.antecedent")).alias("because"),
    )
