"""Queries of the operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations, decontaminate, exact_dedup, html_main, packing, phrases, pseudonyms, quality_rules, sharding, simhash, substring_dedup, toxicity, url_rules,
)
from .common import read, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Shards of the placement query, and the demonstration key of the pseudonyms (a user brings a secret one).
SHARDS = [f"shard-{i:03d}" for i in range(256)]
KEY = b"public demonstration key"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query("op3_exact_dedup", sql="""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicates(read(spark, folder, "documents"))


@query("op10_benchmark_decontamination", sql="""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), spans AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
), hits AS (SELECT r, i, n, item_id FROM spans JOIN items USING (win, n)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op1_html_extraction")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return html_main.extract(read(spark, folder, "pages"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op9_substring_dedup", sql="""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER () AS r FROM documents
), win AS (
  SELECT r, i, md5(list_aggregate(w[i:i + 34], 'string_agg', ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i
  FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1
), lost AS (SELECT r, count(*) AS n, list(i) AS l FROM gone GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN lost.n IS NULL THEN array_to_string(w, ' ') ELSE (
         SELECT string_agg(x, ' ' ORDER BY j) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j)
         WHERE NOT list_contains(lost.l, j)) END, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, folder, "documents"))


@query("op4_sharding")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(read(spark, folder, "documents"), SHARDS).select("doc_id", "slot", "shard")


@query("op5_url_filters")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(read(spark, folder, "pages"), read(spark, folder, "labels"))


@query("op6_pii_pseudonyms")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = pseudonyms.pseudonyms(read(spark, folder, "documents").select("doc_id", "text"), KEY)
    kinds = F.map_values("found")
    return found.select("doc_id", F.aggregate(kinds, F.lit(0).cast("bigint"), lambda s, n: s + n).alias("n_values"), "found", "text")


def _stop_words(lang: str) -> str:
    forms = sorted({f for w in quality_rules.STOP_WORDS[lang] for f in (w, w.capitalize())})
    return "[" + ", ".join(f"'{w}'" for w in forms) + "]"


@query("op11_quality_rules", sql=f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), again AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         CASE lang {' '.join(f"WHEN '{x}' THEN len(list_filter(w, lambda x: list_contains({_stop_words(x)}, x)))" for x in quality_rules.STOP_WORDS)} END::BIGINT AS n_stop_words
  FROM d LEFT JOIN again USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         concat_ws(',', CASE WHEN n_words < 10 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeated_windows' END,
           CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 'word_length' END, CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
           CASE WHEN n_words >= 50 AND n_stop_words * 100 < 2 * n_words THEN 'stop_words' END, CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 'repeated_lines' END) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' AS kept, n_lines, n_stop_words, failed FROM f
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(read(spark, folder, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.report(conversations.damaged(read(spark, folder, "conversations")))


@query("op13_phrase_mining", sql="""
WITH p AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents)
), words AS (SELECT lang, r, unnest(w) AS word FROM p),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS place FROM c),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.place, y.f AS l, z.f AS r, (2000000::HUGEINT * x.a) // (y.f + z.f) AS score
  FROM cuts x JOIN f y ON y.lang = x.lang AND y.phrase = array_to_string(x.w[1:place], ' ') JOIN f z ON z.lang = x.lang AND z.phrase = array_to_string(x.w[place + 1:x.k], ' ')
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
inside AS (
  SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase
  FROM (SELECT lang, w, a, k, j, unnest(range(1, k - j + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < k)
), kept AS (
  SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM inside y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100::HUGEINT * y.a >= 80::HUGEINT * x.a)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(read(spark, folder, "documents"))
