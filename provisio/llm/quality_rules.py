r"""Quality rules: a threshold table compiled into one projection.

Every text is measured by column expressions (no user functions, no shuffle): words, their
characters, symbols, stop words, lines, repeated lines and words in repeated five-word
windows.  ``compiled`` turns the rows of a threshold table into one projection that
compares whole-number products, so no ratio is ever rounded.

Words are ``[^\x20\x09-\x0D]+``, lines are parted by ``\n`` and count if they hold a word.
A window is repeated if its five words also stand elsewhere in the same text; windows are
paired by a hash first, then the words themselves are compared.

Null text: empty, so without words; it fails the base rules.  A rule whose whole is 0
holds; so does a stop-word rule on a language without a list.  Repeated rows are judged each
for itself, texts of any length as a whole.  Empty table: no rows.  Other columns are not
read by ``report`` and pass through ``drop_poor``, where clashing names stay untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
SPAN = 5
#: Common words of each language that the stop-word rule knows.
STOP_WORDS = {
    "en": "the and of to in that is was for on with as by it at from be this are have not or an which you a".split(),
    "de": "der die und in den das von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "fr": "le la les et de des un une du que en est pour qui dans par sur pas au plus ne se ce il sont avec".split(),
    "es": "el la los las y de que en un una por con para del se es no al lo su como más o pero sus le".split(),
}


@dataclass(frozen=True)
class Rule:
    """``least`` <= 100 * part / whole <= ``most``, where ``when`` holds; an absent bound does not bind."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    when: str = "true"


#: The base rules, which the contract fixes.
BASE = (
    Rule("few_words", "n_words", "one", least=1000),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=20),
)
#: The method's own rules.  Parts and wholes are the measures below.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=2, when="n_words >= 50 AND n_stop_words IS NOT NULL"),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30),
)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) with the measures in place of the text.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and
    n_stop_words (null for a language without a list), all long.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(BLANK))
    rows = docs.select(
        "doc_id", "lang",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "").alias("lines"),
        F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
    )
    n = F.size("words")
    rows = rows.select("*", n.cast("bigint").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    starts = F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(SPAN)]))
    # Positions take as many low bits as they need, the hash of the window the others.
    rows = rows.select("*", windows.alias("windows"), F.length(F.bin(n)).alias("bits")).drop("hashes")
    shifted = lambda way, value: F.call_function(f"shift{way}", value, F.col("bits"))
    keys = F.sort_array(F.transform("windows", lambda h, i: shifted("left", h).bitwiseOR(i.cast("bigint"))))
    # Most texts repeat no window: their hashes are all different.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("keys", F.when(twice, keys).otherwise(F.array().cast("array<bigint>"))).drop("windows")
    # Only windows whose hash stands next to an equal one can be repeated.
    alike = F.filter(
        "keys",
        lambda key, i: F.coalesce(shifted("right", key) == shifted("right", F.get("keys", i - 1)), F.lit(False))
        | F.coalesce(shifted("right", key) == shifted("right", F.get("keys", i + 1)), F.lit(False)),
    )
    place = lambda key: key.bitwiseAND(shifted("left", F.lit(1).cast("bigint")) - 1)
    found = F.array_sort(F.transform(
        alike, lambda key: F.struct(F.array_join(F.slice("words", place(key).cast("int") + 1, SPAN), " ").alias("window"), place(key).alias("at"))
    ))
    rows = rows.withColumn("found", F.when(F.size("keys") > 0, found).otherwise(F.array().cast("array<struct<window:string,at:bigint>>")))
    twice = F.filter(
        "found",
        lambda x, i: F.coalesce(x["window"] == F.get("found", i - 1)["window"], F.lit(False))
        | F.coalesce(x["window"] == F.get("found", i + 1)["window"], F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["at"])),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-SPAN).cast("bigint").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(SPAN).cast("bigint"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    stops = F.lit(None).cast("bigint")
    for lang, words in STOP_WORDS.items():
        stops = F.when(F.col("lang") == lang, _stop_words(words)).otherwise(stops)
    return rows.select(
        "doc_id", "n_words",
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("found") == 0, F.lit(0).cast("bigint")).otherwise(covered).alias("n_repeat_words"),
        stops.alias("n_stop_words"),
    )


def _stop_words(common: list[str]) -> Column:
    forms = sorted({*common, *(w.capitalize() for w in common)})
    return F.size(F.filter("words", lambda w: w.isin(forms))).cast("bigint")


def _fails(rule: Rule) -> Column:
    part = F.lit(100).cast("bigint") * F.col(rule.part)
    whole = F.lit(1).cast("bigint") if rule.whole == "one" else F.col(rule.whole)
    bounds = [part < rule.least * whole] if rule.least is not None else []
    bounds += [part > rule.most * whole] if rule.most is not None else []
    return F.coalesce(F.expr(rule.when) & reduce(Column.__or__, bounds, F.lit(False)), F.lit(False))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules of a table that a row of measures fails: one expression."""
    return F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string")), lambda x: x.isNotNull())


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base_failed, kept and the comma-joined names of the failed rules of every row."""
    table = measured(docs.select("doc_id", "text", "lang"))
    base = reduce(Column.__or__, [_fails(r) for r in BASE])
    own = compiled(rules)
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(own) == 0)).alias("kept"),
        "n_lines", "n_stop_words", F.array_join(F.concat(compiled(BASE), own), ",").alias("failed"),
    )


def drop_poor(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without the rows that fail a rule; no shuffle, no join: the row rides along with its measures."""
    held = docs.select(F.struct("*").alias("doc_id"), "text", "lang")
    judged = report(held, rules)
    return judged.filter("kept").select("doc_id.*")
