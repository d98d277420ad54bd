"""Column functions over dotted hierarchy paths such as ``168_2024.C1.D5.K2.a``.

A label is ``[A-Za-z0-9_]+``; every function is a built-in expression, so it
stays inside whole-stage code generation and can be pushed below joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provisio.functions.let import bind

# Level name -> label prefix.
LEVEL_PREFIX = {
    "Part": "P",
    "Chapter": "C",
    "Section": "M",
    "SubSection": "TM",
    "Article": "D",
    "Clause": "K",
    "Appendix": "PL",
    "Group": "N",
}

# Ordinal words, with and without marks.
ORDINAL_WORDS = {
    "nhat": 1, "nhất": 1, "hai": 2, "ba": 3, "bon": 4, "bốn": 4, "tu": 4, "tư": 4,
    "nam": 5, "năm": 5, "sau": 6, "sáu": 6, "bay": 7, "bảy": 7, "tam": 8, "tám": 8,
    "chin": 9, "chín": 9, "muoi": 10, "mười": 10,
}

# Number right after the level keyword.
LEVEL_NUMBER = {
    "Part": r"(?iuU)Phần\s+(?:Thứ\s+)?([IVXLCDM\d]+|[A-Za-zÀ-ỹ]+)",
    "Chapter": r"(?iuU)Chương\s+([IVXLCDM\d]+)",
    "Section": r"(?iuU)Mục\s+([IVXLCDM\d]+)",
    "SubSection": r"(?iuU)Tiểu\s*mục\s+([IVXLCDM\d]+)",
    "Article": r"(?iuU)Điều\s+(\d+)",
    "Clause": r"(?iuU)Khoản\s+(\d+)",
}

ROMAN_LEVELS = ("Part", "Chapter", "Section", "SubSection")


def _roman(n: int) -> str:
    out = ""
    for value, digits in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + digits, n - value
    return out


ROMANS = {_roman(n): n for n in [*range(1, 41), 50]}


def literal_map(table: dict) -> Column:
    """A constant map column (folded by the optimizer)."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# -- B1..B6, B21 ------------------------------------------------------------

def path_sanitize(c: Column) -> Column:
    """Anything outside the label alphabet becomes ``_``; nothing left -> ``doc``."""
    cleaned = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_]", "_")
    return F.coalesce(_blank_to_null(cleaned), F.lit("doc"))


def path_build(root: Column, structural: Column) -> Column:
    tail = F.regexp_replace(F.trim(F.coalesce(structural, F.lit(""))), r"^\.+", "")
    return F.concat_ws(".", path_sanitize(root), _blank_to_null(tail))


def ref_to_path(ref: Column) -> Column:
    """``doc:structural`` -> path; null without a colon or without a tail."""
    cut = F.instr(ref, ":")
    tail = F.substr(ref, cut + F.lit(1))
    return F.when((cut > 0) & (F.length(tail) > 0), path_build(F.substr(ref, F.lit(1), cut - F.lit(1)), tail))


def labels(path: Column) -> Column:
    return F.split(path, r"\.")


def path_depth(path: Column) -> Column:
    return F.size(labels(path))


def path_prefix(path: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(labels(path), F.lit(1), n), ".")


def path_leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def path_parent(path: Column) -> Column:
    """Path without its last label; null at the root."""
    return F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*$", ""))


def path_is_descendant(path: Column, ancestor: Column) -> Column:
    """Label-wise ``<@``: equal or below. For joins use :func:`path_prefixes`."""
    return (path == ancestor) | F.startswith(path, F.concat(ancestor, F.lit(".")))


def path_prefixes(path: Column, proper: bool = False) -> Column:
    """All prefixes, shortest first: turns a tree join into an equi-join.

    The array is as long as the path is deep (8 levels), however large the
    subtree, so exploding it grows a table by a constant factor only.
    """
    parts = labels(path)
    last = F.size(parts) - F.lit(1 if proper else 0)
    lengths = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def path_suffixes(path: Column) -> Column:
    """All suffixes, longest first."""
    parts = labels(path)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def _through(path: Column, label_pattern: str) -> Column:
    return _blank_to_null(F.regexp_extract(path, rf"^((?:.*\.)?{label_pattern})(?:\.|$)", 1))


def article_root(path: Column) -> Column:
    """Prefix through the nearest ``D<digits>`` label from the right."""
    return _through(path, r"D[0-9]+")


def nearest_clause(path: Column) -> Column:
    """Prefix through the nearest ``K<digits>`` label from the right."""
    return _through(path, r"K[0-9]+")


# -- B7 ---------------------------------------------------------------------

def parse_number(token: Column) -> Column:
    """Arabic, roman I..L or an ordinal word -> int, else null."""
    t = F.trim(token)
    return F.coalesce(
        F.when(t.rlike(r"^\d+$"), t.try_cast("int")),
        lookup(ROMANS, F.upper(t)),
        lookup(ORDINAL_WORDS, F.lower(t)),
    )


def point_letter(title: Column) -> Column:
    """Letter of the first ``Điểm x`` when a boundary follows it; ``đ`` -> ``dd``."""
    keyword = r"(?:Điểm|ĐIỂM)\s*"
    pattern = rf"(?U)^(?:(?!{keyword}[a-zA-ZđĐ]).)*{keyword}([a-zA-ZđĐ])(?=\s|$|[).,;:])"
    letter = F.lower(_blank_to_null(F.regexp_extract(title, pattern, 1)))
    return F.when(letter == "đ", F.lit("dd")).otherwise(letter)


def any_roman(title: Column) -> Column:
    """Value of the longest stand-alone roman numeral; equal lengths: V before X."""
    found = F.regexp_extract_all(F.upper(title), F.lit(r"(?U)\b([IVXL]+)\b"), F.lit(1))
    scored = F.transform(
        F.filter(found, lambda r: F.map_contains_key(literal_map(ROMANS), r)),
        lambda r: F.struct(
            F.length(r).alias("len"),
            F.when(r == "X", F.lit(4)).otherwise(lookup(ROMANS, r)).alias("pri"),
            lookup(ROMANS, r).alias("val"),
        ),
    )
    return F.array_max(scored).getField("val")


def segment_token(level: Column, title: Column) -> Column:
    """Path label made from a heading, or null when the heading holds no number."""
    prefix = lookup(LEVEL_PREFIX, level)
    after_keyword = F.coalesce(
        *[
            F.when(level == name, parse_number(_blank_to_null(F.regexp_extract(title, pattern, 1))))
            for name, pattern in LEVEL_NUMBER.items()
        ]
    )
    digits = _blank_to_null(F.regexp_extract(title, r"(\d+)", 1)).try_cast("bigint")
    roman = F.when(level.isin(*ROMAN_LEVELS), any_roman(title))
    number = F.coalesce(after_keyword.cast("bigint"), digits, roman.cast("bigint"))
    return F.when(level == "Point", point_letter(title)).otherwise(F.concat(prefix, number.cast("string")))


def id_token(prefix: Column, node_id: Column, sibling_index: Column) -> Column:
    """Stable fallback label: ``{prefix}_{first 10 id characters}`` or ``{prefix}_u{i}``."""
    cleaned = F.substring(F.regexp_replace(F.coalesce(node_id, F.lit("")), r"[^A-Za-z0-9]", ""), 1, 10)
    ordinal = F.concat(F.lit("u"), (sibling_index + F.lit(1)).cast("string"))
    return F.concat(prefix, F.lit("_"), F.coalesce(_blank_to_null(cleaned), ordinal))


# -- B14..B17 ---------------------------------------------------------------

# Fixed value: the text of a missing hierarchy level.
PLACEHOLDER = "Không có"

# Display words of path labels.
LOCATION_WORDS = {"C": "Chương", "M": "Mục", "TM": "Tiểu mục", "D": "Điều", "K": "Khoản"}
POINT_WORD = "Điểm"


def resolve_ancestors(path: Column) -> Column:
    """Struct of the part / chapter / section / sub-section prefixes above an article."""
    names = (("part", "P"), ("chapter", "C"), ("section", "M"), ("sub_section", "TM"))
    article = F.coalesce(article_root(path), path)
    return F.struct(*[_through(path_parent(article), rf"{p}[0-9]+").alias(n) for n, p in names])


def fill_placeholder(c: Column) -> Column:
    return F.coalesce(_blank_to_null(F.trim(c)), F.lit(PLACEHOLDER))


def node_title(label: Column, path: Column, sort_order: Column) -> Column:
    return F.coalesce(
        _blank_to_null(F.trim(label)), _blank_to_null(path_leaf(path)), sort_order.cast("string")
    )


def _location_label(token: Column) -> Column:
    prefix = F.upper(F.regexp_extract(token, r"(?i)^(C|M|TM|D|K)(\d+)$", 1))
    number = F.regexp_extract(token, r"(?i)^(C|M|TM|D|K)(\d+)$", 2)
    return F.concat(lookup(LOCATION_WORDS, prefix), F.lit(" "), number)


def path_location(path: Column) -> Column:
    """Readable coordinates: one field per level and the ``a > b > c`` line."""
    parts = labels(F.coalesce(path, F.lit("")))
    under_clause = F.transform(
        parts, lambda t, i: F.exists(F.slice(parts, F.lit(1), i), lambda x: x.rlike(r"(?i)^K\d+$"))
    )
    named = F.array_compact(
        F.transform(
            parts,
            lambda t, i: F.coalesce(
                _location_label(t),
                F.when(
                    F.get(under_clause, i) & t.rlike(r"(?iu)^[a-zđ]+$"),
                    F.concat(F.lit(POINT_WORD + " "), t),
                ),
            ),
        )
    )

    def last_of(*words: str) -> Column:
        hits = F.filter(named, lambda x: F.substring_index(x, " ", -1).isNotNull() & _starts(x, words))
        return F.try_element_at(hits, F.lit(-1))

    def _starts(x: Column, words: tuple[str, ...]) -> Column:
        test = F.startswith(x, F.lit(words[0] + " "))
        for w in words[1:]:
            test = test | F.startswith(x, F.lit(w + " "))
        return test

    return F.struct(
        last_of("Chương").alias("chapter"),
        last_of("Mục", "Tiểu mục").alias("section"),
        last_of("Điều").alias("article"),
        last_of("Khoản").alias("clause"),
        last_of(POINT_WORD).alias("point"),
        _blank_to_null(F.array_join(named, " > ")).alias("location"),
    )


# Where a provision title names part, chapter, article, clause, point.
TITLE_PARTS = (
    ("P", r"(?iuU)Phần\s+(?:Thứ\s+)?([IVXLC\d]+|[A-Za-zÀ-ỹ]+)"),
    ("C", r"(?iuU)Chương\s+([IVXLC\d]+)"),
    ("D", r"(?iuU)Điều\s+(\d+)"),
    ("K", r"(?iuU)Khoản\s+(\d+)"),
)
TITLE_POINT = r"(?iuU)Điểm\s*([a-zđ])"


def title_to_path(title: Column) -> Column:
    """``Điểm b, Khoản 1, Điều 177`` -> ``D177.K1.b``; null when nothing is named."""
    pieces = [
        bind(F.regexp_extract(title, rx, 1), lambda n, p=p: F.when(n != "", F.concat(F.lit(p), parse_number(n).cast("string"))))
        for p, rx in TITLE_PARTS
    ]
    pieces.append(bind(F.lower(F.regexp_extract(title, TITLE_POINT, 1)), lambda x: F.when(x == "đ", F.lit("dd")).when(x != "", x)))
    return bind(F.concat_ws(".", *pieces), _blank_to_null)
