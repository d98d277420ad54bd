"""Text helpers as column expressions, and the two Arrow functions text needs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from provisio.functions.let import bind

# Separators from coarse to fine, and the default sizes.
SEPARATORS = ("\n\n", "\n", ".", " ", "")
CHUNK_SIZE, CHUNK_OVERLAP = 1800, 120

# Heading forms.
EFFECT_TITLE = r"(?iuU)^(?:Hiệu\s+lực\s+thi\s+hành\b|Tổ\s+chức\s+thực\s+hiện\b)"
ARTICLE_PREFIX = r"(?iuU)^Điều\s+\d+\s*[.:\-–—]?\s*"
CHAPTER_PREFIX = r"(?iuU)^Chương\s+[IVXLCDM\d]+\s*[.:\-–—]?\s*"


@F.pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC and plain spaces; run once at ingest and store the result."""
    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).replace("\xa0", " "))


def _pack(pieces: list[str], sep: str, size: int) -> Iterator[tuple[str, bool]]:
    """Join neighbours while they fit; yields (text, is one oversize piece)."""
    held: list[str] = []
    width = 0
    for piece in pieces:
        grown = width + len(sep) + len(piece) if width else len(piece)
        if grown <= size:
            held, width = ([*held, piece] if width else [piece]), grown
            continue
        if width:
            yield sep.join(held), False
        if len(piece) > size:
            yield piece, True
            held, width = [], 0
        else:
            held, width = [piece], len(piece)
    if width:
        yield sep.join(held), False


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, seps: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Greedy packing by the coarsest separator, finer ones for what is too long.

    Every part but the first starts with the last ``overlap`` characters of the
    part before it (as it was before its own overlap was added at this level).
    """
    if len(text) <= size:
        return [text] if text else []
    sep, finer = seps[0], seps[1:]
    parts: list[str] = []
    for piece, oversize in _pack(text.split(sep) if sep else list(text), sep, size):
        parts += split_text(piece, size, overlap, finer) if oversize and finer else [piece]
    if overlap <= 0:
        return parts
    return [p if i == 0 else parts[i - 1][-overlap:] + p for i, p in enumerate(parts)]


def splitter(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Arrow function ``text -> array<string>`` for the given sizes."""

    @F.pandas_udf(ArrayType(StringType()))
    def split_recursive(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, size, overlap))

    return split_recursive


def piece_splitter(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Arrow function over the pieces of one text."""

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def split_pieces(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda ps: None if ps is None else [split_text(p, size, overlap) for p in ps])

    return split_pieces


# -- column expressions ------------------------------------------------------


def fold_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric runs, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def is_effectivity_title(title: Column) -> Column:
    bare = lambda c: F.trim(F.trim(c, F.lit("*")))
    text = bare(fold_space(title))
    rest = F.regexp_replace(F.regexp_replace(text, ARTICLE_PREFIX, ""), CHAPTER_PREFIX, "")
    return bare(rest).rlike(EFFECT_TITLE)


def lines_around(text: Column, keyword: str, after: int = 2, heading: str = r"\n(?:Điều|ĐIỀU)\s+\d+[^\n]*$") -> Column:
    """First line matching the keyword and the next ``after`` lines, cut at a following heading."""
    lines = F.split(text, "\n")
    hits = F.transform(lines, lambda x: x.rlike(f"(?iuU){keyword}"))
    at = F.array_position(hits, F.lit(True))
    block = F.array_join(F.slice(lines, F.greatest(at.cast("int"), F.lit(1)), F.lit(after + 1)), "\n")
    return F.when(at > 0, fold_space(F.regexp_replace(block, f"(?U){heading}", "")))


def clause_excerpt(text: Column, number: Column, width: int = 2500) -> Column:
    """From the heading of article ``number`` up to the next number's heading."""
    after = (number + 1).cast("string")
    pattern = F.concat(
        F.lit(r"(?iuU)(?:\*{0,2}\s*)?Điều\s*"), number.cast("string"),
        F.lit(r"\b[\s\S]*?(?=(?:\n\s*(?:\*{0,2}\s*)?Điều\s*"), after, F.lit(r"\b)|\z)"))
    found = F.call_function("regexp_extract", text, pattern, F.lit(0))
    return F.nullif(F.substring(fold_space(found), 1, width), F.lit(""))


def strip_internal_refs(text: Column) -> Column:
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\s*([^\]|]+?)\s*\|\s*[^\]]+\]", "$1")
    s = F.regexp_replace(s, r"\b\d{3,}:[A-Za-z0-9.]+\b", "")
    s = F.regexp_replace(s, r"\s{2,}", " ")
    return F.trim(F.regexp_replace(s, r"\s+([,.;:])", "$1"))


def clean_quote(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", " "), r"\*\*|__|\*", "")
    return fold_space(bare)


def article_title(text: Column) -> Column:
    """First heading line ``Điều N. …`` without markers."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", " "), r"\*\*|__|\*", "")
    lines = F.transform(F.split(bare, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*#+\s*", "")))
    return fold_space(F.try_element_at(F.filter(lines, lambda x: x.rlike(r"(?iuU)^Điều\s+\d+\s*[.:)]\s*\S")), F.lit(1)))


def fragment_quote(text: Column, width: int = 180, floor: int = 60) -> Column:
    """At most ``width`` characters, cut at the last ``.``, ``;`` or space beyond ``floor``."""
    def cut(c: Column) -> Column:
        head = F.substring(c, 1, width)
        last = F.length(F.regexp_extract(head, r"(?s)^(.*)[.; ]", 1))
        return F.when(F.length(c) <= width, c).otherwise(
            F.trim(F.when(last >= floor, F.substr(head, F.lit(1), last)).otherwise(head)))

    return bind(clean_quote(text), cut)


def deep_link(url: Column, element_id: Column, quote: Column) -> Column:
    """Page address with the full-text tab and the element, else a text fragment; http(s) only."""
    u = F.trim(url)
    ok = u.rlike(r"^https?://[^/?#]+")
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^tabs(=|$)"))
    joined = F.array_join(F.concat(kept, F.array(F.lit("tabs=toan-van"))), "&")
    encoded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    fragment = F.coalesce(
        F.nullif(encoded(F.trim(element_id)), F.lit("")),
        F.concat(F.lit(":~:text="), F.nullif(encoded(fragment_quote(quote)), F.lit(""))))
    return F.when(ok & fragment.isNotNull(), F.concat(base, F.lit("?"), joined, F.lit("#"), fragment))
