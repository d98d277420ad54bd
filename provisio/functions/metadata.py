"""Dates, kinds and numbers read from the text of a legal document.

All rules are built-in expressions over arrays of segments; no Python runs per
row.  Patterns are Java regexes; ``(?iuU)`` makes them fold and classify
Unicode letters.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from provisio.functions.let import bind
from provisio.functions.rank import first_match

# Patterns of document numbers, dates and effect phrases.
DOC_NUMBER = r"\d{1,4}(?:/[A-ZĐa-zđ0-9\-]+)*(?:/[A-ZĐa-zđ]+)*"
DATE_PATTERNS = (
    (r"(?:ngày\s+)?(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", (3, 2, 1)),
    (r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", (3, 2, 1)),
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
)
EFFECT_KEYWORDS = (
    "có hiệu lực thi hành", "hiệu lực thi hành", "có hiệu lực kể từ ngày", "có hiệu lực từ ngày",
    "có hiệu lực sau", "có hiệu lực vào", "kể từ ngày ký", "kể từ ngày ký ban hành", "kể từ ngày ban hành",
    "bắt đầu có hiệu lực", "bắt đầu thi hành", "thi hành kể từ ngày", "thi hành từ ngày",
)
FROM_SIGNING = (
    r"có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?kể\s+từ\s+ngày\s+ký",
    r"có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?từ\s+ngày\s+ký",
    r"hiệu\s+lực\s+thi\s+hành\s+kể\s+từ\s+ngày\s+ký",
    r"có\s+hiệu\s+lực\s+kể\s+từ\s+ngày\s+ban\s+hành",
    r"có\s+hiệu\s+lực\s+từ\s+ngày\s+ban\s+hành",
    r"có\s+hiệu\s+lực\s+thi\s+hành\s+kể\s+từ\s+ngày\s+ban\s+hành",
    r"có\s+hiệu\s+lực\s+thi\s+hành\s+từ\s+ngày\s+ban\s+hành",
)
EFFECT_DATE = (
    r"có\s+hiệu\s+lực\s+thi\s+hành\s+kể\s+từ\s+ngày\s+([^.;]+)",
    r"có\s+hiệu\s+lực\s+thi\s+hành\s+từ\s+ngày\s+([^.;]+)",
    r"có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:kể\s+từ\s+|từ\s+|vào\s+)?ngày\s+([^.;]+)",
    r"hiệu\s+lực\s+thi\s+hành\s+(?:kể\s+từ\s+|từ\s+)?ngày\s+([^.;]+)",
    r"thi\s+hành\s+(?:kể\s+từ\s+|từ\s+)?ngày\s+([^.;]+)",
)
SIGNING_DELAY = r"sau\s+(\d+)\s+ngày\s+kể\s+từ\s+ngày\s+ký"
ENFORCEMENT_HEADER = r"(?<!\p{L})Điều\s+[\dIVXLCH]+\s*[.:]"
SEGMENT_START = r"\n\s*(?:\d+[.)]|[a-zđ][.)]|[-–•])\s*"
EXPIRY_LEADS = (
    r"hết\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:kể\s+từ\s+)?ngày\s+",
    r"hết\s+hiệu\s+lực\s+vào\s+ngày\s+",
)
EXPIRY_LEAD_IN_CONTEXT = r"đến\s+hết\s+ngày\s+"
EXPIRY_DATES = (r"\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{4}", r"\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}")
OTHERS_EXPIRE = (
    r"(?:các|những)\s+(?:quy[ếe]t\s*đ[ịi]nh|v[ăa]n\s*b[ảa]n|ngh[ịi]\s*đ[ịi]nh|th[ôo]ng\s*t[ưu])"
    r"\s+sau\s+đ[âa]y\s+h[ếe]t\s+hi[ệe]u\s+l[ựư]c"
)
CROSS_REFERENCE = (
    rf"kể\s+từ\s+ngày\s+(?:[\wĐđ]+\s+){{1,5}}số\s+({DOC_NUMBER})\s+.*?có\s+hiệu\s+lực",
    rf"từ\s+ngày\s+(?:[\wĐđ]+\s+){{1,5}}số\s+({DOC_NUMBER})\s+.*?có\s+hiệu\s+lực",
)
TITLE_KIND = (
    (r"\bHiến\s*pháp\b", "Hiến pháp"),
    (r"\bBộ\s*luật\b", "Bộ luật"),
    (r"\bLuật\b(?!.*\bBộ\s*luật\b)", "Luật"),
    (r"\bNghị\s*quyết\b", "Nghị quyết"),
    (r"\bNghị\s*định\b", "Nghị định"),
    (r"\bQuyết\s*định\b", "Quyết định"),
    (r"\bThông\s*tư\b", "Thông tư"),
    (r"\bChỉ\s*thị\b", "Chỉ thị"),
    (r"\bPháp\s*lệnh\b", "Pháp lệnh"),
    (r"\bQuy\s*chuẩn\b", "Quy chuẩn"),
    (r"\bVăn\s+bản\s+hợp\s+nhất\b", "Văn bản hợp nhất"),
)
ISSUED_YEAR = (r"(?:ngày|số)\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+(\d{4})", r"năm\s+(\d{4})")


def _got(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _extract(text: Column, pattern: str, group: int = 1, flags: str = "(?U)") -> Column:
    return _got(F.regexp_extract(text, flags + pattern, group))


def _first(items: Column) -> Column:
    return F.try_element_at(F.filter(items, lambda x: x.isNotNull()), F.lit(1))


def parse_local_date(text: Column) -> Column:
    """First pattern that gives a calendar day within 1900..2100."""
    def parsed(t: Column) -> Column:
        out = []
        for pattern, (y, m, d) in DATE_PATTERNS:
            parts = [_extract(t, pattern, g) for g in (y, m, d)]
            day = F.when(t.rlike("(?U)" + pattern), F.try_to_date(F.concat_ws("-", *parts), "y-M-d"))
            out.append(bind(day, lambda x: F.when(F.year(x).between(1900, 2100), x)))
        return F.coalesce(*out)

    return bind(text, lambda t: F.when(t.isNotNull(), parsed(t)))


def parse_as_of(text: Column, today: Column) -> Column:
    """ISO or d/m/y (two-digit years are 20xx); anything else is ``today``."""
    t = F.substring(F.trim(text), 1, 10)
    parts = F.split(t, "/")
    year = F.get(parts, 2).try_cast("int")
    full = F.concat_ws("-", (F.when(year < 100, year + 2000).otherwise(year)).cast("string"), F.get(parts, 1), F.get(parts, 0))
    slashed = F.when((F.size(parts) == 3) & year.isNotNull(), F.try_to_date(full, "y-M-d"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t))
    return F.coalesce(slashed, iso, today)


def from_signing(text: Column) -> Column:
    return F.lower(text).rlike("(?U)" + "|".join(f"(?:{p})" for p in FROM_SIGNING))


def cross_ref_number(text: Column) -> Column:
    """Number of another document whose effect date is referred to (5 characters or more)."""
    hits = [F.rtrim(_extract(F.lower(text), p), F.lit("-/")) for p in CROSS_REFERENCE]
    return F.coalesce(*[F.when(F.length(h) >= 5, h) for h in hits])


def enforcement_article(text: Column) -> Column:
    """The article about taking effect: by its first 100, else by its first 400 characters."""
    return bind(F.split(text, f"(?iuU)(?={ENFORCEMENT_HEADER})"), _about_effect)


def _about_effect(parts: Column) -> Column:
    heads = F.transform(
        parts, lambda p, i: F.struct(p.alias("seg"), F.array_join(F.slice(parts, i + 1, F.lit(4)), "").alias("ahead"))
    )
    found = F.filter(heads, lambda h: h["seg"].rlike(f"(?iuU)^{ENFORCEMENT_HEADER}"))

    def pick(found: Column, width: int, pattern: str) -> Column:
        hit = F.filter(found, lambda h: F.substring(h["ahead"], 1, width).rlike(f"(?iuU){pattern}"))
        return F.try_element_at(hit, F.lit(1)).getField("seg")

    seg = bind(found, lambda f: F.coalesce(pick(f, 100, r"hiệu\s+lực"), pick(f, 400, r"có\s+hiệu\s+lực|hiệu\s+lực\s+thi\s+hành")))
    return bind(F.trim(seg), _got)


def enforcement_section(text: Column) -> Column:
    """Last paragraph with an effect keyword; a long one is narrowed to its article."""
    keyword = "|".join(EFFECT_KEYWORDS)
    paragraphs = F.reverse(F.split(text, r"\n\s*\n"))
    hit = F.filter(paragraphs, lambda p: F.lower(p).rlike(keyword))
    return bind(F.trim(F.try_element_at(hit, F.lit(1))), lambda para: F.when(
        F.length(para) > 2000, F.coalesce(enforcement_article(para), para)).otherwise(para))


def _date_in_segments(text: Column) -> Column:
    segments = F.filter(
        F.split(F.lower(text), "(?U)" + SEGMENT_START), lambda s: ~from_signing(s) & cross_ref_number(s).isNull()
    )
    return _first(F.transform(
        segments,
        lambda s: F.coalesce(*[parse_local_date(F.substring(_extract(s, p), 1, 80)) for p in EFFECT_DATE]),
    ))


def _signing_rule(text: Column, issued: Column) -> Column:
    days = _extract(F.lower(text), SIGNING_DELAY).try_cast("int")
    return F.when(from_signing(text), issued).otherwise(F.date_add(issued, days))


def effective_date(text: Column, issued: Column) -> Column:
    """Day of taking effect: stated date, else signing day, else signing day plus N days.

    The enforcement article is looked at first, then the enforcement section,
    then the whole text (signing rules only).
    """
    def ladder(source: Column) -> Column:
        return bind(source, lambda s: F.coalesce(_date_in_segments(s), _signing_rule(s, issued)))

    return F.coalesce(ladder(enforcement_article(text)), ladder(enforcement_section(text)), _signing_rule(text, issued))


def expiry_date(text: Column, enforcement: Column | None = None) -> Column:
    """Day of expiry stated for this document in its enforcement text."""
    source = enforcement_article(text) if enforcement is None else F.coalesce(_got(enforcement), enforcement_article(text))
    return bind(source, _expiry_in)


def _expiry_in(source: Column) -> Column:
    return bind(F.regexp_replace(F.lower(source), r"\[([^\]]+)\]\([^)]+\)", "$1"), _expiry_in_low)


def _expiry_in_low(low: Column) -> Column:
    lines = F.filter(F.transform(F.split(low, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    paragraphs = F.split(F.array_join(lines, "\n"), r"(?iuU)(?:^|\n)(?=(?:\d+|điều\s+\d+)[.)]\s)")
    context = low.rlike("hiệu lực|thi hành")

    def found(lead: str) -> Column:
        def one(own: Column) -> Column:
            return F.coalesce(*[
                bind(_extract(own, f"{lead}({date})"), lambda d, i=i: parse_local_date(d if i == 1 else F.replace(d, F.lit(" "), F.lit(""))))
                for i, date in enumerate(EXPIRY_DATES)
            ])
        return one

    def one_paragraph(p: Column) -> Column:
        def dated(own: Column) -> Column:
            strict = F.coalesce(*[found(lead)(own) for lead in EXPIRY_LEADS])
            return F.coalesce(strict, F.when(context, found(EXPIRY_LEAD_IN_CONTEXT)(own)))

        # Every lead ends in the word for day, so most paragraphs need no pattern.
        own = F.get(F.split(p, rf"(?iuU)số\s+{DOC_NUMBER}"), F.lit(0))
        return F.when(F.contains(p, F.lit("ngày")) & ~p.rlike("(?iuU)" + OTHERS_EXPIRE), bind(own, dated))

    return bind(F.transform(paragraphs, one_paragraph), _first)


def doc_type_from_title(title: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    return first_match(clean, TITLE_KIND, "Unknown")


def issued_year(text: Column, as_of: Column) -> Column:
    """January 1 of the year in the first 1 200 characters (header of the document)."""
    head = F.substring(text, 1, 1200)
    years = [_extract(head, p, 1, "(?iuU)").try_cast("int") for p in ISSUED_YEAR]
    ok = [F.when(y.between(F.lit(1900), F.year(as_of) + 5), F.make_date(y, F.lit(1), F.lit(1))) for y in years]
    return F.coalesce(*ok)


def doc_metadata(title: Column, text: Column, issued: Column, as_of: Column, enforcement: Column | None = None) -> Column:
    days = F.struct(effective_date(text, issued).alias("begin"), expiry_date(text, enforcement).alias("end"))
    return bind(days, lambda d: F.struct(
        d["begin"].alias("effective_date"),
        F.when(d["begin"].isNull() | (d["end"] >= d["begin"]), d["end"]).alias("expiry_date"),
        doc_type_from_title(title).alias("doc_type"),
        F.coalesce(issued, issued_year(text, as_of)).alias("issued_date"),
    ))


def _fold_table() -> tuple[str, str]:
    """Letters with marks and their plain base letter, from the Unicode decomposition."""
    pairs = [("Đ", "D"), ("đ", "d")]
    for code in range(0xC0, 0x1F00):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def slug(title: Column) -> Column:
    marked, plain = _fold_table()
    ascii_only = F.regexp_replace(F.translate(title, marked, plain), r"[^\x00-\x7F]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(ascii_only, r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))


def folder_name(title: Column, max_len: int = 150) -> Column:
    """Readable name of a document's folder."""
    safe = F.trim(F.regexp_replace(F.regexp_replace(title, r"[/\\]", "-"), r'[<>:"|?*]', ""))
    return F.rtrim(F.substring(F.regexp_replace(safe, r"(?U)\s+", " "), 1, max_len), F.lit(" ."))
