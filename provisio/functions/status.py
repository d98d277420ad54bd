"""Legal-effect labels, status codes and the rules that link them to dates.

The current day is always an argument (``as_of``), never read from the clock,
so a run can be repeated and a plan can be folded.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from provisio.functions.paths import lookup

# The nine canonical labels and their status codes.
UNKNOWN = "Chưa xác định"
IN_FORCE = "Còn hiệu lực"
EXPIRED = "Hết hiệu lực toàn bộ"
PARTLY_EXPIRED = "Hết hiệu lực một phần"
FUTURE = "Chưa có hiệu lực"
SUSPENDED = "Ngưng hiệu lực"
PARTLY_SUSPENDED = "Ngưng hiệu lực một phần"
UNSUITABLE = "Không còn phù hợp"
PARTLY_IN_FORCE = "Có hiệu lực một phần"

LABEL_STATUS = {
    UNKNOWN: 0,
    IN_FORCE: 1,
    EXPIRED: 2,
    SUSPENDED: 2,
    UNSUITABLE: 2,
    FUTURE: 3,
    PARTLY_EXPIRED: 4,
    PARTLY_SUSPENDED: 4,
    PARTLY_IN_FORCE: 5,
}
STATUS_LABEL = {0: UNKNOWN, 1: IN_FORCE, 2: EXPIRED, 3: FUTURE, 4: PARTLY_EXPIRED, 5: PARTLY_IN_FORCE}

# Portal codes and label spellings.
CODE_LABEL = {
    "CHL": IN_FORCE,
    "HHL": EXPIRED,
    "HHL1P": PARTLY_EXPIRED,
    "BB": EXPIRED,
    "CHUA_HL": FUTURE,
    "CHHL": FUTURE,
    "SD": PARTLY_EXPIRED,
}
ALIAS_LABEL = {
    "chưa xác định": UNKNOWN,
    "còn hiệu lực": IN_FORCE,
    "hết hiệu lực toàn bộ": EXPIRED,
    "hết hiệu lực": EXPIRED,
    "hết hiệu lực một phần": PARTLY_EXPIRED,
    "hết hiệu lực 1 phần": PARTLY_EXPIRED,
    "chưa có hiệu lực": FUTURE,
    "chưa hiệu lực": FUTURE,
    "sắp có hiệu lực": FUTURE,
    "ngưng hiệu lực": SUSPENDED,
    "ngưng hiệu lực một phần": PARTLY_SUSPENDED,
    "không còn phù hợp": UNSUITABLE,
    "có hiệu lực một phần": PARTLY_IN_FORCE,
    "bãi bỏ": EXPIRED,
}
PARTIAL_LABELS = (PARTLY_EXPIRED, PARTLY_SUSPENDED, PARTLY_IN_FORCE)
KEPT_AT_EXPIRED = (SUSPENDED, UNSUITABLE)


def as_date(as_of: Column | str | dt.date) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _filled(c: Column) -> Column:
    return F.nullif(_text(c), F.lit(""))


# -- D1, D2 -----------------------------------------------------------------

def normalize_effect_label(flag: Column, status: Column, code: Column) -> Column:
    """One of nine labels: exact, alias, code, then words contained in the text."""
    flag_t, status_t = _filled(flag), _filled(status)

    def known(t: Column) -> Column:
        return F.coalesce(F.when(t.isin(*LABEL_STATUS), t), lookup(ALIAS_LABEL, F.lower(t)))

    text = F.lower(F.coalesce(_filled(flag), _filled(status)))
    has = lambda w: F.contains(text, F.lit(w))
    worded = (
        F.when(has("không còn phù hợp"), UNSUITABLE)
        .when(has("ngưng") & has("một phần"), PARTLY_SUSPENDED)
        .when(has("ngưng"), SUSPENDED)
        .when(has("có hiệu lực một phần"), PARTLY_IN_FORCE)
        .when(has("một phần") & (has("hết") | has("sửa")), PARTLY_EXPIRED)
        .when(has("bãi") | has("hết hiệu lực"), EXPIRED)
        .when(has("chưa xác định"), UNKNOWN)
        .when(has("chưa"), FUTURE)
        .when(has("còn hiệu lực"), IN_FORCE)
    )
    return F.coalesce(
        known(flag_t), known(status_t), lookup(CODE_LABEL, F.upper(_filled(code))), worded, F.lit(UNKNOWN)
    )


def label_to_status(label: Column) -> Column:
    return F.coalesce(lookup(LABEL_STATUS, _text(label)), F.lit(0))


def status_to_label(status: Column) -> Column:
    return F.coalesce(lookup(STATUS_LABEL, status.cast("int")), F.lit(UNKNOWN))


# -- E1..E3: label / status / window ----------------------------------------

def _pair(status: Column, label: Column) -> Column:
    return F.struct(status.cast("int").alias("status_flag"), label.alias("eff_flag"))


def sync_on_insert(status: Column, label: Column) -> Column:
    """A filled label decides the status; otherwise the status decides the label."""
    s = F.coalesce(status.cast("int"), F.lit(0))
    return F.when(_filled(label).isNotNull(), _pair(label_to_status(label), label)).otherwise(
        _pair(s, status_to_label(s))
    )


def sync_on_update(old_status: Column, old_label: Column, status: Column, label: Column) -> Column:
    """Whichever of the two changed drives the other; both changed: the label."""
    label_changed = ~label.eqNullSafe(old_label)
    status_changed = ~status.eqNullSafe(old_status)
    from_label = _pair(label_to_status(label), label)
    from_status = _pair(status, status_to_label(status))
    kept = ((status == 2) & _text(old_label).isin(*KEPT_AT_EXPIRED)) | (
        (status == 4) & (_text(old_label) == PARTLY_SUSPENDED)
    )
    filled = _filled(label).isNotNull()
    return (
        F.when(label_changed, from_label)
        .when(status_changed & kept, _pair(status, label))
        .when(status_changed, from_status)
        .when(filled & ~status.eqNullSafe(label_to_status(label)), from_label)
        .when(~filled & status.isNotNull(), from_status)
        .otherwise(_pair(status, label))
    )


def is_partial(status: Column, label: Column) -> Column:
    return F.coalesce(status.isin(4, 5), F.lit(False)) | _text(label).isin(*PARTIAL_LABELS)


def short_window(status: Column, label: Column, eff_from: Column, eff_to: Column, as_of) -> Column:
    """Dates that overrule any label: not yet begun, already over."""
    day = as_date(as_of)
    over = F.when(_text(label).isin(*KEPT_AT_EXPIRED), _text(label)).otherwise(F.lit(EXPIRED))
    return (
        F.when(eff_from > day, _pair(F.lit(3), F.lit(FUTURE)))
        .when(eff_to <= day, _pair(F.lit(2), over))
        .otherwise(_pair(status, label))
    )


def status_from_window(status: Column, label: Column, eff_from: Column, eff_to: Column, as_of) -> Column:
    """Full window rule: as :func:`short_window`, and in-window rows become 1 unless partial."""
    day = as_date(as_of)
    outside = short_window(status, label, eff_from, eff_to, day)
    inside = (eff_from <= day) & (eff_to.isNull() | (eff_to > day))
    partial = (
        F.when(_filled(label).isNotNull(), _pair(label_to_status(label), label))
        .when(status.isin(4, 5), _pair(status, status_to_label(status)))
        .otherwise(_pair(status, label))
    )
    return (
        F.when((eff_from > day) | (eff_to <= day), outside)
        .when(inside & is_partial(status, label), partial)
        .when(inside, _pair(F.lit(1), F.lit(IN_FORCE)))
        .otherwise(_pair(status, label))
    )


def insert_status(status, label, eff_from, eff_to, as_of, short: bool = True) -> Column:
    """Status of a new row: window, then label sync, then (documents only) the short window."""
    first = status_from_window(status, label, eff_from, eff_to, as_of)
    second = sync_on_insert(first["status_flag"], first["eff_flag"])
    if not short:
        return second
    return short_window(second["status_flag"], second["eff_flag"], eff_from, eff_to, as_of)


# -- E9, E10 ----------------------------------------------------------------

# Wording of the citation verdict.
NOT_FOUND_LABEL = "Chưa đối chiếu kho"
OVER_LABEL = "Hết hiệu lực"
CHECKED = "Đã đối chiếu · "


def _verdict(ok: bool, verified: bool, label, detail: str) -> Column:
    return F.struct(
        F.lit(ok).alias("ok_to_cite"),
        F.lit(verified).alias("verified"),
        (F.lit(label) if isinstance(label, str) else label).alias("status_label"),
        F.lit(detail).alias("detail"),
    )


def evaluate_effect(present: Column, status: Column, eff_from: Column, eff_to: Column, as_of) -> Column:
    """May a document be cited on a day?  Struct of decision, label and reason code."""
    day = as_date(as_of)
    checked = lambda words: F.concat(F.lit(f"{CHECKED}{words} · "), day.cast("string"))
    return (
        F.when(~present, _verdict(False, False, NOT_FOUND_LABEL, "not_found"))
        .when(status == 2, _verdict(False, True, OVER_LABEL, "expired"))
        .when((status == 3) | (eff_from > day), _verdict(False, True, FUTURE, "future"))
        .when(eff_to <= day, _verdict(False, True, OVER_LABEL, "expired"))
        .when(status == 4, _verdict(True, True, checked("Còn hiệu lực (có sửa đổi)"), "partial"))
        .when(status == 5, _verdict(True, True, checked("Còn hiệu lực (một phần)"), "ok"))
        .when(status == 1, _verdict(True, True, checked("Còn hiệu lực"), "ok"))
        .otherwise(_verdict(True, True, checked("Chưa rõ trạng thái"), "unclear"))
    )


def validity_bucket(status: Column, eff_from: Column, eff_to: Column, as_of) -> Column:
    """0 usable, 50 not yet in force, 99 dead."""
    day = as_date(as_of)
    return (
        F.when((status == 2) | (eff_to <= day), F.lit(99))
        .when((status == 3) | (eff_from > day), F.lit(50))
        .otherwise(F.lit(0))
    )


def status_rank(status: Column, bucket: Column) -> Column:
    # Preference of each status in ranked results.
    ranks = {1: 1.00, 5: 0.85, 3: 0.55, 4: 0.50, 0: 0.40, 2: 0.0}
    return F.when(bucket == 99, F.lit(0.0)).otherwise(
        F.coalesce(lookup(ranks, status.cast("int")), F.lit(0.40))
    )


def ranking_year(issue_date: Column, eff_from: Column) -> Column:
    return F.coalesce(F.year(issue_date), F.year(eff_from), F.lit(0))
