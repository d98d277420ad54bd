"""Ordered pattern tables applied to texts.

A rule table is small and constant, so it is compiled into one array column of
the text's own row: no join, no shuffle, native regex.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuUs)"


@dataclass(frozen=True)
class FieldRule:
    """A field is covered when every group of patterns matches."""

    key: str
    label: str
    groups: tuple[str, ...]


@dataclass(frozen=True)
class FlagRule:
    """A risky wording with its explanation and the edits that repair it."""

    key: str
    clause_hint: str
    short: str
    title: str
    severity: str
    topics: tuple[str, ...]
    pattern: str
    reason: str
    impact: str
    action: str
    article_hint: str
    articles: tuple[int, ...]
    law_blurb: str
    edits: tuple[tuple[str, str], ...] = ()
    soft_pattern: str | None = None


def any_match(text: Column, rules, soft: bool = False) -> Column:
    """Keys of the rules that match, in rule order."""
    def test(r) -> Column:
        hit = text.rlike(FLAGS + r.pattern)
        return hit | text.rlike(FLAGS + r.soft_pattern) if soft and r.soft_pattern else hit

    return F.array_compact(F.array(*[F.when(test(r), F.lit(r.key)) for r in rules]))


def missing_groups(text: Column, rules) -> Column:
    """Keys of the fields for which some pattern group does not match, in rule order."""
    def covered(r) -> Column:
        out = F.lit(True)
        for g in r.groups:
            out = out & text.rlike(FLAGS.replace("s", "") + g)
        return out

    return F.array_compact(F.array(*[F.when(~covered(r), F.lit(r.key)) for r in rules]))


def values_of(keys: Column, rules, value) -> Column:
    """``value(rule)`` of every listed key, in rule order."""
    return F.array_compact(F.array(*[F.when(F.array_contains(keys, r.key), F.lit(value(r))) for r in rules]))
