"""Evaluate a costly expression once and use its value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let v = value in body(v)``: the projections below are merged by the
    optimizer, which would otherwise repeat ``value`` at every use."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column | str) -> Column:
    """White space of every kind removed at both ends (``trim`` knows blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
