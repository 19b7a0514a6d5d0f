"""Guarded arithmetic: a missing or non-positive denominator gives null, never an error and never infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 0.02  # absolute, of every reconciliation
MOVE_PCT, MOVE_GUARD = 10.0, 1e-10


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    """A double; null for text that is no number, and for NaN."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def is_finite(x: Column | str) -> Column:
    v = _c(x)
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def strict_violation(x: Column | str) -> Column:
    """Whether a value is there but is no finite number."""
    v = _c(x).try_cast("double")
    return _c(x).isNotNull() & (v.isNull() | ~is_finite(v))


def safe_growth(current: Column | str, previous: Column | str) -> Column:
    now, before = _c(current), _c(previous)
    return F.when(before > 0, (now / before - 1) * 100)


def growth_of_change(change: Column | str, previous: Column | str) -> Column:
    return F.when(_c(previous) > 0, _c(change) / _c(previous) * 100)


def share(part: Column | str, total: Column | str) -> Column:
    return F.when(_c(total) > 0, _c(part) / _c(total) * 100)


def within(a: Column | str, b: Column | str, tolerance: float = TOLERANCE) -> Column:
    return F.abs(_c(a) - _c(b)) <= tolerance


def scaled(x: Column | str, factor: float) -> Column:
    return _c(x) * F.lit(factor)


def large_move(pct: Column | str, limit: float = MOVE_PCT, guard: float = MOVE_GUARD) -> Column:
    """Strictly over the limit, and not by floating-point noise alone."""
    size = F.abs(_c(pct))
    return F.coalesce((size > limit) & ~(F.abs(size - limit) <= guard), F.lit(False))


def sum_or_null(x: Column | str, least: int = 1) -> Column:
    """Aggregate: the sum if at least `least` values are there."""
    return F.when(F.count(_c(x)) >= least, F.sum(_c(x)))


def parse_decimal(text: Column | str) -> Column:
    """Numbers with grouping blanks and a decimal comma; null where none is left."""
    plain = F.replace(F.regexp_replace(_c(text), r"[\s\u00a0\u202f]", ""), F.lit(","), F.lit("."))
    return plain.try_cast("decimal(20,2)")
