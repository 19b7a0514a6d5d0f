"""Calendar expressions: slots, exact shifts, period ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slot(period: Column | str, frequency: Column | str) -> Column:
    """Ordinal of a month (monthly) or quarter (anything else): neighbours differ by one, also over the year's end."""
    p = _c(period)
    return F.when(_c(frequency) == "monthly", F.year(p) * 12 + F.month(p)).otherwise(F.year(p) * 4 + F.quarter(p))


def month_end(period: Column | str) -> Column:
    return F.last_day(_c(period))


def quarter_end(period: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(_c(period), "quarter"), 2))


def month_start(period: Column | str) -> Column:
    return F.trunc(_c(period), "month")


def year_start(period: Column | str) -> Column:
    return F.trunc(_c(period), "year")


def shift_period(period: Column | str, months: int, snap: str | None = None) -> Column:
    """The period `months` later; snap="month_end" keeps month ends month ends."""
    moved = F.add_months(_c(period), months)
    return F.last_day(moved) if snap == "month_end" else moved


def next_quarter_end(period: Column | str) -> Column:
    """The quarter end after a quarter end, or the end of the quarter that any other day lies in."""
    p = _c(period)
    return F.when(p == quarter_end(p), F.last_day(F.add_months(p, 3))).otherwise(quarter_end(p))


def is_month_end(period: Column | str) -> Column:
    return F.coalesce(_c(period) == month_end(period), F.lit(False))


def is_quarter_end(period: Column | str) -> Column:
    return F.coalesce(_c(period) == quarter_end(period), F.lit(False))


def is_month_start(period: Column | str) -> Column:
    return F.coalesce(_c(period) == month_start(period), F.lit(False))


def window_label(period: Column | str, half: str = "H1") -> Column:
    """Q1 at the first quarter's end, `half` at the second's, else unsupported."""
    p = _c(period)
    return F.when(is_quarter_end(p) & (F.month(p) == 3), "Q1").when(is_quarter_end(p) & (F.month(p) == 6), half).otherwise("unsupported")


def parse_date(text: Column | str, pattern: str = "dd.MM.yyyy", expression: str = r"(\d{2}\.\d{2}\.\d{4})") -> Column:
    """The first date of this shape in a text, null where there is none or it is no day of the calendar."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(_c(text), expression, 1), F.lit("")), F.lit(pattern)).cast("date")


def cutoff_period(cutoff: Column | str) -> Column:
    """The last day that a report as of this date covers."""
    return F.date_sub(_c(cutoff), 1)


def calendar(start: Column | str, end: Column | str, frequency: str = "monthly") -> Column:
    """All month ends (or quarter ends) from start to end as an array."""
    step = F.expr("interval 1 month" if frequency == "monthly" else "interval 3 month")
    first = month_start(start) if frequency == "monthly" else F.trunc(_c(start), "quarter")
    ends = F.transform(F.sequence(first, _c(end), step), lambda d: F.last_day(d) if frequency == "monthly" else F.last_day(F.add_months(d, 2)))
    return F.filter(ends, lambda d: d <= _c(end))
