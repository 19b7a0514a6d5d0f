"""Lineage as structs, hashes, and lists of issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("source_file", "source_sha256", "source_member", "reporting_cutoff")
#: What two operands of one calculation must agree in.
SAME = ("period", *FIELDS)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(x: Column | str) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def short_id(prefix: str, x: Column | str, length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(content_hash(x), 1, length))


def evidence(*columns: str, prefix: str = "") -> Column:
    """A struct of a row's lineage; null fields stay out of its JSON."""
    return F.struct(*[_c(prefix + c).alias(c) for c in columns])


def endpoints(end: Column, start: Column | None = None) -> Column:
    return F.struct(end.alias("end"), *([] if start is None else [start.alias("start")]))


def as_json(x: Column | str) -> Column:
    return F.to_json(_c(x), {"ignoreNullFields": "false"})


def sources_of(*items: Column) -> Column:
    """The distinct non-null structs of several evidence columns."""
    return F.array_distinct(F.filter(F.array(*items), lambda x: x.isNotNull()))


def issue_list(*conditions: tuple[Column, str], none: str = "matched") -> Column:
    """Names of the conditions that hold, joined by ";", or `none`."""
    joined = F.concat_ws(";", *[F.when(F.coalesce(c, F.lit(False)), name) for c, name in conditions])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(none))


def same_source(a: str, b: str, fields=SAME) -> Column:
    """Null-safe equality of two lineage structs in these fields."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out
