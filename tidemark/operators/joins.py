"""Joins on exact keys: calendar shifts, complete grids, checked cardinality, parity.

Nothing here falls back to an earlier row: a missing key gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal

#: Literal domains are broadcast, up to this many rows.
MOST_LITERALS = 10_000


def _known(columns: list[str]) -> Column:
    """Whether none of the columns is null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _refused(df: DataFrame, wrong: Column, keys: list[str], what: str) -> DataFrame:
    """df, failing when it is read if a row is wrong. A filter, so that no pruning of columns drops it."""
    message = F.concat(F.lit(f"{what} on {', '.join(keys)}: "), F.to_json(F.struct(*keys)))
    return df.filter(F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(message).isNull()).otherwise(F.lit(True)))


def unique_guard(df: DataFrame, keys: list[str], what: str = "rows", nulls: bool = True) -> DataFrame:
    """df, failing when read if a key occurs twice; nulls: whether a null is a value like any other, or matches nothing and may repeat."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    twice = F.col("_n") > 1
    return _refused(df.withColumn("_n", n), twice if nulls else twice & _known(keys), keys, f"{what} are not unique").drop("_n")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that fails if a side that should be unique on the keys is not."""
    one, other = validate.split("_to_")
    left = unique_guard(left, keys, "left rows") if one == "one" else left
    right = unique_guard(right, keys, "right rows") if other == "one" else right
    return left.join(right, keys, how)


def star_join(base: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """base with the columns of every part, each joined one to one: a key that occurs twice on any side is an error."""
    out = unique_guard(base, keys, "base rows")
    for i, part in enumerate(parts, 1):
        out = out.join(unique_guard(part, keys, f"rows of part {i}"), keys, "left")
    return out


def calendar_join(df: DataFrame, keys: list[str], values: list[str], prefix: str, months: int = 12, period: str = "period", snap: str | None = None, keep_period: bool = False) -> DataFrame:
    """df with the values of exactly the row `months` earlier, named with the prefix. One row to one: keys and period that occur
    twice, or two earlier rows that are moved to the same period, are an error when the result is read. Rows with a null key or
    period match nothing and may repeat.

    Whole years need no join: rows of one key and one day of the year lie together, and the frame holds the row so many
    years earlier and nothing else; a row whose period, moved on, is another day is left out like any missing one. Repeated rows are
    neighbours there, so the check needs no exchange and no sort of its own; for other shifts it is made in the order that the join needs.
    """
    known = _known([*keys, period])
    if months % 12 == 0 and months > 0:
        day = F.when((F.month(period) == 2) & (F.dayofmonth(period) == 29), 28).otherwise(F.dayofmonth(period))
        place = F.month(period) * 100 + (F.lit(0) if snap == "month_end" else day)
        by_year = Window.partitionBy(*keys, place).orderBy(F.year(period))
        years, now = by_year.rangeBetween(-(months // 12), -(months // 12)), by_year.rangeBetween(0, 0)
        prior = F.first(F.struct(F.col(period).alias("_period"), *[F.col(v).alias(prefix + v) for v in values])).over(years)
        exact = known & (cal.shift_period(F.col("_prior._period"), months, snap) == F.col(period))
        if snap:  # days of a month share a frame, of which one may be another's prior
            twice = known & (F.col("_rows") > 1) & (F.col("_first") == F.col("_last")) | exact & (F.col("_earlier") > 1)
        else:  # a frame is one day, or 28 and 29 February: as many rows as days, or one occurs twice
            twice = known & ((F.col("_rows") > 2) | (F.col("_rows") == 2) & (F.col("_first") == F.col("_last")))
        found = {prefix + v: F.when(exact, F.col(f"_prior.`{prefix}{v}`")) for v in values} | ({prefix + period: F.when(exact, F.col("_prior._period"))} if keep_period else {})
        seen = {"_prior": prior, "_rows": F.count(F.lit(1)).over(now), "_first": F.min(period).over(now), "_last": F.max(period).over(now), "_earlier": F.count(F.lit(1)).over(years)}
        return _refused(df.withColumns(seen), twice, [*keys, period], "more than one row").withColumns(found).drop(*seen)
    prior = df.select(
        *keys,
        cal.shift_period(period, months, snap).alias(period),
        *[F.col(v).alias(prefix + v) for v in values],
        *([F.col(period).alias(prefix + period)] if keep_period else []),
    )
    if snap:
        prior = unique_guard(prior, [*keys, period], "earlier rows", nulls=False)
    df = unique_guard(df, [*keys, period], "rows", nulls=False)
    return df.join(prior, [*keys, period], "left")


def first_quarter_join(df: DataFrame, keys: list[str], values: list[str], prefix: str = "start_", period: str = "period") -> DataFrame:
    """Second-quarter rows with the values of the same year's first quarter end; other rows get nulls. A quarter end that
    occurs twice for a key is an error when the result is read."""
    year = Window.partitionBy(*keys, F.year(period))
    first = cal.is_quarter_end(period) & (F.month(period) == 3)
    second = cal.is_quarter_end(period) & (F.month(period) == 6)
    known = F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x) if keys else F.lit(True)
    of = {prefix + c: F.when(second & known, F.max(F.when(first, F.col(c))).over(year)) for c in (period, *values)}
    twice = F.greatest(F.count_if(first).over(year), F.count_if(second).over(year)) > 1
    return _refused(df.withColumns(of | {"_twice": known & twice}), F.col("_twice"), [*keys, period], "more than one quarter end").drop("_twice")


def literal_domain(df: DataFrame, column: str, values: list) -> DataFrame:
    """A one-column frame of literal values, to be broadcast."""
    if len(values) > MOST_LITERALS:
        raise ValueError(f"{len(values)} literals are too many for a domain")
    return df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {'long' if values and isinstance(values[0], int) else 'string'}")


def grid_join(population: DataFrame, facts: DataFrame, keys: list[str], column: str, values: list) -> DataFrame:
    """Every key with every value of the domain, and the facts where they exist. The domain is exploded, so no cross join."""
    if len(values) > MOST_LITERALS:
        raise ValueError(f"{len(values)} literals are too many for a domain")
    grid = population.select(*keys).distinct().withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(facts, [*keys, column], "left")


def parity_join(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Full outer join with presence and a null-aware verdict for each value: same, different, only_a or only_b."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    both = left.join(right, keys, "full_outer")

    def same(v):
        close = F.coalesce(F.abs(F.col(f"a_{v}").try_cast("double") - F.col(f"b_{v}").try_cast("double")) <= tolerance, F.lit(False))
        return F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) | close

    verdict = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.forall(F.array(*[same(v) for v in values]), lambda x: x), "same").otherwise("different")
    return both.withColumn("verdict", verdict).drop("_a", "_b")


def either_key_lookup(df: DataFrame, dimension: DataFrame, first: tuple[Column, str], second: tuple[Column, str], value: str) -> DataFrame:
    """df with `value` of the dimension, matched on the first key, else on the second. Keys: (expression over df, dimension column)."""
    by_first = dimension.select(F.col(first[1]).alias("_k1"), F.col(value).alias("_v1")).dropDuplicates(["_k1"])
    by_second = dimension.select(F.col(second[1]).alias("_k2"), F.col(value).alias("_v2")).dropDuplicates(["_k2"])
    keyed = df.withColumns({"_k1": first[0], "_k2": second[0]})
    out = keyed.join(by_first, "_k1", "left").join(by_second, "_k2", "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def concordance(a: DataFrame, b: DataFrame, c: DataFrame, key: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Entities of three sources on a normalised name: each with id columns a_id, b_id, c_id and status.

    a, b, c: columns id, name, with `key` made by functions.text.name_key. aliases map keys of b and c to those of a.
    """
    fixed = F.coalesce(*[F.when(F.col(key) == k, v) for k, v in (aliases or {}).items()], F.col(key))
    named = [d.select(fixed.alias(key), F.col("id").alias(f"{n}_id")) for n, d in (("a", a), ("b", b), ("c", c))]
    out = named[0].join(named[1], key, "full_outer").join(named[2], key, "full_outer")
    seen = F.concat_ws("", *[F.when(F.col(f"{n}_id").isNotNull(), n) for n in "abc"])
    times = F.count(F.lit(1)).over(Window.partitionBy(key))
    return out.withColumn("status", F.when(times > 1, "ambiguous").when(seen == "abc", "matched").otherwise(F.concat(F.lit("only_"), seen)))


def borrowed_context(grid: DataFrame, facts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Metadata of the one release of a key group, for cells that the release lacks; null where releases disagree."""
    release = facts.groupBy(*keys).agg(F.countDistinct(F.struct(*columns)).alias("_releases"), *[F.min(c).alias(f"release_{c}") for c in columns])
    one = [F.when(F.col("_releases") == 1, F.col(f"release_{c}")).alias(f"release_{c}") for c in columns]
    return grid.join(release.select(*keys, *one), keys, "left")


def orphans(facts: DataFrame, dimension: DataFrame, foreign: str, key: str) -> DataFrame:
    """Facts whose non-null foreign key is in no row of the dimension."""
    known = dimension.select(F.col(key).alias(foreign)).distinct()
    return facts.filter(F.col(foreign).isNotNull()).join(known, foreign, "left_anti")


def in_key_set(facts: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return facts.join(keys.select(column).distinct(), column, "left_semi")


def vintage_overlap(original: DataFrame, selected: DataFrame, grain: list[str], value: str, vintage: str) -> DataFrame:
    """Every observation that has rivals, against the one selected for its grain, with a five-way status."""
    rivals = original.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*grain))).filter("_n > 1").drop("_n")
    chosen = selected.select(*grain, F.col(value).alias(f"selected_{value}"), F.col(vintage).alias(f"selected_{vintage}"))
    v, s = F.col(value), F.col(f"selected_{value}")
    status = (
        F.when(v.isNotNull() & s.isNotNull() & (v - s == 0), "unchanged")
        .when(v.isNotNull() & s.isNotNull(), "revised")
        .when(v.isNotNull(), "latest_missing")
        .when(s.isNotNull(), "original_missing")
        .otherwise("both_missing")
    )
    return rivals.join(chosen, grain).withColumns(
        {"is_selected": F.col(vintage) == F.col(f"selected_{vintage}"), "difference": v - s, "comparison_status": status}
    )


def two_vintages(a: DataFrame, b: DataFrame, grain: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows in both, with their difference and whether they changed (a value that appears or goes is a change)."""
    both = a.select(*grain, F.col(value).alias("older")).join(b.select(*grain, F.col(value).alias("newer")), grain)
    gone = F.col("older").isNull() != F.col("newer").isNull()
    changed = gone | F.coalesce(F.abs(F.col("newer") - F.col("older")) > tolerance, F.lit(False))
    return both.withColumns({"difference": F.col("newer") - F.col("older"), "changed": changed})


def lineage_agreement(facts: DataFrame, lineage: DataFrame, keys: list[str], value: str, tolerance: float = 0.02) -> DataFrame:
    """Facts with `agrees`: whether the lineage has the row, with an equal value."""
    other = lineage.select(*keys, F.col(value).alias(f"lineage_{value}"))
    close = F.abs(F.col(value) - F.col(f"lineage_{value}")) <= tolerance
    return facts.join(other, keys, "left").withColumn("agrees", F.coalesce(close, F.lit(False)))


def outer_labelled(a: DataFrame, b: DataFrame, key: str, label: str, names: dict[str, str]) -> DataFrame:
    """Full outer join on a code; a label that is missing is filled from the code's fixed name."""
    filled = F.coalesce(F.col(label), *[F.when(F.col(key) == k, v) for k, v in names.items()])
    return a.join(b, key, "full_outer").withColumn(label, filled)
