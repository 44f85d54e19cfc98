"""The panel of entities and years: its grid, joins that keep every key, scopes and upserts.

Keys are (ticker, year) unless an operator takes them as an argument.  Joins on
keys are plain equi-joins: adaptive execution broadcasts a side by its measured size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("ticker", "year")


def grid(entities: DataFrame, first: int = 2016, last: int = 2024) -> DataFrame:
    """Every entity in every year: one small array per row instead of a join."""
    years = F.sequence(F.lit(first), F.lit(last))
    return entities.select("*", F.explode(years).alias("year"))


def with_target(cells: DataFrame, month: int = 6, day: int = 30, hour: int = 12) -> DataFrame:
    """Adds target_timestamp, the moment of each year that a capture should be near (session time zone)."""
    return cells.withColumn("target_timestamp", F.make_timestamp("year", F.lit(month), F.lit(day), F.lit(hour), F.lit(0), F.lit(0)))


def final_panel(status: DataFrame, artifacts: DataFrame, fetches: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every row of ``status`` with its artifact and fetch, where there are any; nothing is dropped."""
    return status.join(artifacts, list(key), "left").join(fetches, list(key), "left")


def restricted(df: DataFrame, scope: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The rows whose key is in ``scope``."""
    return df.join(scope.select(*key).distinct(), list(key), "left_semi")


def with_status(df: DataFrame, statuses: Sequence[str], column: str = "observation_status") -> DataFrame:
    return df.filter(F.col(column).isin(*statuses))


def effective_scope(targets: DataFrame, selected: DataFrame, artifacts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The keys to work on: the targets, and what is selected but has no artifact yet."""
    missing = selected.select(*key).join(artifacts.select(*key), list(key), "left_anti")
    return targets.select(*key).unionByName(missing).distinct()


def within_validity(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Targets with every candidate of their ticker that is valid in their year: an equi-join with a range condition."""
    c = candidates.withColumnRenamed("ticker", "__ticker")
    return targets.join(c, (F.col("ticker") == F.col("__ticker")) & F.col("year").between(F.col("valid_from_year"), F.col("valid_to_year"))).drop("__ticker")


def paired(left: DataFrame, right: DataFrame, key: Sequence[str] = KEY, suffixes: tuple[str, str] = ("_part1", "_part2"), expected: int | None = None) -> DataFrame:
    """Inner join; columns of both sides get a suffix.  With ``expected`` any other number of rows is an error."""
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {k.lower() for k in key}
    named = lambda d, s: d.select(*[F.col(f"`{c}`").alias(c + s if c.lower() in both else c) for c in d.columns])
    out = named(left, suffixes[0]).join(named(right, suffixes[1]), list(key))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"expected {expected} joined rows, found {n}")
    return out


def with_optional(df: DataFrame, other: DataFrame | None, fill: Mapping[str, object], key: Sequence[str] = KEY) -> DataFrame:
    """Left join with a supplementary table; ``fill`` gives its columns' values where the table or a row of it is missing."""
    if other is None:
        return df.select("*", *[F.lit(v).alias(c) for c, v in fill.items()])
    out = df.join(other.select(*key, *fill), list(key), "left")
    return out.select(*df.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in fill.items()])


def prior_year(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("ticker",), year: str = "year") -> DataFrame:
    """Adds prior_year (null if absent) and prior_<column> of the row one calendar year before: gaps are not bridged."""
    prior = df.select(*key, (F.col(year) + 1).alias(year), F.col(year).alias("prior_year"), *[F.col(c).alias(f"prior_{c}") for c in columns])
    return df.join(prior, [*key, year], "left")


def prior_observed(df: DataFrame, columns: Sequence[str], key: Sequence[str], year: str = "year") -> DataFrame:
    """Adds prior_year and prior_<column> of the last year before that has a row: gaps are bridged."""
    w = Window.partitionBy(*key).orderBy(year)
    return df.select("*", F.lag(year).over(w).alias("prior_year"), *[F.lag(c).over(w).alias(f"prior_{c}") for c in columns])


def upserted(existing: DataFrame, updates: DataFrame, key: Sequence[str] = KEY, scope: DataFrame | None = None) -> DataFrame:
    """``existing`` with the rows of ``updates`` in place of those with their keys (with ``scope``: of those keys only); new keys are added."""
    new = updates if scope is None else restricted(updates, scope, key)
    kept = existing.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def replaced(existing: DataFrame, updates: DataFrame, scope: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``existing`` outside the scope, ``updates`` inside it: keys of the scope without an update go."""
    return existing.join(scope.select(*key).distinct(), list(key), "left_anti").unionByName(restricted(updates, scope, key), allowMissingColumns=True)


def last_wins(tables: Sequence[DataFrame], key: Sequence[str] = KEY, order: Sequence[Column] = ()) -> DataFrame:
    """One row of each key: of the last table that has it, there the last by ``order``."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("__source", F.lit(i)) for i, t in enumerate(tables)])
    w = Window.partitionBy(*key).orderBy(F.desc("__source"), *order)
    return every.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__source")


def looked_up(df: DataFrame, table: Mapping[str, str], column: str, into: str, otherwise: str | None = None) -> DataFrame:
    """Adds the value of a small dictionary for ``column``."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(into, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(otherwise)))


def pattern_looked_up(df: DataFrame, table: Mapping[str, str], column: str, into: str) -> DataFrame:
    """Adds the value of the first pattern of a small dictionary that is found in ``column``."""
    return df.withColumn(into, F.coalesce(*[F.when(F.col(column).rlike(p), F.lit(v)) for p, v in table.items()], F.lit(None).cast("string")))


def duplicate_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_keys(expected: DataFrame, observed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return expected.select(*key).distinct().join(observed.select(*key), list(key), "left_anti")


def key_differences(expected: DataFrame, observed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key and side (missing or unexpected); empty if both have the same keys."""
    one = missing_keys(expected, observed, key).withColumn("side", F.lit("missing"))
    return one.unionByName(missing_keys(observed, expected, key).withColumn("side", F.lit("unexpected")))
