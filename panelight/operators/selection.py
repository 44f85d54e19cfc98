"""Selections of rows: tails, buckets, representatives, tops.  Every order is total: ties go by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, into: str = "rank") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(into) <= n)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tails(df: DataFrame, x: str, keys: Sequence[str] = ("ticker", "year"), n: int = 10) -> DataFrame:
    """The ``n`` highest and the ``n`` lowest rows, marked by audit_bucket."""
    some = df.filter(F.col(x).isNotNull())
    return _union([top(some, [o(x), *keys], n).withColumn("audit_bucket", F.lit(b)) for b, o in (("high_alignment", F.desc), ("low_alignment", F.asc))])


def quartile_buckets(df: DataFrame, x: str, y: str, names: tuple[str, str] = ("oai", "ss"), keys: Sequence[str] = ("ticker", "year"), n: int = 5) -> DataFrame:
    """Up to ``n`` rows of each combination of the lowest and the highest quarter of two metrics, most extreme first."""
    some = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    cut = some.crossJoin(F.broadcast(some.agg(q(x).alias("__x"), q(y).alias("__y"))))  # one row on the right
    low = {c: F.col(c) <= F.col(f"__{s}")[0] for c, s in ((x, "x"), (y, "y"))}
    high = {c: F.col(c) >= F.col(f"__{s}")[1] for c, s in ((x, "x"), (y, "y"))}
    a, b = names
    buckets = [
        (f"low_{a}_low_{b}", low[x] & low[y], [F.asc(x), F.asc(y)]),
        (f"low_{a}_high_{b}", low[x] & high[y], [F.desc(y), F.asc(x)]),
        (f"high_{a}_low_{b}", high[x] & low[y], [F.desc(x), F.asc(y)]),
        (f"high_{a}_high_{b}", high[x] & high[y], [F.desc(x), F.desc(y)]),
    ]
    return _union([top(cut.filter(c).select(*df.columns), [*o, *keys], n).withColumn("audit_bucket", F.lit(name)) for name, c, o in buckets])


def quadrant_cases(df: DataFrame, x: str, y: str, quadrant: str = "quadrant", keys: Sequence[str] = ("ticker", "year")) -> DataFrame:
    """One row for each quadrant: the strongest and the weakest of both, and the widest apart of each kind."""
    both, gap = F.col(x) + F.col(y), F.col(x) - F.col(y)
    order = F.when(F.col(quadrant) == "both_high", -both).when(F.col(quadrant) == "both_low", both).when(F.col(quadrant) == "keyword_high_only", -gap).otherwise(gap)
    return top_of_each(df.filter(F.col(quadrant).isNotNull()), [quadrant], [order, *keys], 1, "__n").drop("__n")


def split_by_intensity(summary: DataFrame, x: str = "mean_rate", threshold: float = 10.0, by: str = "theme") -> DataFrame:
    """by, intensity: high where the mean over the rows reaches the threshold, else low."""
    return summary.groupBy(by).agg(F.when(F.avg(x) >= threshold, "high").otherwise("low").alias("intensity"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with their side, repeats counted; empty if both tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
