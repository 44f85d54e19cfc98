"""Statistics of panel columns: ranks, scores, terciles, quadrants, correlations, regression.

Ranks over a whole table need a global order.  They are taken as offsets of
sorted, range-partitioned values (``global_rank``), so no task holds the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelight.sources.shared import checkpoint

LABELS = ("low", "medium", "high")


def _over(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def percentile_rank(x: Column | str, by: Sequence[str]) -> Column:
    """Rank within the group, average of ties, as a share of the group."""
    w = Window.partitionBy(*by).orderBy(x)
    ties = Window.partitionBy(*by, x)
    return (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(Window.partitionBy(*by))


def sample_zscore(x: Column | str, by: Sequence[str]) -> Column:
    """Distance from the group's mean in sample standard deviations; 0 where there is no spread."""
    c = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(c).over(w)
    return F.when(sd > 0, (c - F.avg(c).over(w)) / sd).otherwise(F.when(c.isNotNull(), F.lit(0.0)))


def population_zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Adds <column>_z over the whole table, by one aggregate row; nulls stay null, no spread gives 0."""
    one = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0)))
    return df.crossJoin(F.broadcast(one)).select(*df.columns, *[z(c).alias(c + suffix) for c in columns])  # one row on the right


def mean_of_available(columns: Sequence[str]) -> Column:
    """The mean of the columns that are not null; null if none is."""
    values = F.array_compact(F.array(*[F.col(c) for c in columns]))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def composite(df: DataFrame, columns: Sequence[str], computed: Column, into: str = "composite") -> DataFrame:
    """Adds the mean of the available z-scores, estimated on ``computed`` rows only; null elsewhere."""
    inside = df.select("*", *[F.when(computed, F.col(c)).alias(f"__c_{c}") for c in columns])
    scored = population_zscores(inside, [f"__c_{c}" for c in columns])
    return scored.select(*df.columns, F.when(computed, mean_of_available([f"__c_{c}_z" for c in columns])).alias(into))


def global_rank(df: DataFrame, order: Sequence[Column | str], into: str = "rank") -> DataFrame:
    """Adds the row's number (from 1) in the order of the whole table.

    The rows are range-partitioned, numbered within partitions and written once: partitions
    made again for their counts alone have other bounds, or are merged otherwise.
    Offsets are counts of the partitions before, one small row each.
    """
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the row in it below
    placed = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__r", at))
    part = F.shiftright("__r", 33).alias("__p")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__o", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn("__p", part).join(F.broadcast(before.select("__p", "__o")), "__p")
    return numbered.select(*df.columns, (F.col("__r").bitwiseAND((1 << 33) - 1) + 1 + F.col("__o")).cast("long").alias(into))


def average_rank(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds the rank of ``column`` in the whole table, average of ties: ranks of distinct values by running counts.

    Distinct values are ranked, not rows, and their counts are combined before the shuffle.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    ranked = counts.withColumn("__to", F.sum("__n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = ranked.select(column, (F.col("__to") - (F.col("__n") - 1) / 2).alias(into))
    return df.join(at, column)


def terciles(df: DataFrame, column: str, tie_keys: Sequence[str], into: str = "tercile") -> DataFrame:
    """Adds low, medium or high by the row's place among the n values: up to (n + 1) div 3, n div 3 more, the rest.  Null stays null.

    Ties are told apart by ``tie_keys``, so groups differ by one row at most.
    """
    ranked = global_rank(df, [F.col(column).asc_nulls_last(), *tie_keys], "__at")
    n = F.broadcast(ranked.agg(F.count(column).alias("__n")))  # one row
    first = F.expr("(__n + 1) div 3")
    label = F.when(F.col("__at") <= first, LABELS[0]).when(F.col("__at") <= first + F.expr("__n div 3"), LABELS[1]).when(F.col("__at") <= F.col("__n"), LABELS[2])
    return ranked.crossJoin(n).select(*df.columns, label.alias(into))


def quadrants(df: DataFrame, x: str, y: str, into: str = "quadrant") -> DataFrame:
    """Adds both_high, keyword_high_only (x), semantic_high_only (y) or both_low by the medians of rows with both; null elsewhere."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cut = df.filter(both).agg(F.median(x).alias("__x"), F.median(y).alias("__y"))
    hx, hy = F.col(x) >= F.col("__x"), F.col(y) >= F.col("__y")
    label = F.when(hx & hy, "both_high").when(hx, "keyword_high_only").when(hy, "semantic_high_only").otherwise("both_low")
    return df.crossJoin(F.broadcast(cut)).select(*df.columns, F.when(both, label).alias(into))


def correlations(df: DataFrame, x: str, metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """comparison_metric, company_years, pearson, spearman of ``x`` with each metric, over rows that have both; null below two rows."""
    out = None
    for m in metrics:
        pair = df.select(F.col(x).cast("double").alias("__x"), F.col(m).cast("double").alias("__y")).dropna()
        ranked = average_rank(average_rank(pair, "__x", "__rx"), "__y", "__ry")
        some = lambda a, b: F.when(F.count("*") > 1, F.round(F.corr(a, b), digits))
        row = ranked.agg(F.lit(m).alias("comparison_metric"), F.count("*").alias("company_years"), some("__x", "__y").alias("pearson"), some("__rx", "__ry").alias("spearman"))
        out = row if out is None else out.unionByName(row)
    return out


def indexed_to_base(df: DataFrame, x: str, by: Sequence[str], order: str = "year", into: str = "idx") -> DataFrame:
    """Adds ``x`` with the first value of the group as 100; 0 where that is 0."""
    base = F.first_value(F.col(x)).over(Window.partitionBy(*by).orderBy(order))
    return df.select("*", F.when(base > 0, 100 * F.col(x) / base).otherwise(F.lit(0.0)).alias(into))


def min_max_scaled(df: DataFrame, x: str, into: str = "scaled") -> DataFrame:
    one = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(x) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(one)).select(*df.columns, scaled.alias(into))


def distribution(df: DataFrame, x: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """n, mean, median, std (sample), low, p10, p25, p75, p90, high of the values that are not null; one row for each group.

    ``n`` counts values and ``missing`` the rows without one; a group with no value has null statistics.
    """
    r = lambda c: F.round(c, digits)
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    made = df.groupBy(*by).agg(F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("missing"), r(F.avg(x)).alias("mean"), q.alias("__q"), r(F.stddev_samp(x)).alias("std"), r(F.min(x)).alias("low"), r(F.max(x)).alias("high"))
    return made.select(*by, "n", "missing", "mean", r(F.col("__q")[2]).alias("median"), "std", "low", r(F.col("__q")[0]).alias("p10"), r(F.col("__q")[1]).alias("p25"), r(F.col("__q")[3]).alias("p75"), r(F.col("__q")[4]).alias("p90"), "high")


def regression(df: DataFrame, y: str, numeric: Sequence[str], dummies: Sequence[str], minimum: int = 10, digits: int = 6) -> DataFrame:
    """term, coefficient, company_years, r_squared of a least-squares fit with fixed effects.

    Each dummy's least level is left out.  One aggregate gives the sums of
    products (their number depends on the terms, not on the rows); the driver
    solves them with the least norm.  Below ``minimum`` rows the result is empty.
    """
    import numpy as np

    schema = "term string, coefficient double, company_years long, r_squared double"
    data = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in dummies]).dropna()
    levels = {d: sorted(r[0] for r in data.select(d).distinct().collect())[1:] for d in dummies}
    terms = ["intercept", *numeric, *[f"{d}_{v}" for d in dummies for v in levels[d]]]
    cells = [F.lit(1.0), *[F.col(c) for c in numeric], *[(F.col(d) == v).cast("double") for d in dummies for v in levels[d]], F.col("__y")]
    sums = [F.sum(a * b) for i, a in enumerate(cells) for b in cells[i:]]
    row = data.agg(F.count("*"), *sums).first()
    if row[0] < minimum:
        return df.sparkSession.createDataFrame([], schema)
    k = len(cells)
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = row[1:]
    full = full + np.triu(full, 1).T
    xx, xy, yy, n = full[:-1, :-1], full[:-1, -1], full[-1, -1], row[0]
    scale = 1 / np.sqrt(np.maximum(np.diag(xx), 1e-300))  # columns alike in size before they are solved
    beta = scale * np.linalg.lstsq(xx * scale[:, None] * scale, xy * scale, rcond=1e-12)[0]
    total = yy - full[0, -1] ** 2 / n
    rest = yy - 2 * beta @ xy + beta @ xx @ beta
    r2 = round(float(1 - rest / total), digits) if total > 0 else None
    return df.sparkSession.createDataFrame([(t, round(float(b), digits), n, r2) for t, b in zip(terms, beta)], schema)
