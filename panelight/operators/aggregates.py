"""Summaries of theme and language indicators, coverage and gaps.

Theme rows are long (ticker, year, sector, theme, cnt, n_words), one for each
text and theme, as ``theme_counts`` gives them.  Means and shares of empty
groups are 0, as reports want them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelight.functions.text import rate
from panelight.functions.vocabularies import EVENT_WINDOWS, LEXICONS

RATE_FIELDS = tuple(f"{n}_rate_per_100_words" for n in LEXICONS) + ("average_sentence_length", "quantified_claim_count")
PER = 10_000


def mean0(c: Column | str, digits: int = 6) -> Column:
    return F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))


def median0(c: Column | str, digits: int = 6) -> Column:
    return F.coalesce(F.round(F.median(c), digits), F.lit(0.0))


def share0(condition: Column, digits: int = 6) -> Column:
    return mean0(condition.cast("double"), digits)


def with_rate(themes: DataFrame) -> DataFrame:
    return themes.withColumn("rate", rate(F.col("cnt"), F.col("n_words"), PER))


def theme_summary(themes: DataFrame, by: Sequence[str], total: bool = True) -> DataFrame:
    """by, theme: texts, presence rate, mean and median matches per 10,000 words, and their total."""
    aggs = [F.count("*").alias("company_years"), share0(F.col("cnt") > 0).alias("presence_rate"), mean0("rate").alias("mean_rate"), median0("rate").alias("median_rate")]
    return with_rate(themes).groupBy(*by, "theme").agg(*aggs, *([F.sum("cnt").alias("total_matches")] if total else []))


def linguistic_summary(metrics: DataFrame, by: Sequence[str], fields: Sequence[str] = RATE_FIELDS) -> DataFrame:
    """by: texts, mean and median words and the mean of each field."""
    return metrics.groupBy(*by).agg(F.count("*").alias("company_years"), mean0("word_count").alias("mean_word_count"), median0("word_count").alias("median_word_count"), *[mean0(f).alias(f"mean_{f}") for f in fields])


def company_trends(themes: DataFrame) -> DataFrame:
    """ticker, theme: the change of the rate from the first to the last year, where there are two years at least."""
    r = with_rate(themes).groupBy("ticker", "theme").agg(F.min("sector").alias("sector"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("rate", "year").alias("__a"), F.max_by("rate", "year").alias("__b"), F.count_distinct("year").alias("observed_years"))
    return r.filter("observed_years >= 2").select("ticker", "sector", "theme", "first_year", "last_year", F.round("__a", 6).alias("first_rate"), F.round("__b", 6).alias("last_rate"), F.round(F.col("__b") - F.col("__a"), 6).alias("change"), "observed_years")


def adjacent_shifts(themes: DataFrame, limit: int | None = 250) -> DataFrame:
    """Changes of a company's theme rate from one observed year to the next, largest first; missing years are bridged.

    Equal changes are ordered by ticker, theme and year.
    """
    w = Window.partitionBy("ticker", "theme").orderBy("year")
    r = with_rate(themes).select("ticker", "sector", "theme", "year", "rate", F.lag("year").over(w).alias("prior_year"), F.lag("rate").over(w).alias("__p")).filter("prior_year IS NOT NULL")
    out = r.select("ticker", "sector", "theme", "prior_year", "year", F.round("__p", 6).alias("prior_rate"), F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("__p"), 6).alias("change"), F.round(F.abs(F.col("rate") - F.col("__p")), 6).alias("absolute_change"))
    return out if limit is None else out.orderBy(F.desc("absolute_change"), "ticker", "theme", "year").limit(limit)


def window_of(year: Column | str, windows: Mapping[str, Sequence[int]] = EVENT_WINDOWS) -> Column:
    y = F.col(year) if isinstance(year, str) else year
    return F.coalesce(*[F.when(y.isin(*years), F.lit(name)) for name, years in windows.items()])


def event_window_summary(themes: DataFrame, theme_ids: Sequence[str], windows: Mapping[str, Sequence[int]] = EVENT_WINDOWS) -> DataFrame:
    """event_window, years, theme: texts, mean rate and presence; windows without a text have zeros."""
    spark = themes.sparkSession
    cells = spark.createDataFrame([(w, ",".join(map(str, y)), t) for w, y in windows.items() for t in theme_ids], "event_window string, years string, theme string")
    made = with_rate(themes).withColumn("event_window", window_of("year", windows)).filter("event_window IS NOT NULL").groupBy("event_window", "theme").agg(F.count("*").alias("n"), mean0("rate").alias("m"), share0(F.col("cnt") > 0).alias("p"))
    zero = F.lit(0.0)
    return cells.join(made, ["event_window", "theme"], "left").select("event_window", "years", "theme", F.coalesce("n", F.lit(0).cast("long")).alias("company_years"), F.coalesce("m", zero).alias("mean_rate"), F.coalesce("p", zero).alias("presence_rate"))


def event_window_changes(summary: DataFrame, first: str = "pre_2020", second: str = "covid_dei_governance_window", third: str = "post_2021") -> DataFrame:
    """theme: the mean rate of each window as a column, and the differences to the first."""
    wide = summary.groupBy("theme").pivot("event_window", [first, second, third]).agg(F.first("mean_rate"))
    return wide.select("theme", *[F.coalesce(c, F.lit(0.0)).alias(f"{c}_rate") for c in (first, second, third)]).select("*", F.round(F.col(f"{second}_rate") - F.col(f"{first}_rate"), 6).alias("window_minus_pre"), F.round(F.col(f"{third}_rate") - F.col(f"{first}_rate"), 6).alias("post_minus_pre"))


def leading_themes(sector_summary: DataFrame, by: str = "sector", limit: int = 4) -> DataFrame:
    """The ``limit`` themes with the highest mean rate of each group; ties by name."""
    w = Window.partitionBy(by).orderBy(F.desc("mean_rate"), "theme")
    return sector_summary.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def missing_summary(missing: DataFrame) -> DataFrame:
    """ticker: the years without an observation in order, their number, and the distinct reasons.  A company has at most one row a year."""
    key = [c for c in ("ticker", "company_name", "sector") if c in missing.columns]
    return missing.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("year")).cast("array<string>"), ",").alias("missing_years"), F.count("*").alias("missing_count"), F.array_join(F.array_sort(F.collect_set(F.coalesce("gap_reason", F.lit("")))), "; ").alias("gap_reasons"))


def coverage(records: DataFrame, status: str = "observation_status", by: Sequence[str] = ()) -> DataFrame:
    """by, status: rows, share of the group, distinct companies and years."""
    made = records.groupBy(*by, F.coalesce(status, F.lit("missing_status")).alias(status)).agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("companies"), F.count_distinct("year").alias("years"))
    return made.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))), 6))


def metric_means(scored: DataFrame, by: Sequence[str], x: str = "keyword", y: str = "semantic") -> DataFrame:
    """by: rows and means of both metrics and of their average."""
    hybrid = (F.col(x) + F.col(y)) / 2
    return scored.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("company_years"), F.round(F.avg(x), 6).alias(f"mean_{x}"), F.round(F.avg(y), 6).alias(f"mean_{y}"), F.round(F.avg(hybrid), 6).alias("mean_hybrid"))


def pressure_summary(frame: DataFrame, x: str = "pressure", y: str = "score", tercile: str = "tercile", digits: int = 6) -> DataFrame:
    """group (overall and each tercile): rows, rows with either value, means and medians: one pass by grouping sets."""
    labelled = frame.select(x, y, F.explode(F.array_compact(F.array(F.lit("overall"), F.concat(F.lit("tercile_"), F.col(tercile))))).alias("group"))
    r = lambda c: F.round(c, digits)
    return labelled.groupBy("group").agg(F.count("*").alias("company_years"), F.count(x).alias("diagnostic_company_years"), F.count(y).alias("scored_company_years"), r(F.avg(x)).alias("mean_pressure"), r(F.median(x)).alias("median_pressure"), r(F.avg(y)).alias("mean_score"), r(F.median(y)).alias("median_score"))


def counter(df: DataFrame, columns: Sequence[str], limit: int | None = 100) -> DataFrame:
    """columns, n, share: how often each value occurs, the ``limit`` most frequent; ties by value."""
    made = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("__t")))
    out = made.crossJoin(total).select(*columns, "n", F.round(F.col("n") / F.col("__t"), 6).alias("share"))  # one row on the right
    return out if limit is None else out.orderBy(F.desc("n"), *columns).limit(limit)


def flag_counts(artifacts: DataFrame, flags: str = "qa_flags") -> DataFrame:
    """flag, n, share of the artifacts that have it."""
    total = F.broadcast(artifacts.agg(F.count("*").alias("__t")))
    made = artifacts.select(F.explode(F.array_distinct(flags)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return made.crossJoin(total).select("flag", "n", F.round(F.col("n") / F.col("__t"), 6).alias("share"))  # one row on the right


def scores_by_group(topics: DataFrame, by: str, topic_ids: Sequence[str], scores: str = "scores") -> DataFrame:
    """by, topic_id: documents, mean and total of an array of topic scores."""
    each = topics.select(by, F.posexplode(scores).alias("__i", "__v"))
    name = F.element_at(F.array(*map(F.lit, topic_ids)), F.col("__i") + 1)
    return each.groupBy(by, name.alias("topic_id")).agg(F.count("*").alias("document_count"), F.round(F.avg("__v"), 8).alias("mean_topic_score"), F.round(F.sum("__v"), 8).alias("total_topic_score"))
