"""State of a run: what is done, what is still to do, and where each company's year stands.

The functions take batches and streams of progress events alike where they say so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelight.sources.schemas import EVENT

# Statuses of events with data, and of those that end a year's query.
DATA_STATUSES = ("success", "cached")
COMPLETE_STATUSES = ("success", "cached", "failed")


def latest_state(events: DataFrame, key: Sequence[str], time: str = "timestamp", order: str | None = None) -> DataFrame:
    """key, status and time of the latest event of each key; of equal times the later row (``order``) counts.  For batch and stream."""
    at = F.struct(time, order) if order else F.col(time)
    return events.groupBy(*key).agg(F.count("*").alias("event_count"), F.max_by("status", at).alias("latest_status"), F.max(time).alias("latest_timestamp"))


def year_progress(events: DataFrame, stage: str = "cdx_discovery") -> DataFrame:
    """ticker, year: events, status (has_capture, zero_capture, failed_only, incomplete), most captures, and the latest event, one that ends the query before others."""
    e = events.filter((F.col("stage") == stage) & (F.coalesce("ticker", F.lit("")) != "") & F.col("year").isNotNull())
    data, done = F.col("status").isin(*DATA_STATUSES), F.col("status").isin(*COMPLETE_STATUSES)
    captures = F.coalesce(F.max(F.when(data, F.coalesce("capture_count", F.lit(0)))), F.lit(0))
    status = F.when(captures > 0, "has_capture").when(F.count_if(data) > 0, "zero_capture").when(F.count_if(F.col("status") == "failed") > 0, "failed_only").otherwise("incomplete")
    last = F.max(F.struct(F.coalesce(done, F.lit(False)).alias("d"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.col("status")))
    return e.groupBy("ticker", "year").agg(F.count("*").alias("event_count"), status.alias("status"), captures.alias("capture_count"), last.alias("l")).select("ticker", "year", "event_count", "status", "capture_count", F.col("l.status").alias("latest_status"), F.col("l.timestamp").alias("latest_timestamp"))


def company_progress(progress: DataFrame, companies: DataFrame, years: Sequence[int] = tuple(range(2016, 2025))) -> DataFrame:
    """ticker: years of each status, years completed and expected, and the latest one; companies without an event are incomplete."""
    seen = progress.filter(F.col("year").isin(*years))
    n = lambda s: F.count_if(F.col("status") == s)
    latest = F.max(F.struct("latest_timestamp", (-F.col("year")).alias("y"), "year", "latest_status"))
    made = seen.groupBy("ticker").agg(n("has_capture").alias("years_with_capture"), n("zero_capture").alias("years_zero_capture"), n("failed_only").alias("years_failed_only"), F.count("*").alias("__s"), latest.alias("__l"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = companies.select("ticker").distinct().join(made, "ticker", "left").select("ticker", *[zero(c) for c in ("years_with_capture", "years_zero_capture", "years_failed_only")], (F.lit(len(years)) - F.coalesce("__s", F.lit(0))).cast("long").alias("years_incomplete"), F.col("__l.year").alias("latest_year"), F.col("__l.latest_status").alias("latest_status"), F.col("__l.latest_timestamp").alias("latest_timestamp"))
    done = F.col("years_with_capture") + F.col("years_zero_capture") + F.col("years_failed_only")
    return rows.select("ticker", done.alias("years_completed"), F.lit(len(years)).cast("long").alias("years_expected"), *rows.columns[1:])


def progress_totals(companies: DataFrame) -> DataFrame:
    """One row of totals over ``company_progress``."""
    full = F.col("years_completed") == F.col("years_expected")
    s = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    return companies.agg(F.count_if(F.col("years_completed") > 0).alias("companies_seen"), F.count_if(full).alias("companies_completed"), F.count("*").alias("companies_expected"), s("years_completed", "company_years_completed"), s("years_expected", "company_years_expected"), s("years_with_capture", "company_years_with_capture"), s("years_zero_capture", "company_years_zero_capture"), s("years_failed_only", "company_years_failed_only"), s("years_incomplete", "company_years_incomplete"))


def stage_counts(events: DataFrame) -> DataFrame:
    """"stage:status" and its number of events, and the latest timestamp.  For batch and stream."""
    return events.groupBy(F.concat_ws(":", "stage", "status").alias("stage_status")).agg(F.count("*").alias("n"), F.max("timestamp").alias("latest"))


def to_query(wanted: DataFrame, cache: DataFrame, force: bool = False, new_fallback: bool = False, key: Sequence[str] = ("ticker", "candidate_url", "year")) -> DataFrame:
    """The keys to query: those without a successful record; with ``new_fallback`` also successful ones without a capture that never tried it, with ``force`` all."""
    if force:
        return wanted.select(*key).distinct()
    tried = F.coalesce(F.col("fallback_tried"), F.lit(False)) if "fallback_tried" in cache.columns else F.lit(False)
    good = F.coalesce(F.col("collection_status") == "success", F.lit(False))
    again = (F.coalesce(F.size("captures"), F.lit(0)) <= 0) & ~tried if new_fallback else F.lit(False)
    return wanted.select(*key).distinct().join(cache.filter(good & ~again).select(*key), list(key), "left_anti")


def refreshed(cache: DataFrame, answers: DataFrame, key: Sequence[str] = ("ticker", "candidate_url", "year")) -> DataFrame:
    """The cache after queries: an answer that failed does not replace a record that succeeded."""
    good = lambda d: d.filter(F.coalesce(F.col("collection_status") == "success", F.lit(False)))
    failed = answers.filter(~F.coalesce(F.col("collection_status") == "success", F.lit(False))).join(good(cache).select(*key), list(key), "left_anti")
    new = good(answers).unionByName(failed, allowMissingColumns=True)
    return cache.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def resumed(todo: DataFrame, audit: DataFrame, key: Sequence[str]) -> DataFrame:
    """What an earlier run's audit does not list as done."""
    return todo.join(audit.select(*key).distinct(), list(key), "left_anti")


def until_settled(step: Callable[[DataFrame], DataFrame], start: DataFrame, changed: str = "recovered", passes: int = 3) -> DataFrame:
    """Applies ``step`` until it marks no row as changed, ``passes`` times at most."""
    now = start
    for _ in range(passes):
        now = step(now)
        if now.filter(F.col(changed)).isEmpty():
            break
    return now


def with_retries(call: Callable[[], object], attempts: int = 3, wait: Callable[[int], None] | None = None, retried: tuple[type[Exception], ...] = (OSError,)) -> tuple[object, list[str]]:
    """(result, errors before it); ``wait`` is told the number of the attempt that failed.  The last failure is raised."""
    errors: list[str] = []
    for i in range(attempts):
        try:
            return call(), errors
        except retried as e:
            errors.append(f"{type(e).__name__}: {e}")
            if i + 1 == attempts:
                raise
            if wait:
                wait(i + 1)
    raise ValueError("attempts must be at least 1")


def run_stages(stages: Sequence[tuple[str, Callable[[], object]]]) -> dict[str, dict]:
    """Runs every stage; one that fails is an entry with its error and the others go on."""
    out: dict[str, dict] = {}
    for name, stage in stages:
        try:
            out[name] = {"status": "completed", "result": stage()}
        except Exception as e:  # noqa: BLE001
            out[name] = {"status": "failed", "error_type": type(e).__name__, "error": str(e).splitlines()[0][:300] if str(e) else ""}
    return out


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(folder)
