"""Annotation tasks for a text model: which rows are asked, with what prompt, and how answers come back.

No model is part of this engine.  ``answered`` takes any table of responses by prompt digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelight.functions.text import annotation_quality, prompt, sha256, signal_excerpt, without_thoughts
from panelight.operators.panel import prior_year

#: Templates: %s for company, ticker, year and excerpt; and for company, ticker, both years and both excerpts.
SNAPSHOT = "Read this excerpt of a company's page about itself. Answer in three lines that begin with Themes:, Tone: and Analyst note:.\n\nCompany: %s (%s)\nYear: %s\nExcerpt: %s"
CHANGE = "Compare two yearly versions of a company's page about itself. Answer in three lines that begin with Changed:, Main shift: and Linguistic shift:.\n\nCompany: %s (%s)\nPrior year %s: %s\nCurrent year %s: %s"


def _limited(rows: DataFrame, wanted: Column, order: Sequence[str], limit: int | None) -> DataFrame:
    """Marks the rows that are asked: all wanted ones, or the first ``limit`` of them."""
    if limit is None:
        return rows.withColumn("__ask", wanted)
    first = rows.filter(wanted).orderBy(*order).limit(limit).select(*order, F.lit(True).alias("__ask"))
    return rows.join(F.broadcast(first), list(order), "left").withColumn("__ask", F.coalesce("__ask", F.lit(False)))


def snapshot_tasks(rows: DataFrame, limit: int | None = None, version: str = "v1", template: str = SNAPSHOT) -> DataFrame:
    """One row for each company's year: status (pending, skipped_nonusable), excerpt and prompt with its digest.

    ``rows`` has ticker, company_name, year, observation_status and page_text_clean; text goes to Python for usable rows only.
    """
    usable = F.coalesce(F.col("observation_status") == "usable", F.lit(False))
    made = _limited(rows, usable, ("ticker", "year"), limit)
    made = made.withColumn("input_excerpt", signal_excerpt(F.when(usable, F.col("page_text_clean"))))
    text = F.when(F.col("__ask"), prompt(template, "company_name", "ticker", F.col("year").cast("string"), "input_excerpt"))
    return made.select(*[c for c in rows.columns if c != "page_text_clean"], F.when(F.col("__ask"), "pending").otherwise("skipped_nonusable").alias("analysis_status"), F.lit(version).alias("prompt_version"), "input_excerpt", text.alias("prompt")).withColumn("prompt_sha256", F.when(F.col("prompt").isNotNull(), sha256("prompt")).otherwise(""))


def change_tasks(rows: DataFrame, limit: int | None = None, version: str = "v1", template: str = CHANGE) -> DataFrame:
    """The same for pairs of neighbouring calendar years: pending, skipped_no_prior or skipped_nonusable_pair."""
    usable = F.coalesce(F.col("observation_status") == "usable", F.lit(False))
    base = rows.select("ticker", "company_name", "year", "observation_status", signal_excerpt(F.when(usable, F.col("page_text_clean"))).alias("excerpt"))
    both = prior_year(base, ["observation_status", "excerpt"])
    wanted = F.coalesce((F.col("observation_status") == "usable") & (F.col("prior_observation_status") == "usable"), F.lit(False))
    made = _limited(both, wanted, ("ticker", "year"), limit)
    status = F.when(F.col("__ask"), "pending").when(F.col("prior_year").isNull(), "skipped_no_prior").otherwise("skipped_nonusable_pair")
    text = F.when(F.col("__ask"), prompt(template, "company_name", "ticker", F.col("prior_year").cast("string"), "prior_excerpt", F.col("year").cast("string"), "excerpt"))
    return made.select("ticker", "company_name", "year", "prior_year", status.alias("analysis_status"), F.lit(version).alias("prompt_version"), F.coalesce("prior_excerpt", F.lit("")).alias("prior_excerpt"), F.col("excerpt").alias("current_excerpt"), text.alias("prompt")).withColumn("prompt_sha256", F.when(F.col("prompt").isNotNull(), sha256("prompt")).otherwise(""))


def largest(documents: DataFrame, n: int = 8, words: str = "word_count", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``n`` documents with most words; ties by key."""
    return documents.orderBy(F.desc(words), *keys).limit(n)


def answered(tasks: DataFrame, responses: DataFrame, model: str) -> DataFrame:
    """``tasks`` with their responses (prompt_sha256, response): pending rows with one are completed, its quality is flagged."""
    one = responses.groupBy("prompt_sha256").agg(F.min("response").alias("__r"))
    joined = tasks.join(one, "prompt_sha256", "left")
    done = (F.col("analysis_status") == "pending") & F.col("__r").isNotNull()
    answer = F.when(done, without_thoughts("__r")).otherwise("")
    return joined.select(*[c for c in tasks.columns if c != "analysis_status"], F.when(done, "completed").otherwise(F.col("analysis_status")).alias("analysis_status"), F.when(done, model).otherwise("").alias("model_name"), answer.alias("llm_response"), F.when(done, sha256(answer)).otherwise("").alias("response_sha256"), F.when(done, annotation_quality(answer)).otherwise("not_applicable").alias("annotation_quality_flag"))


def resumable(tasks: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pending tasks whose prompt no earlier run has answered."""
    done = earlier.filter("analysis_status = 'completed'").select("prompt_sha256").distinct()
    return tasks.filter("analysis_status = 'pending'").join(done, "prompt_sha256", "left_anti")


def latest_of_each(annotations: DataFrame, key: Sequence[str] = ("ticker", "year"), order: str = "prompt_version") -> DataFrame:
    """One annotation of each key: of the last version."""
    w = Window.partitionBy(*key).orderBy(F.desc(order), "prompt_sha256")
    return annotations.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
