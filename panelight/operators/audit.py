"""Audits: each is one pass of conditional counts, and a table of checks with what failed them.

``checks`` tables have name, passed and failures (how many rows break the rule);
``issues`` tables list the offending keys.  A table of checks passes if all its rows do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelight.operators.panel import duplicate_keys

# Columns that the deliverables must have, and decisions.
FINAL_COLUMNS = ("ticker", "company_name", "sector", "year", "observation_status", "gap_reason", "source_url", "capture_timestamp", "theme_categories", "theme_evidence", "changed_from_prior")
SCORES = ("authenticity_index", "cosine_alignment", "l1_alignment", "jaccard_theme_overlap", "sector_percentile", "sector_z_score")
KEEP, KEEP_FLAGGED, GAP = "retain_for_analysis", "retain_for_analysis_with_extraction_flags", "retain_gap_status_exclude_from_substantive_text_analysis"


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def _cell() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("ticker"), F.lit("None")), F.col("year").cast("string"))


def rules_broken(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """name, passed, failures for each rule, a condition that a row breaks: one aggregate over the table."""
    names = list(rules)
    one = df.agg(*[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(n) == 0).alias("passed"), F.col(n).alias("failures")) for n in names])))


def issues(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """name, cell (ticker:year) of every row that breaks a rule."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(broken).alias("name"), _cell().alias("cell"))


def stated_rules(years: Sequence[int] = tuple(range(2016, 2025))) -> dict[str, Column]:
    """What a row of the final dataset breaks: by name."""
    usable = F.coalesce(F.col("observation_status") == "usable", F.lit(False))
    return {
        "years_within_scope": ~F.coalesce(F.col("year").cast("int").isin(*years), F.lit(False)),
        "failures_have_reasons": ~F.coalesce(F.col("observation_status").isin("usable", "pending"), F.lit(False)) & blank("gap_reason"),
        "usable_records_traceable": usable & (blank("source_url") | blank("capture_timestamp")),
        "themes_have_evidence": ~blank("theme_categories") & blank("theme_evidence"),
        "missing_records_do_not_claim_no_change": ~usable & ~blank("changed_from_prior"),
        "discovery_queries_completed": F.col("observation_status") == "discovery_incomplete",
    }


def stated_audit(records: DataFrame, companies: int = 50, years: Sequence[int] = tuple(range(2016, 2025)), required: Sequence[str] = FINAL_COLUMNS, model_done: bool = False) -> DataFrame:
    """The eleven checks of the final dataset of stated values: name, passed, failures."""
    lacking = [c for c in required if c not in records.columns]
    full = records.select("*", *[F.lit(None).cast("string").alias(c) for c in lacking])
    counts = full.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("c"), F.count_distinct(F.struct("ticker", F.col("year").cast("string"))).alias("k"))
    expected = companies * len(years)
    whole = {"expected_record_count": F.abs(F.col("n") - expected), "unique_company_year_keys": F.col("n") - F.col("k"), "expected_company_count": F.abs(F.col("c") - companies), "required_fields_present": F.lit(len(lacking)), "llm_analysis_completed": F.lit(0 if model_done else 1)}
    made = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (c == 0).alias("passed"), c.cast("long").alias("failures")) for n, c in whole.items()])))
    return made.unionByName(rules_broken(full, stated_rules(years)))


def grid_audit(targets: DataFrame, expected: int = 450) -> DataFrame:
    """passed, row_count, unique_company_years."""
    return targets.agg(F.count("*").alias("row_count"), F.count_distinct("ticker", "year").alias("unique_company_years")).select(((F.col("row_count") == expected) & (F.col("unique_company_years") == expected)).alias("passed"), "row_count", "unique_company_years")


def dataset_audit(records: DataFrame, required: Sequence[str] = FINAL_COLUMNS, expected: int = 450) -> DataFrame:
    """passed, row_count, unique_company_years, missing_required_columns, nonusable_without_gap_reason."""
    lacking = sorted(set(required) - set(records.columns))
    full = records.select("*", *[F.lit(None).cast("string").alias(c) for c in lacking])
    bare = ~F.coalesce(F.col("observation_status") == "usable", F.lit(False)) & blank("gap_reason")
    one = full.agg(F.count("*").alias("row_count"), F.count_distinct("ticker", "year").alias("unique_company_years"), F.count_if(bare).alias("nonusable_without_gap_reason"))
    ok = (F.col("row_count") == expected) & (F.col("unique_company_years") == expected) & (F.col("nonusable_without_gap_reason") == 0) & F.lit(not lacking)
    return one.select(ok.alias("passed"), "*", F.lit(",".join(lacking)).alias("missing_required_columns"))


def manifest_audit(companies: DataFrame, total: int = 50, sectors: int = 5, each: int = 10) -> DataFrame:
    """passed, companies, tickers, sectors, and the least and the greatest number of companies of a sector."""
    by = companies.groupBy("sector").agg(F.count("*").alias("n"))
    one = companies.agg(F.count("*").alias("companies"), F.count_distinct("ticker").alias("tickers")).crossJoin(F.broadcast(by.agg(F.count("*").alias("sectors"), F.min("n").alias("least"), F.max("n").alias("greatest"))))  # one row each
    ok = (F.col("companies") == total) & (F.col("tickers") == total) & (F.col("sectors") == sectors) & (F.col("least") == each) & (F.col("greatest") == each)
    return one.select(F.coalesce(ok, F.lit(False)).alias("passed"), "*")


def registry_audit(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """ticker and side: unknown (a candidate's that is no company) or missing (a company without a candidate)."""
    known, named = companies.select("ticker").distinct(), candidates.select("ticker").distinct()
    return named.join(known, "ticker", "left_anti").withColumn("side", F.lit("unknown")).unionByName(known.join(named, "ticker", "left_anti").withColumn("side", F.lit("missing")))


def registry_counts(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count_distinct("ticker").alias("companies"), F.count("*").alias("candidates"), F.count_if(F.col("eligibility_status") == "eligible").alias("eligible_candidates"))


def phase_gates(targets: DataFrame, candidates: DataFrame, status: DataFrame, artifacts: DataFrame, changes: DataFrame, themes: DataFrame, final: DataFrame, reviews: DataFrame, documents: Sequence[str] = (), model_done: bool = False, expected: int = 450, companies: int = 50, sectors: int = 5) -> DataFrame:
    """phase, passed: the eight gates from environment to deliverables.  ``documents`` names the written ones (methodology, validation_report, summary).

    Each table is counted once; the gates are conditions on one row of counts.
    """
    one = lambda d, **c: d.agg(*[v.alias(k) for k, v in c.items()])
    by_sector = targets.groupBy("sector").agg(F.count_distinct("ticker").alias("n"))
    both = targets.select("ticker").distinct().withColumn("t", F.lit(1)).join(candidates.select("ticker").distinct().withColumn("c", F.lit(1)), "ticker", "full")
    parts = [
        one(targets, n=F.count("*"), t=F.count_distinct("ticker"), y=F.count_distinct("year")),
        one(by_sector, s=F.count("*"), lo=F.min("n"), hi=F.max("n")),
        one(candidates, cand=F.count("*")),
        one(both, odd=F.count_if(F.col("t").isNull() | F.col("c").isNull())),
        one(status, st=F.count("*"), inc=F.count_if(F.col("acquisition_status") == "discovery_incomplete"), sel=F.count_if(F.col("acquisition_status") == "selected")),
        one(artifacts, art=F.count("*")),
        one(changes, ch=F.count("*")),
        one(themes, th=F.count("*")),
        one(final, fin=F.count("*"), use=F.count_if(F.col("observation_status") == "usable")),
        one(reviews, rev=F.count("*"), don=F.count_if(F.col("review_status") == "completed")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))  # one row each
    c = F.col
    has = lambda d: F.lit(d in documents)
    each = companies // sectors
    p3 = (c("st") == expected) & (c("inc") == 0)
    p4 = (c("sel") > 0) & (c("art") == c("sel")) & (c("use") > 0) & (c("rev") == expected) & (c("fin") == expected) & (c("don") == c("rev")) & has("validation_report")
    p5 = (c("ch") == expected) & has("validation_report")
    p6 = (c("th") > 0) & F.lit(model_done)
    gates = {
        "phase_0_environment_and_contract": (c("n") == expected) & (c("t") == companies) & (c("y") == expected // companies) & (c("s") == sectors) & (c("lo") == each) & (c("hi") == each),
        "phase_1_pilot_and_rule_lock": has("methodology") & has("validation_report") & (c("cand") >= companies),
        "phase_2_candidate_registry": c("odd") == 0,
        "phase_3_cdx_and_snapshot_selection": p3,
        "phase_4_text_extraction": p4,
        "phase_5_change_detection": p5,
        "phase_6_theme_and_llm_analysis": p6,
        "phase_7_reporting_and_deliverables": (c("fin") == expected) & has("summary") & p3 & p4 & p5 & p6,
    }
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("phase"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in gates.items()])))


def review_decisions(records: DataFrame) -> DataFrame:
    """One decision for each row: usable rows stay, with their flags, gaps stay in the panel without an inference from them."""
    usable = F.coalesce(F.col("observation_status") == "usable", F.lit(False))
    decision = F.when(usable & (F.col("extraction_quality") == "review_required"), KEEP_FLAGGED).when(usable, KEEP).otherwise(GAP)
    return records.select("ticker", "year", F.lit("extraction_and_gap_adjudication").alias("review_area"), F.when(usable, F.col("extraction_quality")).otherwise(F.col("gap_reason")).alias("review_reason"), "observation_status", F.lit("completed").alias("review_status"), decision.alias("decision"), F.lit("deterministic_protocol").alias("reviewer_type"))


def success_evidence(words: int = 1000) -> Column:
    """A collected row that can be traced: source, file, digests and enough words."""
    return ~blank("cik") & ~blank("accession_number") & ~blank("sec_archive_url") & ~blank("raw_file_path") & (F.coalesce(F.col("raw_file_bytes"), F.lit(0)) > 0) & ~blank("raw_content_sha256") & ~blank("clean_text_sha256") & (F.coalesce(F.col("word_count"), F.lit(0)) >= words)


def lived_audit(results: DataFrame, years: Sequence[int] = tuple(range(2016, 2025)), expected: int = 450) -> DataFrame:
    """The audit of collected filings: one row of conditions and counts."""
    collected = F.coalesce(F.col("collection_status") == "collected", F.lit(False))
    one = results.agg(
        F.count("*").alias("target_rows"), F.count_if(collected).alias("collected_rows"), F.sort_array(F.collect_set("year")).alias("__y"),
        F.coalesce(F.every(F.when(collected, success_evidence())), F.lit(True)).alias("successful_rows_have_source_hash_and_text_metrics"),
        F.coalesce(F.some(collected & success_evidence()), F.lit(False)).alias("has_real_success_evidence"),
        F.coalesce(F.every(~blank("collection_status") & (collected | ~blank("gap_reason"))), F.lit(True)).alias("all_rows_have_status_or_gap"),
    )
    return one.select((F.col("target_rows") == expected).alias("same_50_company_grid"), F.coalesce(F.col("__y").cast("array<int>") == F.array(*map(F.lit, years)), F.lit(False)).alias("year_window"), "all_rows_have_status_or_gap", "successful_rows_have_source_hash_and_text_metrics", "has_real_success_evidence", "collected_rows", "target_rows", (F.col("target_rows") - F.col("collected_rows")).alias("manual_review_required_rows"))


def join_check(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """row_count, joinable (every observed key is expected, and there is one), covers_all (both have the same keys)."""
    a, b = expected.select(*key).distinct().withColumn("__a", F.lit(1)), observed.select(*key).distinct().withColumn("__b", F.lit(1))
    one = a.join(b, list(key), "full").agg(F.count("__b").alias("__n"), F.count_if(F.col("__a").isNull()).alias("__odd"), F.count_if(F.col("__b").isNull()).alias("__gone"))
    return one.crossJoin(F.broadcast(observed.agg(F.count("*").alias("row_count")))).select("row_count", ((F.col("__n") > 0) & (F.col("__odd") == 0)).alias("joinable"), ((F.col("__n") > 0) & (F.col("__odd") == 0) & (F.col("__gone") == 0)).alias("covers_all"))


def index_audit(index: DataFrame, required: Sequence[str], version: str, expected: int = 450) -> DataFrame:
    """The checks of the index panel: name, passed, failures."""
    lacking = [c for c in required if c not in index.columns]
    full = index.select("*", *[F.lit(None).cast("string").alias(c) for c in dict.fromkeys([*lacking, *SCORES, "part1_clean_text_sha256", "part2_clean_text_sha256", "semantic_similarity_status", "semantic_text_similarity", "taxonomy_version"]) if c not in index.columns])
    scored = F.coalesce(F.col("score_status") == "scored", F.lit(False))
    empty = lambda cs: F.greatest(*[F.col(c).isNull().cast("int") for c in cs]) == 1
    rules = {
        "scored_rows_have_scores": scored & empty(SCORES),
        "scored_rows_traceable": scored & empty(["part1_clean_text_sha256", "part2_clean_text_sha256"]),
        "scored_rows_have_semantic_status": scored & (F.col("semantic_similarity_status").isNull() | ((F.col("semantic_similarity_status") == "computed") & F.col("semantic_text_similarity").isNull())),
        "taxonomy_version_recorded": F.coalesce(F.col("taxonomy_version") != version, F.lit(False)),
    }
    counts = full.agg(F.count("*").alias("n"), F.count_distinct("ticker", "year").alias("k"), F.count_if(scored).alias("s"))
    whole = {"index_exists": (F.col("n") == 0).cast("long"), "expected_row_count": F.abs(F.col("n") - expected), "unique_company_year_keys": F.col("n") - F.col("k"), "required_columns_present": F.lit(len(lacking)).cast("long"), "has_scored_rows": (F.col("s") == 0).cast("long")}
    made = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (c == 0).alias("passed"), c.alias("failures")) for n, c in whole.items()])))
    return made.unionByName(rules_broken(full, rules))


def duplicates(df: DataFrame) -> DataFrame:
    """cell of every key that occurs more than once."""
    return duplicate_keys(df).select(_cell().alias("cell"), "n")


def run_manifest(df: DataFrame, parameters: Mapping[str, object], hashed: Sequence[str]) -> dict:
    """What a run was: versions, parameters, rows, and an order-free digest of the given columns, as a document."""
    import sys

    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*hashed).cast("decimal(38,0)")).alias("h")).first()
    return {"python": sys.version.split()[0], "spark": df.sparkSession.version, "parameters": {k: parameters[k] for k in sorted(parameters)}, "rows": row["n"], "content": str(row["h"])}
