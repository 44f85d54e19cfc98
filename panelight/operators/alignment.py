"""Alignment of two theme vectors: shares, four scores, status, top themes and gaps.

Vectors are maps in taxonomy order held as arrays of counts, one number for
each theme, so every score is an array expression of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelight.functions.text import bundled_excerpts
from panelight.functions.vocabularies import Theme

EVIDENCE = "array<struct<theme_id: string, theme_label: string, match_count: string, evidence_excerpts: array<string>>>"

# Reasons of each status.
GAP_REASONS = {
    "missing_both": "Part 1 is not usable and Part 2 is not collected.",
    "missing_part1": "Part 1 stated-values observation is not usable.",
    "missing_part2": "Part 2 proxy disclosure is not collected.",
    "insufficient_stated_theme_signal": "Part 1 is usable but has no deterministic theme matches.",
    "insufficient_disclosure_theme_signal": "Part 2 is collected but has no deterministic theme matches.",
    "scored": "",
}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def theme_vector(evidence: Column | str, ids: Sequence[str]) -> Column:
    """Counts of ``ids``, in order, from a JSON list of evidence: repeats add up; unknown ids, bad numbers and bad JSON count nothing."""
    items = F.coalesce(F.from_json(evidence, EVIDENCE), F.array().cast(EVIDENCE))
    one = lambda t: F.aggregate(F.filter(items, lambda e: e["theme_id"] == t), F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e["match_count"].try_cast("long"), F.lit(0)))
    return F.array(*[one(t) for t in ids])


def theme_excerpts(evidence: Column | str, ids: Sequence[str]) -> Column:
    """Excerpts of ``ids``, in order: of repeats the last counts."""
    items = F.coalesce(F.from_json(evidence, EVIDENCE), F.array().cast(EVIDENCE))
    none = F.array().cast("array<string>")
    one = lambda t: F.coalesce(F.try_element_at(F.transform(F.filter(items, lambda e: e["theme_id"] == t), lambda e: F.coalesce(e["evidence_excerpts"], none)), F.lit(-1)), none)
    return F.array(*[one(t) for t in ids])


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, v: s + F.greatest(v, F.lit(0).cast("long")))


def shares(counts: Column | str) -> Column:
    """Parts of the whole; negatives count 0 and an empty vector stays 0."""
    c = F.col(counts) if isinstance(counts, str) else counts
    t = total(c)
    return F.transform(c, lambda v: F.when(t > 0, F.greatest(v, F.lit(0)) / t).otherwise(F.lit(0.0)))


def overlap(a: Column, b: Column) -> Column:
    """100 times the sum of the smaller shares."""
    return F.round(100 * _sum(F.zip_with(a, b, lambda p, q: F.least(p, q))), 6)


def cosine(a: Column, b: Column, digits: int | None = 6) -> Column:
    """100 times the cosine; 0 if a side is 0."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(_sum(F.transform(x, lambda v: v * v))) * F.sqrt(_sum(F.transform(y, lambda v: v * v)))
    c = F.when(norm > 0, 100 * _sum(F.zip_with(x, y, lambda p, q: p * q)) / norm).otherwise(F.lit(0.0))
    return c if digits is None else F.round(c, digits)


def l1(a: Column, b: Column) -> Column:
    return F.round(100 * (1 - _sum(F.zip_with(a, b, lambda p, q: F.abs(p - q))) / 2), 6)


def jaccard(a: Column, b: Column) -> Column:
    """100 times the share of themes of either side that both have; 0 without any."""
    both = F.size(F.filter(F.zip_with(a, b, lambda p, q: (p > 0) & (q > 0)), lambda v: v))
    either = F.size(F.filter(F.zip_with(a, b, lambda p, q: (p > 0) | (q > 0)), lambda v: v))
    return F.when(either > 0, F.round(100 * both / either, 6)).otherwise(F.lit(0.0))


def score_status(first: Column, second: Column, a: Column, b: Column) -> Column:
    """The first that holds of: a side is not there, a side has no match, scored.  ``first`` and ``second`` are the sides' statuses."""
    no1, no2 = F.coalesce(first != "usable", F.lit(True)), F.coalesce(second != "collected", F.lit(True))
    return F.when(no1 & no2, "missing_both").when(no1, "missing_part1").when(no2, "missing_part2").when(a <= 0, "insufficient_stated_theme_signal").when(b <= 0, "insufficient_disclosure_theme_signal").otherwise("scored")


def gap_reason(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in GAP_REASONS.items() for x in kv]), status)


def semantic_status(first: Column, second: Column, a: Column, b: Column) -> Column:
    """Whether two texts can be compared by a model; ``a`` and ``b`` are the texts."""
    no1, no2 = F.coalesce(first != "usable", F.lit(True)), F.coalesce(second != "collected", F.lit(True))
    blank = lambda t: F.coalesce(t, F.lit("")) == ""
    return F.when(no1 & no2, "source_not_available").when(no1, "missing_part1_text").when(no2, "missing_part2_text").when(blank(a) & blank(b), "missing_both_text").when(blank(a), "missing_part1_text").when(blank(b), "missing_part2_text").otherwise("computed")


def _named(themes: Sequence[Theme], counts: Column) -> Column:
    return F.arrays_zip(F.array(*[F.lit(t.id) for t in themes]).alias("theme_id"), F.array(*[F.lit(t.label) for t in themes]).alias("theme_label"), counts.alias("match_count"))


def top_themes(counts: Column, themes: Sequence[Theme], limit: int = 3) -> Column:
    """JSON of the ``limit`` themes with most matches (ties by id), without those that have none."""
    some = F.filter(_named(themes, counts), lambda e: e["match_count"] > 0)
    order = F.transform(F.array_sort(F.transform(some, lambda e: F.struct((-e["match_count"]).alias("o"), e["theme_id"].alias("theme_id"), e["theme_label"].alias("theme_label"), e["match_count"].alias("match_count")))), lambda e: F.struct(e["theme_id"].alias("theme_id"), e["theme_label"].alias("theme_label"), e["match_count"].alias("match_count")))
    return F.to_json(F.slice(order, 1, limit))


def theme_gaps(a: Column, b: Column, themes: Sequence[Theme], limit: int = 5) -> Column:
    """JSON of the ``limit`` themes whose rounded shares differ most (ties by id)."""
    z = F.arrays_zip(F.array(*[F.lit(t.id) for t in themes]).alias("theme_id"), F.array(*[F.lit(t.label) for t in themes]).alias("theme_label"), a.alias("x"), b.alias("y"))
    full = F.transform(z, lambda e: F.struct((-F.abs(F.round(e["x"] - e["y"], 6))).alias("o"), e["theme_id"].alias("theme_id"), e["theme_label"].alias("theme_label"), F.round(e["x"], 6).alias("stated_share"), F.round(e["y"], 6).alias("disclosure_share"), F.round(e["x"] - e["y"], 6).alias("stated_minus_disclosure")))
    return F.to_json(F.slice(F.transform(F.array_sort(full), lambda e: F.struct(*[e[n].alias(n) for n in ("theme_id", "theme_label", "stated_share", "disclosure_share", "stated_minus_disclosure")])), 1, limit))


def json_metric(payload: Column | str, key: str) -> Column:
    """A number of a JSON object, rounded; null if there is none or the JSON is bad."""
    return F.round(F.get_json_object(payload, f"$.{key}").try_cast("double"), 6)


def rescaled(similarity: Column | str, clip: bool = False) -> Column:
    """From -100..100 to 0..100."""
    c = ((F.col(similarity) if isinstance(similarity, str) else similarity) + 100) / 2
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)) if clip else c, 6)


def index_panel(pairs: DataFrame, themes: Sequence[Theme], stated: str = "stated", disclosure: str = "disclosure", first: str = "observation_status", second: str = "collection_status") -> DataFrame:
    """``pairs`` with status, reason, four scores, totals, top themes and gaps, sector percentile and z-score.

    ``stated`` and ``disclosure`` are arrays of counts in the order of ``themes``.  Rows that are not scored have null scores.
    """
    from panelight.operators.stats import percentile_rank, sample_zscore

    a, b = F.col(stated), F.col(disclosure)
    base = pairs.select("*", total(a).alias("stated_total"), total(b).alias("disclosure_total"), shares(a).alias("__a"), shares(b).alias("__b"))
    base = base.withColumn("score_status", score_status(F.col(first), F.col(second), F.col("stated_total"), F.col("disclosure_total"))).withColumn("score_gap_reason", gap_reason(F.col("score_status")))
    ok = F.col("score_status") == "scored"
    scored = {"authenticity_index": overlap(F.col("__a"), F.col("__b")), "cosine_alignment": cosine(F.col("__a"), F.col("__b")), "l1_alignment": l1(F.col("__a"), F.col("__b")), "jaccard_theme_overlap": jaccard(a, b)}
    out = base.select("*", *[F.when(ok, c).alias(n) for n, c in scored.items()], top_themes(a, themes).alias("stated_top_themes"), top_themes(b, themes).alias("disclosure_top_themes"), theme_gaps(F.col("__a"), F.col("__b"), themes).alias("theme_gap_summary")).drop("__a", "__b")
    # windows over scored rows only; the others form a group of their own, whose values are not used
    by = ["sector", "__scored"]
    out = out.withColumn("__scored", ok)
    return out.select("*", F.when(ok, F.round(percentile_rank("authenticity_index", by), 6)).alias("sector_percentile"), F.when(ok, F.round(sample_zscore("authenticity_index", by), 6)).alias("sector_z_score")).drop("__scored")


def theme_pairs(panel: DataFrame, themes: Sequence[Theme], stated: str = "theme_evidence_part1", disclosure: str = "theme_evidence_part2") -> DataFrame:
    """One row for each row of ``panel`` and theme: match counts, shares, excerpts of both sides, and what is missing of them."""
    ids = [t.id for t in themes]
    kept = [c for c in panel.columns if c not in (stated, disclosure)]
    base = panel.select(*kept, theme_vector(stated, ids).alias("__a"), theme_vector(disclosure, ids).alias("__b"), theme_excerpts(stated, ids).alias("__x"), theme_excerpts(disclosure, ids).alias("__y"))
    cells = F.arrays_zip(F.array(*map(F.lit, ids)).alias("theme_id"), F.col("__a").alias("a"), F.col("__b").alias("b"), F.transform(shares("__a"), lambda v: F.round(v, 6)).alias("p"), F.transform(shares("__b"), lambda v: F.round(v, 6)).alias("q"), F.col("__x").alias("x"), F.col("__y").alias("y"))
    rows = base.select(*kept, F.inline(cells))
    rows = rows.select(*kept, "theme_id", F.size("x").alias("stated_excerpt_count"), F.size("y").alias("disclosure_excerpt_count"), F.col("a").alias("stated_theme_match_count"), F.col("b").alias("disclosure_theme_match_count"), F.col("p").alias("stated_theme_share"), F.col("q").alias("disclosure_theme_share"), bundled_excerpts("x").alias("stated_theme_excerpt_text"), bundled_excerpts("y").alias("disclosure_theme_excerpt_text"), F.abs(F.col("p") - F.col("q")).alias("theme_share_gap_abs"))
    no_a, no_b = F.col("stated_theme_excerpt_text") == "", F.col("disclosure_theme_excerpt_text") == ""
    return rows.withColumn("theme_semantic_status", F.when(no_a & no_b, "missing_both_theme_evidence").when(no_a, "missing_stated_theme_evidence").when(no_b, "missing_disclosure_theme_evidence").otherwise("pending"))


def theme_pair_summary(pairs: DataFrame, similarity: str = "theme_semantic_similarity") -> DataFrame:
    """theme_id: pairs that have a similarity, its mean and median, and the mean share gap."""
    r = lambda c: F.round(c, 6)
    return pairs.filter(F.col(similarity).isNotNull()).groupBy("theme_id").agg(F.count("*").alias("computed_company_years"), r(F.avg(similarity)).alias("mean_similarity"), r(F.median(similarity)).alias("median_similarity"), r(F.avg("theme_share_gap_abs")).alias("mean_share_gap_abs"))
