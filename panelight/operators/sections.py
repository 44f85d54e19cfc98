"""Sections of long documents: headings cut them into spans, sparse ones into chunks of words.

A document's lines are an array of one row.  Span numbers are running sums over
that array, so no window and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelight.functions.text import genre_form, genre_matches, is_heading, rate, section_family, stripped, tokens, whole, word_count
from panelight.functions.vocabularies import GENRES, SECTION_FAMILIES, Theme


def parsed(docs: DataFrame, keys: Sequence[str], text_col: str = "text", families: Mapping[str, Sequence[str]] = SECTION_FAMILIES, least: int = 20, sections: int = 3, chunk: int = 1800) -> DataFrame:
    """keys, section_order, section_title, section_family, section_text.

    A section begins at a heading and ends before the next; bodies under ``least`` words are left out.
    A document with fewer than ``sections`` of them is cut into chunks of ``chunk`` words instead; one without words has no row.
    """
    base = docs.select(F.struct(*keys).alias("k"), whole(text_col).alias("t"), F.monotonically_increasing_id().alias("r"))
    lines = F.filter(F.transform(F.split("t", r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"), stripped), lambda x: x != "")
    base = base.withColumn("lines", lines)
    marked = base.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(is_heading(x, families), i)), lambda i: i.isNotNull()))
    spans = F.transform("at", lambda start, o: F.struct(o.alias("section_order"), F.element_at("lines", start + 1).alias("title"), F.array_join(F.slice("lines", start + 2, F.coalesce(F.get("at", o + 1), F.size("lines")) - start - 1), "\n").alias("body")))
    whole_spans = marked.withColumn("spans", F.filter(spans, lambda s: word_count(s["body"]) >= least))
    words = tokens("t")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / chunk).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("section_order"), F.concat(F.lit("Fallback chunk "), (i + 1).cast("string")).alias("title"), F.array_join(F.slice("w", i * chunk + 1, chunk), " ").alias("body")))
    few = F.size("spans") < sections
    cut = whole_spans.withColumn("w", F.when(few, words).otherwise(F.array().cast("array<string>")))
    cut = cut.withColumn("parts", F.when(~few, F.col("spans")).when(F.size("w") > 0, chunks).otherwise(F.slice("spans", 1, 0)))
    # outer: for a plain one the optimiser filters on the array's size, far below, and parses every text twice
    rows = cut.select("k", F.inline_outer("parts")).filter("section_order IS NOT NULL")
    guess = F.when(F.col("title").startswith("Fallback chunk "), F.concat(F.lit("chunk "), (F.col("section_order") + 1).cast("string"))).otherwise(F.col("title"))
    return rows.select("k.*", "section_order", F.left("title", F.lit(140)).alias("section_title"), section_family(guess, "body", families).alias("section_family"), F.col("body").alias("section_text"))


def diagnostics(docs: DataFrame, sections: DataFrame, keys: Sequence[str], themes: Sequence[Theme], genres: Mapping[str, Sequence[str]] = GENRES, text_col: str = "text") -> DataFrame:
    """keys, section_status and, for each section, its words, share of the document, genre rate, theme counts and dominant theme.

    A document without a section has one row that says so.
    """
    form = sections.withColumn("__f", genre_form("section_text"))
    counted = form.select(*keys, "section_order", "section_family", "section_title", word_count("section_text").alias("section_word_count"), genre_matches("__f", [p for ps in genres.values() for p in ps]).alias("section_genre_count"), F.array(*[genre_matches("__f", t.phrases) for t in themes]).alias("theme_counts"))
    rows = docs.select(*keys, word_count(text_col).alias("__n")).join(counted, list(keys), "left")
    ids = F.array(*[F.lit(t.id) for t in themes])
    pairs = F.arrays_zip((F.transform("theme_counts", lambda v: -v)).alias("c"), ids.alias("i"))
    first = F.array_min(F.filter(pairs, lambda p: p["c"] < 0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    found = F.col("section_order").isNotNull()
    share = F.when(F.col("__n") > 0, F.round(F.col("section_word_count") / F.col("__n"), 6))
    return rows.select(*keys, F.when(found, "parsed").otherwise("missing_proxy_text").alias("section_status"), "section_order", *[F.coalesce(c, F.lit("")).alias(c) for c in ("section_family", "section_title")], zero("section_word_count"), F.coalesce(share, F.lit(0.0)).alias("section_share"), zero("section_genre_count"), F.coalesce(rate(F.col("section_genre_count"), F.col("section_word_count"), 1000, 6), F.lit(0.0)).alias("section_genre_rate"), F.coalesce(first["i"], F.lit("")).alias("dominant_theme_id"), F.coalesce(-first["c"], F.lit(0).cast("long")).alias("dominant_theme_count"), F.coalesce(F.aggregate("theme_counts", F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0).cast("long")).alias("total_theme_matches"), "theme_counts")


def family_summary(rows: DataFrame, keys: Sequence[str] = ("ticker", "year")) -> DataFrame:
    """section_family: sections, documents, words, mean share, word-weighted genre rate and theme matches of parsed sections."""
    w, v = F.col("section_word_count"), F.col("section_genre_rate")
    weighted = F.when(F.sum(w) > 0, F.round(F.sum(v * w) / F.sum(w), 6)).otherwise(F.lit(0.0))
    return rows.filter("section_status = 'parsed'").groupBy("section_family").agg(F.count("*").alias("section_rows"), F.count_distinct(*keys).alias("company_years"), F.sum(w).alias("total_words"), F.round(F.avg("section_share"), 6).alias("mean_section_share"), weighted.alias("weighted_genre_rate"), F.sum("total_theme_matches").alias("total_theme_matches"))


def family_themes(rows: DataFrame, themes: Sequence[Theme], limit: int = 8) -> DataFrame:
    """section_family, theme: matches, their share of the family's and per 1,000 words, for the ``limit`` families with most matches."""
    each = rows.filter("section_status = 'parsed'").select("section_family", F.posexplode("theme_counts").alias("__i", "c"))
    sums = each.groupBy("section_family", F.element_at(F.array(*[F.lit(t.id) for t in themes]), F.col("__i") + 1).alias("theme")).agg(F.sum("c").alias("matches"))
    families = rows.filter("section_status = 'parsed'").groupBy("section_family").agg(F.sum("section_word_count").alias("__w"), F.sum("total_theme_matches").alias("__t"))
    best = families.orderBy(F.desc("__t"), "section_family").limit(limit)
    return sums.join(best, "section_family").select("section_family", "theme", "matches", F.when(F.col("__t") > 0, F.round(F.col("matches") / F.col("__t"), 6)).otherwise(F.lit(0.0)).alias("share"), rate(F.col("matches"), F.col("__w"), 1000, 6).alias("per_1000_words"))
