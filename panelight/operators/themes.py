"""Theme and genre counts of texts: one scan, counts before rows are multiplied."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelight.functions.text import classify_themes, genre_form, genre_matches, linguistic_metrics, phrase_matches, rate, sentences, whole, word_count
from panelight.functions.vocabularies import LEXICONS, Theme


def _theme_count(words: Column, text: Column, phrases: Sequence[str]) -> Column:
    """Matches of all phrases: single words among the split words, others by their pattern."""
    single = [p for p in phrases if re.fullmatch(r"\w+", p)]
    parts = [F.size(F.filter(words, lambda w: w.isin(*single))).cast("long")] if single else []
    return reduce(add, parts + [phrase_matches(text, p) for p in phrases if p not in single])


def theme_counts(docs: DataFrame, keys: Sequence[str], themes: Sequence[Theme], text_col: str = "text") -> DataFrame:
    """keys, n_words, theme, cnt: one row for each text and theme, zeros included.

    The text is split once; only the counts go through the explode.
    """
    base = docs.select(*keys, whole(text_col).alias("__t"))
    base = base.select(*keys, "__t", F.split(F.lower("__t"), r"[^\p{L}\p{N}_]+").alias("__w"))
    counts = [_theme_count(F.col("__w"), F.col("__t"), t.phrases).alias(f"__c{i}") for i, t in enumerate(themes)]
    narrow = base.select(*keys, word_count("__t").alias("n_words"), *counts)
    pairs = F.array(*[F.struct(F.lit(t.id).alias("theme"), F.col(f"__c{i}").alias("cnt")) for i, t in enumerate(themes)])
    return narrow.select(*keys, "n_words", F.inline(pairs))


def theme_evidence(docs: DataFrame, keys: Sequence[str], themes: Sequence[Theme], text_col: str = "text", excerpt_chars: int | None = None, max_excerpts: int | None = None) -> DataFrame:
    """keys, theme_evidence: what ``classify_themes`` finds in each text; sentences are split once."""
    base = docs.select(*keys, whole(text_col).alias("__t")).select("*", sentences("__t").alias("__s"))
    return base.select(*keys, classify_themes("__t", themes, F.col("__s"), excerpt_chars, max_excerpts).alias("theme_evidence"))


def theme_observations(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and one row for each theme found: the long form of ``theme_evidence``."""
    # outer, as the optimiser else finds the evidence twice: once to filter on the array's size
    return evidence.select(*keys, F.inline_outer("theme_evidence")).filter("theme_id IS NOT NULL")


def genre_rates(docs: DataFrame, keys: Sequence[str], genres: Mapping[str, Sequence[str]], text_col: str = "text") -> DataFrame:
    """keys, n_words, and <genre>_count and <genre>_rate (per 1,000 words) of each genre."""
    base = docs.select(*keys, word_count(text_col).alias("n_words"), genre_form(text_col).alias("__f"))
    base = base.select(*keys, "n_words", *[genre_matches("__f", p).alias(f"{g}_count") for g, p in genres.items()])
    return base.select("*", *[rate(F.col(f"{g}_count"), F.col("n_words"), 1000, 6).alias(f"{g}_rate") for g in genres])


def linguistics(docs: DataFrame, keys: Sequence[str], lexicons: Mapping[str, Sequence[str]] = LEXICONS, text_col: str = "text") -> DataFrame:
    """keys and the linguistic metrics of each text as columns."""
    return docs.select(*keys, linguistic_metrics(text_col, lexicons).alias("__m")).select(*keys, "__m.*")
