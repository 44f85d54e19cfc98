"""Change of a text from one year to the next: similarity, class, evidence.

Only pairs that need it go to Python: texts whose normal forms are equal are
told by digest, before any text is moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.functions.text import comparison_form, sentences, tokens, whole

# The classes.
CLASSES = ("no_prior", "indeterminate", "unchanged_exact", "minor_edit", "substantive_change")


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    """Common share of the distinct tokens of both normal forms; 1 if neither has any."""
    x, y = (F.array_distinct(tokens(comparison_form(c))) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(1.0))


_EDITS = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("added", T.ArrayType(T.StringType())), T.StructField("removed", T.ArrayType(T.StringType()))])


def edits(a: Column, b: Column, sa: Column, sb: Column, snippets: int = 3) -> Column:
    """ratio (matching blocks of characters of the two forms), and the first added and removed sentences.

    The ratio is Ratcliff and Obershelp's, of the standard library, whose time grows with the product of the lengths.
    """

    @F.pandas_udf(_EDITS)
    def compare(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def form(s):
            return " ".join(s.casefold().split())

        def one(x, y, xs, ys):
            added, removed = [], []
            for kind, i, j, k, m in SequenceMatcher(None, [form(s) for s in xs], [form(s) for s in ys], autojunk=False).get_opcodes():
                if kind != "equal":
                    removed += xs[i:j]
                    added += ys[k:m]
            return SequenceMatcher(None, form(x), form(y), autojunk=False).ratio(), added[:snippets], removed[:snippets]

        for xs, ys, ss, ts in batches:
            yield pd.DataFrame([one(x, y, list(s), list(t)) for x, y, s, t in zip(xs, ys, ss, ts)], columns=_EDITS.names)

    return compare(a, b, sa, sb)


def compared(pairs: DataFrame, prior: str, current: str, threshold: float = 0.9, snippets: int = 3) -> DataFrame:
    """``pairs`` (both texts not blank) with change_class, changed_from_prior, exact_match, token_jaccard_similarity,
    edit_similarity, word_count_delta_ratio, change_score, added_snippets and removed_snippets."""
    a, b = F.col(f"`{prior}`"), F.col(f"`{current}`")
    exact = comparison_form(a) == comparison_form(b)
    # equal forms need no comparison: they reach Python as empty texts
    x, y = (F.when(exact, F.lit("")).otherwise(whole(c)) for c in (a, b))
    none = F.array().cast("array<string>")
    made = pairs.select("*", exact.alias("exact_match"), token_jaccard(a, b).alias("token_jaccard_similarity"), F.size(tokens(comparison_form(a))).alias("__n"), F.size(tokens(comparison_form(b))).alias("__m"), edits(x, y, F.when(exact, none).otherwise(sentences(a)), F.when(exact, none).otherwise(sentences(b)), snippets).alias("__e"))
    low = F.least("token_jaccard_similarity", F.col("__e.ratio"))
    cls = F.when(F.col("exact_match"), "unchanged_exact").when(low >= threshold, "minor_edit").otherwise("substantive_change")
    delta = F.when(F.col("__n") > 0, (F.col("__m") - F.col("__n")) / F.col("__n")).otherwise(F.lit(0.0))
    return made.select(*pairs.columns, cls.alias("change_class"), (~F.col("exact_match")).alias("changed_from_prior"), "exact_match", "token_jaccard_similarity", F.col("__e.ratio").alias("edit_similarity"), delta.alias("word_count_delta_ratio"), F.round(1 - low, 6).alias("change_score"), F.col("__e.added").alias("added_snippets"), F.col("__e.removed").alias("removed_snippets"))


def changes(texts: DataFrame, key: Sequence[str] = ("ticker",), year: str = "year", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """key, year, prior_year and the comparison with the calendar year before.

    A year without the one before is ``no_prior``; one of two with a blank text on either side is
    ``indeterminate``; neither claims a change.  Texts meet by a shuffle on key and year, one neighbour each.
    """
    rows = texts.select(*key, F.col(year).alias("year"), whole(text).alias("__b"))
    prior = rows.select(*key, (F.col("year") + 1).alias("year"), F.lit(True).alias("__has"), F.col("__b").alias("__a"))
    both = rows.join(prior, [*key, "year"], "left").withColumn("prior_year", F.when(F.col("__has"), F.col("year") - 1))
    sides = (F.coalesce("__a", F.lit("")) != "") & (F.col("__b") != "")
    done = compared(both.filter(F.col("__has") & sides).select(*key, "year", "prior_year", "__a", "__b"), "__a", "__b", threshold).drop("__a", "__b")
    cls = F.when(F.col("__has").isNull(), "no_prior").otherwise("indeterminate")
    rest = both.filter(F.col("__has").isNull() | ~sides).select(*key, "year", "prior_year", cls.alias("change_class"))
    return done.unionByName(rest, allowMissingColumns=True)


def change_classes(texts: DataFrame, key: Sequence[str] = ("ticker",), year: str = "year", text: str = "text") -> DataFrame:
    """key, year, prior_year, change_class (``changed`` for minor and substantive alike): told by digests, without moving a text."""
    from panelight.functions.text import sha256

    rows = texts.select(*key, F.col(year).alias("year"), F.when(whole(text) != "", sha256(comparison_form(text))).alias("__d"))
    prior = rows.select(*key, (F.col("year") + 1).alias("year"), F.lit(True).alias("__has"), F.col("__d").alias("__p"))
    both = rows.join(prior, [*key, "year"], "left")
    cls = F.when(F.col("__has").isNull(), "no_prior").when(F.col("__d").isNull() | F.col("__p").isNull(), "indeterminate").when(F.col("__d") == F.col("__p"), "unchanged_exact").otherwise("changed")
    return both.select(*key, "year", F.when(F.col("__has"), F.col("year") - 1).alias("prior_year"), cls.alias("change_class"))
