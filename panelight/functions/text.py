"""Text functions: columns in, columns out, all of them JVM expressions.

Word characters are Unicode letters, digits and the underscore; white space is
Unicode white space.  A null text is an empty text.  ``lower`` stands for case
folding: a sharp s stays one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelight.functions.binding import let
from panelight.functions.vocabularies import LEXICONS, SECTION_FAMILIES, TAXONOMY_VERSION, Theme

WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD_CHAR}(?:[\p{{L}}\p{{N}}_'-]*{WORD_CHAR})?"
SENTENCE_END = r"(?<=[.!?])(?U:\s+)|\n+"
QUANTITY = r"(?U)\b(?:\d+(?:[.,]\d+)*|percent|percentage)\b|%"


def whole(text: Column | str) -> Column:
    """The text; "" for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column | str) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(whole(text), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(TOKEN)).cast("long")


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty parts between sentence ends and line breaks."""
    parts = F.transform(F.split(stripped(whole(text)), SENTENCE_END), stripped)
    return F.filter(parts, lambda s: s != "")


def quantified_claims(text: Column | str, fold: bool = True) -> Column:
    """Numbers, "percent", "percentage" and "%"; "25%" counts twice.  Without ``fold`` capitals don't match."""
    t = whole(text)
    return F.regexp_count(F.lower(t) if fold else t, F.lit(QUANTITY)).cast("long")


def phrase_regex(phrase: str) -> str:
    """The phrase with any white space between its words and no word character beside it, in either case."""
    inner = r"(?U:\s+)".join(re.escape(p) for p in phrase.split(" "))
    return rf"(?iu)(?<!{WORD_CHAR}){inner}(?!{WORD_CHAR})"


def phrase_matches(text: Column | str, phrase: str) -> Column:
    return F.regexp_count(whole(text), F.lit(phrase_regex(phrase))).cast("long")


def _with(phrase: str):
    return lambda s: s.rlike(phrase_regex(phrase))


def _among(words: Sequence[str]):
    return lambda w: w.isin(*words)


def classify_themes(text: Column | str, themes: Sequence[Theme], sentence_list: Column | None = None, excerpt_chars: int | None = None, max_excerpts: int | None = None, version: str = TAXONOMY_VERSION) -> Column:
    """Evidence of every theme that matches: array of (theme_id, theme_label, taxonomy_version, matched_phrases, evidence_excerpts, match_count).

    Excerpts are the distinct sentences with a match, by phrase and then by place; they may be cut
    to ``excerpt_chars`` and to the first ``max_excerpts`` of a theme.  ``sentence_list`` may name a column that has the sentences.
    """
    parts = sentences(text) if sentence_list is None else sentence_list
    found = []
    for theme in themes:
        counts = [phrase_matches(text, p) for p in theme.phrases]
        matched = F.array_compact(F.array(*[F.when(c > 0, F.lit(p)) for p, c in zip(theme.phrases, counts)]))
        excerpts = F.flatten(F.array(*[F.filter(parts, _with(p)) for p in theme.phrases]))
        if excerpt_chars is not None:
            excerpts = F.transform(excerpts, lambda s: F.left(s, F.lit(excerpt_chars)))
        excerpts = F.array_distinct(excerpts)
        if max_excerpts is not None:
            excerpts = F.slice(excerpts, 1, max_excerpts)
        total = reduce(add, counts)
        item = F.struct(F.lit(theme.id).alias("theme_id"), F.lit(theme.label).alias("theme_label"), F.lit(version).alias("taxonomy_version"), matched.alias("matched_phrases"), excerpts.alias("evidence_excerpts"), total.alias("match_count"))
        found.append(F.when(total > 0, item))
    return F.array_compact(F.array(*found))


def linguistic_metrics(text: Column | str, lexicons: Mapping[str, Sequence[str]] = LEXICONS, digits: int = 4, fold: bool = True) -> Column:
    """word_count, sentence_count, average_sentence_length, quantified_claim_count, and count and rate per 100 words of each lexicon."""
    def metrics(x: Column) -> Column:
        n, s, zero = F.size(x["w"]).cast("long"), x["s"], F.lit(0.0)
        out = [n.alias("word_count"), s.alias("sentence_count"), F.when(s > 0, F.round(n / s, digits)).otherwise(zero).alias("average_sentence_length"), x["q"].alias("quantified_claim_count")]
        for name, lexicon in lexicons.items():
            c = F.size(F.filter(x["w"], _among(lexicon))).cast("long")
            out += [c.alias(f"{name}_count"), F.when(n > 0, F.round(100 * c / n, 4)).otherwise(zero).alias(f"{name}_rate_per_100_words")]
        return F.struct(*out)

    return let(F.struct(F.transform(tokens(text), lambda w: F.lower(w)).alias("w"), F.size(sentences(text)).cast("long").alias("s"), quantified_claims(text, fold).alias("q")), metrics)


def rate(count: Column, words: Column, per: int, digits: int | None = None) -> Column:
    """Matches per ``per`` words; 0 where there are no words or the count is missing."""
    r = F.when(words > 0, per * F.coalesce(count, F.lit(0)).cast("double") / words).otherwise(F.lit(0.0))
    return r if digits is None else F.round(r, digits)


def genre_form(text: Column | str) -> Column:
    """Lower case with squeezed white space: what genre and section phrases are looked up in."""
    return squeezed(F.lower(whole(text)))


def genre_matches(form: Column | str, phrases: Sequence[str]) -> Column:
    """Matches of all phrases in a ``genre_form``, each counted by itself, with no ASCII letter or digit beside it."""
    c = F.col(form) if isinstance(form, str) else form
    low = [p.lower() for p in phrases]
    single = [p for p in low if re.fullmatch("[a-z0-9]+", p)]
    # single words are parts between the boundaries: one split counts them all
    parts = [F.size(F.filter(F.split(c, "[^a-z0-9]+"), _among(single)))] if single else []
    return reduce(add, parts + [F.regexp_count(c, F.lit(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])")) for p in low if p not in single]).cast("long")


def front_window(text: Column | str, chars: int = 9000) -> Column:
    """The squeezed text's first ``chars`` characters: a window of fixed size for a model."""
    return F.left(squeezed(text), F.lit(chars))


def bundled_excerpts(excerpts: Column | str, limit: int = 8, chars: int = 4500) -> Column:
    """The first ``limit`` excerpts, squeezed, joined by blanks and cut to ``chars``."""
    items = F.transform(F.slice(F.coalesce(F.col(excerpts) if isinstance(excerpts, str) else excerpts, F.array().cast("array<string>")), 1, limit), squeezed)
    return F.left(F.array_join(F.filter(items, lambda s: s != ""), " "), F.lit(chars))


def without_thoughts(text: Column | str) -> Column:
    """<think> blocks of model output taken out."""
    return stripped(F.regexp_replace(whole(text), r"(?is)<think>.*?</think>", ""))


def comparison_form(text: Column | str) -> Column:
    """Lower case and squeezed: texts that differ in layout or case only are equal."""
    return squeezed(F.lower(whole(text)))


def sha256(value: Column | str) -> Column:
    return F.sha2(whole(value).cast("binary"), 256)


def prompt(template: str, *columns: Column | str) -> Column:
    """A prompt: ``template`` with %s for each column."""
    return F.format_string(template, *[whole(c) for c in columns])


def extraction_quality(text: Column | str, minimum_words: int = 1000) -> Column:
    """empty, insufficient_text, possibly_index_only or usable, in this order."""
    n = word_count(text)
    index = F.upper(F.left(whole(text), F.lit(5000))).contains("TABLE OF CONTENTS")
    return F.when(n == 0, "empty").when(n < minimum_words, "insufficient_text").when(index & (n < 2500), "possibly_index_only").otherwise("usable")


def clean_lines(text: Column | str) -> Column:
    """Blanks squeezed within lines, lines trimmed, empty lines gone."""
    t = F.regexp_replace(F.regexp_replace(whole(text), "\u00a0", " "), r"[ \t\r\f\x0B]+", " ")
    lines = F.transform(F.split(t, "\n"), stripped)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def normal_ticker(ticker: Column | str) -> Column:
    return F.replace(F.upper(F.col(ticker) if isinstance(ticker, str) else ticker), F.lit("."), F.lit("-"))


def filing_url(cik: Column, accession: Column, document: Column, base: str = "https://www.sec.gov/Archives/edgar/data") -> Column:
    return F.concat_ws("/", F.lit(base), cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def safe_file_name(value: Column | str, chars: int = 80) -> Column:
    """Letters, digits, dots, dashes and underscores; anything else becomes one underscore; a digest keeps names apart."""
    v = whole(value)
    return F.concat(F.left(F.regexp_replace(v, r"[^A-Za-z0-9._-]+", "_"), F.lit(chars)), F.lit("-"), F.left(sha256(v), F.lit(16)))


def truthy(value: Column | str) -> Column:
    return F.lower(F.trim(whole(value))).isin("1", "true", "yes")


def section_family(title: Column | str, body: Column | str, families: Mapping[str, Sequence[str]] = SECTION_FAMILIES, front: int = 1500) -> Column:
    """The first family with a phrase in the title, else in the title and the body's first ``front`` characters, else "other"."""
    def first(x: Column) -> Column:
        out = None
        for where in (x["head"], x["both"]):
            for family, phrases in families.items():
                fits = reduce(lambda a, b: a | b, [where.contains(p) for p in phrases])
                out = F.when(fits, family) if out is None else out.when(fits, family)
        return out.otherwise("other")

    both = genre_form(F.concat(whole(title), F.lit(" "), F.left(whole(body), F.lit(front))))
    return let(F.struct(genre_form(title).alias("head"), both.alias("both")), first)


def is_heading(line: Column | str, families: Mapping[str, Sequence[str]] = SECTION_FAMILIES) -> Column:
    """A line that looks like a heading: short, of 2 to 18 words, in capitals or title case.

    Lines that end like a sentence must be in capitals; known section phrases need less.
    """
    def parts(s: Column) -> Column:
        return F.struct(s.alias("s"), F.lower(s).alias("low"), tokens(s).alias("w"), F.regexp_count(s, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(s, F.lit(r"\p{Lu}")).alias("capitals"))

    def judged(x: Column) -> Column:
        n = F.size(x["w"])
        upper = x["capitals"] / F.nullif(x["letters"], F.lit(0))
        title = F.size(F.filter(x["w"], lambda w: w.rlike(r"^\p{Lu}"))) / F.nullif(n, F.lit(0))
        known = reduce(lambda a, b: a | b, [x["low"].contains(p) for ps in families.values() for p in ps])
        sentence = x["s"].rlike(r"[.,]$") & (upper < 0.65)
        cased = F.when(known, (upper >= 0.65) | (title >= 0.45) | (n <= 7)).otherwise((upper >= 0.65) | (x["s"].rlike(r"^\p{Lu}") & (title >= 0.45)))
        return n.between(2, 18) & (x["letters"] > 0) & ~sentence & cased

    # a line that is too long is not looked at further
    return let(squeezed(line), lambda s: F.when(F.length(s).between(1, 140), F.coalesce(let(parts(s), judged), F.lit(False))).otherwise(F.lit(False)))


# Headings that a structured annotation has, and answers that say nothing.
ANNOTATION_HEADS = ("themes:", "tone:", "analyst note:", "changed:", "main shift:", "linguistic shift:")
EMPTY_ANSWERS = ("yes", "no", "none", "n/a")

# Words that value statements hold.
SIGNAL_TERMS = ("mission", "purpose", "values", "vision", "customer", "customers", "employee", "employees", "people", "integrity", "ethics", "innovation", "quality", "sustainability", "community", "diversity", "inclusion", "safety", "shareholder", "leadership")


def annotation_quality(annotation: Column | str, heads: Sequence[str] = ANNOTATION_HEADS) -> Column:
    """What a model's annotation is worth: a fragment, uninformative, unstructured, or a candidate signal."""
    a = stripped(whole(annotation))
    structured = reduce(lambda x, y: x | y, [F.lower(a).contains(h) for h in heads])
    return F.when(F.length(a) < 20, "low_empty_or_fragment").when(F.lower(a).isin(*EMPTY_ANSWERS), "low_uninformative").when(~structured, "medium_unstructured").otherwise("candidate_interpretive_signal")


def signal_excerpt(text: Column | str, terms: Sequence[str] = SIGNAL_TERMS, chars: int = 1800, before: int = 240, between: str = " [...] ") -> Column:
    """Windows round signal terms, joined and cut to ``chars``; the front of the text where no term occurs.

    Each window begins up to ``before`` characters ahead of its term; looking goes on behind the term
    until the joined windows are long enough.  Arrow batches, as each step depends on the one before it.
    """
    find = re.compile("|".join(f"(?={re.escape(t)})" for t in terms))
    lead = min(before, chars // 3)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            parts: list[str] = []
            low = t.lower()
            size, at = 0, 0
            while size < chars and (m := find.search(low, at)):
                start = max(0, m.start() - lead)
                part = t[start : start + chars].strip()
                if part and part not in parts:
                    size += len(part) + (len(between) if parts else 0)
                    parts.append(part)
                at = m.start() + 1
            return (between.join(parts) if parts else t)[:chars]

        return pd.Series([one(t) for t in texts], dtype="object")

    return cut(squeezed(text))
