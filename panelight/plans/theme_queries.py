"""Queries on texts: themes, language, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelight.functions import text as X
from panelight.functions.vocabularies import CORPUS_LEXICONS, CORPUS_THEMES
from panelight.operators import aggregates as A
from panelight.operators import change, selection, themes
from panelight.operators.stats import indexed_to_base
from panelight.plans.frames import COUNTS, KEYS, OBS, RATE, SPARSE, THEME_IDS, TOKEN_SQL, counts, observations, sparse, with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, run, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_tables(sql, *tables) if tables else sql


_T = (OBS, COUNTS)
_AGG = f"count(*) AS company_years, coalesce(round(avg(CASE WHEN cnt > 0 THEN 1e0 ELSE 0e0 END), 6), 0e0) AS presence_rate, coalesce(round(avg({RATE}), 6), 0e0) AS mean_rate, coalesce(round(median({RATE}), 6), 0e0) AS median_rate"
query("theme_counts", lambda s, d: A.with_rate(counts(s, d)).select("doc_id", "theme", "cnt", "n_words", F.round("rate", 6).alias("rate")), f"SELECT doc_id, theme, cnt, n_words, round({RATE}, 6) AS rate FROM counts", *_T)
query("theme_year_summary", lambda s, d: A.theme_summary(counts(s, d), ["year"]), f"SELECT year, theme, {_AGG}, cast(sum(cnt) AS BIGINT) AS total_matches FROM counts GROUP BY year, theme", *_T)
query("theme_sector_summary", lambda s, d: A.theme_summary(counts(s, d), ["sector"], total=False), f"SELECT sector, theme, {_AGG} FROM counts GROUP BY sector, theme", *_T)

_WINDOWS = "VALUES ('pre_2020', '2016,2017,2018,2019', 2016, 2019), ('covid_dei_governance_window', '2020,2021', 2020, 2021), ('post_2021', '2022,2023,2024', 2022, 2024)"
# documents before 2020 only, so that two windows are empty
_EVENTS = f"""ev AS (SELECT event_window, years, t.theme AS theme, count(c.doc_id) AS company_years, coalesce(round(avg({RATE.replace('n_words', 'c.n_words')}) FILTER (c.doc_id IS NOT NULL), 6), 0e0) AS mean_rate,
 coalesce(round(avg(CASE WHEN cnt > 0 THEN 1e0 ELSE 0e0 END) FILTER (c.doc_id IS NOT NULL), 6), 0e0) AS presence_rate
 FROM ({_WINDOWS}) w(event_window, years, a, b) CROSS JOIN (SELECT DISTINCT theme FROM counts) t LEFT JOIN (SELECT * FROM counts WHERE year <> 2020 AND year <> 2021) c ON c.theme = t.theme AND c.year BETWEEN a AND b GROUP BY event_window, years, t.theme)"""
_event_windows = lambda s, d: A.event_window_summary(counts(s, d).filter("year NOT IN (2020, 2021)"), THEME_IDS)
query("event_windows", _event_windows, "SELECT * FROM ev", *_T, _EVENTS)
query("event_window_changes", lambda s, d: A.event_window_changes(_event_windows(s, d)), """SELECT theme, a AS pre_2020_rate, b AS covid_dei_governance_window_rate, c AS post_2021_rate, round(b - a, 6) AS window_minus_pre, round(c - a, 6) AS post_minus_pre
 FROM (SELECT theme, max(CASE WHEN event_window = 'pre_2020' THEN mean_rate END) AS a, max(CASE WHEN event_window LIKE 'covid%' THEN mean_rate END) AS b, max(CASE WHEN event_window = 'post_2021' THEN mean_rate END) AS c FROM ev GROUP BY theme)""", *_T, _EVENTS)
query("sector_leading_themes", lambda s, d: A.leading_themes(A.theme_summary(counts(s, d), ["sector"], total=False), limit=2).select("sector", "theme", "mean_rate", "rank"), f"SELECT sector, theme, mean_rate, cast(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY mean_rate DESC, theme) AS n FROM (SELECT sector, theme, {_AGG} FROM counts GROUP BY sector, theme)) WHERE n <= 2", *_T)
query("theme_intensity", lambda s, d: selection.split_by_intensity(A.theme_summary(counts(s, d), ["year"]), threshold=150.0), f"SELECT theme, CASE WHEN avg(mean_rate) >= 150 THEN 'high' ELSE 'low' END AS intensity FROM (SELECT year, theme, {_AGG} FROM counts GROUP BY year, theme) GROUP BY theme", *_T)
_ranked = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, theme) AS n FROM counts"
query("dominant_theme", lambda s, d: selection.top_of_each(counts(s, d), ["doc_id"], [F.desc("cnt"), "theme"], 1).select("doc_id", F.when(F.col("cnt") > 0, F.col("theme")).otherwise("").alias("theme"), "cnt"), f"SELECT doc_id, CASE WHEN cnt > 0 THEN theme ELSE '' END AS theme, cnt FROM ({_ranked}) WHERE n = 1", *_T)
query("top3_themes", lambda s, d: selection.top_of_each(counts(s, d).filter("cnt > 0"), ["doc_id"], [F.desc("cnt"), "theme"], 3).select("doc_id", "rank", "theme", "cnt"), f"SELECT doc_id, cast(n AS BIGINT) AS rank, theme, cnt FROM ({_ranked}) WHERE n <= 3 AND cnt > 0", *_T)

_SPARSE_COUNTS = "sc AS (SELECT c.* FROM counts c JOIN sparse s ON s.doc_id = c.doc_id)"
_S = (*_T, SPARSE, _SPARSE_COUNTS)
_sparse_counts = lambda s, d: themes.theme_counts(sparse(observations(s, d)), KEYS, CORPUS_THEMES)
query("company_theme_change", lambda s, d: A.company_trends(_sparse_counts(s, d)), f"""SELECT ticker, sector, theme, first_year, last_year, round(a, 6) AS first_rate, round(b, 6) AS last_rate, round(b - a, 6) AS change, observed_years
 FROM (SELECT ticker, min(sector) AS sector, theme, min(year) AS first_year, max(year) AS last_year, arg_min({RATE}, year) AS a, arg_max({RATE}, year) AS b, count(DISTINCT year) AS observed_years FROM sc GROUP BY ticker, theme) WHERE observed_years >= 2""", *_S)
query("adjacent_shifts", lambda s, d: A.adjacent_shifts(_sparse_counts(s, d)), f"""SELECT ticker, sector, theme, py AS prior_year, year, round(p, 6) AS prior_rate, round(r, 6) AS rate, round(r - p, 6) AS change, round(abs(r - p), 6) AS absolute_change
 FROM (SELECT *, lag(r) OVER w AS p, lag(year) OVER w AS py FROM (SELECT *, {RATE} AS r FROM sc) WINDOW w AS (PARTITION BY ticker, theme ORDER BY year)) WHERE py IS NOT NULL ORDER BY round(abs(r - p), 6) DESC, ticker, theme, year LIMIT 250""", *_S)
query("base_year_index", lambda s, d: indexed_to_base(A.with_rate(_sparse_counts(s, d)), "rate", ["ticker", "theme"]).select("ticker", "theme", "year", F.round("idx", 5).alias("idx")), f"SELECT ticker, theme, year, CASE WHEN b > 0 THEN round(100 * r / b, 5) ELSE 0e0 END AS idx FROM (SELECT *, first_value(r) OVER (PARTITION BY ticker, theme ORDER BY year) AS b FROM (SELECT *, {RATE} AS r FROM sc))", *_S)

_SENTENCES = r"list_filter(string_split(regexp_replace(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)"
_LING = (
    "ling AS MATERIALIZED (SELECT *, CASE WHEN s > 0 THEN round(n * 1e0 / s, 4) ELSE 0e0 END AS average_sentence_length, "
    + ", ".join("CASE WHEN n > 0 THEN round(100e0 * {0}_count / n, 4) ELSE 0e0 END AS {0}_rate_per_100_words".format(k) for k in CORPUS_LEXICONS)
    + " FROM (SELECT doc_id, ticker, year, sector, cast(len(w) AS BIGINT) AS n, s, q, "
    + ", ".join("cast(len(list_filter(w, lambda x: x IN ({}))) AS BIGINT) AS {}_count".format(", ".join(f"'{v}'" for v in words), k) for k, words in CORPUS_LEXICONS.items())
    + " FROM (SELECT doc_id, ticker, year, sector, list_transform(regexp_extract_all(coalesce(text, ''), '" + TOKEN_SQL + "'), lambda x: lower(x)) AS w, cast(len(" + _SENTENCES + ") AS BIGINT) AS s, "
    + r"cast(len(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[à-öø-ɏ]', 'z', 'g'), '\b(?:\d+(?:[.,]\d+)*|percent|percentage)\b|%')) AS BIGINT) AS q FROM obs)))"
)
_FIELDS = [f"{k}_rate_per_100_words" for k in CORPUS_LEXICONS] + ["average_sentence_length", "quantified_claim_count"]
_ling = lambda s, d: themes.linguistics(observations(s, d), ["doc_id", "year", "sector"], CORPUS_LEXICONS)
query("linguistic_metrics", lambda s, d: _ling(s, d).drop("year", "sector"), "SELECT doc_id, n AS word_count, s AS sentence_count, average_sentence_length, q AS quantified_claim_count, " + ", ".join(f"{k}_count, {k}_rate_per_100_words" for k in CORPUS_LEXICONS) + " FROM ling", OBS, _LING)
# means of values of four digits have ties at the sixth, which engines round apart
_three = lambda df: df.withColumns({c: F.round(c, 3) for c in df.columns if c.startswith("mean_")})
for _by in ("year", "sector"):
    query(f"linguistic_by_{_by}", lambda s, d, by=_by: _three(A.linguistic_summary(_ling(s, d), [by], _FIELDS)), f"SELECT {_by}, count(*) AS company_years, round(round(avg(n), 6), 3) AS mean_word_count, round(median(n), 6) AS median_word_count, " + ", ".join("round(round(avg({}), 6), 3) AS mean_{}".format("q" if f == "quantified_claim_count" else f, f) for f in _FIELDS) + f" FROM ling GROUP BY {_by}", OBS, _LING)
query("word_count_range", lambda s, d: _ling(s, d).agg(F.count("*").alias("n"), F.min("word_count").alias("least"), F.median("word_count").alias("median"), F.max("word_count").alias("greatest")), "SELECT count(*) AS n, min(n) AS least, median(n) AS median, max(n) AS greatest FROM ling", OBS, _LING)

_pattern = lambda p: r"(?i)\b" + p.replace(" ", r"\s+") + r"\b"
_z = lambda x: f"regexp_replace({x}, '[À-ÖØ-öø-ɏ]', 'z', 'g')"
_EVIDENCE = " UNION ALL ".join(
    f"SELECT doc_id, '{t.id}' AS theme_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(z, '{_pattern(p)}') THEN '{p}' END''' for p in t.phrases)}], lambda x: x IS NOT NULL), '|') AS matched_phrases, "
    f"cast(len(ex) AS BIGINT) AS n_excerpts, cast(list_sum(list_transform(ex, lambda x: length(x))) AS BIGINT) AS excerpt_chars, cast({' + '.join(f'''len(regexp_extract_all(z, '{_pattern(p)}'))''' for p in t.phrases)} AS BIGINT) AS match_count "
    f"FROM (SELECT doc_id, z, list_distinct(list_filter(list_transform(ss, lambda x: trim(x)), lambda x: {' OR '.join(f'''regexp_matches({_z('x')}, '{_pattern(p)}')''' for p in t.phrases)})) AS ex FROM (SELECT doc_id, {_z('''coalesce(text, '')''')} AS z, {_SENTENCES} AS ss FROM obs)) WHERE {' OR '.join(f'''regexp_matches(z, '{_pattern(p)}')''' for p in t.phrases)}"
    for t in CORPUS_THEMES[:2]
)
query("theme_evidence", lambda s, d: themes.theme_observations(themes.theme_evidence(observations(s, d), ["doc_id"], CORPUS_THEMES[:2]), ["doc_id"]).select("doc_id", "theme_id", F.array_join("matched_phrases", "|").alias("matched_phrases"), F.size("evidence_excerpts").cast("long").alias("n_excerpts"), F.aggregate(F.transform("evidence_excerpts", lambda x: F.length(x)), F.lit(0).cast("long"), lambda a, b: a + b).alias("excerpt_chars"), "match_count"), _EVIDENCE, OBS)

_GENRES = {"first": ["the", "in the", "of"], "second": ["and", "is", "a"]}
_dd = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), '([^a-z0-9])', '\1\1', 'g'), '$', '')"
_g = lambda p: f"len(regexp_extract_all(dd, '(?:^|[^a-z0-9])' || '{p.replace(' ', '  ')}' || '(?:[^a-z0-9]|$)'))"
query("genre_rates", lambda s, d: themes.genre_rates(observations(s, d), ["doc_id"], _GENRES), "SELECT *, " + ", ".join(f"CASE WHEN n_words > 0 THEN round(1000e0 * {k}_count / n_words, 6) ELSE 0e0 END AS {k}_rate" for k in _GENRES) + f" FROM (SELECT doc_id, n_words, " + ", ".join(f"cast({' + '.join(map(_g, v))} AS BIGINT) AS {k}_count" for k, v in _GENRES.items()) + f" FROM (SELECT doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS BIGINT) AS n_words, {_dd} AS dd FROM obs))", OBS)
query("text_digest", lambda s, d: observations(s, d).select("doc_id", X.sha256("text").alias("digest"), F.length(X.whole("text")).cast("long").alias("chars"), X.sha256(X.comparison_form("text")).alias("form_digest")), r"SELECT doc_id, sha256(coalesce(text, '')) AS digest, cast(length(coalesce(text, '')) AS BIGINT) AS chars, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS form_digest FROM obs", OBS)
query("front_windows", lambda s, d: observations(s, d).select("doc_id", F.length(X.front_window("text", 500)).cast("long").alias("chars"), X.sha256(X.front_window("text", 500)).alias("digest")), r"SELECT doc_id, cast(length(w) AS BIGINT) AS chars, sha256(w) AS digest FROM (SELECT doc_id, left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 500) AS w FROM obs)", OBS)
query("extraction_quality", lambda s, d: observations(s, d).select("doc_id", X.extraction_quality("text", 300).alias("quality")), f"SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 300 THEN 'insufficient_text' WHEN contains(upper(left(coalesce(text, ''), 5000)), 'TABLE OF CONTENTS') AND n < 2500 THEN 'possibly_index_only' ELSE 'usable' END AS quality FROM (SELECT doc_id, text, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS n FROM obs)", OBS)
query("section_families", lambda s, d: observations(s, d).select("doc_id", X.section_family(F.left(X.whole("text"), F.lit(40)), F.substr(X.whole("text"), F.lit(41)), {"one": ["under", "the value"], "two": ["system", "ein"], "three": ["of"]}).alias("family")), r"""SELECT doc_id, CASE WHEN contains(t, 'under') OR contains(t, 'the value') THEN 'one' WHEN contains(t, 'system') OR contains(t, 'ein') THEN 'two' WHEN contains(t, 'of') THEN 'three'
 WHEN contains(h, 'under') OR contains(h, 'the value') THEN 'one' WHEN contains(h, 'system') OR contains(h, 'ein') THEN 'two' WHEN contains(h, 'of') THEN 'three' ELSE 'other' END AS family
 FROM (SELECT doc_id, trim(regexp_replace(lower(left(coalesce(text, ''), 40)), '\s+', ' ', 'g')) AS t, trim(regexp_replace(lower(left(coalesce(text, ''), 40) || ' ' || substr(coalesce(text, ''), 41, 1500)), '\s+', ' ', 'g')) AS h FROM obs)""", OBS)
_FORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
query("change_classes", lambda s, d: change.change_classes(sparse(observations(s, d)).withColumn("text", F.when(F.col("doc_id") % 11 != 0, F.when(F.col("year") > 2020, F.col("ticker")).otherwise(F.col("text"))))), f"""SELECT c.ticker, c.year, p.year AS prior_year, CASE WHEN p.year IS NULL THEN 'no_prior' WHEN coalesce(c.text, '') = '' OR coalesce(p.text, '') = '' THEN 'indeterminate' WHEN {_FORM.replace('text', 'c.text')} = {_FORM.replace('text', 'p.text')} THEN 'unchanged_exact' ELSE 'changed' END AS change_class
 FROM v c LEFT JOIN v p ON p.ticker = c.ticker AND p.year = c.year - 1""", OBS, SPARSE, "v AS (SELECT ticker, year, CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN year > 2020 THEN ticker ELSE text END END AS text FROM sparse)")
_TOK = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
query("token_jaccard", lambda s, d: _neighbours(s, d).select("ticker", "year", F.round(change.token_jaccard("prior_text", "text"), 6).alias("similarity")), f"""SELECT ticker, year, CASE WHEN len(u) > 0 THEN round(len(list_intersect(a, b)) * 1e0 / len(u), 6) ELSE 1e0 END AS similarity
 FROM (SELECT ticker, year, a, b, list_distinct(list_concat(a, b)) AS u FROM (SELECT c.ticker, c.year, list_distinct(regexp_extract_all(lower(p.text), '{_TOK}')) AS a, list_distinct(regexp_extract_all(lower(c.text), '{_TOK}')) AS b FROM sparse c JOIN sparse p ON p.ticker = c.ticker AND p.year = c.year - 1))""", OBS, SPARSE)
query("change_events", lambda s, d: change.changes(sparse(observations(s, d)).select("ticker", "year", "text")))


def _neighbours(s, d):
    from panelight.operators.panel import prior_year

    return prior_year(sparse(observations(s, d)).select("ticker", "year", "text"), ["text"]).filter("prior_year IS NOT NULL")
