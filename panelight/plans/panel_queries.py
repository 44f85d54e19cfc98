"""Queries on the panel: joins, scopes, upserts, statistics and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelight.functions.vocabularies import CORPUS_THEMES
from panelight.operators import aggregates as A
from panelight.operators import alignment, panel, selection, stats
from panelight.plans.frames import COUNTS, METRICS, OBS, SIDES, SPARSE, THEME_IDS, metrics, observations, read, sides, sparse, with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, run, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_tables(sql, *tables) if tables else sql


_obs = lambda s, d: observations(s, d).select("doc_id", "ticker", "year", "sector", "side")
_cells = lambda s, d: sparse(_obs(s, d))

# Joins and scopes
_GRID = "grid AS (SELECT t.ticker, y.year FROM (SELECT DISTINCT ticker FROM obs) t CROSS JOIN (SELECT unnest(range(2016, 2025)) AS year) y)"


def _panel(s, d):
    cells = _cells(s, d)
    status = panel.with_target(panel.grid(cells.select("ticker").distinct()))
    artifacts = cells.select("ticker", "year", "doc_id")
    fetches = cells.filter("doc_id % 3 <> 0").select("ticker", "year", F.lit("success").alias("fetch_status"))
    out = panel.final_panel(status, artifacts, fetches)
    return out.select("ticker", "year", F.date_format("target_timestamp", "yyyy-MM-dd HH:mm").alias("target"), "doc_id", "fetch_status", F.when(F.col("doc_id").isNull(), "missing").otherwise("collected").alias("status"))


query("panel_grid", _panel, "SELECT g.ticker, cast(g.year AS INTEGER) AS year, g.year || '-06-30 12:00' AS target, doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'success' END AS fetch_status, CASE WHEN doc_id IS NULL THEN 'missing' ELSE 'collected' END AS status FROM grid g LEFT JOIN sparse s ON s.ticker = g.ticker AND s.year = g.year", OBS, SPARSE, _GRID)
query("valid_candidates", lambda s, d: panel.within_validity(_cells(s, d).select("ticker", "year"), read(s, d, "pages").select("page_id", F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("ticker"), (2014 + F.col("page_id") % 7).alias("valid_from_year"), (2017 + F.col("page_id") % 11).alias("valid_to_year"))).select("ticker", "year", "page_id"), "SELECT s.ticker, s.year, page_id FROM sparse s JOIN pages p ON 'src' || (page_id % 20) = s.ticker AND s.year BETWEEN 2014 + page_id % 7 AND 2017 + page_id % 11", OBS, SPARSE)


def _paired(s, d):
    o = _obs(s, d)
    one = lambda side: o.filter(F.col("side") == side).groupBy("ticker", "year").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    both = panel.paired(one(0), one(1))
    return panel.with_optional(both, _cells(s, d).select("ticker", "year", F.lit("computed").alias("semantic_similarity_status"), F.col("doc_id").alias("cell")), {"semantic_similarity_status": "not_computed", "cell": None})


query("paired_sides", _paired, "SELECT a.ticker, a.year, a.n AS n_part1, b.n AS n_part2, a.f AS first_part1, b.f AS first_part2, CASE WHEN s.doc_id IS NULL THEN 'not_computed' ELSE 'computed' END AS semantic_similarity_status, s.doc_id AS cell FROM (SELECT ticker, year, count(*) AS n, min(doc_id) AS f FROM obs WHERE side = 0 GROUP BY 1, 2) a JOIN (SELECT ticker, year, count(*) AS n, min(doc_id) AS f FROM obs WHERE side = 1 GROUP BY 1, 2) b ON a.ticker = b.ticker AND a.year = b.year LEFT JOIN sparse s ON s.ticker = a.ticker AND s.year = a.year", OBS, SPARSE)
query("prior_year", lambda s, d: panel.prior_year(_cells(s, d).select("ticker", "year", "doc_id"), ["doc_id"]), "SELECT c.ticker, c.year, c.doc_id, p.year AS prior_year, p.doc_id AS prior_doc_id FROM sparse c LEFT JOIN sparse p ON p.ticker = c.ticker AND p.year = c.year - 1", OBS, SPARSE)
query("prior_observed", lambda s, d: panel.prior_observed(_cells(s, d).select("ticker", "year", "doc_id"), ["doc_id"], ["ticker"]), "SELECT ticker, year, doc_id, (SELECT max(p.year) FROM sparse p WHERE p.ticker = c.ticker AND p.year < c.year) AS prior_year, (SELECT arg_max(p.doc_id, p.year) FROM sparse p WHERE p.ticker = c.ticker AND p.year < c.year) AS prior_doc_id FROM sparse c", OBS, SPARSE)
_new = lambda s, d: _obs(s, d).filter("doc_id >= 180 AND doc_id < 360").select("ticker", "year", (F.col("doc_id") * 10).alias("doc_id"))
query("upserted", lambda s, d: panel.upserted(_cells(s, d).select("ticker", "year", "doc_id"), _new(s, d), scope=_obs(s, d).filter("year < 2020")), "SELECT ticker, year, doc_id FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM obs n WHERE n.doc_id BETWEEN 180 AND 359 AND n.ticker = s.ticker AND n.year = s.year AND n.year < 2020) UNION ALL SELECT ticker, year, doc_id * 10 FROM obs WHERE doc_id BETWEEN 180 AND 359 AND year < 2020", OBS, SPARSE)
query("replaced_scope", lambda s, d: panel.replaced(_cells(s, d).select("ticker", "year", "doc_id"), _new(s, d).filter("doc_id % 20 = 0"), _obs(s, d).filter("year < 2019")), "SELECT ticker, year, doc_id FROM sparse WHERE year >= 2019 UNION ALL SELECT ticker, year, doc_id * 10 FROM obs WHERE doc_id BETWEEN 180 AND 359 AND doc_id % 2 = 0 AND year < 2019", OBS, SPARSE)
query("last_wins", lambda s, d: panel.last_wins([_cells(s, d).select("ticker", "year", "doc_id"), _new(s, d)], order=[F.desc("doc_id")]), "SELECT ticker, year, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY o DESC, doc_id DESC) AS n FROM (SELECT 0 AS o, ticker, year, doc_id FROM sparse UNION ALL SELECT 1, ticker, year, doc_id * 10 FROM obs WHERE doc_id BETWEEN 180 AND 359)) WHERE n = 1", OBS, SPARSE)
query("effective_scope", lambda s, d: panel.effective_scope(_obs(s, d).filter("year = 2016"), _obs(s, d).filter("side = 1 AND year < 2021"), _cells(s, d)), "SELECT DISTINCT ticker, year FROM obs WHERE year = 2016 OR (side = 1 AND year < 2021 AND NOT EXISTS (SELECT 1 FROM sparse s WHERE s.ticker = obs.ticker AND s.year = obs.year))", OBS, SPARSE)
query("restricted_rows", lambda s, d: panel.restricted(_obs(s, d), _cells(s, d).filter("doc_id % 4 = 1")).select("doc_id"), "SELECT doc_id FROM obs WHERE EXISTS (SELECT 1 FROM sparse s WHERE s.ticker = obs.ticker AND s.year = obs.year AND s.doc_id % 4 = 1)", OBS, SPARSE)
query("duplicate_keys", lambda s, d: panel.duplicate_keys(_obs(s, d)), "SELECT ticker, year, count(*) AS n FROM obs GROUP BY ticker, year HAVING count(*) > 1", OBS)
query("key_differences", lambda s, d: panel.key_differences(panel.grid(_cells(s, d).select("ticker").distinct(), 2018, 2027), _cells(s, d)), "SELECT ticker, cast(year AS INTEGER) AS year, 'missing' AS side FROM (SELECT t.ticker, y.year FROM (SELECT DISTINCT ticker FROM sparse) t CROSS JOIN (SELECT unnest(range(2018, 2028)) AS year) y) g WHERE NOT EXISTS (SELECT 1 FROM sparse s WHERE s.ticker = g.ticker AND s.year = g.year) UNION ALL SELECT ticker, year, 'unexpected' FROM sparse WHERE year < 2018", OBS, SPARSE)
query("looked_up", lambda s, d: panel.pattern_looked_up(panel.looked_up(read(s, d, "nation").select("n_nationkey", "n_name"), {"GERMANY": "de", "FRANCE": "fr"}, "n_name", "code", "other"), {"^U": "u", "A$": "a"}, "n_name", "kind"), "SELECT n_nationkey, n_name, CASE n_name WHEN 'GERMANY' THEN 'de' WHEN 'FRANCE' THEN 'fr' ELSE 'other' END AS code, CASE WHEN n_name LIKE 'U%' THEN 'u' WHEN n_name LIKE '%A' THEN 'a' END AS kind FROM nation")
query("row_differences", lambda s, d: selection.same_rows(_obs(s, d).select("ticker", "year"), _cells(s, d).select("ticker", "year").unionByName(panel.grid(_cells(s, d).select("ticker").distinct(), 2025, 2025))), "SELECT * FROM (SELECT ticker, year, 'first' AS side FROM (SELECT ticker, year FROM obs EXCEPT ALL SELECT ticker, year FROM sparse)) UNION ALL SELECT DISTINCT ticker, 2025, 'second' FROM sparse", OBS, SPARSE)
query("running_ordinal", lambda s, d: selection.top_of_each(_obs(s, d).select("doc_id", "ticker", "year"), ["ticker", "year"], ["doc_id"], 1 << 40, "ordinal").select("doc_id", "ticker", "ordinal"), "SELECT doc_id, ticker, row_number() OVER (PARTITION BY ticker, year ORDER BY doc_id) AS ordinal FROM obs", OBS)
query("missing_summary", lambda s, d: A.missing_summary(panel.missing_keys(panel.grid(_cells(s, d).select("ticker").distinct()), _cells(s, d)).withColumn("gap_reason", F.when(F.col("year") % 2 == 0, "no capture").otherwise("too short"))), "SELECT ticker, string_agg(year, ',' ORDER BY year) AS missing_years, count(*) AS missing_count, string_agg(DISTINCT CASE WHEN year % 2 = 0 THEN 'no capture' ELSE 'too short' END, '; ' ORDER BY CASE WHEN year % 2 = 0 THEN 'no capture' ELSE 'too short' END) AS gap_reasons FROM (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM sparse s WHERE s.ticker = g.ticker AND s.year = g.year)) GROUP BY ticker", OBS, SPARSE, _GRID)

# Alignment
_I = (OBS, COUNTS, SIDES)
_index = lambda s, d: alignment.index_panel(sides(s, d), CORPUS_THEMES)
_SCORED = "CASE WHEN score_status = 'scored' THEN {} END AS {}"
query("alignment_index", lambda s, d: _index(s, d).select("ticker", "year", "sector", "score_status", "stated_total", "disclosure_total", "authenticity_index", "cosine_alignment", "l1_alignment", "jaccard_theme_overlap"), "SELECT ticker, year, sector, score_status, cast(ta AS BIGINT) AS stated_total, cast(tb AS BIGINT) AS disclosure_total, " + ", ".join(_SCORED.format(a, b) for a, b in (("overlap", "authenticity_index"), ("cosine", "cosine_alignment"), ("l1", "l1_alignment"), ("jaccard", "jaccard_theme_overlap"))) + " FROM idx", *_I)
query("index_sector_context", lambda s, d: _index(s, d).filter("score_status = 'scored'").select("ticker", "year", "sector_percentile", "sector_z_score"), "SELECT ticker, year, round((rank() OVER (PARTITION BY sector ORDER BY overlap) + (count(*) OVER (PARTITION BY sector, overlap) - 1) / 2e0) / count(*) OVER (PARTITION BY sector), 6) AS sector_percentile, round(CASE WHEN stddev_samp(overlap) OVER (PARTITION BY sector) > 0 THEN (overlap - avg(overlap) OVER (PARTITION BY sector)) / stddev_samp(overlap) OVER (PARTITION BY sector) ELSE 0e0 END, 6) AS sector_z_score FROM idx WHERE score_status = 'scored'", *_I)
_share = lambda x, t: f"round(CASE WHEN {t} > 0 THEN {x} * 1e0 / {t} ELSE 0e0 END, 6)"
_GAP_SCHEMA = "array<struct<theme_id: string, stated_share: double, disclosure_share: double, stated_minus_disclosure: double>>"
query("theme_gaps", lambda s, d: _index(s, d).select("ticker", "year", F.posexplode(F.from_json("theme_gap_summary", _GAP_SCHEMA)).alias("rank", "g")).select("ticker", "year", "rank", "g.*"), f"SELECT ticker, year, cast(n - 1 AS INTEGER) AS rank, theme AS theme_id, p AS stated_share, q AS disclosure_share, g AS stated_minus_disclosure FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY abs(g) DESC, theme) AS n FROM (SELECT ticker, year, theme, {_share('a', 'ta')} AS p, {_share('b', 'tb')} AS q, round(CASE WHEN ta > 0 THEN a * 1e0 / ta ELSE 0e0 END - CASE WHEN tb > 0 THEN b * 1e0 / tb ELSE 0e0 END, 6) AS g FROM totals)) WHERE n <= 5", *_I)
query("top_stated_themes", lambda s, d: _index(s, d).select("ticker", "year", F.posexplode(F.from_json("stated_top_themes", "array<struct<theme_id: string, match_count: bigint>>")).alias("rank", "g")).select("ticker", "year", "rank", "g.*"), "SELECT ticker, year, cast(n - 1 AS INTEGER) AS rank, theme AS theme_id, cast(a AS BIGINT) AS match_count FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY a DESC, theme) AS n FROM totals WHERE a > 0) WHERE n <= 3", *_I)
query("coverage_by_status", lambda s, d: A.coverage(_index(s, d), "score_status"), "SELECT score_status, count(*) AS n, count(DISTINCT ticker) AS companies, count(DISTINCT year) AS years, round(count(*) * 1e0 / sum(count(*)) OVER (), 6) AS share FROM idx GROUP BY score_status", *_I)
query("coverage_by_sector", lambda s, d: A.coverage(_index(s, d), "score_status", ["sector"]), "SELECT sector, score_status, count(*) AS n, count(DISTINCT ticker) AS companies, count(DISTINCT year) AS years, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY sector), 6) AS share FROM idx GROUP BY sector, score_status", *_I)


def _theme_pairs(s, d):
    """Evidence as JSON: excerpts are there for every other theme of the first side."""
    rows = sides(s, d)
    js = lambda c, m: F.to_json(F.filter(F.transform(F.arrays_zip(F.array(*map(F.lit, THEME_IDS)).alias("t"), F.col(c).alias("n")), lambda e: F.struct(e["t"].alias("theme_id"), e["n"].cast("string").alias("match_count"), F.when(e["n"] % m != 0, F.array(F.concat(F.lit("some  text of "), e["t"]), F.lit("and more"))).otherwise(F.array().cast("array<string>")).alias("evidence_excerpts"))), lambda e: e["match_count"] != "0"))
    return alignment.theme_pairs(rows.select("ticker", "year", js("stated", 2).alias("theme_evidence_part1"), js("disclosure", 3).alias("theme_evidence_part2")), CORPUS_THEMES)


query("theme_pairs", lambda s, d: _theme_pairs(s, d).drop("theme_share_gap_abs"), "SELECT ticker, year, theme AS theme_id, cast(CASE WHEN a % 2 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS stated_excerpt_count, cast(CASE WHEN b % 3 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS disclosure_excerpt_count, cast(a AS BIGINT) AS stated_theme_match_count, cast(b AS BIGINT) AS disclosure_theme_match_count, " + _share("a", "ta") + " AS stated_theme_share, " + _share("b", "tb") + " AS disclosure_theme_share, CASE WHEN a % 2 <> 0 THEN 'some text of ' || theme || ' and more' ELSE '' END AS stated_theme_excerpt_text, CASE WHEN b % 3 <> 0 THEN 'some text of ' || theme || ' and more' ELSE '' END AS disclosure_theme_excerpt_text, CASE WHEN a % 2 = 0 AND b % 3 = 0 THEN 'missing_both_theme_evidence' WHEN a % 2 = 0 THEN 'missing_stated_theme_evidence' WHEN b % 3 = 0 THEN 'missing_disclosure_theme_evidence' ELSE 'pending' END AS theme_semantic_status FROM totals", *_I)

# Statistics over customers
_M = (METRICS,)
_r = lambda c, n=5: F.round(c, n).alias(c)
_stats_sql = lambda by: f"SELECT {by + ', ' if by else ''}count(y) AS n, count(*) - count(y) AS missing, round(avg(y), 4) AS mean, round(median(y), 4) AS median, round(stddev_samp(y), 4) AS std, round(min(y), 4) AS low, round(quantile_cont(y, 0.1), 4) AS p10, round(quantile_cont(y, 0.25), 4) AS p25, round(quantile_cont(y, 0.75), 4) AS p75, round(quantile_cont(y, 0.9), 4) AS p90, round(max(y), 4) AS high FROM metrics" + (f" GROUP BY {by}" if by else "")
query("distribution", lambda s, d: stats.distribution(metrics(s, d), "y", digits=4), _stats_sql(""), *_M)
query("sector_summary", lambda s, d: stats.distribution(metrics(s, d), "y", ["sector"], 4), _stats_sql("sector"), *_M)
query("year_summary", lambda s, d: stats.distribution(metrics(s, d), "y", ["year"], 4), _stats_sql("year"), *_M)
query("company_summary", lambda s, d: stats.distribution(metrics(s, d).filter("year < 3"), "y", ["ticker"], 4), _stats_sql("ticker").replace("FROM metrics", "FROM (SELECT * FROM metrics WHERE year < 3)"), *_M)
query("sector_percentile", lambda s, d: metrics(s, d).filter("y IS NOT NULL").select("ticker", F.round(stats.percentile_rank("y", ["sector"]), 6).alias("pct")), "SELECT ticker, round((rank() OVER (PARTITION BY sector ORDER BY y) + (count(*) OVER (PARTITION BY sector, y) - 1) / 2e0) / count(*) OVER (PARTITION BY sector), 6) AS pct FROM metrics WHERE y IS NOT NULL", *_M)
query("sector_zscore", lambda s, d: metrics(s, d).select("ticker", F.round(stats.sample_zscore("y", ["sector"]), 5).alias("z")), "SELECT ticker, round((y - avg(y) OVER w) / stddev_samp(y) OVER w, 5) AS z FROM metrics WINDOW w AS (PARTITION BY sector)", *_M)
_computed = lambda: F.col("year") % 5 != 0
_composite = lambda s, d: stats.composite(metrics(s, d), ["x", "y", "n_orders"], _computed())
_COMPOSITE = "comp AS MATERIALIZED (SELECT m.*, CASE WHEN year % 5 <> 0 THEN ((x - mx) / sx + coalesce((y - my) / sy, 0) + coalesce((n_orders - mn) / sn, 0)) / (1 + CASE WHEN y IS NULL THEN 0 ELSE 1 END + CASE WHEN n_orders IS NULL THEN 0 ELSE 1 END) END AS composite FROM metrics m, (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(n_orders) AS mn, stddev_pop(n_orders) AS sn FROM metrics WHERE year % 5 <> 0) q)"
query("composite_zscore", lambda s, d: _composite(s, d).select("ticker", _r("composite")), "SELECT ticker, round(composite, 5) AS composite FROM comp", METRICS, _COMPOSITE)
_terciles = lambda s, d: stats.terciles(_composite(s, d).withColumn("composite", F.round("composite", 6)), "composite", ["ticker"])
_TERCILES = "terc AS MATERIALIZED (SELECT ticker, x, y, composite, CASE WHEN composite IS NULL THEN NULL WHEN n <= (k + 1) // 3 THEN 'low' WHEN n <= (k + 1) // 3 + k // 3 THEN 'medium' ELSE 'high' END AS tercile FROM (SELECT ticker, x, y, round(composite, 6) AS composite, row_number() OVER (PARTITION BY composite IS NULL ORDER BY round(composite, 6), ticker) AS n, count(composite) OVER () AS k FROM comp))"
query("terciles", lambda s, d: _terciles(s, d).select("ticker", "tercile"), "SELECT ticker, tercile FROM terc", METRICS, _COMPOSITE, _TERCILES)
_ps = "count(*) AS company_years, count(composite) AS diagnostic_company_years, count(y) AS scored_company_years, round(avg(composite), 4) + 0 AS mean_pressure, round(median(composite), 4) AS median_pressure, round(avg(y), 4) AS mean_score, round(median(y), 4) AS median_score"
query("pressure_summary", lambda s, d: A.pressure_summary(_terciles(s, d), "composite", "y", digits=4), f"""SELECT 'overall' AS "group", {_ps} FROM terc UNION ALL SELECT 'tercile_' || tercile, {_ps} FROM terc WHERE tercile IS NOT NULL GROUP BY tercile""", METRICS, _COMPOSITE, _TERCILES)
_quad = lambda s, d: stats.quadrants(metrics(s, d), "x", "y")
_QUAD = "quad AS MATERIALIZED (SELECT m.*, CASE WHEN y IS NULL THEN NULL WHEN x >= mx AND y >= my THEN 'both_high' WHEN x >= mx THEN 'keyword_high_only' WHEN y >= my THEN 'semantic_high_only' ELSE 'both_low' END AS quadrant FROM metrics m, (SELECT median(x) AS mx, median(y) AS my FROM metrics WHERE y IS NOT NULL) q)"
query("quadrants", lambda s, d: _quad(s, d).select("ticker", "quadrant"), "SELECT ticker, quadrant FROM quad", METRICS, _QUAD)
query("quadrant_summary", lambda s, d: A.metric_means(_quad(s, d).filter("quadrant IS NOT NULL"), ["quadrant"], "x", "y").select("quadrant", "company_years", *[_r(c, 4) for c in ("mean_x", "mean_y", "mean_hybrid")]), "SELECT quadrant, count(*) AS company_years, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(avg((x + y) / 2), 4) AS mean_hybrid FROM quad WHERE quadrant IS NOT NULL GROUP BY quadrant", METRICS, _QUAD)
query("quadrant_cases", lambda s, d: selection.quadrant_cases(_quad(s, d), "x", "y").select("quadrant", "ticker"), "SELECT quadrant, ticker FROM (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY CASE quadrant WHEN 'both_high' THEN -(x + y) WHEN 'both_low' THEN x + y WHEN 'keyword_high_only' THEN y - x ELSE x - y END, ticker) AS n FROM quad WHERE quadrant IS NOT NULL) WHERE n = 1", METRICS, _QUAD)
query("correlations", lambda s, d: stats.correlations(metrics(s, d).withColumn("gap", F.col("x") - F.col("y")), "x", ["y", "n_orders", "gap"], 5), " UNION ALL ".join(f"SELECT '{m}' AS comparison_metric, count(*) AS company_years, round(corr(x, v), 5) AS pearson, round(corr(rx, rv), 5) AS spearman FROM (SELECT x, v, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS rv FROM (SELECT x, cast({e} AS DOUBLE) AS v FROM metrics) WHERE v IS NOT NULL)" for m, e in (("y", "y"), ("n_orders", "n_orders"), ("gap", "x - y"))), *_M)
query("min_max_scaled", lambda s, d: stats.min_max_scaled(metrics(s, d), "x").select("ticker", _r("scaled", 6)), "SELECT ticker, round((x - lo) / (hi - lo), 6) AS scaled FROM metrics, (SELECT min(x) AS lo, max(x) AS hi FROM metrics) q", *_M)
query("high_low_tails", lambda s, d: selection.tails(metrics(s, d), "y").select("audit_bucket", "ticker", "year", "y"), "SELECT * FROM (SELECT 'high_alignment' AS audit_bucket, ticker, year, y FROM metrics WHERE y IS NOT NULL ORDER BY y DESC, ticker, year LIMIT 10) UNION ALL SELECT * FROM (SELECT 'low_alignment', ticker, year, y FROM metrics WHERE y IS NOT NULL ORDER BY y, ticker, year LIMIT 10)", *_M)
_B = [("low_oai_low_ss", "x <= x1 AND y <= y1", "x, y"), ("low_oai_high_ss", "x <= x1 AND y >= y3", "y DESC, x"), ("high_oai_low_ss", "x >= x3 AND y <= y1", "x DESC, y"), ("high_oai_high_ss", "x >= x3 AND y >= y3", "x DESC, y DESC")]
query("quartile_buckets", lambda s, d: selection.quartile_buckets(metrics(s, d), "x", "y").select("audit_bucket", "ticker"), " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS audit_bucket, ticker FROM metrics, (SELECT quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x3, quantile_cont(y, 0.25) AS y1, quantile_cont(y, 0.75) AS y3 FROM metrics WHERE y IS NOT NULL) q WHERE {c} ORDER BY {o}, ticker, year LIMIT 5)" for n, c, o in _B), *_M)
query("rescaled_gap", lambda s, d: metrics(s, d).select("ticker", alignment.rescaled(F.col("x") / 100).alias("scaled"), alignment.rescaled(F.col("x") / 100, clip=True).alias("clipped"), F.round(F.col("y") - alignment.rescaled(F.col("x") / 100), 6).alias("gap")), "SELECT ticker, round((x / 100 + 100) / 2, 6) AS scaled, round(least(greatest((x / 100 + 100) / 2, 0), 100), 6) AS clipped, round(y - round((x / 100 + 100) / 2, 6), 6) AS gap FROM metrics", *_M)
query("fixed_effects_regression", lambda s, d: stats.regression(metrics(s, d).withColumn("log_orders", F.log1p("n_orders")), "y", ["x", "log_orders"], ["sector", "year"]))
# one regressor, which SQL knows
query("simple_regression", lambda s, d: stats.regression(metrics(s, d), "y", ["x"], []), "SELECT 'intercept' AS term, round(regr_intercept(y, x), 6) AS coefficient, count(y) AS company_years, round(regr_r2(y, x), 6) AS r_squared FROM metrics WHERE y IS NOT NULL UNION ALL SELECT 'x', round(regr_slope(y, x), 6), count(y), round(regr_r2(y, x), 6) FROM metrics WHERE y IS NOT NULL", *_M)
