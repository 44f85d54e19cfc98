"""Queries on captures, URLs and pages.  Events stand for captures: their time, and URL, status and type by their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelight.functions import html, urls
from panelight.operators import captures as C
from panelight.plans.frames import read, with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, run, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_tables(sql, *tables) if tables else sql


PAGES = ["https://a.example.org/about-us", "https://a.example.org/investor/news", "https://a.example.org/our-company/values.html", "https://a.example.org/media/logo.png", "https://a.example.org/default.aspx", "https://a.example.org/x"]


def captures(s, d):
    """ticker (user), year, target (day 15 of January at noon), candidate page, and the capture."""
    e = read(s, d, "events")
    page = F.element_at(F.array(*map(F.lit, PAGES)), (F.col("event_id") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["values", "about", "other"])), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.when(F.col("user_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, 301).otherwise(404)).when(F.col("event_id") % 7 == 0, 404).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(200)
    mime = F.when(F.col("event_id") % 13 == 0, "warc/revisit").when(F.col("event_id") % 5 == 0, "application/pdf").otherwise("text/html")
    return e.select(F.col("user_id").alias("ticker"), F.lit(2024).alias("year"), F.lit("2024-01-15 12:00:00").cast("timestamp").alias("target_timestamp"), page.alias("candidate_url"), page.alias("normalized_url"), kind.alias("page_type"), F.col("ts").cast("timestamp").alias("timestamp"), F.concat(page, F.lit("?e="), F.col("event_id").cast("string")).alias("original_url"), status.cast("int").alias("status_code"), mime.alias("mime_type"), F.col("event_id").cast("string").alias("digest"), F.col("event_id").alias("length"))


_ASSET = r"(?i)(?:/media/|/images?/|/assets?/|/static/|/~/media/|\.(?:ashx|css|gif|ico|jpe?g|js|pdf|png|svg|webp)(?:[?#]|$))"
CAPTURES = f"""cap AS MATERIALIZED (SELECT *, coalesce(status_code = 200 AND mime_type = 'text/html', false) AS good, regexp_matches(original_url, '{_ASSET}') AS asset, abs(epoch_us(ts) - 1705320000000000) AS delta FROM
 (SELECT event_id, user_id AS ticker, ts, p AS page, p || '?e=' || event_id AS original_url, ['values', 'about', 'other'][event_id % 3 + 1] AS page_type,
 CASE WHEN user_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 301 ELSE 404 END WHEN event_id % 7 = 0 THEN 404 WHEN event_id % 11 = 0 THEN NULL ELSE 200 END AS status_code,
 CASE WHEN event_id % 13 = 0 THEN 'warc/revisit' WHEN event_id % 5 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime_type
 FROM (SELECT *, [{', '.join(f"'{p}'" for p in PAGES)}][event_id % 6 + 1] AS p FROM events))),
rep AS MATERIALIZED (SELECT *, NOT asset AND (good OR coalesce(status_code IN (301, 302, 303, 307, 308) AND mime_type = 'text/html', false) OR mime_type = 'warc/revisit') AS ok FROM cap)"""
query("ranked_captures", lambda s, d: C.ranked_annual(captures(s, d), fallback=False).select("ticker", F.col("length").alias("event_id"), "rank"), "SELECT ticker, event_id, cast(row_number() OVER (PARTITION BY ticker ORDER BY delta, ts, original_url) AS INTEGER) AS rank FROM rep WHERE good AND NOT asset AND year(ts) = 2024", CAPTURES)
_NEAR = "near AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY delta, CASE WHEN good OR status_code IN (301, 302, 303, 307, 308) THEN 0 ELSE 1 END, ts, original_url) AS n FROM (SELECT *, bool_or(good AND NOT asset) OVER (PARTITION BY ticker) AS has_good FROM rep WHERE year(ts) = 2024) WHERE (good AND NOT asset) OR (NOT has_good AND ok))"
query("nearest_capture", lambda s, d: C.nearest(captures(s, d)).select("ticker", F.col("length").alias("event_id"), "status_code"), "SELECT ticker, event_id, status_code FROM near WHERE n = 1", CAPTURES, _NEAR)
_like = lambda terms: " OR ".join(f"contains(t, '{x}')" for x in terms)
_TABLE = f"""tab AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN good THEN 0 ELSE 1 END, CASE WHEN {_like(C.PRIMARY_TERMS)} THEN 0 WHEN {_like(C.SECONDARY_TERMS)} THEN 1 ELSE 2 END,
 {' + '.join(f"CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END" for x in C.LOW_VALUE_TERMS)}, delta, ts, original_url, page) AS rank FROM (SELECT *, lower(page_type || ' ' || page || ' ' || original_url) AS t FROM rep))"""
query("capture_candidates", lambda s, d: C.candidate_table(captures(s, d)).select("ticker", F.col("length").alias("event_id"), "rank", "eligible", "rejection_reason", "selected", "distance_seconds", "replay_url"), "SELECT ticker, event_id, cast(rank AS INTEGER) AS rank, ok AS eligible, CASE WHEN ok THEN '' WHEN asset THEN 'asset_or_document_url' WHEN status_code IS DISTINCT FROM 200 THEN 'status_code_' || coalesce(cast(status_code AS VARCHAR), 'None') ELSE 'non_html_mime_type_' || mime_type END AS rejection_reason, coalesce(rank = min(CASE WHEN ok THEN rank END) OVER (PARTITION BY ticker), false) AS selected, delta // 1000000 AS distance_seconds, 'https://web.archive.org/web/' || strftime(ts, '%Y%m%d%H%M%S') || 'id_/' || original_url AS replay_url FROM tab", CAPTURES, _TABLE)


def _annual(s, d):
    """Targets of 2023 to 2025; pages of a ticker are valid for some years, and queries of some fail."""
    spark_captures = captures(s, d)
    pages = spark_captures.select("ticker", "candidate_url", "normalized_url", "page_type").groupBy("ticker", "candidate_url", "normalized_url").agg(F.min("page_type").alias("page_type"))
    n = F.length("candidate_url") + F.col("ticker")
    candidates = pages.select("*", F.when(n % 4 == 0, "rejected").when(n % 4 == 1, "approved").otherwise("eligible").alias("eligibility_status"), F.when(F.col("ticker") % 3 == 0, 2024).otherwise(2020).alias("valid_from_year"), F.lit(2024).alias("valid_to_year"))
    targets = spark_captures.select("ticker").distinct().withColumn("year", F.explode(F.array(F.lit(2023), F.lit(2024), F.lit(2025)))).withColumn("target_timestamp", F.make_timestamp("year", F.lit(1), F.lit(15), F.lit(12), F.lit(0), F.lit(0)))
    found = spark_captures.groupBy("ticker", "candidate_url", "year").agg(F.collect_list(F.struct("timestamp", "original_url", "status_code", "mime_type", "digest", "length")).alias("captures"))
    asked = candidates.select("ticker", "candidate_url").withColumn("year", F.explode(F.array(F.lit(2023), F.lit(2024)))).join(found, ["ticker", "candidate_url", "year"], "left")
    m = F.length("candidate_url") + F.col("ticker") * 2 + F.col("year")
    records = asked.filter(m % 9 != 0).select("*", F.when((m % 5 == 0) | (F.col("ticker") % 17 == 0), "failed").otherwise("success").alias("collection_status"), F.lit(2).cast("long").alias("attempt_count"))
    return C.annual_outputs(targets, candidates, records)


_ANNUAL = [
    "pages_of AS (SELECT ticker, page, min(page_type) AS page_type FROM cap GROUP BY ticker, page)",
    "cand AS (SELECT *, (length(page) + ticker) % 4 AS k, CASE WHEN ticker % 3 = 0 THEN 2024 ELSE 2020 END AS y1, 2024 AS y2 FROM pages_of)",
    "tgt AS (SELECT ticker, y.year FROM (SELECT DISTINCT ticker FROM cap) t CROSS JOIN (VALUES (2023), (2024), (2025)) y(year))",
    "rel AS (SELECT t.ticker, t.year, c.page, CASE WHEN t.year > 2024 OR (length(c.page) + t.ticker * 2 + t.year) % 9 = 0 THEN NULL WHEN (length(c.page) + t.ticker * 2 + t.year) % 5 = 0 OR t.ticker % 17 = 0 THEN 'failed' ELSE 'success' END AS st FROM tgt t JOIN cand c ON c.ticker = t.ticker AND c.k <> 0 AND t.year BETWEEN y1 AND y2)",
    "hit AS (SELECT r.ticker, r.year, p.* EXCLUDE (ticker) FROM rel r JOIN rep p ON p.ticker = r.ticker AND p.page = r.page AND r.st = 'success' AND year(p.ts) = r.year)",
    f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY CASE WHEN good THEN 0 ELSE 1 END, CASE WHEN {_like(C.PRIMARY_TERMS)} THEN 0 WHEN {_like(C.SECONDARY_TERMS)} THEN 1 ELSE 2 END, {' + '.join(f'''CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END''' for x in C.LOW_VALUE_TERMS)}, delta, ts, original_url, page) AS n FROM (SELECT h.*, lower(c.page_type || ' ' || h.page || ' ' || original_url) AS t FROM hit h JOIN pages_of c ON c.ticker = h.ticker AND c.page = h.page WHERE ok)) WHERE n = 1)",
    "cnt AS (SELECT t.ticker, t.year, (SELECT count(*) FROM rel r WHERE r.ticker = t.ticker AND r.year = t.year) AS pages, (SELECT count(*) FROM rel r WHERE r.ticker = t.ticker AND r.year = t.year AND st = 'success') AS good, (SELECT 2 * count(st) FROM rel r WHERE r.ticker = t.ticker AND r.year = t.year) AS attempts, (SELECT count(*) FROM hit h WHERE h.ticker = t.ticker AND h.year = t.year) AS caps, (SELECT count(*) FROM hit h WHERE h.ticker = t.ticker AND h.year = t.year AND ok) AS oks FROM tgt t)",
]
query("annual_status", lambda s, d: _annual(s, d)[1].select("ticker", "year", "acquisition_status", "query_status", "eligible_page_count", "capture_count", "eligible_capture_count", "query_attempt_count", "selected_original_url"), "SELECT c.ticker, c.year, CASE WHEN b.original_url IS NOT NULL THEN 'selected' WHEN pages = 0 THEN 'no_eligible_page' WHEN pages > c.good AND c.good = 0 THEN 'discovery_incomplete' WHEN pages > c.good AND caps = 0 THEN 'discovery_incomplete' WHEN caps = 0 THEN 'no_cdx_capture' ELSE 'no_eligible_capture' END AS acquisition_status, CASE WHEN pages = 0 THEN 'not_applicable' WHEN pages > c.good THEN 'incomplete' ELSE 'complete' END AS query_status, pages AS eligible_page_count, caps AS capture_count, oks AS eligible_capture_count, attempts AS query_attempt_count, b.original_url AS selected_original_url FROM cnt c LEFT JOIN best b ON b.ticker = c.ticker AND b.year = c.year", CAPTURES, *_ANNUAL)


def _recovered(s, d):
    table = C.candidate_table(captures(s, d))
    status = table.groupBy("ticker", "year").agg(F.max(F.when(F.col("selected"), F.col("replay_url"))).alias("selected_replay_url"), F.max(F.when(F.col("selected"), F.col("timestamp"))).alias("selected_capture_timestamp"), F.max(F.when(F.col("selected"), F.col("original_url"))).alias("selected_original_url")).withColumns({"acquisition_status": F.lit("selected"), "failure_reason": F.lit("")})
    final = status.select("ticker", "year", F.when(F.col("ticker") % 2 == 0, "insufficient_substantive_text").otherwise("usable").alias("observation_status"), F.lit("").alias("wayback_url"))
    return C.recovered(status, table, final, scope=status.filter("ticker % 3 <> 0"))


query("recovered_captures", lambda s, d: _recovered(s, d).select("ticker", "selected_original_url", "recovered"), "SELECT f.ticker, coalesce(CASE WHEN f.ticker % 2 = 0 AND f.ticker % 3 <> 0 THEN g.original_url END, f.original_url) AS selected_original_url, coalesce(f.ticker % 2 = 0 AND f.ticker % 3 <> 0 AND g.original_url IS NOT NULL, false) AS recovered FROM (SELECT t.ticker, o.original_url FROM (SELECT DISTINCT ticker FROM cap) t LEFT JOIN (SELECT * FROM el WHERE n = 1) o ON o.ticker = t.ticker) f LEFT JOIN (SELECT * FROM el WHERE n = 2) g ON g.ticker = f.ticker", CAPTURES, _TABLE, "el AS (SELECT ticker, original_url, row_number() OVER (PARTITION BY ticker ORDER BY rank) AS n FROM tab WHERE ok)")


def _records(s, d):
    e = read(s, d, "events")
    return e.groupBy(F.col("user_id").alias("ticker"), F.col("event_type").alias("candidate_url"), (2016 + F.col("event_id") % 3).cast("int").alias("year")).agg(F.count("*").alias("attempt_count"), F.min("event_id").alias("i")).select("ticker", "candidate_url", F.col("candidate_url").alias("normalized_url"), "year", F.when(F.col("i") % 3 == 0, "failed").otherwise("success").alias("collection_status"), "attempt_count", F.array_repeat(F.col("i"), (F.col("i") % 4).cast("int")).alias("captures"), F.lit(200).alias("response_status"), F.when(F.col("i") % 3 == 0, F.array(F.lit("Timeout: a"), F.lit("HTTPError: b"), F.lit("Timeout: c"))).alias("errors"))


_RECORDS = "rec AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'failed' ELSE 'success' END AS st FROM (SELECT user_id AS ticker, event_type AS candidate_url, cast(2016 + event_id % 3 AS INTEGER) AS year, count(*) AS n, min(event_id) AS i FROM events GROUP BY 1, 2, 3))"
query("query_log", lambda s, d: C.query_log(_records(s, d)).select("ticker", "candidate_url", "year", "query_status", "attempt_count", "capture_count", "error_types"), "SELECT ticker, candidate_url, year, st AS query_status, n AS attempt_count, cast(i % 4 AS INTEGER) AS capture_count, CASE WHEN i % 3 = 0 THEN 'HTTPError;Timeout' ELSE '' END AS error_types FROM rec", _RECORDS)
query("candidate_status", lambda s, d: C.candidate_status(_records(s, d)), "SELECT ticker, candidate_url, CASE WHEN count(*) = count(*) FILTER (st = 'success') THEN 'success' WHEN count(*) FILTER (st = 'success') > 0 THEN 'partial' ELSE 'failed' END AS collection_status, cast(sum(n) AS BIGINT) AS attempt_count FROM rec GROUP BY ticker, candidate_url", _RECORDS)


def _artifacts(s, d):
    flags = F.array_compact(F.array(F.when(F.col("doc_id") % 5 == 0, "short_text"), F.when(F.col("doc_id") % 7 == 0, "low_alpha_ratio")))
    return read(s, d, "documents").select("doc_id", F.col("text").alias("page_text_clean"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("success").alias("fetch_status"), flags.alias("qa_flags"), (F.col("doc_id") % 60).alias("clean_word_count"))


query("usable_artifacts", lambda s, d: _artifacts(s, d).filter(C.usable_artifact()).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND trim(coalesce(text, '')) <> '' AND doc_id % 7 <> 0 AND doc_id % 60 >= 25")
from panelight.operators.aggregates import flag_counts  # noqa: E402

query("quality_flag_counts", lambda s, d: flag_counts(_artifacts(s, d)), "SELECT 'short_text' AS flag, count(*) FILTER (doc_id % 5 = 0) AS n, round(count(*) FILTER (doc_id % 5 = 0) * 1e0 / count(*), 6) AS share FROM documents UNION ALL SELECT 'low_alpha_ratio', count(*) FILTER (doc_id % 7 = 0), round(count(*) FILTER (doc_id % 7 = 0) * 1e0 / count(*), 6) FROM documents")

# URLs and pages
_PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_has = lambda p, words: " OR ".join(f"contains({p}, '{w}')" for w in words)
_POINTS = " + ".join(["CASE WHEN contains(sp, 'who we are') THEN 9 ELSE 0 END", *[f"CASE WHEN contains(p, '{k}') OR contains(sp, '{k}') THEN 5 ELSE 0 END" for k in urls.IDENTITY_KEYWORDS], f"CASE WHEN {_has('p', urls.ABOUT_FORMS)} THEN 4 ELSE 0 END", "CASE WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '')) <= 4 THEN 2 ELSE 0 END", f"CASE WHEN {_has('p', urls.OFF_TOPIC)} THEN -3 ELSE 0 END"])
_U = "u AS (SELECT page_id, url, p, replace(replace(p, '-', ' '), '_', ' ') AS sp FROM (SELECT page_id, url, " + _PATH + " AS p FROM (SELECT page_id, url || ['/about-us', '/news/x', '/Our_Company/who-we-are', '/a/b/c/d/e/f', '/logo.png'][page_id % 5 + 1] AS url FROM pages)))"


def _page_urls(s, d):
    more = F.element_at(F.array(*map(F.lit, ["/about-us", "/news/x", "/Our_Company/who-we-are", "/a/b/c/d/e/f", "/logo.png"])), (F.col("page_id") % 5 + 1).cast("int"))
    return read(s, d, "pages").select("page_id", F.concat("url", more).alias("url"))


query("url_scores", lambda s, d: _page_urls(s, d).select("page_id", urls.identity_score("url").alias("score"), urls.page_type("url").alias("page_type")), f"SELECT page_id, cast(CASE WHEN regexp_matches(p, '{urls.ASSET_PATH}') THEN 0 ELSE {_POINTS} END AS INTEGER) AS score, CASE WHEN contains(p, 'values') OR contains(p, 'principles') THEN 'values' WHEN contains(p, 'mission') THEN 'mission' WHEN contains(p, 'purpose') THEN 'purpose' ELSE 'about' END AS page_type FROM u", _U)
query("normalised_urls", lambda s, d: read(s, d, "pages").select("page_id", urls.normalised(F.concat(F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "^https", "HTTPS"), F.lit("/?utm_source=a&b=2&a=1#top"))).alias("url")), "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^([^:]+://[^/]*)', 1)) || regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1), '/+$', '') || CASE WHEN regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1) = '' THEN '/' ELSE '' END || '?a=1&b=2' AS url FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS url FROM pages)")
query("best_domain_urls", lambda s, d: C.best_urls(_page_urls(s, d).select((F.col("page_id") % 10).alias("ticker"), F.col("page_id").alias("timestamp"), F.col("url").alias("original_url"))).select("ticker", "url", "score", "rank"), f"SELECT ticker, url, score, cast(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), url) AS n FROM (SELECT page_id % 10 AS ticker, url, cast(CASE WHEN regexp_matches(p, '{urls.ASSET_PATH}') THEN 0 ELSE {_POINTS} END AS INTEGER) AS score FROM u) WHERE score > 0) WHERE n <= 3", _U)
query("url_variants", lambda s, d: C.best_variants(_page_urls(s, d)))
query("page_texts", lambda s, d: html.extracted(read(s, d, "pages")).drop("url"))
query("homepage_links", lambda s, d: html.homepage_links(read(s, d, "pages"), keywords=("the", "der", "de")).select("page_id", "link"), "SELECT DISTINCT page_id, lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)) || h AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\">', 1)) AS h, unnest(regexp_extract_all(html, '<a href=\"/[^\"]*\">([^<]*)', 1)) AS t FROM pages) WHERE regexp_matches(lower(h) || ' ' || lower(t), 'the|der|de')")
query("filing_texts", lambda s, d: read(s, d, "pages").select("page_id", html.filing_text("html").alias("text")))


def _filings(s, d):
    o = read(s, d, "orders")
    form = F.element_at(F.array(F.lit("DEF 14A"), F.lit("DEFA14A"), F.lit("10-K")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("ticker"), form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.lit("").alias("reportDate"), F.col("o_orderkey").cast("string").alias("accessionNumber"), F.when(F.col("o_orderkey") % 5 != 0, "doc.htm").otherwise("").alias("primaryDocument"))


def _filing_targets(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("ticker")).withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(1998))))


query("selected_filings", lambda s, d: C.selected_filings(_filings(s, d), _filing_targets(s, d), supplements=True).select("ticker", "year", "form", "filingDate", "accessionNumber"), "SELECT t.ticker, t.year, form, filingDate, accessionNumber FROM (SELECT c_custkey AS ticker, cast(y AS INTEGER) AS year FROM customer, range(1995, 1999) r(y)) t LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, left(filingDate, 4) ORDER BY form <> 'DEF 14A', filingDate, accessionNumber) AS n FROM (SELECT o_custkey AS ticker, ['DEF 14A', 'DEFA14A', '10-K'][o_orderkey % 3 + 1] AS form, strftime(o_orderdate, '%Y-%m-%d') AS filingDate, cast(o_orderkey AS VARCHAR) AS accessionNumber FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 5 <> 0)) WHERE n = 1) f ON f.ticker = t.ticker AND left(filingDate, 4) = cast(t.year AS VARCHAR)")
