"""Queries on vectors, topics, progress of runs, and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelight.functions.vocabularies import CORPUS_THEMES
from panelight.operators import aggregates as A
from panelight.operators import audit, sections, topics, vectors
from panelight.plans.frames import OBS, SPARSE, observations, read, sparse, with_tables
from panelight.streaming import state

QUERIES, ORACLES = {}, {}


def query(name: str, run, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_tables(sql, *tables) if tables else sql


# Vectors: the label is the sector, the id modulo 25 the ticker
def _vectors(s, d):
    return read(s, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("sector"), (F.col("vec_id") % 25).alias("ticker"))


_UNIT = "v AS MATERIALIZED (SELECT vec_id, label AS sector, vec_id % 25 AS ticker, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM embeddings), u AS MATERIALIZED (SELECT vec_id, sector, ticker, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)"
_COS = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))"
query("vector_top_pairs", lambda s, d: vectors.top_pairs_within(_vectors(s, d), "vec_id", "embedding", ["sector", "ticker"]), f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.sector = b.sector AS same_sector, a.ticker = b.ticker AS same_ticker, round({_COS}, 8) AS cosine_similarity FROM u a JOIN u b ON a.vec_id < b.vec_id AND (a.sector = b.sector OR a.ticker = b.ticker) ORDER BY round({_COS}, 8) DESC, id_a, id_b LIMIT 500", _UNIT)
query("vector_shifts", lambda s, d: vectors.shifts(_vectors(s, d), "vec_id", "embedding", ["ticker"], ["vec_id"]).select("ticker", "id_prior", "id_current", "cosine_similarity"), f"SELECT b.ticker, a.vec_id AS id_prior, b.vec_id AS id_current, round({_COS}, 8) AS cosine_similarity FROM u b JOIN u a ON a.vec_id = b.vec_id - 25", _UNIT)


def _turn_pairs(s, d):
    """Neighbouring turns of a conversation as two texts."""
    t = read(s, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return t.join(n, ["conv_id", "turn"])


_W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]+')"
_grams = lambda c: f"SELECT conv_id, turn, '{c}' AS side, unnest(list_concat({c}, list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))) AS term FROM w"
query("turn_similarity", lambda s, d: vectors.tfidf_pair_cosine(_turn_pairs(s, d), "text", "next", ["conv_id", "turn"], 5), "SELECT conv_id, turn, coalesce(round(100 * x / nullif(y, 0), 5), 0e0) AS similarity FROM w LEFT JOIN (SELECT conv_id, turn, sum(a * i * b * i) AS x, sqrt(sum(a * i * a * i)) * sqrt(sum(b * i * b * i)) AS y FROM (SELECT conv_id, turn, term, count(*) FILTER (side = 'p') AS a, count(*) FILTER (side = 'q') AS b, ln(3e0 / (1 + count(DISTINCT side))) + 1 AS i FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (conv_id, turn)", "t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2)", f"w AS MATERIALIZED (SELECT a.conv_id, a.turn, {_W.format('a.text')} AS p, {_W.format('b.text')} AS q FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)", f"g AS ({_grams('p')} UNION ALL {_grams('q')})")
_FEATURES = 300
query("tfidf_weights", lambda s, d: topics.tfidf(observations(s, d), features=_FEATURES, pairs=False).select("id", "term", F.round("weight", 6).alias("weight")), f"SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM (SELECT id, term, (1 + ln(tf)) * (ln((1e0 + n) / (1 + df)) + 1) AS x FROM tf JOIN kept USING (term))", OBS, "tf AS MATERIALIZED (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + _W.format("text") + ") AS term FROM obs) GROUP BY 1, 2)", f"kept AS MATERIALIZED (SELECT term, df, n FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term) CROSS JOIN (SELECT count(*) AS n FROM obs) WHERE df >= 5 AND df <= 0.85 * n ORDER BY total DESC, term LIMIT {_FEATURES})")


def _topics(s, d):
    w = topics.tfidf(sparse(observations(s, d)), least=2, features=400).cache()
    scores, _, _ = topics.factorised(w, topics=4, steps=12)
    return scores


query("topic_scores", _topics)
query("topic_by_sector", lambda s, d: A.scores_by_group(_topics(s, d).join(observations(s, d).select(F.col("doc_id").alias("id"), "sector"), "id"), "sector", [f"nmf_topic_{i + 1}" for i in range(4)]))


def _doc_sections(s, d):
    o = observations(s, d).select("doc_id", "ticker", "year", "text")
    return sections.diagnostics(o, sections.parsed(o, ["doc_id", "ticker", "year"], chunk=200), ["doc_id", "ticker", "year"], CORPUS_THEMES)


query("section_diagnostics", _doc_sections)
query("section_summary", lambda s, d: sections.family_summary(_doc_sections(s, d)))
query("section_themes", lambda s, d: sections.family_themes(_doc_sections(s, d), CORPUS_THEMES))


# Progress: an event's type is its status, its user the ticker
def _events(s, d):
    e = read(s, d, "events")
    status = F.element_at(F.array(*map(F.lit, ["success", "failed", "started", "cached"])), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.when(F.col("event_type") == "click", "extraction").otherwise("cdx_discovery").alias("stage"), status.alias("status"), F.col("user_id").cast("string").alias("ticker"), (2016 + F.col("event_id") % 37 % 12).cast("int").alias("year"), F.when(F.col("event_id") % 8 == 0, F.col("event_id") % 5).alias("capture_count"), "event_id")


_EVENTS = "ev AS MATERIALIZED (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, CASE WHEN event_type = 'click' THEN 'extraction' ELSE 'cdx_discovery' END AS stage, ['success', 'failed', 'started', 'cached'][event_id % 4 + 1] AS status, cast(user_id AS VARCHAR) AS ticker, cast(2016 + event_id % 37 % 12 AS INTEGER) AS year, CASE WHEN event_id % 8 = 0 THEN event_id % 5 END AS capture_count FROM events)"
_PROGRESS = "pr AS MATERIALIZED (SELECT ticker, year, count(*) AS event_count, CASE WHEN max(CASE WHEN status IN ('success', 'cached') THEN coalesce(capture_count, 0) END) > 0 THEN 'has_capture' WHEN bool_or(status IN ('success', 'cached')) THEN 'zero_capture' WHEN bool_or(status = 'failed') THEN 'failed_only' ELSE 'incomplete' END AS status, coalesce(max(CASE WHEN status IN ('success', 'cached') THEN coalesce(capture_count, 0) END), 0) AS capture_count, arg_max(status, CASE WHEN status IN ('success', 'cached', 'failed') THEN '1' ELSE '0' END || timestamp || status) AS latest_status, substr(max(CASE WHEN status IN ('success', 'cached', 'failed') THEN '1' ELSE '0' END || timestamp), 2) AS latest_timestamp FROM ev WHERE stage = 'cdx_discovery' GROUP BY ticker, year)"
_COMPANIES = "co AS MATERIALIZED (SELECT c.ticker, count(*) FILTER (status = 'has_capture') AS a, count(*) FILTER (status = 'zero_capture') AS b, count(*) FILTER (status = 'failed_only') AS f, 9 - count(year) AS i, arg_max(year, latest_timestamp || (3000 - year)) AS latest_year, arg_max(latest_status, latest_timestamp || (3000 - year)) AS latest_status, max(latest_timestamp) AS latest_timestamp FROM (SELECT cast(c_custkey AS VARCHAR) AS ticker FROM customer) c LEFT JOIN (SELECT * FROM pr WHERE year BETWEEN 2016 AND 2024) p ON p.ticker = c.ticker GROUP BY c.ticker)"
_progress = lambda s, d: state.year_progress(_events(s, d))
_companies = lambda s, d: state.company_progress(_progress(s, d), read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker")))
query("year_progress", _progress, "SELECT * FROM pr", _EVENTS, _PROGRESS)
query("company_progress", _companies, "SELECT ticker, a + b + f AS years_completed, cast(9 AS BIGINT) AS years_expected, a AS years_with_capture, b AS years_zero_capture, f AS years_failed_only, cast(i AS BIGINT) AS years_incomplete, latest_year, latest_status, latest_timestamp FROM co", _EVENTS, _PROGRESS, _COMPANIES)
query("progress_totals", lambda s, d: state.progress_totals(_companies(s, d)), "SELECT count(*) FILTER (a + b + f > 0) AS companies_seen, count(*) FILTER (a + b + f = 9) AS companies_completed, count(*) AS companies_expected, cast(sum(a + b + f) AS BIGINT) AS company_years_completed, 9 * count(*) AS company_years_expected, cast(sum(a) AS BIGINT) AS company_years_with_capture, cast(sum(b) AS BIGINT) AS company_years_zero_capture, cast(sum(f) AS BIGINT) AS company_years_failed_only, cast(sum(i) AS BIGINT) AS company_years_incomplete FROM co", _EVENTS, _PROGRESS, _COMPANIES)
query("status_counts", lambda s, d: state.stage_counts(_events(s, d)), "SELECT stage || ':' || status AS stage_status, count(*) AS n, max(timestamp) AS latest FROM ev GROUP BY 1", _EVENTS)
query("latest_state", lambda s, d: state.latest_state(_events(s, d), ["ticker"], order="event_id"), "SELECT ticker, count(*) AS event_count, arg_max(status, timestamp || lpad(cast(event_id AS VARCHAR), 12, '0')) AS latest_status, max(timestamp) AS latest_timestamp FROM ev GROUP BY ticker", _EVENTS)


def _cache(s, d):
    return _events(s, d).groupBy("ticker", F.lit("u").alias("candidate_url"), "year").agg(F.min("status").alias("collection_status"), F.min("event_id").alias("i")).select("ticker", "candidate_url", "year", F.when(F.col("collection_status") == "failed", "failed").otherwise("success").alias("collection_status"), F.array_repeat(F.lit(1), (F.col("i") % 3).cast("int")).alias("captures"), (F.col("i") % 2 == 0).alias("fallback_tried"))


_CACHE = "ca AS MATERIALIZED (SELECT ticker, year, CASE WHEN min(status) = 'failed' THEN 'failed' ELSE 'success' END AS st, min(event_id) AS i FROM ev GROUP BY ticker, year)"
_wanted = lambda s, d: _events(s, d).select("ticker").distinct().select("ticker", F.lit("u").alias("candidate_url"), F.explode(F.sequence(F.lit(2016), F.lit(2024))).alias("year"))
query("to_query", lambda s, d: state.to_query(_wanted(s, d), _cache(s, d), new_fallback=True), "SELECT t.ticker, 'u' AS candidate_url, cast(y AS INTEGER) AS year FROM (SELECT DISTINCT ticker FROM ev) t, range(2016, 2025) r(y) WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.ticker = t.ticker AND ca.year = y AND st = 'success' AND NOT (i % 3 = 0 AND i % 2 <> 0))", _EVENTS, _CACHE)
_answers = lambda s, d: _cache(s, d).filter("year <= 2018").select("ticker", "candidate_url", "year", F.when(F.size("captures") == 1, "failed").otherwise("success").alias("collection_status"), F.array(F.lit(9)).alias("captures"), F.lit(True).alias("fallback_tried"))
query("refreshed_cache", lambda s, d: state.refreshed(_cache(s, d), _answers(s, d)).select("ticker", "year", "collection_status", F.size("captures").alias("n")), "SELECT ticker, year, CASE WHEN year <= 2018 AND (i % 3 <> 1 OR st = 'failed') THEN CASE WHEN i % 3 = 1 THEN 'failed' ELSE 'success' END ELSE st END AS collection_status, cast(CASE WHEN year <= 2018 AND (i % 3 <> 1 OR st = 'failed') THEN 1 ELSE i % 3 END AS INTEGER) AS n FROM ca", _EVENTS, _CACHE)


# Audits over a dataset with faults
def _final(s, d):
    rows = sparse(observations(s, d))
    n = F.col("doc_id")
    usable = n % 3 != 0
    return rows.select("ticker", F.lit("name").alias("company_name"), "sector", "year", F.when(usable, "usable").when(n % 2 == 0, "retrieval_failed").otherwise("discovery_incomplete").alias("observation_status"), F.when(~usable & (n % 5 != 0), "why").alias("gap_reason"), F.when(usable & (n % 7 != 0), "http://x").otherwise(" ").alias("source_url"), F.lit("2024").alias("capture_timestamp"), F.when(n % 2 == 0, "theme").alias("theme_categories"), F.when(n % 4 == 0, "[]").alias("theme_evidence"), F.when(n % 9 == 0, "False").alias("changed_from_prior"), F.when(n % 2 == 0, "review_required").otherwise("usable").alias("extraction_quality"))


_F = "f AS MATERIALIZED (SELECT *, doc_id % 3 <> 0 AS ok FROM sparse)"
query("stated_audit", lambda s, d: audit.stated_audit(_final(s, d).drop("company_name"), companies=20), "SELECT name, v = 0 AS passed, cast(v AS BIGINT) AS failures FROM (SELECT unnest(['expected_record_count', 'unique_company_year_keys', 'expected_company_count', 'required_fields_present', 'llm_analysis_completed', 'years_within_scope', 'failures_have_reasons', 'usable_records_traceable', 'themes_have_evidence', 'missing_records_do_not_claim_no_change', 'discovery_queries_completed']) AS name, unnest([abs(count(*) - 180), 0, abs(count(DISTINCT ticker) - 20), 1, 1, 0, count(*) FILTER (NOT ok AND doc_id % 5 = 0), count(*) FILTER (ok AND doc_id % 7 = 0), count(*) FILTER (doc_id % 2 = 0 AND doc_id % 4 <> 0), count(*) FILTER (NOT ok AND doc_id % 9 = 0), count(*) FILTER (NOT ok AND doc_id % 2 <> 0)]) AS v FROM f)", OBS, SPARSE, _F)
query("audit_issues", lambda s, d: audit.issues(_final(s, d), {k: v for k, v in audit.stated_rules().items() if k in ("failures_have_reasons", "usable_records_traceable")}), "SELECT 'failures_have_reasons' AS name, ticker || ':' || year AS cell FROM f WHERE NOT ok AND doc_id % 5 = 0 UNION ALL SELECT 'usable_records_traceable', ticker || ':' || year FROM f WHERE ok AND doc_id % 7 = 0", OBS, SPARSE, _F)
query("dataset_audit", lambda s, d: audit.dataset_audit(_final(s, d).drop("theme_evidence", "source_url")), "SELECT false AS passed, count(*) AS row_count, count(DISTINCT ticker || ':' || year) AS unique_company_years, count(*) FILTER (NOT ok AND doc_id % 5 = 0) AS nonusable_without_gap_reason, 'source_url,theme_evidence' AS missing_required_columns FROM f", OBS, SPARSE, _F)
query("review_decisions", lambda s, d: audit.review_decisions(_final(s, d)).select("ticker", "year", "review_reason", "observation_status", "decision"), "SELECT ticker, year, CASE WHEN ok THEN CASE WHEN doc_id % 2 = 0 THEN 'review_required' ELSE 'usable' END WHEN doc_id % 5 <> 0 THEN 'why' END AS review_reason, CASE WHEN ok THEN 'usable' WHEN doc_id % 2 = 0 THEN 'retrieval_failed' ELSE 'discovery_incomplete' END AS observation_status, CASE WHEN ok AND doc_id % 2 = 0 THEN 'retain_for_analysis_with_extraction_flags' WHEN ok THEN 'retain_for_analysis' ELSE 'retain_gap_status_exclude_from_substantive_text_analysis' END AS decision FROM f", OBS, SPARSE, _F)
query("registry_audit", lambda s, d: audit.registry_audit(read(s, d, "orders").select(F.when(F.col("o_custkey") % 40 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("ticker")), read(s, d, "customer").select(F.col("c_custkey").alias("ticker"))), "SELECT DISTINCT t AS ticker, 'unknown' AS side FROM o WHERE t NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT t FROM o)", "o AS (SELECT CASE WHEN o_custkey % 40 = 0 THEN -o_custkey ELSE o_custkey END AS t FROM orders)")
query("manifest_audit", lambda s, d: audit.manifest_audit(read(s, d, "nation").select("n_nationkey", F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("sector")), total=25, sectors=5, each=5), "SELECT count(*) = 25 AND count(DISTINCT n_name) = 25 AND (SELECT count(*) = 5 AND min(n) = 5 AND max(n) = 5 FROM r) AS passed, count(*) AS companies, count(DISTINCT n_name) AS tickers, (SELECT count(*) FROM r) AS sectors, (SELECT min(n) FROM r) AS least, (SELECT max(n) FROM r) AS greatest FROM nation", "r AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)")
query("join_check", lambda s, d: audit.join_check(read(s, d, "customer").select(F.col("c_custkey").alias("k")), read(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]), "SELECT (SELECT count(*) FROM orders) AS row_count, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS joinable, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS covers_all")


def _lived(s, d):
    n = F.col("o_orderkey")
    one = F.lit("x")
    return read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), (2016 + n % 9).cast("int").alias("year"), F.when(n % 4 != 0, "collected").otherwise("missing").alias("collection_status"), F.when(n % 8 != 0, "gap").alias("gap_reason"), one.alias("cik"), one.alias("accession_number"), one.alias("sec_archive_url"), one.alias("raw_file_path"), (n % 10).alias("raw_file_bytes"), one.alias("raw_content_sha256"), one.alias("clean_text_sha256"), (n % 3000).alias("word_count"))


query("lived_audit", lambda s, d: audit.lived_audit(_lived(s, d)), "SELECT count(*) = 450 AS same_50_company_grid, count(DISTINCT o_orderkey % 9) = 9 AS year_window, bool_and(o_orderkey % 4 <> 0 OR o_orderkey % 8 <> 0) AS all_rows_have_status_or_gap, bool_and(o_orderkey % 4 = 0 OR (o_orderkey % 10 > 0 AND o_orderkey % 3000 >= 1000)) AS successful_rows_have_source_hash_and_text_metrics, bool_or(o_orderkey % 4 <> 0 AND o_orderkey % 10 > 0 AND o_orderkey % 3000 >= 1000) AS has_real_success_evidence, count(*) FILTER (o_orderkey % 4 <> 0) AS collected_rows, count(*) AS target_rows, count(*) FILTER (o_orderkey % 4 = 0) AS manual_review_required_rows FROM orders")
query("value_counts", lambda s, d: A.counter(read(s, d, "part").select("p_brand", "p_type"), ["p_brand", "p_type"]), "SELECT p_brand, p_type, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 100")
