"""Archive captures: which of them count, how they rank, which one stands for a company's year.

A capture row has timestamp, original_url, status_code, mime_type, digest and
length; a candidate page has candidate_url, normalized_url, page_type and its
years.  Ranks are windows over a company's year, whose captures are few.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.functions import urls
from panelight.functions.text import truthy
from panelight.operators.panel import within_validity

# What makes a capture readable, and words of pages that state values or don't.
HTML_TYPES = ("text/html", "application/xhtml+xml")
REDIRECTS = (301, 302, 303, 307, 308)
ELIGIBLE = ("approved", "eligible")
PRIMARY_TERMS = ("mission", "values", "purpose", "vision", "who-we-are", "who_we_are", "company-overview", "company_overview", "overview", "about-us", "about_us", "aboutus", "about/")
SECONDARY_TERMS = ("default.aspx", "backgrounder", "factsheet", "fact-sheet", "company-information")
LOW_VALUE_TERMS = ("awards", "board", "management", "officer", "executive", "governance", "corpgov", "history", "foundation", "research", "/rd/", "refiner", "where-we-operate", "investor", "shareholder", "stockholder", "media", "press", "news", "privacy", "terms")
BLOCKING_FLAGS = ("empty_text", "likely_error_page", "low_alpha_ratio")
RECOVERABLE = ("retrieval_failed", "redirect_unresolved", "non_html_capture", "soft_404_or_error_page", "insufficient_substantive_text", "extraction_failed")
INDEX_FIELDS = ("timestamp", "original", "statuscode", "mimetype", "digest", "length")

CAPTURE = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("original_url", T.StringType()), T.StructField("status_code", T.IntegerType()), T.StructField("mime_type", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("length", T.LongType())])
YEAR_RECORD = T.StructType([T.StructField(n, t) for n, t in (("ticker", T.StringType()), ("candidate_url", T.StringType()), ("normalized_url", T.StringType()), ("year", T.IntegerType()), ("collection_status", T.StringType()), ("attempt_count", T.LongType()), ("captures", T.ArrayType(CAPTURE)))])


def _any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def html_success(status: Column | str = "status_code", mime: Column | str = "mime_type") -> Column:
    s, m = (F.col(c) if isinstance(c, str) else c for c in (status, mime))
    return F.coalesce((s == 200) & m.isin(*HTML_TYPES), F.lit(False))


def html_like(status: str = "status_code", mime: str = "mime_type") -> Column:
    """The other test of success: any type that begins with text/html."""
    return F.coalesce((F.col(status) == 200) & F.lower(F.col(mime)).startswith("text/html"), F.lit(False))


def replayable(status: str = "status_code", mime: str = "mime_type", url: str = "original_url") -> Column:
    """HTML, a redirect to HTML or a revisit record; never an asset."""
    redirect = F.col(status).isin(*REDIRECTS) & F.col(mime).isin(*HTML_TYPES)
    return ~urls.is_asset(url) & (html_success(status, mime) | F.coalesce(redirect, F.lit(False)) | F.coalesce(F.col(mime) == "warc/revisit", F.lit(False)))


def eligible_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("eligibility_status").isin(*ELIGIBLE))


def kept_generated(domain_discovery: bool, method: str = "discovery_method") -> Column:
    """Generated candidates that stay: URL variants never, those of a domain's index only where that is enabled."""
    m = F.coalesce(F.col(method), F.lit(""))
    return F.when(m == "historical_url_variant", False).when(m == "historical_domain_cdx_url", domain_discovery).otherwise(True)


def usable_artifact(status: str = "fetch_status", text: str = "page_text_clean", flags: str = "qa_flags", words: str = "clean_word_count", minimum: int = 25) -> Column:
    blocked = F.coalesce(F.arrays_overlap(F.col(flags), F.array(*map(F.lit, BLOCKING_FLAGS))), F.lit(False))
    return F.coalesce(F.col(status) != "failed", F.lit(True)) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & ~blocked & (F.coalesce(F.col(words), F.lit(0)) >= minimum)


def distance(timestamp: str = "timestamp", target: str = "target_timestamp") -> Column:
    """Microseconds between a capture and the target."""
    return F.abs(F.unix_micros(F.col(timestamp).cast("timestamp")) - F.unix_micros(F.col(target).cast("timestamp")))


def ranked_annual(captures: DataFrame, key=("ticker", "year"), fallback: bool = True) -> DataFrame:
    """The same-year captures of each key that count, with ``rank``, nearest to the target first, then earliest, then by URL.

    Where a key has no HTML success, and with ``fallback``, its other replayable captures are ranked, redirects first among equals.
    """
    same = captures.filter(F.year(F.col("timestamp").cast("timestamp")) == F.year(F.col("target_timestamp").cast("timestamp")))
    good = html_success() & ~urls.is_asset("original_url")
    marked = same.select("*", good.alias("__good"), distance().alias("__d")).withColumn("__any", F.max("__good").over(Window.partitionBy(*key)))
    counted = marked.filter(F.col("__good") | (~F.col("__any") & replayable())) if fallback else marked.filter("__good")
    order = [F.col("__d"), F.when(F.col("__good"), 0).when(F.col("status_code").isin(*REDIRECTS), 0).otherwise(1), F.col("timestamp"), F.col("original_url")]
    w = Window.partitionBy(*key).orderBy(*order)
    return counted.withColumn("rank", F.row_number().over(w)).drop("__good", "__d", "__any")


def nearest(captures: DataFrame, key=("ticker", "year"), fallback: bool = True) -> DataFrame:
    """One capture of each key: the first of ``ranked_annual``."""
    return ranked_annual(captures, key, fallback).filter("rank = 1").drop("rank")


def page_priority(text: Column) -> Column:
    """0 for pages that state values, 1 for neighbours of them, 2 for others."""
    return F.when(_any(text, PRIMARY_TERMS), 0).when(_any(text, SECONDARY_TERMS), 1).otherwise(2)


def low_value_terms(text: Column) -> Column:
    return reduce(add, [text.contains(t).cast("int") for t in LOW_VALUE_TERMS])


def candidate_table(captures: DataFrame, key=("ticker", "year")) -> DataFrame:
    """Every capture with replay_url, distance_seconds, rank, eligible, rejection_reason and selected (the first eligible of its key)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("page_type", F.lit("")), F.coalesce("candidate_url", F.lit("")), F.coalesce("original_url", F.lit(""))))
    marked = captures.select("*", text.alias("__t"), distance().alias("__d"), replayable().alias("eligible"))
    order = [(~html_success()).cast("int"), page_priority(F.col("__t")), low_value_terms(F.col("__t")), F.col("__d"), F.col("timestamp"), F.col("original_url"), F.col("normalized_url")]
    ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    first = F.min(F.when(F.col("eligible"), F.col("rank"))).over(Window.partitionBy(*key))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    reason = F.when(F.col("eligible"), "").when(urls.is_asset("original_url"), "asset_or_document_url").when(~F.equal_null(F.col("status_code"), F.lit(200)), F.concat(F.lit("status_code_"), none("status_code"))).otherwise(F.concat(F.lit("non_html_mime_type_"), none("mime_type")))
    stamp = F.date_format(F.col("timestamp").cast("timestamp"), "yyyyMMddHHmmss")
    return ranked.select(*captures.columns, urls.replay_url(stamp, "original_url").alias("replay_url"), F.expr("__d div 1000000").alias("distance_seconds"), "rank", "eligible", reason.alias("rejection_reason"), F.coalesce(F.col("rank") == first, F.lit(False)).alias("selected"))


def year_records(own: DataFrame, older: DataFrame) -> DataFrame:
    """The record of each candidate's year: its own, else what the candidate's older whole record has for the year.

    ``own`` has YEAR_RECORD's columns; ``older`` the same without the year, its captures of all years, expanded here to 2016-2024.
    """
    key = ["ticker", "candidate_url", "year"]
    good = F.col("collection_status") == "success"
    old = older.select("*", F.explode(F.sequence(F.lit(2016), F.lit(2024))).alias("year"))
    old = old.withColumn("captures", F.when(good, F.filter("captures", lambda c: F.year(c["timestamp"]) == F.col("year"))))
    return own.select(*YEAR_RECORD.names).unionByName(old.join(own.select(*key), key, "left_anti").select(*YEAR_RECORD.names))


def annual_outputs(targets: DataFrame, candidates: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate table, one status row for each target).

    The status says why a company's year has no capture: no page that counts, queries that are missing
    or failed, no capture, or none that can be replayed.
    """
    pages = within_validity(targets, eligible_candidates(candidates).select("ticker", "candidate_url", "normalized_url", "page_type", "valid_from_year", "valid_to_year"))
    cached = pages.join(records.select("ticker", "candidate_url", "year", "collection_status", "attempt_count", F.col("captures").alias("__c")), ["ticker", "candidate_url", "year"], "left")
    good = F.coalesce(F.col("collection_status") == "success", F.lit(False))
    found = cached.filter(good).select("ticker", "year", "target_timestamp", "candidate_url", "normalized_url", "page_type", F.inline("__c")).filter(F.year("timestamp") == F.col("year"))
    table = candidate_table(found)
    queries = cached.groupBy("ticker", "year").agg(F.count("*").alias("eligible_page_count"), F.count_if(good).alias("__good"), F.count_if(~good).alias("__bad"), F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("query_attempt_count"))
    chosen = F.max(F.when(F.col("selected"), F.struct("timestamp", "original_url", "replay_url")))
    counts = table.groupBy("ticker", "year").agg(F.count("*").alias("capture_count"), F.count_if("eligible").alias("eligible_capture_count"), chosen.alias("__chosen"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = targets.join(queries, ["ticker", "year"], "left").join(counts, ["ticker", "year"], "left")
    rows = rows.select(*targets.columns, *[zero(c) for c in ("eligible_page_count", "capture_count", "eligible_capture_count", "query_attempt_count", "__good", "__bad")], F.col("__chosen.timestamp").alias("selected_capture_timestamp"), F.col("__chosen.original_url").alias("selected_original_url"), F.col("__chosen.replay_url").alias("selected_replay_url"))
    ladder = [
        (F.col("selected_replay_url").isNotNull(), "selected", ""),
        (F.col("eligible_page_count") == 0, "no_eligible_page", "no eligible page candidate"),
        ((F.col("__bad") > 0) & (F.col("__good") == 0), "discovery_incomplete", "same-year CDX query missing or failed for all relevant candidates"),
        ((F.col("__bad") > 0) & (F.col("capture_count") == 0), "discovery_incomplete", "same-year CDX query incomplete and completed queries returned no captures"),
        (F.col("capture_count") == 0, "no_cdx_capture", "no same-year CDX capture"),
        (F.lit(True), "no_eligible_capture", "same-year captures exist but none are successful HTML"),
    ]
    status, reason = F.when(*ladder[0][:2]), F.when(ladder[0][0], ladder[0][2])
    for condition, s, r in ladder[1:]:
        status, reason = status.when(condition, s), reason.when(condition, r)
    query = F.when(F.col("eligible_page_count") == 0, "not_applicable").when(F.col("__bad") > 0, "incomplete").otherwise("complete")
    return table, rows.select("*", status.alias("acquisition_status"), reason.alias("failure_reason"), query.alias("query_status")).drop("__good", "__bad")


def recovered(status: DataFrame, table: DataFrame, final: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``status`` with the next eligible capture for rows whose text failed, and ``recovered``.

    The next one has a higher rank than the one that was tried and another address; usable rows and rows outside the scope stay.
    """
    key = ["ticker", "year"]
    rows = status.join(final.select(*key, "observation_status", F.col("wayback_url").alias("__w")), key, "left")
    if scope is not None:
        rows = rows.join(scope.select(*key).distinct().withColumn("__in", F.lit(True)), key, "left")
    else:
        rows = rows.withColumn("__in", F.lit(True))
    tried = F.coalesce(F.nullif("selected_replay_url", F.lit("")), F.nullif("__w", F.lit("")))
    rows = rows.withColumn("__tried", tried)
    todo = F.col("observation_status").isin(*RECOVERABLE) & F.col("__tried").isNotNull() & F.col("__in")
    options = table.filter(truthy(F.col("eligible").cast("string")) & (F.coalesce("replay_url", F.lit("")) != "")).select(*key, F.col("rank").alias("__rank"), F.struct("rank", "timestamp", "original_url", "replay_url").alias("__o"))
    options = rows.filter(todo).select(*key, "__tried").join(options, key)
    at = F.coalesce(F.min(F.when(F.col("__o.replay_url") == F.col("__tried"), F.col("__rank"))).over(Window.partitionBy(*key)), F.lit(0))
    nexts = options.withColumn("__at", at).filter((F.col("__rank") > F.col("__at")) & (F.col("__o.replay_url") != F.col("__tried"))).groupBy(*key).agg(F.min("__o").alias("__next"))
    out = rows.join(nexts, key, "left")
    new = {"acquisition_status": F.lit("selected"), "failure_reason": F.lit(""), "selected_capture_timestamp": F.col("__next.timestamp"), "selected_original_url": F.col("__next.original_url"), "selected_replay_url": F.col("__next.replay_url")}
    return out.select(*[F.when(F.col("__next").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in status.columns], F.col("__next").isNotNull().alias("recovered"))


def query_log(records: DataFrame) -> DataFrame:
    """One row of each candidate's year: status, attempts, captures and the distinct sorted kinds of error.

    ``records`` has YEAR_RECORD's columns, response_status and errors (strings "kind: message").
    """
    kinds = F.array_sort(F.array_distinct(F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda e: F.element_at(F.split(e, ":"), 1))))
    return records.select("ticker", "candidate_url", "normalized_url", "year", F.col("collection_status").alias("query_status"), "attempt_count", F.coalesce(F.size("captures"), F.lit(0)).alias("capture_count"), "response_status", F.array_join(kinds, ";").alias("error_types"))


def candidate_status(records: DataFrame) -> DataFrame:
    """ticker, candidate_url, collection_status (success, partial or failed), attempt_count of all years."""
    good = F.count_if(F.coalesce(F.col("collection_status") == "success", F.lit(False)))
    status = F.when(good == F.count("*"), "success").when(good > 0, "partial").otherwise("failed")
    return records.groupBy("ticker", "candidate_url").agg(status.alias("collection_status"), F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("attempt_count"))


def index_query(url: str, first: int = 2016, last: int = 2024, match: str = "exact") -> dict[str, str]:
    """Parameters of an archive index query for a URL."""
    query = {"url": url, "from": str(first), "to": str(last), "output": "json", "fl": ",".join(INDEX_FIELDS), "collapse": "timestamp:8"}
    return query if match == "exact" else {**query, "matchType": match}


def index_captures(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns of ``df`` and the captures in its index payloads (JSON: a header row, then rows).

    A payload whose header lacks a field is an error.  "-" and "" are null numbers.
    """
    rows = F.from_json(F.col(payload), T.ArrayType(T.ArrayType(T.StringType())))
    kept = [c for c in df.columns if c != payload]
    table = df.select(*kept, rows.alias("__r")).filter("size(__r) > 0").select("*", F.element_at("__r", 1).alias("__h"))
    lacking = F.array_except(F.array(*map(F.lit, INDEX_FIELDS)), "__h")
    header = F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("index payload lacks fields: "), F.array_join(lacking, ",")))).otherwise(F.col("__h"))
    each = table.select(*kept, header.alias("__h"), F.explode(F.slice("__r", 2, 1 << 30)).alias("__v"))
    cell = lambda f: F.nullif(F.element_at("__v", F.array_position("__h", f).cast("int")), F.lit(""))
    return each.select(*kept, F.to_timestamp(cell("timestamp"), "yyyyMMddHHmmss").alias("timestamp"), cell("original").alias("original_url"), cell("statuscode").try_cast("int").alias("status_code"), cell("mimetype").alias("mime_type"), cell("digest").alias("digest"), cell("length").try_cast("long").alias("length"))


def available_capture(df: DataFrame, payload: str = "payload", year: str = "target_year", url: str = "url") -> DataFrame:
    """The other columns and the capture that an availability answer names, if it is of the target year and has status 200."""
    schema = "struct<archived_snapshots: struct<closest: struct<available: boolean, timestamp: string, status: string, url: string>>>"
    kept = [c for c in df.columns if c != payload]
    c = df.select(*kept, F.from_json(payload, schema)["archived_snapshots"]["closest"].alias("__c")).filter("__c.available AND length(__c.timestamp) = 14")
    made = c.select(*kept, F.to_timestamp("__c.timestamp", "yyyyMMddHHmmss").alias("timestamp"), urls.replay_original("__c.url", url).alias("original_url"), F.col("__c.status").try_cast("int").alias("status_code"), F.lit("text/html").alias("mime_type"))
    return made.filter((F.year("timestamp") == F.col(year)) & (F.col("status_code") == 200))


def best_urls(captures: DataFrame, key=("ticker",), limit: int = 3) -> DataFrame:
    """key, url, score: of the captured URLs of a domain the best ``limit`` by identity score, then shorter path, then name.

    Of URLs with one normal form the first captured with the highest score stands for all.
    """
    scored = captures.select(*key, "timestamp", "original_url", urls.normalised("original_url").alias("__n"), urls.identity_score("original_url").alias("score")).filter("score > 0")
    one = scored.groupBy(*key, "__n").agg(F.min(F.struct((-F.col("score")).alias("s"), "timestamp", "original_url", "score")).alias("b")).select(*key, F.col("b.original_url").alias("url"), F.col("b.score").alias("score"))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), F.length(urls.path("url")), "url")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def best_variants(pages: DataFrame, url: str = "url", limit: int = 4) -> DataFrame:
    """The columns of ``pages``, variant, rank: the best ``limit`` other addresses of each URL (higher score, http first, shorter path, name)."""
    # the variants are in normal form already
    each = pages.select("*", F.explode_outer(urls.recovery_variants(url)).alias("variant")).filter("variant IS NOT NULL").distinct()
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in pages.columns]).orderBy(F.desc(urls.identity_score("variant")), (urls.scheme("variant") != "http").cast("int"), F.length(urls.path("variant")), "variant")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def selected_filings(filings: DataFrame, targets: DataFrame, supplements: bool = False) -> DataFrame:
    """One filing for each target (ticker, year): forms that count, filed in the year, the real form before supplements, earliest first.

    Rows of ``filings`` have form, filingDate, reportDate, accessionNumber, primaryDocument and the target's ticker.
    """
    forms = ["DEF 14A", "DEFA14A"] if supplements else ["DEF 14A"]
    usable = filings.filter(F.col("form").isin(*forms) & (F.coalesce("accessionNumber", F.lit("")) != "") & (F.coalesce("primaryDocument", F.lit("")) != ""))
    dated = usable.withColumn("year", F.left("filingDate", F.lit(4)).try_cast("int"))
    order = F.struct((F.col("form") != "DEF 14A").alias("o"), F.col("filingDate"), F.col("accessionNumber"))
    best = dated.groupBy("ticker", "year").agg(F.min_by(F.struct("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument"), order).alias("f"))
    return targets.join(best, ["ticker", "year"], "left").select(*targets.columns, "f.*")


def columnar_rows(df: DataFrame, columns: str = "columns") -> DataFrame:
    """Rows of a struct of parallel arrays (the column-oriented form of filing lists), beside the other columns."""
    names = df.schema[columns].dataType.names
    kept = [c for c in df.columns if c != columns]
    return df.select(*kept, F.inline(F.arrays_zip(*[F.col(columns)[n].alias(n) for n in names])))
