"""Declared schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, I, L, D, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

COMPANY = _of(ticker=S, company_name=S, sector=S, primary_domain=S, known_historical_domains=S)
TARGET = _of(ticker=S, company_name=S, sector=S, year=I, target_timestamp=TS, observation_status=S)
CANDIDATE = _of(ticker=S, candidate_url=S, page_type=S, valid_from_year=I, valid_to_year=I, discovery_method=S, eligibility_status=S, eligibility_reason=S, reviewer=S)
EVENT = _of(timestamp=S, stage=S, status=S, ticker=S, year=I, capture_count=L)
EVIDENCE = T.ArrayType(_of(theme_id=S, theme_label=S, taxonomy_version=S, matched_phrases=T.ArrayType(S), evidence_excerpts=T.ArrayType(S), match_count=S))
SEMANTIC = _of(ticker=S, year=I, semantic_text_similarity=D, semantic_similarity_status=S, semantic_similarity_gap_reason=S, semantic_embedding_model=S)
DISCOVERY_AUDIT = _of(discovery_source=S, ticker=S, year=I, domain=S, query_url=S, homepage_url=S, query_status=S, capture_count=L, selected_capture_timestamp=S, selected_original_url=S, selected_replay_url=S, fetched=B, discovered_link_count=L, candidate_urls=S, error=S)
