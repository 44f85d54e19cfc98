import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelight.functions.vocabularies import Theme
from panelight.operators import aggregates, alignment, audit, captures, change, panel, selection, stats, topics, vectors

THEMES = (Theme("a", "A", ("x",)), Theme("b", "B", ("y",)), Theme("c", "C", ("z",)))


def at(text):
    return dt.datetime.fromisoformat(text)


def frame(spark, rows):
    schema = "ticker string, year int, target_timestamp timestamp, candidate_url string, normalized_url string, page_type string, timestamp timestamp, original_url string, status_code int, mime_type string, digest string, length long"
    return spark.createDataFrame([("T", 2020, at("2020-06-30 12:00:00"), "http://x.example/p", "http://x.example/p", "other", at(t), u, s, m, None, None) for t, u, s, m in rows], schema)


def test_nearest_capture_is_of_the_same_year(spark):
    H = "text/html"
    rows = [("2020-02-01 00:00:00", "u1", 200, H), ("2020-07-01 06:00:00", "u2", 200, H), ("2020-06-29 11:00:00", "u3", 200, H), ("2021-06-30 12:00:00", "u4", 200, H), ("2020-06-30 12:00:00", "u5", 302, H)]
    assert captures.nearest(frame(spark, rows)).first()["original_url"] == "u2"
    tie = [("2020-07-01 12:00:00", "late", 200, H), ("2020-06-29 12:00:00", "early", 200, H)]
    assert captures.nearest(frame(spark, tie)).first()["original_url"] == "early"
    assert captures.nearest(frame(spark, [("2019-12-31 00:00:00", "u", 200, H)])).collect() == []
    redirect = [("2020-06-30 12:00:00", "rev", 200, "warc/revisit"), ("2020-06-30 12:00:00", "red", 301, H), ("2020-06-30 12:00:00", "a.pdf", 301, H)]
    assert captures.nearest(frame(spark, redirect)).first()["original_url"] == "red"
    assert captures.nearest(frame(spark, redirect), fallback=False).collect() == []


def test_candidates_are_ranked_with_reasons(spark):
    H = "text/html"
    rows = [("2020-06-30 12:00:00", "http://x.example/press", 200, H), ("2020-01-01 00:00:00", "http://x.example/about-us", 200, H), ("2020-06-30 12:00:00", "http://x.example/a.png", 200, H), ("2020-06-30 12:00:00", "http://x.example/b", 404, H), ("2020-06-30 12:00:00", "http://x.example/c", 200, "application/pdf"), ("2020-06-30 12:00:00", "http://x.example/d", None, None)]
    got = {r["original_url"].rsplit("/", 1)[1]: r for r in captures.candidate_table(frame(spark, rows)).collect()}
    assert got["about-us"]["rank"] == 1 and got["about-us"]["selected"] and not got["press"]["selected"]
    assert [got[k]["rejection_reason"] for k in ("press", "a.png", "b", "c", "d")] == ["", "asset_or_document_url", "status_code_404", "non_html_mime_type_application/pdf", "status_code_None"]
    assert got["about-us"]["replay_url"] == "https://web.archive.org/web/20200101000000id_/http://x.example/about-us"


def test_recovery_goes_forward_only(spark):
    table = spark.createDataFrame([("T", 2020, 1, True, "r1", "u1"), ("T", 2020, 2, False, "r2", "u2"), ("T", 2020, 3, True, "r3", "u3"), ("S", 2020, 1, True, "r1", "u1")], "ticker string, year int, rank int, eligible boolean, replay_url string, original_url string").withColumn("timestamp", F.lit("2020-01-01").cast("timestamp"))
    status = table.filter("rank = 1").select("ticker", "year", F.lit("selected").alias("acquisition_status"), F.lit("").alias("failure_reason"), F.col("timestamp").alias("selected_capture_timestamp"), F.col("original_url").alias("selected_original_url"), F.col("replay_url").alias("selected_replay_url"))
    final = status.select("ticker", "year", F.lit("extraction_failed").alias("observation_status"), F.lit("").alias("wayback_url"))
    got = {r["ticker"]: r for r in captures.recovered(status, table, final).collect()}
    assert got["T"]["selected_replay_url"] == "r3" and got["T"]["recovered"] and not got["S"]["recovered"]
    again = captures.recovered(captures.recovered(status, table, final).drop("recovered"), table, final)
    assert not again.filter("recovered").collect()
    usable = final.withColumn("observation_status", F.lit("usable"))
    assert not captures.recovered(status, table, usable).filter("recovered").collect()


def test_index_payloads(spark):
    good = json.dumps([["timestamp", "original", "statuscode", "mimetype", "digest", "length"], ["20200102030405", "http://x", "200", "text/html", "D", "12"], ["20200102030406", "http://y", "-", "", "", "-"]])
    df = spark.createDataFrame([("T", good), ("S", "[]")], "ticker string, payload string")
    got = captures.index_captures(df).orderBy("timestamp").collect()
    assert [(r["ticker"], r["original_url"], r["status_code"], r["mime_type"], r["length"]) for r in got] == [("T", "http://x", 200, "text/html", 12), ("T", "http://y", None, None, None)]
    with pytest.raises(Exception, match="lacks fields"):
        captures.index_captures(spark.createDataFrame([("T", '[["timestamp"],["1"]]')], "ticker string, payload string")).collect()
    answer = json.dumps({"archived_snapshots": {"closest": {"available": True, "timestamp": "20200102030405", "status": "200", "url": "http://web.archive.org/web/20200102030405/http://x"}}})
    df = spark.createDataFrame([(2020, "u", answer), (2021, "u", answer), (2020, "u", "{}")], "target_year int, url string, payload string")
    assert [r["original_url"] for r in captures.available_capture(df).collect()] == ["http://x"]
    assert captures.index_query("u", match="domain")["matchType"] == "domain"


def test_filings_and_columnar_rows(spark):
    df = spark.createDataFrame([("T", (["DEFA14A", "DEF 14A", "DEF 14A", "DEF 14A"], ["2020-01-01", "2020-05-01", "2020-04-01", "2021-01-01"], ["", "", "", ""], ["1", "2", "3", "4"], ["a", "b", "c", ""]))], "ticker string, columns struct<form: array<string>, filingDate: array<string>, reportDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>")
    targets = spark.createDataFrame([("T", 2020), ("T", 2021)], "ticker string, year int")
    rows = captures.columnar_rows(df)
    got = {r["year"]: r["accessionNumber"] for r in captures.selected_filings(rows, targets, supplements=True).collect()}
    assert rows.count() == 4 and got == {2020: "3", 2021: None}


def test_changes_between_calendar_years(spark):
    rows = [("T", 2018, "first words of it"), ("T", 2019, " First WORDS of it "), ("T", 2020, None), ("T", 2021, "first words of it"), ("S", 2019, "a b c d e f g h i j k l m n o p q r s t u v w. Keep this."), ("S", 2020, "a b c d e f g h i j k l m n o p q r s t u v w. Keep this. x"), ("S", 2021, "wholly other text. Keep this."), ("R", 2019, "x"), ("R", 2021, "x")]
    got = {(r["ticker"], r["year"]): r for r in change.changes(spark.createDataFrame(rows, "ticker string, year int, text string")).collect()}
    classes = {k: r["change_class"] for k, r in got.items()}
    assert classes == {("T", 2018): "no_prior", ("T", 2019): "unchanged_exact", ("T", 2020): "indeterminate", ("T", 2021): "indeterminate", ("S", 2019): "no_prior", ("S", 2020): "minor_edit", ("S", 2021): "substantive_change", ("R", 2019): "no_prior", ("R", 2021): "no_prior"}
    assert got["T", 2021]["prior_year"] == 2020 and got["R", 2021]["prior_year"] is None and got["T", 2020]["changed_from_prior"] is None and got["T", 2019]["changed_from_prior"] is False
    s = got["S", 2021]
    assert s["added_snippets"] == ["wholly other text."] and s["removed_snippets"] == ["a b c d e f g h i j k l m n o p q r s t u v w.", "x"] and s["change_score"] > 0.1
    assert got["S", 2020]["word_count_delta_ratio"] == pytest.approx(1 / 25) and got["T", 2019]["token_jaccard_similarity"] == 1.0
    simple = {(r["ticker"], r["year"]): r["change_class"] for r in change.change_classes(spark.createDataFrame(rows, "ticker string, year int, text string")).collect()}
    assert simple == {k: "changed" if v in ("minor_edit", "substantive_change") else v for k, v in classes.items()}


def test_vectors_of_themes(spark):
    ids = [t.id for t in THEMES]
    cases = {json.dumps([{"theme_id": "a", "match_count": 2}, {"theme_id": "a", "match_count": "3"}, {"theme_id": "zz", "match_count": 9}, {"theme_id": "b", "match_count": "?"}]): [5, 0, 0], None: [0, 0, 0], "": [0, 0, 0], "not": [0, 0, 0], "{}": [0, 0, 0]}
    for payload, want in cases.items():
        assert spark.createDataFrame([(payload,)], "p string").select(alignment.theme_vector("p", ids).alias("v")).first()["v"] == want
    rows = [("T", 2016, "s", [1, 3, 0], [1, 3, 0], "usable", "collected"), ("T", 2017, "s", [4, 0, 0], [0, 0, 2], "usable", "collected"), ("T", 2018, "s", [1, 1, 0], [1, 3, 0], "usable", "collected"), ("T", 2019, "s", [0, 0, 0], [1, 0, 0], "usable", "collected"), ("T", 2020, "s", [1, 0, 0], [0, 0, 0], "usable", "collected"), ("T", 2021, "s", [1, 0, 0], [1, 0, 0], None, "missing"), ("T", 2022, "s", [1, 0, 0], [1, 0, 0], "x", "collected"), ("T", 2023, "s", [1, 0, 0], [1, 0, 0], "usable", None)]
    df = spark.createDataFrame(rows, "ticker string, year int, sector string, stated array<bigint>, disclosure array<bigint>, observation_status string, collection_status string")
    got = {r["year"]: r for r in alignment.index_panel(df, THEMES).collect()}
    scores = lambda y: [got[y][c] for c in ("authenticity_index", "cosine_alignment", "l1_alignment", "jaccard_theme_overlap")]
    assert scores(2016) == [100, 100, 100, 100] and scores(2017) == [0, 0, 0, 0] and scores(2018)[0] == 75 and scores(2019) == [None] * 4
    assert [got[y]["score_status"] for y in range(2019, 2024)] == ["insufficient_stated_theme_signal", "insufficient_disclosure_theme_signal", "missing_both", "missing_part1", "missing_part2"]
    assert got[2016]["sector_percentile"] == 1.0 and got[2019]["sector_percentile"] is None and "Part 2" in got[2023]["score_gap_reason"]
    assert [e["theme_id"] for e in json.loads(got[2016]["stated_top_themes"])] == ["b", "a"] and json.loads(got[2017]["theme_gap_summary"])[0] == {"theme_id": "a", "theme_label": "A", "stated_share": 1.0, "disclosure_share": 0.0, "stated_minus_disclosure": 1.0}
    metric = spark.createDataFrame([('{"k": "1.23456789"}',), ('{"k": "x"}',), ("no",), (None,)], "p string").select(alignment.json_metric("p", "k").alias("v"))
    assert [r["v"] for r in metric.collect()] == [1.234568, None, None, None]
    status = spark.createDataFrame([("usable", "collected", "a", "b"), ("usable", "collected", "", None), ("usable", "collected", "a", ""), ("x", "collected", "a", "b"), (None, None, "", "")], "f string, s string, a string, b string").select(alignment.semantic_status(F.col("f"), F.col("s"), F.col("a"), F.col("b")).alias("v"))
    assert [r["v"] for r in status.collect()] == ["computed", "missing_both_text", "missing_part2_text", "missing_part1_text", "source_not_available"]


@pytest.mark.parametrize("n", [3, 4, 5, 100, 434])
def test_terciles_by_rank(spark, n):
    df = spark.createDataFrame([(i, float(i * 7 % n // 2)) for i in range(n)] + [(n, None)], "k long, x double")
    got = stats.terciles(df, "x", ["k"]).collect()
    sizes = [sum(r["tercile"] == t for r in got) for t in stats.LABELS]
    assert sizes == [(n + 1) // 3, n // 3, n - (n + 1) // 3 - n // 3] and [r["tercile"] for r in got if r["k"] == n] == [None]
    order = sorted((r["x"], r["k"], stats.LABELS.index(r["tercile"])) for r in got if r["x"] is not None)
    assert [o[2] for o in order] == sorted(o[2] for o in order)


def test_terciles_of_wide_rows(spark):
    """Range partitions that are made twice, for rows and for their counts, are merged otherwise where columns are left out."""
    n = 40_000
    df = spark.range(0, n, 1, 8).select("id", F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id"), F.lit(1000))).alias("x"), F.concat(*[F.sha2(F.concat("id", F.lit(i)).cast("string"), 512) for i in "abc"]).alias("wide"))
    some = sorted((r["x"], r["id"]) for r in df.select("x", "id").collect() if r["x"] is not None)
    k = len(some)
    first, second = (k + 1) // 3, (k + 1) // 3 + k // 3
    want = {i: "low" if at < first else "medium" if at < second else "high" for at, (_, i) in enumerate(some)}
    got = stats.terciles(df, "x", ["id"]).collect()
    assert len(got) == n
    assert {r["id"]: r["tercile"] for r in got} == {i: want.get(i) for i in range(n)}


def test_statistics(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60).round(2), rng.normal(size=60).round(1)
    rows = [(i, f"s{i % 3}", 2016 + i % 4, float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, sector string, year int, x double, y double")
    keep = np.array([r[4] is not None for r in rows])
    got = stats.correlations(df, "x", ["y"]).first()
    ranks = lambda v: np.array([((v < e).sum() + (v <= e).sum() + 1) / 2 for e in v])
    assert got["company_years"] == keep.sum() and got["pearson"] == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1], abs=1e-6)
    assert got["spearman"] == pytest.approx(np.corrcoef(ranks(x[keep]), ranks(y[keep]))[0, 1], abs=1e-6)
    assert stats.correlations(df.limit(1), "x", ["x"]).first()["pearson"] is None
    fit = {r["term"]: r["coefficient"] for r in stats.regression(df, "x", ["y"], ["sector", "year"]).collect()}
    design = np.array([[1, r[4], *[r[1] == s for s in ("s1", "s2")], *[r[2] == v for v in (2017, 2018, 2019)]] for r in rows if r[4] is not None], float)
    assert list(fit.values()) == pytest.approx(np.linalg.lstsq(design, x[keep], rcond=None)[0], abs=1e-5) and list(fit)[2:] == ["sector_s1", "sector_s2", "year_2017", "year_2018", "year_2019"]
    assert stats.regression(df.limit(5), "x", ["y"], []).collect() == []
    z = stats.composite(df, ["x", "y"], F.col("k") >= 10).collect()
    inside = np.arange(60) >= 10
    zx, zy = (x - x[inside].mean()) / x[inside].std(), (y - y[inside & keep].mean()) / y[inside & keep].std()
    assert all(r["composite"] is None if r["k"] < 10 else r["composite"] == pytest.approx(zx[r["k"]] if r["y"] is None else (zx[r["k"]] + zy[r["k"]]) / 2) for r in z)
    flat = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("t", 2.0)], "sector string, x double")
    assert [r["z"] for r in flat.select(stats.sample_zscore("x", ["sector"]).alias("z")).collect()] == [0.0] * 3
    ranked = stats.global_rank(df, ["x", "k"]).collect()
    assert [r["k"] for r in sorted(ranked, key=lambda r: r["rank"])] == [k for _, k in sorted((r[3], r[0]) for r in rows)]
    empty = stats.distribution(df.filter("k < 0"), "x").first()
    assert empty["n"] == 0 and empty["mean"] is None


def test_shifts_bridge_gaps(spark):
    rows = [("T", y, "s", "a", c, 1000) for y, c in ((2016, 1), (2019, 5), (2020, 4))] + [("S", 2018, "s", "a", 3, 0)]
    df = spark.createDataFrame(rows, "ticker string, year int, sector string, theme string, cnt long, n_words long")
    got = [(r["prior_year"], r["year"], r["change"], r["absolute_change"]) for r in aggregates.adjacent_shifts(df).collect()]
    assert got == [(2016, 2019, 40.0, 40.0), (2019, 2020, -10.0, 10.0)]
    trend = aggregates.company_trends(df).first()
    assert (trend["first_year"], trend["last_year"], trend["change"], trend["observed_years"]) == (2016, 2020, 30.0, 3)
    windows = {r["event_window"]: r for r in aggregates.event_window_summary(df, ["a"], {"w1": (2016, 2018), "w2": (2030,)}).collect()}
    assert windows["w1"]["mean_rate"] == 5.0 and windows["w1"]["presence_rate"] == 1.0 and windows["w2"]["company_years"] == 0 and windows["w2"]["mean_rate"] == 0.0


def test_panel_joins(spark):
    a = spark.createDataFrame([("T", 2016, 1), ("T", 2018, 2)], "ticker string, year int, v int")
    b = spark.createDataFrame([("T", 2018, 9), ("S", 2016, 8)], "ticker string, year int, v int")
    assert sorted(map(tuple, panel.upserted(a, b).collect())) == [("S", 2016, 8), ("T", 2016, 1), ("T", 2018, 9)]
    assert sorted(map(tuple, panel.upserted(a, b, scope=b.filter("ticker = 'S'")).collect())) == [("S", 2016, 8), ("T", 2016, 1), ("T", 2018, 2)]
    assert [tuple(r) for r in panel.paired(a, b).collect()] == [("T", 2018, 2, 9)]
    with pytest.raises(ValueError, match="expected 2"):
        panel.paired(a, b, expected=2)
    assert [r["prior_year"] for r in panel.prior_year(a, ["v"]).orderBy("year").collect()] == [None, None]
    assert [r["prior_v"] for r in panel.prior_observed(a, ["v"], ["ticker"]).orderBy("year").collect()] == [None, 1]
    assert panel.with_optional(a, None, {"s": "not_computed"}).first()["s"] == "not_computed"
    assert panel.key_differences(a, a).collect() == [] and selection.same_rows(a, a).collect() == []
    cells = panel.with_target(panel.grid(a.select("ticker").distinct()))
    assert cells.count() == 9 and str(cells.orderBy("year").first()["target_timestamp"]) == "2016-06-30 12:00:00"


def test_vector_pairs_and_topics(spark):
    rows = [(1, [1.0, 0.0], "s", "t1"), (2, [2.0, 0.0], "s", "t2"), (3, [0.0, 1.0], "r", "t1"), (4, [0.0, 0.0], "q", "t9"), (5, [1.0, 1.0], "q", "t9")]
    df = spark.createDataFrame(rows, "id long, v array<float>, sector string, ticker string")
    got = {(r["id_a"], r["id_b"]): r["cosine_similarity"] for r in vectors.pairs_within(df, "id", "v", ["sector", "ticker"]).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.0, (4, 5): 0.0}
    texts = spark.createDataFrame([(1, "red fish swims", "red fish swims"), (2, "red fish", "blue bird"), (3, "", None)], "k long, a string, b string")
    sims = {r["k"]: r["similarity"] for r in vectors.tfidf_pair_cosine(texts, "a", "b", ["k"]).collect()}
    assert sims == {1: 100.0, 2: 0.0, 3: 0.0}
    docs = spark.createDataFrame([(i, " ".join(("sun moon star sky" if i % 2 else "bread milk egg salt").split() * (1 + i % 3))) for i in range(20)], "doc_id long, text string")
    w = topics.tfidf(docs, least=2, pairs=False).cache()
    assert w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).filter("abs(n - 1) > 1e-9").count() == 0
    scores, terms, errors = topics.factorised(w, topics=2, steps=20)
    top = {r["id"]: r["dominant_topic"] for r in scores.collect()}
    assert len({top[i] for i in range(0, 20, 2)}) == 1 and len(set(top.values())) == 2
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < errors[0] and terms.count() == 16


def test_audits(spark):
    rows = [("T", 2016, "usable", None, "u", "t", "x", None, None), ("T", 2017, "failed", "", None, None, None, None, "False"), ("T", 2017, "failed", "why", None, None, None, None, None), ("S", 2030, "discovery_incomplete", "why", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "ticker string, year int, observation_status string, gap_reason string, source_url string, capture_timestamp string, theme_categories string, theme_evidence string, changed_from_prior string")
    got = {r["name"]: r["failures"] for r in audit.stated_audit(df, companies=2, years=(2016, 2017)).collect()}
    assert got == {"expected_record_count": 0, "unique_company_year_keys": 1, "expected_company_count": 0, "required_fields_present": 2, "llm_analysis_completed": 1, "years_within_scope": 1, "failures_have_reasons": 1, "usable_records_traceable": 0, "themes_have_evidence": 1, "missing_records_do_not_claim_no_change": 1, "discovery_queries_completed": 1}
    assert [r["cell"] for r in audit.duplicates(df).collect()] == ["T:2017"] and audit.grid_audit(df, 4).first()["unique_company_years"] == 3
    t = spark.createDataFrame([(f"T{i % 2}", 2016 + i // 2, f"s{i % 2}") for i in range(4)], "ticker string, year int, sector string")
    status = t.withColumn("acquisition_status", F.lit("selected"))
    final = t.withColumns({"observation_status": F.lit("usable"), "review_status": F.lit("completed")})
    gates = audit.phase_gates(t, t, status, t, t, t, final, final, ("methodology", "validation_report", "summary"), True, expected=4, companies=2, sectors=2)
    assert all(r["passed"] for r in gates.collect()) and gates.count() == 8
    less = {r["phase"][:7]: r["passed"] for r in audit.phase_gates(t, t, status, t.limit(1), t, t, final, final, ("methodology",), True, expected=4, companies=2, sectors=2).collect()}
    assert less == {"phase_0": True, "phase_1": False, "phase_2": True, "phase_3": True, "phase_4": False, "phase_5": False, "phase_6": True, "phase_7": False}
    index = spark.createDataFrame([("T", 2016, "scored", 1.0, "v1"), ("T", 2017, "missing_both", None, "v1")], "ticker string, year int, score_status string, authenticity_index double, taxonomy_version string")
    checks = {r["name"]: r["passed"] for r in audit.index_audit(index, ["ticker", "year"], "v1", 2).collect()}
    assert checks["expected_row_count"] and checks["taxonomy_version_recorded"] and not checks["scored_rows_have_scores"] and not checks["scored_rows_traceable"]
    a, b = (audit.run_manifest(d, {"k": 1}, ["ticker", "year"]) for d in (t, t.orderBy(F.desc("year"))))
    assert a == b and a["rows"] == 4


def test_top_pairs_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """Copies, ties, nulls, vectors that no matrix holds and ids that occur twice; in blocks no row is made for each pair."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 6)).round(1)
    rows = [(i, None if i % 13 == 0 else f"s{i % 3}", i % 5, [float(v) for v in base[i % 40]]) for i in range(150)]
    rows += [(3, "s0", 3, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (200, "s1", 1, [0.0] * 6), (201, "s1", 1, None), (202, "s1", 2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, "s2", 2, [1.0, 2.0]), (204, "s2", 2, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "k long, g string, h int, v array<double>").repartition(3).cache()
    for n in (1, 40, 700, 100_000):
        want = vectors.top_pairs(vectors.pairs_within(df, "k", "v", ["g", "h"]), n).collect()
        got = vectors.top_pairs_within(df, "k", "v", ["g", "h"], n, block=16).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    df.unpersist()
    from panelight.plans import model_queries

    monkeypatch.setattr(vectors, "pairs_within", None)
    assert model_queries.QUERIES["vector_top_pairs"](spark, "/root/testdata/sf0.001").count() == 500


def test_cosines_are_rounded_as_decimals():
    assert vectors._rounded(np.array([0.123456785, -0.123456785, 0.999999995, 1.0, 0.0, 0.1234567849])).tolist() == [12345679, -12345679, 100000000, 100000000, 0, 12345678]
