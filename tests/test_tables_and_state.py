import json

import pytest
from pyspark.sql import functions as F

from panelight.sources import tables as S
from panelight.streaming import state


def test_tables_round_trip(spark, tmp_path):
    rows = [("B", "two\nlines, \"quoted\"", 3), ("A", " kept ", 1), ("C", None, 2)]
    df = spark.createDataFrame(rows, "ticker string, text string, n int")
    S.write_table(df, str(tmp_path / "t"), ["ticker", "text"], order=["ticker"], single=True)
    got = [tuple(r) for r in S.read_strings(spark, str(tmp_path / "t"), ["ticker", "text"]).collect()]
    assert sorted(got) == [("A", " kept "), ("B", 'two\nlines, "quoted"'), ("C", "")]
    assert S.read_strings(spark, str(tmp_path / "none"), ["a"]).collect() == []
    S.write_table(df.limit(0), str(tmp_path / "empty"), single=True)
    assert S.read_strings(spark, str(tmp_path / "empty"), df.columns).collect() == []
    assert S.compact(df, ["text"]).columns == ["ticker", "n"]


def test_manifest_candidates_and_targets(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ticker,company_name,sector,primary_domain,known_historical_domains\n A ,Name, s ,x.example, a.example ; ;b.example\n,,,,\n")
    got = S.companies(spark, str(tmp_path / "c.csv")).collect()
    assert len(got) == 1 and got[0]["ticker"] == "A" and got[0]["known_historical_domains"] == ["a.example", "b.example"]
    head = "ticker,candidate_url,page_type,valid_from_year,valid_to_year,discovery_method,eligibility_status,eligibility_reason,reviewer\n"
    (tmp_path / "p.csv").write_text(head + "B,x.example/about/,about,,2020,m,eligible,,\nA,http://y.example,about,2018,,m,rejected,,\n")
    got = S.candidates(spark, str(tmp_path / "p.csv")).collect()
    assert [(r["ticker"], r["normalized_url"], r["valid_from_year"], r["valid_to_year"]) for r in got] == [("A", "http://y.example/", 2018, 2024), ("B", "https://x.example/about", 2016, 2020)]
    (tmp_path / "bad.csv").write_text(head + "B,,about,,,m,eligible,,\n")
    with pytest.raises(Exception, match="can't be read"):
        S.candidates(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "t.csv").write_text("ticker,company_name,sector,year,target_timestamp,observation_status\nB,n,s,2017,2017-06-30T12:00:00Z,pending\nA,n,s,x,,\n")
    assert [(r["ticker"], r["year"], str(r["target_timestamp"])) for r in S.targets(spark, str(tmp_path / "t.csv")).collect()] == [("A", None, "None"), ("B", 2017, "2017-06-30 12:00:00")]


def test_events_documents_and_sidecars(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"timestamp": "1", "stage": "s", "status": "x", "ticker": "T", "year": 2016}\n\n   \n{"timestamp": "2", "stage": "s", "status": "y"}\n')
    assert S.events(spark, str(tmp_path / "log.jsonl")).count() == 2 and S.events(spark, str(tmp_path / "no")).collect() == []
    S.append_events(S.events(spark, str(tmp_path / "log.jsonl")), str(tmp_path / "out"), str(tmp_path / "state"))
    S.append_events(S.events(spark, str(tmp_path / "log.jsonl")), str(tmp_path / "out"))
    assert S.events(spark, str(tmp_path / "out")).count() == 4 and S.events(spark, str(tmp_path / "state")).first()["status"] == "y"
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a b.txt").write_text("whole\ntext")
    df = spark.createDataFrame([("T", 2016, "a b.txt"), ("T", 2017, "c.txt"), ("T", 2018, None)], "ticker string, year int, text_path string")
    with_side = S.with_sidecars(df, str(tmp_path / "texts"))
    assert [r["sidecar_text"] for r in with_side.orderBy("year").collect()] == ["whole\ntext", "", ""]
    full = spark.createDataFrame([("T", 2017, "full"), ("T", 2016, "")], "ticker string, year int, page_text_clean string")
    assert [r["page_text_clean"] for r in S.with_text(with_side, full, "sidecar_text").orderBy("year").collect()] == ["whole\ntext", "full", ""]
    S.write_document(spark, {"b": 1, "a": [2]}, str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}'
    assert S.semantic(spark, str(tmp_path / "no.csv")).columns[:2] == ["ticker", "year"]


def test_split_and_reports(spark):
    evidence = json.dumps([{"theme_id": "a", "match_count": 2}, {"theme_id": "a", "match_count": "7"}])
    df = spark.createDataFrame([("T", 2016, "collected", evidence, None), ("T", 2017, None, None, " "), ("T", 2018, "missing", None, "why")], "ticker string, year int, collection_status string, theme_evidence string, gap_reason string")
    got, rest = S.split_by_status(df)
    assert got.select(S.last_counts("theme_evidence", ["a", "b"]).alias("m")).first()["m"] == {"a": 7, "b": 0} and rest.count() == 2
    assert sorted(r["review_reason"] for r in S.review_queue(df).collect()) == ["sample_for_quality_review", "why"]
    small = spark.createDataFrame([("a|b_c", 1.23456)], "name string, x double")
    assert S.markdown(small) == "| name | x |\n| --- | --- |\n| a\\|b_c | 1.235 |" and r"a|b\_c & 1.235 \\" in S.latex(small)


def test_progress(spark, tmp_path):
    e = [("3", "cdx_discovery", "success", "A", 2016, 2), ("4", "cdx_discovery", "started", "A", 2016, None), ("1", "cdx_discovery", "cached", "A", 2017, 0), ("1", "cdx_discovery", "failed", "B", 2016, None), ("1", "cdx_discovery", "started", "B", 2017, None), ("9", "other", "success", "B", 2018, 5), ("9", "cdx_discovery", "success", None, 2018, 5)]
    events = spark.createDataFrame(e, "timestamp string, stage string, status string, ticker string, year int, capture_count long")
    progress = state.year_progress(events)
    got = {(r["ticker"], r["year"]): (r["status"], r["capture_count"], r["latest_status"]) for r in progress.collect()}
    assert got == {("A", 2016): ("has_capture", 2, "success"), ("A", 2017): ("zero_capture", 0, "cached"), ("B", 2016): ("failed_only", 0, "failed"), ("B", 2017): ("incomplete", 0, "started")}
    companies = state.company_progress(progress, spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string"), (2016, 2017))
    rows = {r["ticker"]: r for r in companies.collect()}
    assert rows["A"]["years_completed"] == 2 and rows["B"]["years_completed"] == 1 and rows["C"]["years_incomplete"] == 2 and rows["A"]["latest_year"] == 2016
    totals = state.progress_totals(companies).first()
    assert (totals["companies_seen"], totals["companies_completed"], totals["company_years_completed"]) == (2, 1, 3)
    events.coalesce(1).write.json(str(tmp_path / "e"))
    stream = state.stage_counts(state.stream_events(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("stage_counts").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted(map(tuple, spark.table("stage_counts").collect())) == sorted(map(tuple, state.stage_counts(events).collect()))
    latest = state.latest_state(state.stream_events(spark, str(tmp_path / "e")), ["stage"]).writeStream.format("memory").queryName("latest_state").outputMode("complete").trigger(availableNow=True).start()
    latest.awaitTermination()
    assert spark.table("latest_state").count() == 2


def test_cache_and_resume(spark):
    key = "ticker string, candidate_url string, year int"
    cache = spark.createDataFrame([("A", "u", 2016, "success", [1], None), ("A", "u", 2017, "success", [], None), ("A", "u", 2018, "failed", None, None), ("A", "u", 2019, "success", [], True)], key + ", collection_status string, captures array<int>, fallback_tried boolean")
    wanted = spark.createDataFrame([("A", "u", y) for y in range(2016, 2021)], key)
    years = lambda d: sorted(r["year"] for r in d.collect())
    assert years(state.to_query(wanted, cache)) == [2018, 2020] and years(state.to_query(wanted, cache, new_fallback=True)) == [2017, 2018, 2020] and len(years(state.to_query(wanted, cache, force=True))) == 5
    answers = spark.createDataFrame([("A", "u", 2016, "failed", None, True), ("A", "u", 2018, "success", [4], True), ("A", "u", 2020, "failed", None, True)], cache.schema)
    got = {r["year"]: r["collection_status"] for r in state.refreshed(cache, answers).collect()}
    assert got == {2016: "success", 2017: "success", 2018: "success", 2019: "success", 2020: "failed"}
    assert years(state.resumed(wanted, cache, ["ticker", "year"])) == [2020]
    step = lambda d: d.select("n", (F.col("n") < 2).alias("recovered")).withColumn("n", F.col("n") + F.col("recovered").cast("int"))
    assert state.until_settled(step, spark.createDataFrame([(0,)], "n int"), passes=9).first()["n"] == 2


def test_retries_and_stages():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert state.with_retries(flaky, 3, waits.append) == ("done", ["OSError: again"] * 2) and waits == [1, 2]
    with pytest.raises(OSError):
        state.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), 2)
    out = state.run_stages([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 3)])
    assert [out[k]["status"] for k in "abc"] == ["completed", "failed", "completed"] and out["b"]["error_type"] == "ZeroDivisionError"


def test_filing_lists(spark, tmp_path):
    (tmp_path / "ciks.json").write_text('{"0": {"cik_str": 320, "ticker": "brk.b", "title": "x"}, "1": {"cik_str": 7, "ticker": "A", "title": "y"}}')
    assert sorted(map(tuple, S.ticker_ciks(spark, str(tmp_path / "ciks.json")).collect())) == [("A", "0000000007"), ("BRK-B", "0000000320")]
    recent = spark.createDataFrame([("T", (["10-K"], ["2020-01-01"]))], "ticker string, columns struct<form: array<string>, filingDate: array<string>>")
    older = spark.createDataFrame([("T", (["8-K", "8-K"],))], "ticker string, columns struct<form: array<string>>")
    rows = S.submission_rows([recent, older])
    assert rows.count() == 3 and rows.filter("filingDate IS NULL").count() == 2
    assert S.smoke_subset(rows.withColumn("year", F.lit(1)), ["T"], 2).count() == 2 and S.smoke_subset(rows, ["X"]).count() == 0
