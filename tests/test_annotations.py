from pyspark.sql import functions as F

from panelight.operators import annotations as N
from panelight.operators import captures as C


def test_tasks_and_answers(spark):
    rows = [("A", "Co", 2016, "usable", "we hold our values high"), ("A", "Co", 2017, "usable", "our mission is plain"), ("A", "Co", 2018, "failed", None), ("B", "Bo", 2018, "usable", "nothing of note")]
    df = spark.createDataFrame(rows, "ticker string, company_name string, year int, observation_status string, page_text_clean string")
    tasks = N.snapshot_tasks(df)
    got = {(r["ticker"], r["year"]): r for r in tasks.collect()}
    assert [got[k]["analysis_status"] for k in sorted(got)] == ["pending", "pending", "skipped_nonusable", "pending"] and got["A", 2018]["prompt_sha256"] == ""
    assert "Co (A)" in got["A", 2016]["prompt"] and got["B", 2018]["input_excerpt"] == "nothing of note"
    assert [r["year"] for r in N.snapshot_tasks(df, limit=1).filter("analysis_status = 'pending'").collect()] == [2016]
    pairs = {(r["ticker"], r["year"]): r["analysis_status"] for r in N.change_tasks(df).collect()}
    assert pairs == {("A", 2016): "skipped_no_prior", ("A", 2017): "pending", ("A", 2018): "skipped_nonusable_pair", ("B", 2018): "skipped_no_prior"}
    responses = spark.createDataFrame([(got["A", 2016]["prompt_sha256"], "<think>hm</think>Themes: values, and so on"), ("other", "x")], "prompt_sha256 string, response string")
    done = {(r["ticker"], r["year"]): r for r in N.answered(tasks, responses, "m").collect()}
    assert done["A", 2016]["llm_response"] == "Themes: values, and so on" and done["A", 2016]["annotation_quality_flag"] == "candidate_interpretive_signal"
    assert done["A", 2017]["analysis_status"] == "pending" and done["A", 2018]["annotation_quality_flag"] == "not_applicable"
    assert N.resumable(tasks, N.answered(tasks, responses, "m")).count() == 2
    assert [r["n"] for r in N.largest(spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "doc_id int, n int"), 2, "n").collect()] == [9, 9]


def test_generated_candidates_and_year_records(spark):
    methods = spark.createDataFrame([("historical_url_variant",), ("historical_domain_cdx_url",), ("manual",), (None,)], "discovery_method string")
    assert [r["k"] for r in methods.select(C.kept_generated(False).alias("k")).collect()] == [False, False, True, True]
    assert [r["k"] for r in methods.select(C.kept_generated(True).alias("k")).collect()] == [False, True, True, True]
    capture = "struct<timestamp: timestamp, original_url: string, status_code: int, mime_type: string, digest: string, length: bigint>"
    one = lambda y: F.struct(F.lit(f"{y}-03-01").cast("timestamp").alias("timestamp"), F.lit("u").alias("original_url"), F.lit(200).alias("status_code"), F.lit("text/html").alias("mime_type"), F.lit("d").alias("digest"), F.lit(1).cast("long").alias("length"))
    base = spark.range(1).select(F.lit("A").alias("ticker"), F.lit("u").alias("candidate_url"), F.lit("u").alias("normalized_url"), F.lit("success").alias("collection_status"), F.lit(3).cast("long").alias("attempt_count"))
    older = base.withColumn("captures", F.array(one(2017), one(2018), one(2018)))
    own = base.withColumns({"year": F.lit(2017), "collection_status": F.lit("failed"), "captures": F.lit(None).cast(f"array<{capture}>")})
    got = {r["year"]: (r["collection_status"], len(r["captures"] or [])) for r in C.year_records(own, older).collect()}
    assert got[2017] == ("failed", 0) and got[2018] == ("success", 2) and got[2019] == ("success", 0) and len(got) == 9
