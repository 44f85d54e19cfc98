from pyspark.sql import functions as F

from panelight.functions import text as X
from panelight.functions.vocabularies import LEXICONS, THEMES, Theme
from panelight.operators import sections
from panelight.operators.themes import genre_rates, theme_counts, theme_evidence, theme_observations


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_tokens_and_sentences(spark):
    text = "The crew's well-built boat -- (no. 7) leaks. Émile's naïve über-plan_2 failed!\nNext line?  Last"
    assert one(spark, X.tokens("t"), t=text) == ["The", "crew's", "well-built", "boat", "no", "7", "leaks", "Émile's", "naïve", "über-plan_2", "failed", "Next", "line", "Last"]
    assert one(spark, X.sentences("t"), t=text) == ["The crew's well-built boat -- (no.", "7) leaks.", "Émile's naïve über-plan_2 failed!", "Next line?", "Last"]
    assert one(spark, X.word_count("t"), t=None) == 0 and one(spark, X.sentences("t"), t="  \n ") == []
    assert one(spark, X.squeezed("t"), t=" a \t b ") == "a b"


def test_quantities(spark):
    assert one(spark, X.quantified_claims("t"), t="Sales rose 25% and 1,200.5 units, 3 Percent.") == 5
    assert one(spark, X.quantified_claims("t", fold=False), t="Sales rose 25% and 1,200.5 units, 3 Percent.") == 4


def test_themes_with_evidence(spark):
    themes = (Theme("sea", "Sea", ("boat", "open water")), Theme("land", "Land", ("road",)), Theme("air", "Air", ("jet",)))
    text = "A Boat left. The boats stayed; a boat in open\n water. Broad roads lead on. The road ends."
    got = one(spark, X.classify_themes("t", themes), t=text)
    assert [(e["theme_id"], e["matched_phrases"], e["match_count"]) for e in got] == [("sea", ["boat", "open water"], 3), ("land", ["road"], 1)]
    assert got[0]["evidence_excerpts"] == ["A Boat left.", "The boats stayed; a boat in open"] and got[1]["evidence_excerpts"] == ["The road ends."]
    cut = one(spark, X.classify_themes("t", themes, excerpt_chars=6, max_excerpts=1), t=text)
    assert cut[0]["evidence_excerpts"] == ["A Boat"] and one(spark, X.classify_themes("t", themes), t=None) == []
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    counts = {(r["doc_id"], r["theme"]): r["cnt"] for r in theme_counts(df, ["doc_id"], themes).collect()}
    assert counts == {(1, "sea"): 3, (1, "land"): 1, (1, "air"): 0, (2, "sea"): 0, (2, "land"): 0, (2, "air"): 0}
    assert {r["theme_id"] for r in theme_observations(theme_evidence(df, ["doc_id"], themes), ["doc_id"]).collect()} == {"sea", "land"}
    assert len(THEMES) == 12 and "customers" not in {e["theme_id"] for e in one(spark, X.classify_themes("t", THEMES), t="We customized a platform.")}


def test_linguistic_metrics(spark):
    got = one(spark, X.linguistic_metrics("t"), t="We will cut costs by 5 million. Our crews delivered.")
    assert got["word_count"] == 10 and got["sentence_count"] == 2 and got["average_sentence_length"] == 5.0 and got["quantified_claim_count"] == 1
    assert (got["first_person_plural_count"], got["commitment_count"], got["action_or_evidence_count"]) == (2, 1, 1)
    assert got["first_person_plural_rate_per_100_words"] == 20.0 and list(LEXICONS) == ["first_person_plural", "commitment", "aspiration", "action_or_evidence", "stakeholder"]
    empty = one(spark, X.linguistic_metrics("t"), t=None)
    assert empty["word_count"] == 0 and empty["average_sentence_length"] == 0.0 and empty["stakeholder_rate_per_100_words"] == 0.0


def test_genre_matches_are_counted_by_phrase(spark):
    form = X.genre_form("t")
    assert one(spark, X.genre_matches(form, ["harbour", "harbour master"]), t="The Harbour  master left the harbour. Harbourside; harbour_x") == 4
    rates = genre_rates(spark.createDataFrame([(1, "a b a c"), (2, "")], "doc_id long, text string"), ["doc_id"], {"g": ["a"]})
    assert {r["doc_id"]: (r["g_count"], r["g_rate"]) for r in rates.collect()} == {1: (2, 500.0), 2: (0, 0.0)}
    assert one(spark, X.rate(F.lit(5), F.lit(1000), 1000, 6), t="") == 5.0 and one(spark, X.rate(F.lit(5), F.lit(0), 1000), t="") == 0.0


def test_forms_and_ladders(spark):
    assert one(spark, X.comparison_form("t"), t=" One\n TWO ") == "one two"
    assert one(spark, X.front_window("t", 5), t=" ab  cdef") == "ab cd"
    assert one(spark, X.without_thoughts("t"), t="<think>no\nno</THINK> yes ") == "yes"
    assert one(spark, X.bundled_excerpts(F.array(F.lit(" a  b "), F.lit(""), F.lit("c")), 3, 4), t="") == "a b "
    for text, quality in (("", "empty"), ("one two", "insufficient_text"), ("Table of Contents " + "x " * 1200, "possibly_index_only"), ("x " * 1200, "usable")):
        assert one(spark, X.extraction_quality("t"), t=text) == quality
    assert one(spark, X.clean_lines("t"), t=" a \t b \n\n  \n c d ") == "a b\nc d"
    assert one(spark, X.normal_ticker("t"), t="brk.b") == "BRK-B"
    assert one(spark, X.filing_url(F.lit("0000012"), F.lit("1-2-3"), F.lit("d.htm")), t="").endswith("/12/123/d.htm")
    assert one(spark, X.truthy("t"), t=" Yes ") and not one(spark, X.truthy("t"), t=None)
    assert [one(spark, X.annotation_quality("t"), t=t) for t in ("", "n/a", "a long answer without a head", "Themes: a, b and some more")] == ["low_empty_or_fragment", "low_empty_or_fragment", "medium_unstructured", "candidate_interpretive_signal"]
    assert one(spark, X.signal_excerpt("t", ["gold"], chars=12, before=4), t="aaaa bbbb gold cccc gold dddd") == "bbb gold ccc"
    assert one(spark, X.signal_excerpt("t", ["gold"], chars=6), t="no term here") == "no ter"


def test_headings_and_sections(spark):
    families = {"crew": ("crew",), "cargo": ("cargo", "freight")}
    lines = {"CREW AND OFFICERS": True, "Freight Rates and Tables": True, "the crew went ashore": True, "We sailed on to the next harbour.": False, "x": False, "": False, "12 34": False, "A Very " + "Long " * 40: False}
    for line, want in lines.items():
        assert one(spark, X.is_heading("t", families), t=line) == want, line
    assert one(spark, X.section_family("t", F.lit("about freight"), families), t="Notes") == "cargo"
    assert one(spark, X.section_family("t", F.lit("about freight"), families), t="The Crew") == "crew"
    body = "some plain words of this part go on and on for at least twenty words so that it is kept as a part here."
    text = "\n".join(["CREW AND OFFICERS", body, "FREIGHT RATES TODAY", body, "OTHER PORT MATTERS", body, "TOO SHORT PART", "few words"])
    df = spark.createDataFrame([(1, text), (2, "plain words only " * 10), (3, None)], "doc_id long, text string")
    got = sections.parsed(df, ["doc_id"], families=families, chunk=20)
    rows = sorted((r["doc_id"], r["section_order"], r["section_title"], r["section_family"]) for r in got.collect())
    assert rows == [(1, 0, "CREW AND OFFICERS", "crew"), (1, 1, "FREIGHT RATES TODAY", "cargo"), (1, 2, "OTHER PORT MATTERS", "other"), (2, 0, "Fallback chunk 1", "other"), (2, 1, "Fallback chunk 2", "other")]
    themes = (Theme("plain", "Plain", ("plain",)), Theme("part", "Part", ("part",)))
    diag = {(r["doc_id"], r["section_order"]): r for r in sections.diagnostics(df, got, ["doc_id"], themes, {"g": ("words",)}).collect()}
    assert diag[3, None]["section_status"] == "missing_proxy_text" and diag[1, 0]["dominant_theme_id"] == "part" and diag[1, 0]["total_theme_matches"] == 3
    assert diag[2, 0]["section_share"] == round(20 / 30, 6) and diag[1, 0]["section_genre_count"] == 2
    summary = {r["section_family"]: r for r in sections.family_summary(sections.diagnostics(df, got, ["doc_id"], themes, {"g": ("words",)}), ["doc_id"]).collect()}
    assert summary["other"]["section_rows"] == 3 and summary["other"]["company_years"] == 2
