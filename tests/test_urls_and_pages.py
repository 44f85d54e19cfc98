from pyspark.sql import functions as F

from panelight.functions import html, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_normal_form(spark):
    cases = {
        "HTTP://User@Shop.Example:80/A/b//?utm_medium=x&z=1&a=2&a=1#top": "http://shop.example/A/b?a=1&a=2&z=1",
        "shop.example": "https://shop.example/", "https://shop.example:8443": "https://shop.example:8443/", "https://shop.example/?gclid=1": "https://shop.example/",
        " https://shop.example/x?q=a b&e= ": "https://shop.example/x?e=&q=a+b", "": None, "https:///x": None, None: None,
    }
    for url, want in cases.items():
        assert one(spark, urls.normalised("u"), u=url) == want, url


def test_scores_and_types(spark):
    score = lambda u: one(spark, urls.identity_score("u"), u=u)
    assert score("https://x.example/pics/mark.png") == 0
    assert score("https://x.example/who-we-are") == 9 + 5 + 5 + 2
    assert score("https://x.example/about-us") == 5 + 4 + 2
    assert score("https://x.example/press/a/b/c/d") == -3 and score("") is None
    assert [one(spark, urls.page_type("u"), u=f"https://x.example/{p}") for p in ("our-values", "Mission", "purpose", "team")] == ["values", "mission", "purpose", "about"]
    assert one(spark, urls.is_asset("u"), u="https://x.example/a.PDF?x") and not one(spark, urls.is_asset("u"), u=None)


def test_variants(spark):
    assert one(spark, urls.homepage_variants("d"), d=" HTTP://Shop.example/ ") == ["https://shop.example/", "https://www.shop.example/", "http://shop.example/", "http://www.shop.example/"]
    got = one(spark, urls.recovery_variants("u"), u="https://shop.example/about-us")
    assert got[0] == "https://shop.example/about-us.html" and "http://www.shop.example/about-us" in got and len(got) == 7
    assert "https://shop.example/who-we-are" in one(spark, urls.recovery_variants("u"), u="https://shop.example/a/b/c/d/press") and one(spark, urls.recovery_variants("u"), u="") is None


def test_archive_addresses(spark):
    at = "https://web.archive.org/web/20200102030405id_/http://shop.example/a/b"
    assert one(spark, urls.replay_timestamp("u"), u=at) == "20200102030405" and one(spark, urls.replay_original("u"), u=at) == "http://shop.example/a/b"
    assert one(spark, urls.replay_variants("u"), u=at)[1:] == [at.replace("id_", "if_"), at.replace("id_", "")] and one(spark, urls.replay_variants("u"), u="http://x") == ["http://x"]
    go = lambda x: one(spark, urls.redirect_replay_url("u", "x"), u=at, x=x)
    assert go("../c") == "https://web.archive.org/web/20200102030405id_/http://shop.example/c"
    assert go("/web/2019/http://y") == "https://web.archive.org/web/2019/http://y" and go("https://web.archive.org/web/2019/http://y") == "https://web.archive.org/web/2019/http://y"
    assert go("") is None and go("mailto:a") is None and go("http://shop.example/a/b") is None
    page = "<noscript><meta http-equiv='refresh' content='0; url=/no'></noscript><META HTTP-EQUIV=\"Refresh\" CONTENT=\"0; URL='/yes'\">"
    assert one(spark, urls.refresh_target("p"), p=page) == "/yes" and one(spark, urls.refresh_target("p"), p=None) is None


PAGE = """<html><head><title>T</title><script>no</script></head><body><header>top</header><nav><a href="/about">About</a></nav>
<div class="cookie-banner">eat</div><main><h1>Head</h1><p>One&nbsp;two <b>three<br>four<wbr> five</p><div hidden>gone</div><p style="display: none">gone</p></main><footer>end</footer></body></html>"""


def test_page_texts(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>Page not found</p>"), (3, None), (4, "<body><a href='x'>all of it is a link</a></body>")], "page_id long, html string")
    got = {r["page_id"]: r for r in html.extracted(df, minimum_words=5).collect()}
    assert got[1]["page_text_clean"].split() == ["Head", "One", "two", "three", "four", "five"] and got[1]["used_main_region"] and got[1]["qa_flags"] == []
    assert "top" in got[1]["visible_text_raw"] and "gone" not in got[1]["visible_text_raw"] and "eat" in got[1]["visible_text_raw"]
    assert got[2]["qa_flags"] == ["short_text", "likely_error_page", "no_main_region"] and got[3]["qa_flags"] == ["empty_text", "no_main_region"]
    assert got[4]["link_text_ratio"] == 1.0 and "high_link_text_ratio" in got[4]["qa_flags"]
    assert html.extracted(df.limit(0)).collect() == []


def test_links_of_a_homepage(spark):
    page = '<a href="/our-mission">x</a><a href="http://shop.example/team">The company</a><a href="http://other.example/about">a</a><a href="#about">a</a><a href="/help">help</a><a href="/our-mission#x">again</a>'
    df = spark.createDataFrame([(1, "http://shop.example/index", page)], "page_id long, url string, html string")
    assert sorted(r["link"] for r in html.homepage_links(df).collect()) == ["http://shop.example/our-mission", "http://shop.example/team"]


def test_filings_and_json(spark):
    filing = "<html><head><title>no</title></head><body><ix:header>no</ix:header><p>One &amp; two</p><div>three<br>four</div></body></html>"
    assert one(spark, html.filing_text("t"), t=filing) == "One & two\nthree\nfour"
    assert one(spark, html.filing_text("t"), t="plain  text &lt;x") == "plain text <x" and one(spark, html.filing_text("t"), t=None) == ""
    payload = '{"url": "a b c d", "body": ["<p>We sail the seas</p>", {"note": "we SAIL the seas"}, "two words", "see https://x.example now or later"], "n": 3}'
    assert one(spark, html.json_text("t"), t=payload) == "We sail the seas\nsee now or later"
    assert one(spark, html.json_text("t"), t="{") == "" and one(spark, html.json_text("t"), t=None) == ""
