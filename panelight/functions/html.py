"""Text and links of HTML pages: one pass of the standard library's parser over Arrow batches, then column expressions.

A page is read by one task; a null page is an empty page.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.functions import urls
from panelight.functions.text import TOKEN, whole

# How elements and attributes are read.
INVISIBLE = frozenset({"script", "style", "noscript", "template", "svg", "canvas"})
BOILERPLATE = frozenset({"nav", "footer", "header", "aside"})
WITHOUT_END = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"})
BLOCKS = frozenset({"article", "blockquote", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "main", "p", "section", "td", "th", "tr"})
FILING_HIDDEN = frozenset({"script", "style", "noscript", "ix:header", "head"})
FILING_BREAKS = frozenset({"p", "div", "br", "tr", "table", "section", "article", "h1", "h2", "h3"})
BOILERPLATE_NAMES = r"(?i)(?:^|[-_\s])(?:breadcrumb|cookie|footer|header|menu|modal|nav|newsletter|popup|privacy-banner|search|share|sidebar|social|subscribe)(?:$|[-_\s])"
ERROR_PAGE = r"(?iU)\b(?:404|page not found|page unavailable|access denied|temporarily unavailable)\b"
JSON_KEYS_WITHOUT_TEXT = frozenset({"asset_id", "caption", "created_at", "height", "href", "id", "provider", "ratio", "slug", "src", "src_widths", "updated_at", "url", "video_id", "width"})

HIDDEN, NOISE, MAIN, ANCHOR = 1, 2, 4, 8
_NAMES = re.compile(BOILERPLATE_NAMES)
_BLANKS = re.compile(r"[ \t\f\v]+")


class _Reader(HTMLParser):
    """Three texts of a page (all that is visible, without boilerplate, of the main region), its links and character counts.

    Each open element carries the marks of those round it, so a text needs to look at the innermost one only.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.texts: dict[int, list[str]] = {0: [], NOISE: [], MAIN: []}
        self.chars = self.link_chars = 0
        self.region = False
        self.links: list[list] = []

    def marks(self, tag: str, attrs: dict[str, str]) -> int:
        style = attrs.get("style", "").replace(" ", "").lower()
        hidden = tag in INVISIBLE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style
        noise = tag in BOILERPLATE or _NAMES.search(f"{attrs.get('id', '')} {attrs.get('class', '')}")
        main = tag in ("main", "article") or attrs.get("role", "").lower() == "main"
        return (HIDDEN if hidden else 0) | (NOISE if noise else 0) | (MAIN if main else 0) | (ANCHOR if tag == "a" else 0)

    def handle_starttag(self, tag, attrs):
        values = {k.lower(): v or "" for k, v in attrs}
        if tag == "body":  # what came before it is no part of the page's text
            self.open, self.texts[NOISE], self.texts[MAIN] = [], [], []
        marks = self.marks(tag, values) | (self.open[-1][1] if self.open else 0)
        self.region |= bool(marks & MAIN)
        if tag in BLOCKS:
            self.line()
        if tag == "a" and values.get("href"):
            self.links.append([values["href"].strip(), []])
        if tag not in WITHOUT_END:
            self.open.append((tag, marks))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in WITHOUT_END:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.line()
        last = max((i for i, (name, _) in enumerate(self.open) if name == tag), default=None)
        if last is not None:
            del self.open[last:]

    def handle_data(self, data):
        text = _BLANKS.sub(" ", data).strip()
        if not text or not self.open:
            return
        marks = self.open[-1][1]
        if marks & ANCHOR and self.links:
            self.links[-1][1].append(text)
        if marks & HIDDEN:
            return
        self.chars += len(text)
        self.link_chars += len(text) if marks & ANCHOR else 0
        for kind, fits in ((0, True), (NOISE, not marks & NOISE), (MAIN, marks & MAIN and not marks & NOISE)):
            if fits:
                self.texts[kind].append(text)

    def line(self):
        for parts in self.texts.values():
            if parts and parts[-1] != "\n":
                parts.append("\n")

    def text(self, kind: int) -> str:
        joined = " ".join(self.texts[kind]).replace("\r\n", "\n").replace("\r", "\n")
        return re.sub(r" *(?:\n *)+", "\n", joined).strip()


def _read(page: str) -> _Reader:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader


PAGE = T.StructType([T.StructField("visible_text_raw", T.StringType()), T.StructField("main_text", T.StringType()), T.StructField("broad_text", T.StringType()), T.StructField("link_text_ratio", T.DoubleType()), T.StructField("has_main_region", T.BooleanType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))])


def parsed(page: Column | str) -> Column:
    """What one reading of a page gives, as a struct (``PAGE``)."""

    @F.pandas_udf(PAGE)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for p in pages:
                r = _read(p)
                rows.append((r.text(0), r.text(MAIN), r.text(NOISE), r.link_chars / r.chars if r.chars else 0.0, r.region, [{"href": a, "text": " ".join(b)} for a, b in r.links]))
            yield pd.DataFrame(rows, columns=PAGE.names)

    return read(whole(page))


def extracted(df: DataFrame, html_col: str = "html", minimum_words: int = 75) -> DataFrame:
    """``df`` with visible_text_raw, page_text_clean, used_main_region, clean_word_count, clean_char_count, alpha_ratio, link_text_ratio and qa_flags.

    The main region's text is preferred.  Flags name what looks suspicious; nothing is thrown away.
    """
    new = ["visible_text_raw", "page_text_clean", "used_main_region", "clean_word_count", "clean_char_count", "alpha_ratio", "link_text_ratio", "qa_flags"]
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    page = df.withColumn("__page", parsed(html_col)).select(*kept, "__page.visible_text_raw", F.when(F.col("__page.main_text") != "", F.col("__page.main_text")).otherwise(F.col("__page.broad_text")).alias("page_text_clean"), (F.col("__page.main_text") != "").alias("used_main_region"), "__page.link_text_ratio", F.col("__page.has_main_region").alias("__region"))
    clean = F.col("page_text_clean")
    words, chars = F.regexp_count(clean, F.lit(TOKEN)).cast("long"), F.length(clean).cast("long")
    alpha = F.when(chars > 0, F.regexp_count(clean, F.lit(r"\p{L}")) / chars).otherwise(F.lit(0.0))
    page = page.select("*", words.alias("clean_word_count"), chars.alias("clean_char_count"), alpha.alias("alpha_ratio"))
    flags = [
        F.when(clean == "", "empty_text").when(F.col("clean_word_count") < minimum_words, "short_text"),
        F.when((clean != "") & (F.col("alpha_ratio") < 0.5), "low_alpha_ratio"),
        F.when(F.col("link_text_ratio") > 0.4, "high_link_text_ratio"),
        F.when(F.left(clean, F.lit(1000)).rlike(ERROR_PAGE), "likely_error_page"),
        F.when(~F.col("__region"), "no_main_region"),
    ]
    return page.withColumn("qa_flags", F.array_compact(F.array(*flags))).drop("__region")


def homepage_links(df: DataFrame, html_col: str = "html", url_col: str = "url", keywords: tuple[str, ...] = urls.IDENTITY_KEYWORDS) -> DataFrame:
    """The columns of ``df`` but the page, and link: one row for each distinct link of a page to its own host whose path or text has a keyword."""
    kept = [c for c in df.columns if c not in (html_col, "link")]
    anchors = df.select(*[F.col(f"`{c}`") for c in kept], F.explode(parsed(html_col)["links"]).alias("__a"))
    anchors = anchors.filter(~F.col("__a.href").rlike("(?i)^(#|mailto:|tel:|javascript:)") & (F.col("__a.href") != ""))
    link = urls.normalised(urls.joined(F.col(f"`{url_col}`"), F.col("__a.href")))
    found = anchors.select(*[F.col(f"`{c}`") for c in kept], F.lower("__a.text").alias("__text"), link.alias("link"))
    near = F.concat(F.lower(urls.path("link")), F.lit(" "), F.col("__text"))
    wanted = near.rlike("|".join(re.escape(k) for k in keywords))
    return found.filter((urls.host("link") == urls.host(urls.normalised(F.col(f"`{url_col}`")))) & wanted).drop("__text").distinct()


class _Filing(HTMLParser):
    """Text of a filing: hidden parts are counted in and out, block elements break lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in FILING_HIDDEN
        if tag in FILING_BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in FILING_HIDDEN and self.depth > 0
        if tag in FILING_BREAKS and tag != "br":
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data)


def clean_filing(text: str) -> str:
    t = re.sub(r"[ \t\r\f\v]+", " ", entities.unescape(text).replace("\xa0", " "))
    return "\n".join(line for line in map(str.strip, t.splitlines()) if line)


def filing_text(content: Column | str, content_type: Column | None = None) -> Column:
    """Visible text of a filing (string or binary); what isn't HTML is only cleaned."""

    @F.pandas_udf("string")
    def read(contents: pd.Series, types: pd.Series) -> pd.Series:
        def one(c, kind) -> str:
            t = "" if c is None else c.decode("utf-8", "replace") if isinstance(c, bytes) else c
            if "html" not in (kind or "").lower() and not re.search(r"<html|<body|<document", t, re.IGNORECASE):
                return clean_filing(t)
            f = _Filing()
            f.feed(t)
            return clean_filing(" ".join(f.parts))

        return pd.Series([one(c, k) for c, k in zip(contents, types)], dtype="object")

    return read(F.col(content) if isinstance(content, str) else content, F.lit("") if content_type is None else content_type)


def json_narrative(payload: str | None, minimum_words: int = 3) -> str:
    """Readable strings of a JSON payload, in order, each once; "" where it isn't JSON."""
    try:
        todo = [("", json.loads(payload or ""))]
    except ValueError:
        return ""
    parts: dict[str, str] = {}
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += [(str(k).lower(), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(key, v) for v in reversed(value)]
        elif isinstance(value, str) and key not in JSON_KEYS_WITHOUT_TEXT:
            text = re.sub(r"https?://\S+", " ", re.sub(r"<[^>]+>", " ", entities.unescape(value)))
            text = _BLANKS.sub(" ", text).strip()
            if len(re.findall(r"\b[\w'-]+\b", text)) >= minimum_words:
                parts.setdefault(text.casefold(), text)
    return "\n".join(parts.values())


def json_text(payload: Column | str, minimum_words: int = 3) -> Column:
    @F.pandas_udf("string")
    def read(payloads: pd.Series) -> pd.Series:
        return pd.Series([json_narrative(p, minimum_words) for p in payloads], dtype="object")

    return read(F.col(payload) if isinstance(payload, str) else payload)
