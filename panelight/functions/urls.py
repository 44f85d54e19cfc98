"""URL functions.  All but joining relative links are column expressions; a URL that can't be read is null."""

from __future__ import annotations

from functools import reduce
from operator import add
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelight.functions.binding import let

# Tracking parameters, identity words and paths.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
IDENTITY_KEYWORDS = ("about", "company", "corporate", "mission", "purpose", "values", "who-we-are", "who we are")
ABOUT_FORMS = ("about-us", "aboutus", "company-info")
OFF_TOPIC = ("news", "press", "careers", "investor", "privacy")
IDENTITY_PATHS = ("/about", "/about-us", "/company", "/company/about", "/company/about-us", "/corporate", "/our-company", "/who-we-are")
ASSET_URL = r"(?i)(?:/media/|/images?/|/assets?/|/static/|/~/media/|\.(?:ashx|css|gif|ico|jpe?g|js|pdf|png|svg|webp)(?:[?#]|$))"
ASSET_PATH = r"\.(?:css|js|json|xml|png|jpe?g|gif|svg|pdf|ashx)(?:$|[?#])"
ARCHIVE = "https://web.archive.org/web"
REPLAY = r"(?i)^https?://web\.archive\.org/web/(\d{1,14})(?:[a-z]{2}_)?/(.+)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group)


def is_asset(url: Column | str) -> Column:
    return F.coalesce(_col(url).rlike(ASSET_URL), F.lit(False))


def host(url: Column | str) -> Column:
    """The lower-case host without user and port; null if there is none."""
    return F.nullif(F.lower(_part(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)")), F.lit(""))


def scheme(url: Column | str) -> Column:
    return F.lower(_part(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://"))


def path(url: Column | str) -> Column:
    return _part(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def normalised(url: Column | str) -> Column:
    """A stable form: a scheme (https if none), lower-case scheme and host, no default port, no fragment, no slash at the end,
    no tracking parameters, parameters sorted.  Null for an empty URL or one without a host."""
    u = F.trim(F.coalesce(_col(url), F.lit("")))
    return let(F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u)), _normalised)


def _normalised(u: Column) -> Column:
    s, h = scheme(u), host(u)
    port = _part(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]*:(\d+)")
    default = ((s == "http") & (port == "80")) | ((s == "https") & (port == "443"))
    place = F.when((port == "") | default, h).otherwise(F.concat(h, F.lit(":"), port))
    p = path(u)
    p = F.when(p.rlike("^/*$"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    query = _part(u, r"^[^?#]*\?([^#]*)")
    pair = lambda x: F.struct(_decoded(F.element_at(F.split(x, "=", 2), 1)).alias("k"), _decoded(F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit(""))).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair)
    pairs = F.filter(pairs, lambda x: ~F.lower(x["k"]).startswith("utm_") & ~F.lower(x["k"]).isin(*TRACKING_KEYS))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(F.lit("&"), F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "")
    return F.when(h.isNotNull(), F.concat(s, F.lit("://"), place, p, F.regexp_replace(text, "^&", "?")))


def replay_url(timestamp: Column | str, original: Column | str, kind: str = "id_") -> Column:
    """The archive's address of a capture; ``timestamp`` has 14 digits."""
    return F.concat(F.lit(f"{ARCHIVE}/"), _col(timestamp), F.lit(f"{kind}/"), _col(original))


def replay_timestamp(url: Column | str) -> Column:
    return F.nullif(_part(_col(url), REPLAY, 1), F.lit(""))


def replay_original(url: Column | str, otherwise: Column | str | None = None) -> Column:
    found = F.nullif(_part(_col(url), REPLAY, 2), F.lit(""))
    return found if otherwise is None else F.coalesce(found, _col(otherwise))


def replay_variants(url: Column | str) -> Column:
    """The raw, the frame and the plain address of a capture, in this order; any other URL alone."""
    u = _col(url)
    t, o = replay_timestamp(u), replay_original(u)
    return F.when(t.isNotNull(), F.array(replay_url(t, o), replay_url(t, o, "if_"), replay_url(t, o, ""))).otherwise(F.array(u))


def page_type(url: Column | str) -> Column:
    p = F.lower(path(url))
    return F.when(p.contains("values") | p.contains("principles"), "values").when(p.contains("mission"), "mission").when(p.contains("purpose"), "purpose").otherwise("about")


def identity_score(url: Column | str) -> Column:
    """How likely a URL is a company's page about itself; 0 for assets, null if it can't be read."""
    return let(normalised(url), _score)


def _score(n: Column) -> Column:
    def points(p: Column, spaced: Column) -> Column:
        has = lambda words, *where: reduce(lambda a, b: a | b, [w.contains(x) for x in words for w in where])
        depth = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
        parts = [F.when(spaced.contains("who we are"), 9).otherwise(0), *[F.when(has([k], p, spaced), 5).otherwise(0) for k in IDENTITY_KEYWORDS]]
        parts += [F.when(has(ABOUT_FORMS, p), 4).otherwise(0), F.when(depth <= 4, 2).otherwise(0), F.when(has(OFF_TOPIC, p), -3).otherwise(0)]
        return F.when(p.rlike(ASSET_PATH), 0).otherwise(reduce(add, parts))

    scored = let(F.struct(F.lower(path(n)).alias("p"), F.translate(F.lower(path(n)), "-_", "  ").alias("s")), lambda x: points(x["p"], x["s"]))
    return F.when(n.isNotNull(), scored).cast("int")


def homepage_variants(domain: Column | str) -> Column:
    """Normalised homepages of a domain: https and http, with and without www, distinct."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(domain))), "^https?://", ""), "^/+|/+$", "")
    www = F.when(h.startswith("www."), h).otherwise(F.concat(F.lit("www."), h))
    made = [normalised(F.concat(F.lit(f"{s}://"), x, F.lit("/"))) for s in ("https", "http") for x in (h, www)]
    return F.array_distinct(F.array_compact(F.array(*made)))


def recovery_variants(url: Column | str, common: tuple[str, ...] = IDENTITY_PATHS) -> Column:
    """Other addresses a page may have had: the other scheme, with or without www, a slash or .html at the end,
    and common identity paths where the URL's own score is not positive."""
    more = F.array(*[F.lit(x) for c in common for x in (c, f"{c}.html")])

    def places(n: Column) -> Column:
        h, p, bare = host(n), path(n), F.regexp_replace(path(n), "/+$", "")
        www = F.when(h.startswith("www."), F.substr(h, F.lit(5))).otherwise(F.concat(F.lit("www."), h))
        schemes = F.when(scheme(n) == "https", F.array(F.lit("https"), F.lit("http"))).otherwise(F.array(F.lit("http"), F.lit("https")))
        own = F.when((p == "/") | F.element_at(F.split(bare, "/"), -1).contains("."), F.array(p)).otherwise(F.array(p, F.concat(bare, F.lit(".html"))))
        paths = F.array_sort(F.array_distinct(F.when(_score(n) <= 0, F.concat(own, more)).otherwise(own)))
        return F.struct(n.alias("n"), schemes.alias("s"), F.array(h, www).alias("h"), paths.alias("p"))

    def every(x: Column) -> Column:
        made = F.flatten(F.transform(x["s"], lambda a: F.flatten(F.transform(x["h"], lambda b: F.transform(x["p"], lambda c: F.concat(a, F.lit("://"), b, c))))))
        return F.filter(F.array_distinct(made), lambda v: v != x["n"])

    return let(let(normalised(url), places), lambda x: F.when(x["n"].isNotNull(), every(x)))


def joined(base: Column | str, link: Column | str) -> Column:
    """``link`` resolved against ``base``; a Python function on Arrow batches, as the rules are the standard library's."""

    @F.pandas_udf("string")
    def join(bases: pd.Series, links: pd.Series) -> pd.Series:
        def one(b, x):
            try:
                return urljoin(b, x)
            except (ValueError, TypeError):
                return None

        return pd.Series([one(b, x) for b, x in zip(bases, links)], dtype="object")

    return join(_col(base), _col(link))


def refresh_target(html: Column | str) -> Column:
    """The address of a meta refresh in a page, outside noscript; null if there is none."""
    page = F.regexp_replace(F.coalesce(_col(html), F.lit("")), r"(?is)<noscript\b.*?</noscript>", "")
    found = _part(page, r"""(?is)<meta[^>]+http-equiv\s*=\s*["']?refresh["']?[^>]*content\s*=\s*["'][^"'>]*?url\s*=\s*['"]?([^"'>\s]+)""")
    return F.nullif(found, F.lit(""))


def redirect_replay_url(replay: Column | str, location: Column | str) -> Column:
    """Where a link out of a capture leads: an archive address as it is, any other link resolved against the original page and
    replayed at the capture's own time.  Null without a link to another page."""
    r, x = _col(replay), F.trim(F.replace(_col(location), F.lit("&amp;"), F.lit("&")))
    t, original = replay_timestamp(r), replay_original(r)
    elsewhere = joined(original, x)
    none = x.isNull() | (x == "") | x.rlike("(?i)^(javascript|mailto):") | t.isNull()
    return F.when(none, None).when(host(x) == "web.archive.org", x).when(x.startswith("/web/"), F.concat(F.lit("https://web.archive.org"), x)).when(elsewhere != original, replay_url(t, elsewhere))
