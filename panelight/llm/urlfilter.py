"""URL filters: rules first, then trust and distrust propagated over the host graph.

Hosts that an allow rule fits are trusted seeds, hosts that a block rule fits
are blocked seeds; every seed of either side has the same weight.  Trust flows along links (personalised PageRank from the
trusted), distrust flows against them (a page that links to blocked hosts is
distrusted).  A host is blocked when its distrust exceeds ``ratio`` times its
trust.  Values are fixed-point integers, so sums do not depend on their order.
They are counted in units of 10**-30 and compared so; the columns trust and
distrust show them in whole units of 10**-12.  Flow is passed on until less than
``BOUND`` of all trust is on its way, so no number of steps cuts it off.

All steps are DataFrame operations on one row per host or host pair, which
are aggregated before any shuffle; html is read by the scan only.

A null url, or one without ``://``, has an empty host and path; it fits no rule
and takes the verdict of a host without evidence, allow.  A null html
has no links.  Repeated pages are each reported.  A host with as much trust as
distrust (a tie) is allowed.  Links of a page of any length are all read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelight.llm.common import LOWER, UPPER, ascii_lower, checkpoint

ALLOW, BLOCK = "allow", "block"
#: Rules (host, path, verdict) of the registered query.
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
#: A rank of 1, steps, and the share that follows links (of 100).
UNIT, STEPS, DAMPING = 10**12, 8, 85
#: Parts of a unit that are counted, and the units on their way at which the spreading ends (10**-12 of all; 171 steps at most).
FINE, BOUND = 10**18, 1
#: Decimal type of the counts: 31 digits, times links.
COUNT = "decimal(38,0)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first in string order."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts and their number."""
    links = F.regexp_extract_all("html", F.lit(LINK), 1)
    e = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    e = e.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return e.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _whole(over: str, by: str) -> str:
    """SQL of the whole part of a quotient of counts; ``div`` would give a long."""
    return f"cast((({over}) - ({over}) % ({by})) / ({by}) AS {COUNT})"


def spread(seeds: DataFrame, edges: DataFrame, steps: int | None = None, damping: int = DAMPING, among: DataFrame | None = None) -> DataFrame:
    """host, score (of UNIT * FINE): personalised PageRank from ``seeds`` (host) along ``edges`` (src, dst, n).

    Each seed begins with its part of UNIT among the rows of ``among`` (else of ``seeds``).

    What is on its way is kept apart from what stays: of each host's flow ``100 - damping`` percent
    stay and the rest goes on, until ``BOUND`` or for just ``steps``; what is left then stays where it is.
    """
    count = F.broadcast((seeds if among is None else among).agg(F.greatest(F.count("*"), F.lit(1)).alias("k")))
    moving = checkpoint(seeds.crossJoin(count).select("host", F.expr(f"cast({UNIT} div k AS {COUNT}) * {FINE}BD").cast(COUNT).alias("score")))  # one row on the right
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    # a host of many links passes score * part / whole on: multiplied first, with the remainder of score / whole
    part, whole = F.expr(f"cast(n * {damping}BD AS {COUNT})"), F.expr(f"cast(total * 100BD AS {COUNT})")
    weighted = checkpoint(edges.join(out, "src").select("src", "dst", part.alias("part"), whole.alias("whole")))
    passed = F.expr(f"{_whole('score', 'whole')} * part + {_whole('(score % whole) * part', 'whole')}").cast(COUNT)
    parts, step = [], 0
    while step != steps and (moving.agg(F.sum("score")).first()[0] or 0) >= BOUND * FINE:
        parts.append(moving.select("host", F.expr(_whole(f"score * {100 - damping}BD", "100BD")).alias("score")))
        if len(parts) == 16:
            parts = [checkpoint(_sums(parts))]
        flow = moving.join(weighted, moving["host"] == weighted["src"]).select(F.col("dst").alias("host"), passed.alias("score"))
        moving = checkpoint(_sums([flow]).filter("score > 0"))
        step += 1
    return checkpoint(_sums([*parts, moving]))


def _sums(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("score").cast(COUNT).alias("score"))


def host_scores(pages: DataFrame, rules=RULES, steps: int | None = None) -> DataFrame:
    """host, trust, distrust (of UNIT * FINE) of every host with any."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''")
    judged = hosts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).filter("r IS NOT NULL").select("host", F.col("r.verdict").alias("verdict")).distinct()
    judged, edges = checkpoint(judged), checkpoint(host_edges(pages))
    # seeds of both sides weigh alike, so how many others there are of either side does not matter
    trust = spread(judged.filter(F.col("verdict") == ALLOW).select("host"), edges, steps, among=judged)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(judged.filter(F.col("verdict") == BLOCK).select("host"), back, steps, among=judged)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(COUNT).alias(c)
    return trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full").select("host", zero("trust"), zero("distrust"))


def judge(pages: DataFrame, rules=RULES, ratio: int = 1, steps: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of ``pages``."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    scores = host_scores(pages, rules, steps)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # only hosts that can be blocked matter to a page's verdict; adaptive execution broadcasts or splits by measured size
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(scores, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0)).cast(COUNT) for c in ("trust", "distrust"))
    units = lambda c: F.expr(f"cast({_whole(f'coalesce({c}, 0BD)', f'{FINE}BD')} AS BIGINT)").alias(c)
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(distrust > ratio * trust, BLOCK).otherwise(ALLOW)).alias("verdict"), units("trust"), units("distrust"))


def oracle(rules=RULES, steps: int = STEPS, damping: int = DAMPING) -> str:
    case = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}" for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])))
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    parts = [
        f"p AS MATERIALIZED (SELECT page_id, html, coalesce({low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"r AS MATERIALIZED (SELECT page_id, host, path, CASE {case} END AS r FROM p)",
        "j AS MATERIALIZED (SELECT DISTINCT host, r.verdict AS verdict FROM r WHERE r IS NOT NULL AND host <> '')",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p)",
        f"l2 AS (SELECT src, coalesce({low("regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS dst FROM l)",
        "e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM l2 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2)",
    ]
    for name, verdict, a, b in (("t", ALLOW, "src", "dst"), ("d", BLOCK, "dst", "src")):
        parts.append(f"w{name} AS MATERIALIZED (SELECT {a} AS src, {b} AS dst, n, sum(n) OVER (PARTITION BY {a}) AS total FROM e)")
        parts.append(f"b{name} AS MATERIALIZED (SELECT host, {UNIT} // (SELECT count(*) FROM j) AS seed FROM j WHERE verdict = '{verdict}')")
        parts.append(f"{name}0 AS MATERIALIZED (SELECT host, seed AS score FROM b{name})")
        for i in range(steps):
            parts.append(
                f"{name}{i + 1} AS MATERIALIZED (SELECT host, cast(sum(score) AS BIGINT) AS score FROM (SELECT w.dst AS host, cast((s.score // w.total) * w.n * {damping} // 100 AS BIGINT) AS score FROM {name}{i} s JOIN w{name} w ON s.host = w.src"
                f" UNION ALL SELECT host, seed * {100 - damping} // 100 FROM b{name}) GROUP BY host)"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT page_id, r.host, path, r.r.rule AS rule, coalesce(r.r.verdict, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust"
        f" FROM r LEFT JOIN t{steps} t ON t.host = r.host LEFT JOIN d{steps} d ON d.host = r.host"
    )


ORACLE = oracle()
