"""Benchmark decontamination in DataFrame operations only.

The normalised n-grams of the benchmark are a set of windows.  Of every document
only sparse anchors (each ``stride``-th short n-gram; any window holds exactly one
that begins at a multiple of the stride) are looked up by hash in the set of the
benchmark's anchors.  Round the few that are found the windows themselves are
looked up, by their words, so every hit is verified.  Both sets are broadcast
when their measured bytes are below ``BROADCAST_BYTES``; above it the same
look-ups are shuffle joins, before which each anchor takes the words around it
along instead of the whole text.  Rows and results are the same either way.

Hits depend on the text alone, so they are kept by a 128-bit hash of it: equal texts
are looked up as one and no row needs a number of its own.

Words: runs of digits, a-z and all characters beyond ASCII, after lower-casing
A-Z.  A window is ``n`` consecutive words of an item; an item of fewer words
(but not none) is one window.  Null and empty texts have no words, are never
hit, and as items hit nothing.  Repeated rows are each reported.  A text of any length
is split in one task; its hits are at most its words.  Items that share a window (ties) are all reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelight.llm.common import LOWER, UPPER, ascii_lower, checkpoint

#: Separators, in a text of either case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Bytes of windows that may be broadcast.
BROADCAST_BYTES = 64 << 20


def words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, SEPARATORS + "+"), "")


def benchmark_windows(benchmark: DataFrame, n: int = 13, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (id as string), size and window (words joined by blanks): the distinct windows of every item."""
    w = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    w = w.filter("size(w) > 0").select("item", "w", F.least(F.size("w"), F.lit(n)).alias("size"))
    return w.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> array_join(slice(w, i, size), ' '))")).alias("window")).distinct()


def _anchor(size: int) -> tuple[int, int]:
    """(words, stride): any window of ``size`` words holds one anchor that starts at a multiple of the stride."""
    a = (size + 1) // 2
    return a, size - a + 1


#: The columns that stand for a text: two hashes of it.
KEY = ["key_a", "key_b"]


def _key(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("key_a"), F.xxhash64(F.lit(7), t).alias("key_b")]


def hits(texts: DataFrame, windows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key_a, key_b, n_words (of the text), pos (from 0), size, window: every benchmark window in the texts (column text).

    ``windows`` should be a written table; it is read several times.
    """
    distinct = windows.select("size", "window").distinct()
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect())  # at most n of them
    if not sizes:
        return texts.sparkSession.createDataFrame([], "key_a long, key_b long, n_words long, pos int, size int, window string")
    known = distinct.agg(F.coalesce(F.sum(F.octet_length("window") + 64), F.lit(0))).first()[0]
    small = known <= broadcast_bytes
    near = F.broadcast if small else (lambda d: d)
    a, stride = "((size + 1) div 2)", "(size - (size + 1) div 2 + 1)"
    anchors = distinct.select("size", F.explode(F.expr(f"transform(sequence(1, size - cast({a} AS int) + 1), i -> xxhash64(size, slice(split(window, ' '), i, cast({a} AS int))))")).alias("h")).select("h").distinct()
    every = texts.select("text", words(ascii_lower(F.coalesce(F.col("text"), F.lit("")))).alias("w"))
    # all anchors of a text in one array: the size, which of its anchors it is, and the hash
    parts = []
    for size in sizes:
        n, step = _anchor(size)
        parts.append(f"CASE WHEN size(w) >= {size} THEN transform(sequence(1, size(w) - {n - 1}, {step}), (i, j) -> named_struct('size', {size}, 'j', j, 'h', xxhash64({size}, slice(w, i, {n})))) ELSE cast(array() as array<struct<size: int, j: int, h: bigint>>) END")
    # made before the rows are multiplied, so that the explode copies nothing but the anchors that are found; outer, as the optimiser
    # else adds filters on the arrays, for which it would split the text again in every step of a lambda
    at = every.select("text", "w", F.expr(f"concat({', '.join(parts)})").alias("anchors")).select("text", "w", F.explode_outer("anchors").alias("p")).select("text", "w", "p.size", "p.j", "p.h")
    # anchor j begins at word j * stride + 1 and lies in the windows that begin up to stride - 1 words before
    first = f"cast(greatest(j * {stride} + 2 - {stride}, 1) AS int)"
    around = ["size", *_key(F.col("text")), F.size("w").cast("long").alias("n_words"), F.expr(f"{first} - 1").alias("start"), F.expr(f"slice(w, {first}, cast(j * {stride} AS int) + size - {first} + 1)").alias("part")]
    at = at.join(near(anchors), "h").select(*around) if small else at.select("h", *around).join(anchors, "h").drop("h")
    whole = "CASE WHEN size(part) >= size THEN transform(sequence(1, size(part) - size + 1), i -> array_join(slice(part, i, size), ' ')) ELSE cast(array() as array<string>) END"
    ws = at.select("size", *KEY, "n_words", "start", F.posexplode_outer(F.expr(whole)).alias("i", "window"))
    return ws.join(near(distinct), ["size", "window"]).select(*KEY, "n_words", (F.col("start") + F.col("i")).alias("pos"), "size", "window").distinct()


def hit_spans(found: DataFrame) -> DataFrame:
    """key_a, key_b, n_words and spans: (pos, size) of every hit of a text, in order."""
    return found.groupBy(*KEY, "n_words").agg(F.sort_array(F.collect_list(F.struct("pos", "size"))).alias("spans"))


def n_hit() -> Column:
    """Words inside any span: sorted spans swept from the left."""
    return F.expr(
        "aggregate(spans, named_struct('hit', 0, 'end', 0), (acc, s) -> named_struct("
        "'hit', acc.hit + greatest(0, s.pos + s.size - greatest(acc.end, s.pos)), 'end', greatest(acc.end, s.pos + s.size)), acc -> cast(acc.hit as bigint))"
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def n_words(text: Column) -> Column:
    return F.size(words(ascii_lower(F.coalesce(text, F.lit(""))))).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    windows = checkpoint(benchmark_windows(benchmark, n))
    found = checkpoint(hits(docs, windows, broadcast_bytes))
    spans = hit_spans(found).select(*KEY, n_hit().alias("n_hit"))
    seen = found.select(*KEY, "size", "window").distinct().join(windows, ["size", "window"]).select(*KEY, "item").distinct()
    items = seen.groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    of = checkpoint(spans.join(items, KEY).select(*KEY, "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    rows = docs.select("doc_id", n_words(F.col("text")).alias("n_words"), *_key(F.col("text"))).join(of, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256")).select("*", contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, remove: str = "documents", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``) or with the hit words cut out (``"spans"``).

    All columns stay as they were, whatever their names.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = checkpoint(hits(packed.select("text"), checkpoint(benchmark_windows(benchmark, n)), broadcast_bytes))
    spans = hit_spans(found).select(*KEY, "n_words", "spans", n_hit().alias("n_hit"))
    keyed = packed.select("__doc", "text", *_key(F.col("text")))
    if remove == "documents":
        return keyed.join(checkpoint(spans.filter(contaminated()).select(*KEY)), KEY, "left_anti").select("__doc.*")
    rows = keyed.join(checkpoint(spans.drop("n_words")), KEY, "left")
    lead = F.regexp_extract("text", f"^{SEPARATORS}*", 0)
    pieces = F.expr(f"regexp_extract_all(text, r'[^{SEPARATORS[1:]}+{SEPARATORS}*', 0)").alias("pieces")
    gone = F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.pos, s.pos + s.size - 1))))").alias("gone")
    cut = rows.select("__doc", "n_hit", "text", lead.alias("lead"), pieces, gone)
    cut = cut.select("*", F.expr("transform(array_except(slice(sequence(0, size(pieces)), 1, size(pieces)), gone), i -> element_at(pieces, i + 1))").alias("kept_pieces"))
    text = F.when(F.col("n_hit") > 0, F.concat("lead", F.array_join("kept_pieces", ""))).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == text_col else F.col(f"__doc.`{c}`").alias(c) for c in names])


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_PATTERN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_PATTERN}') AS w FROM benchmark),
bw AS (SELECT DISTINCT cast(item_id AS VARCHAR) AS item, least(len(w), 13) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
dw AS (SELECT r, doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: {{'p': i, 'win': array_to_string(w[i:i + size - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
h AS (SELECT r, x.p AS p, dw.size, item FROM dw JOIN bw ON bw.size = dw.size AND bw.win = x.win),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM h GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
