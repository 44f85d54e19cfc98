"""Near-duplicate classes: one-permutation MinHash, banded buckets, star-shaped candidates.

1.  One Python pass over the texts gives the size of each shingle set, a 128-bit
    fingerprint of it and the hashes of its bands.  One permutation is cut into
    bins; an empty bin takes the value of the first non-empty bin in a fixed
    random order of its own (optimal densification).
2.  Equal sets collapse to one node before anything else, so copies cost one
    row each.
3.  Every bucket links its members to one hub (a star), never to each other:
    the member that shares most buckets with others.  Links are confirmed on
    full sets and joined to components.
4.  A star misses a link between two members that are both unlike the hub.
    The members of buckets that still hold several components get an exact
    prefix filter: shingles are ordered by rarity, and two sets of the wanted
    similarity must share one among the rarest few of each, at places that
    leave room for the overlap.  Passages that many texts share come last in
    that order and give no candidates.  Each of these rare shingles first
    links to a hub of its own; what is left of different components is paired
    only where both places allow the similarity.  No link of a bucket is lost.

Pairs of one component are never made.  What can still grow with the square of
a group are texts of different components that agree in their rare shingles
nearly, but not quite, up to the threshold: those have to be compared.

Skew: every join is a plain shuffle join of two written or scanned inputs, which
adaptive execution can split; every grouping combines before its shuffle, but
for the rare shingles of one text.  Nothing of the corpus reaches the driver.

Null and empty texts have the empty set and are linked with nothing.  A text
of fewer than ``k`` words has one shingle, the whole sequence; a text of any length
is one set, held in one task.  Ties between hubs go to the least node.  A null id is linked
with nothing, its component is null and it is kept.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.llm.common import checkpoint, forget, map_texts

#: 32 bands of 4 bins: two sets of similarity 0.8 share no bucket once in 20 million times.
BINS, BANDS = 128, 32

_ODD = np.random.default_rng(20).integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_ORDER = np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)])
_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _ODD[60]
    h = (h ^ (h >> np.uint64(29))) * _ODD[61]
    return h ^ (h >> np.uint64(32))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased, words split at ASCII white space."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total = (total ^ h[i : i + n]) * _ODD[i]
        total ^= total >> np.uint64(31)
    return np.unique(_mix(total))


def signature(sets: np.ndarray) -> np.ndarray:
    """The value of each bin of a sorted non-empty set."""
    at = np.searchsorted(sets, _STARTS)
    value = sets[np.minimum(at, len(sets) - 1)]
    full = (at < len(sets)) & (value >= _STARTS) & ((value - _STARTS) >> np.uint64(64 - BINS.bit_length() + 1) == 0)
    if full.all():
        return value
    return np.where(full, value, value[_ORDER[np.arange(BINS), full[_ORDER].argmax(axis=1)]])


def bands(signatures: np.ndarray) -> np.ndarray:
    """int64 hash of each band of each signature; the number of the band is part of it."""
    rows = BINS // BANDS
    s = signatures.reshape(len(signatures), BANDS, rows)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[50], s.shape[:2]).copy()
    for i in range(rows):
        total = (total ^ s[:, :, i]) * _ODD[40 + i]
        total ^= total >> np.uint64(30)
    return _mix(total).view(np.int64)


def _print(sets: list[np.ndarray]) -> np.ndarray:
    """Two int64 halves of a 128-bit fingerprint of each set."""
    import xxhash

    return np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64) for s in sets]).reshape(-1, 2)


_FINGERPRINT = [T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), a and b (its fingerprint), bands (none for the empty set)."""

    def make():
        def f(texts: list[str]) -> list:
            sets = [shingles(t, k) for t in texts]
            prints = _print(sets)
            some = [i for i, s in enumerate(sets) if len(s)]
            made: list = [[] for _ in sets]
            if some:
                for i, x in zip(some, bands(np.stack([signature(sets[i]) for i in some]))):
                    made[i] = x
            return [[len(s) for s in sets], prints[:, 0], prints[:, 1], made]

        return f

    fields = [*_FINGERPRINT, T.StructField("bands", T.ArrayType(T.LongType()))]
    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), "t", ["id"], fields, make)


def fingerprints(docs: DataFrame, k: int, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n, a and b."""

    def make():
        def f(texts: list[str]) -> list:
            sets = [shingles(t, k) for t in texts]
            prints = _print(sets)
            return [[len(s) for s in sets], prints[:, 0], prints[:, 1]]

        return f

    return map_texts(docs, text_col, keep, _FINGERPRINT, make)


def set_nodes(s: DataFrame) -> DataFrame:
    """node, rep, n, a, b, bands: one row of each distinct non-empty set that has an id; rep is the least id.

    The node is the rep; where one id has several texts (or is negative) their nodes are negative numbers of their own.
    """
    sets = s.filter("n > 0 AND id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    sets = checkpoint(sets)
    shared = sets.groupBy("rep").agg(F.count("*").alias("c")).filter("c > 1 OR rep < 0").select("rep")
    if shared.isEmpty():
        return sets.select(F.col("rep").alias("node"), "rep", "n", "a", "b", "bands")
    own = sets.join(shared.withColumn("several", F.lit(True)), "rep", "left")
    node = F.when(F.col("several"), -1 - F.monotonically_increasing_id()).otherwise(F.col("rep"))
    out = checkpoint(own.select(node.alias("node"), "rep", "n", "a", "b", "bands"))  # written: the numbers are given once
    forget(sets)
    return out


def full_sets(docs: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node and s, the whole set, of ``nodes`` (node, rep, n, a, b); one row each."""

    def make():
        def f(texts: list[str]) -> list:
            sets = [shingles(t, k) for t in texts]
            prints = _print(sets)
            return [prints[:, 0], prints[:, 1], [s.view(np.int64) for s in sets]]

        return f

    ids = nodes.select(F.col("rep").alias("id")).distinct()
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(ids, "id", "left_semi")
    made = map_texts(some, "t", ["id"], [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))], make)
    of = nodes.select("node", F.col("rep").alias("id"), F.col("n").alias("n"), "a", "b")
    return made.withColumn("n", F.size("s").cast("long")).join(of, ["id", "n", "a", "b"]).groupBy("node").agg(F.first("s").alias("s"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("node").alias("y"), F.col("s").alias("sy")), "y")
    both = both.withColumn("common", F.size(F.array_intersect("sx", "sy")))
    return both.filter(100 * F.col("common") >= percent * (F.size("sx") + F.size("sy") - F.col("common"))).select("x", "y")


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """id, label: the least id that can be reached, for every id of an edge (x, y).

    Alternates large and small stars until the edges no longer change; each
    pair of steps at least halves the depth, so ``max_steps`` is never met by a
    graph that fits on disk, and meeting it is an error.
    """
    edges = checkpoint(edges.select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("m")).filter("v <> m").distinct())

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())

    before = state(edges)
    for step in range(max_steps + 1):
        if not before[0]:
            break
        if step == max_steps:
            raise RuntimeError(f"components: edges still change after {max_steps} steps")
        first = edges
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        second = checkpoint(both.join(least, "u").filter("w > u AND w <> low").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct())
        least = second.groupBy("v").agg(F.min("m").alias("low"))
        joined = second.join(least, "v")
        edges = checkpoint(joined.select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e")).select("e.*").filter("v <> m").distinct())
        forget(first, second)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("id"), F.col("m").alias("label")).union(edges.select(F.col("m").alias("id"), F.col("m").alias("label")).distinct())


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``links`` (x, y) between nodes; a node without a row is its own label."""
    ends = links
    for c in ("x", "y"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias("__l")), c, "left").withColumn(c, F.coalesce("__l", c)).drop("__l")
    moved = checkpoint(components(ends))
    old = labels.join(moved.select(F.col("id").alias("label"), F.col("label").alias("__to")), "label", "left").select("node", F.coalesce("__to", "label").alias("label"))
    new = moved.select(F.col("id").alias("node"), "label").join(labels.select("node"), "node", "left_anti")
    out = checkpoint(old.unionByName(new))
    forget(moved, labels)
    return out


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _pairs(p: DataFrame) -> DataFrame:
    return p.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _fits(percent: int, n: str, at: str, other: str):
    """A set of ``n`` with its first common shingle at place ``at`` can have the similarity with one of ``other``."""
    return (100 + percent) * (F.col(n) - F.col(at)) >= percent * (F.col(n) + F.col(other))


def rare_places(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, tok, at: the shared shingles of each set (node, s) that come early enough by rarity to be the first common one.

    ``at`` counts from 0 in the order (sets that hold the shingle, shingle); those of one set only come first and are not listed.
    """
    tokens = sets.select("node", F.size("s").cast("long").alias("n"), F.explode("s").alias("tok"))
    often = checkpoint(tokens.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = tokens.join(often, "tok").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("list"))  # no longer than the set
    shared = shared.withColumn("own", F.col("n") - F.size("list")).filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    placed = shared.select("node", "n", "own", F.posexplode("list").alias("pos", "e")).select("node", "n", F.col("e.tok").alias("tok"), (F.col("own") + F.col("pos")).alias("at"))
    out = checkpoint(placed.filter(100 * (F.col("n") - F.col("at")) >= percent * F.col("n")))
    forget(often)
    return out


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` whose rows have several labels."""
    return rows.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select(key)


def _linked(nodes: DataFrame, docs: DataFrame, labels: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``labels`` after all links of similar sets among ``nodes``."""
    members = nodes.select(F.explode("bands").alias("key"), "node", "n").distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = checkpoint(members.join(sizes, "key"))
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = checkpoint(members.join(weight, "node").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("order"), F.col("node"), F.col("n"))).alias("hub")).select("key", F.col("hub.node").alias("y"), F.col("hub.n").alias("ny")))
    sets = checkpoint(full_sets(docs, nodes.join(members.select("node").distinct(), "node", "left_semi"), k, id_col, text_col))
    pairs = members.join(hubs, "key").filter(F.col("node") != F.col("y")).filter(100 * F.least("n", "ny") >= percent * F.greatest("n", "ny")).select(F.col("node").alias("x"), "y")
    pairs = checkpoint(_pairs(pairs))
    links = checkpoint(confirmed(pairs, sets, percent))
    forget(hubs, pairs)
    labels = _relabelled(labels, links)
    forget(links)
    # members of buckets that the stars left with several components
    now = checkpoint(_labelled(members.select("key", "node"), labels))
    left = checkpoint(now.join(_mixed(now, "key"), "key", "left_semi").select("node").distinct())
    forget(members, now)
    if left.isEmpty():
        return labels
    places = rare_places(sets.join(left, "node", "left_semi"), percent)
    fits = _fits(percent, "n", "at", "ny") & _fits(percent, "ny", "aty", "n") & (100 * F.least("n", "ny") >= percent * F.greatest("n", "ny"))
    for last in (False, True):
        now = _labelled(places, labels)
        now = checkpoint(now.join(_mixed(now, "tok"), "tok", "left_semi"))
        one = F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("aty"), F.col("label").alias("ly")
        if not last:
            hub = now.groupBy("tok").agg(F.min(F.struct((F.col("at") / F.col("n")).alias("order"), F.col("node"), F.col("n"), F.col("at"), F.col("label"))).alias("h"))
            pairs = now.join(hub.select("tok", F.col("h.node").alias("y"), F.col("h.n").alias("ny"), F.col("h.at").alias("aty"), F.col("h.label").alias("ly")), ["tok"]).filter((F.col("label") != F.col("ly")) & fits)
        else:
            # of two labels one is not the most frequent of its shingle
            major = now.groupBy("tok", "label").agg(F.count("*").alias("c")).groupBy("tok").agg(F.max(F.struct("c", "label")).alias("m")).select("tok", F.col("m.label").alias("major"))
            now = checkpoint(now.join(major, "tok"))
            minor = now.filter("label <> major")
            pairs = minor.join(now.select("tok", *one, (F.col("label") == F.col("major")).alias("of_major")), "tok").filter((F.col("label") != F.col("ly")) & (F.col("of_major") | (F.col("node") < F.col("y"))) & fits)
        pairs = checkpoint(_pairs(pairs.select(F.col("node").alias("x"), "y")))
        links = checkpoint(confirmed(pairs, sets, percent))
        labels = _relabelled(labels, links)
        forget(now, pairs, links)
    forget(sets, left, places)
    return labels


def _classified(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, join_ids: bool) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row (id, n, a, b), and n, a, b, rep, label, first of every set.

    ``first`` is the (rep, n, a, b) with the least rep of the component.  With
    ``join_ids`` the texts of one id count as one document.
    """
    s = checkpoint(sketch(docs, k, id_col, text_col))
    nodes = set_nodes(s)
    labels = docs.sparkSession.createDataFrame([], "node long, label long")
    if join_ids:
        of = s.filter("n > 0 AND id IS NOT NULL").select("id", "n", "a", "b").distinct().join(nodes.select("n", "a", "b", "node"), ["n", "a", "b"])
        several = of.groupBy("id").agg(F.min("node").alias("y"), F.max("node").alias("high")).filter("y <> high").select("id", "y")
        same = checkpoint(of.join(several, "id").filter(F.col("node") != F.col("y")).select(F.col("node").alias("x"), "y").distinct())
        if not same.isEmpty():
            labels = _relabelled(labels, same)
        forget(same)
    labels = _linked(nodes, docs, labels, k, percent, id_col, text_col)
    out = _labelled(nodes.select("node", "rep", "n", "a", "b"), labels)
    first = out.groupBy("label").agg(F.min(F.struct("rep", "n", "a", "b")).alias("first"))
    out = checkpoint(out.join(first, "label").select("n", "a", "b", "rep", "first"))
    forget(nodes, labels)
    return s.select("id", "n", "a", "b"), out


def classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Documents are linked when 100 * |intersection| >= ``percent`` * |union| of
    their sets of ``k``-word shingles; component_id is the least id reachable.
    Rows with the same id count as one document: the links of all its texts join.
    """
    s, sets = _classified(docs, k, percent, id_col, text_col, join_ids=True)
    rows = s.join(sets.select("n", "a", "b", F.col("first.rep").alias("least")), ["n", "a", "b"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least", "id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, of each class of similar texts only one row; all columns stay.

    Here texts alone are linked, so different texts of one id are judged apart.
    The row with the least id stays; of repeated rows with that id and an equal set, one.  Texts
    without words and rows without an id all stay.
    """
    s, sets = _classified(docs, k, percent, id_col, text_col, join_ids=False)
    rows = s.filter("n > 0 AND id IS NOT NULL")
    repeated = checkpoint(rows.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"))
    judged = rows.join(sets, ["n", "a", "b"]).select("id", F.struct(F.col("id").alias("rep"), "n", "a", "b").alias("own"), "first")
    gone = checkpoint(judged.filter("own <> first").select(F.col("id").alias("__id")).distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    if repeated.isEmpty():
        return packed.join(gone, "__id", "left_anti").select("__doc.*")
    again = repeated.select(F.col("id").alias("__id"))
    once = packed.join(gone.unionByName(again).distinct(), "__id", "left_anti").select("__doc")
    # rows that share an id are told apart by their sets
    made = fingerprints(packed.join(again, "__id", "left_semi"), k, "__text", ["__doc", "__id"])
    firsts = sets.select("first.*").distinct()
    empty = made.filter("n = 0").select("__doc")
    kept = made.filter("n > 0").join(firsts.withColumnRenamed("rep", "__id"), ["__id", "n", "a", "b"], "left_semi").groupBy("__id", "n", "a", "b").agg(F.first("__doc").alias("__doc")).select("__doc")
    return once.unionByName(empty).unionByName(kept).select("__doc.*")
