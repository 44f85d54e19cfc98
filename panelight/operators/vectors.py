"""Vectors of texts: pairs, nearest ones, shifts from year to year, and TF-IDF cosines of text pairs."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.functions.binding import let
from panelight.operators.alignment import cosine
from panelight.sources.shared import checkpoint, forget


def _unit(vectors: DataFrame, vector: str) -> DataFrame:
    """The vector as doubles of length 1; a zero vector stays 0."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    unit = let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return vectors.withColumn("__u", unit)


def _dot():
    return F.aggregate(F.zip_with("__ua", "__ub", lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x)


def _prepared(vectors: DataFrame, id_col: str, vector: str, groups: Sequence[str]) -> DataFrame:
    return _unit(vectors, vector).select(F.col(id_col).alias("id"), "__u", *groups)


def _first(groups: Sequence[str], i: int):
    """Whether group ``i`` is the first that both sides share: a pair is found by that one alone, so nothing has to be made distinct."""
    out = F.lit(True)
    for other in groups[:i]:
        out = out & ~F.equal_null(F.col(f"__{other}_a"), F.col(f"__{other}_b"))
    return out


def _joined(a: DataFrame, b: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Pairs of a row of ``a`` and one of ``b`` with a greater id that share a group."""
    a, b = (u.select(F.col("id").alias(f"id_{s}"), F.col("__u").alias(f"__u{s}"), *[F.col(g).alias(f"__{g}_{s}") for g in groups]) for u, s in ((a, "a"), (b, "b")))
    out = None
    for i, g in enumerate(groups):
        found = a.join(b, (F.col(f"__{g}_a") == F.col(f"__{g}_b")) & (F.col("id_a") < F.col("id_b")) & _first(groups, i))
        out = found if out is None else out.unionByName(found)
    return _shown(out.withColumn("__dot", _dot()), groups)


def _shown(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    return pairs.select("id_a", "id_b", *[F.coalesce(F.col(f"__{g}_a") == F.col(f"__{g}_b"), F.lit(False)).alias(f"same_{g}") for g in groups], F.round("__dot", 8).alias("cosine_similarity"))


def pairs_within(vectors: DataFrame, id_col: str, vector: str, groups: Sequence[str]) -> DataFrame:
    """id_a, id_b, same_<group> and cosine_similarity of all pairs that share any of the ``groups`` columns, each pair once.

    These pairs are the result that is asked for, so their number is that of pairs in a group.  Each group
    column is one equi-join.
    """
    u = _prepared(vectors, id_col, vector, groups)
    return _joined(u, u, groups)


def top_pairs(pairs: DataFrame, n: int = 500) -> DataFrame:
    return pairs.orderBy(F.desc("cosine_similarity"), "id_a", "id_b").limit(n)


#: Rows of a block: two blocks meet in one task.
BLOCK = 4096
#: Decimals of a cosine, as an integer's unit; what two ways to add up may differ by is far below one.
_UNIT = 10**8


def _rounded(x: np.ndarray) -> np.ndarray:
    """Cosines to 8 decimals as int64, halves away from zero as ``round`` has them in decimals."""
    scaled = np.abs(x) * _UNIT
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(8).quantize(Decimal(1), ROUND_HALF_UP))
    return (np.sign(x) * out).astype(np.int64)


def best_of_blocks(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, n: int, same: bool, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` and dot products of the ``n`` best pairs: by the rounded product, then the lesser id, then the greater.

    ``same``: both are one block.  A matrix product tells which pairs can be among them; these
    are added up again in the order of the elements, as a plain loop does.
    """
    key = np.zeros(0, np.int64)
    best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
    for at in range(0, len(a), rows):
        near = a[at : at + rows] @ b.T
        near[ids_a[at : at + rows, None] >= ids_b[None] if same else ids_a[at : at + rows, None] == ids_b[None]] = -np.inf
        floor = (key[-1] - 2) / _UNIT if len(key) == n else -2.0  # above -inf
        i, j = np.nonzero(near >= floor)
        if len(i) > 4 * n:
            v = near[i, j]
            some = v >= np.partition(v, len(v) - n)[len(v) - n] - 2 / _UNIT
            i, j = i[some], j[some]
        dot = np.empty(len(i))
        for k in range(0, len(i), 1 << 16):
            x, y = a[at + i[k : k + (1 << 16)]].T, b[j[k : k + (1 << 16)]].T
            total = np.zeros(x.shape[1])
            for p, q in zip(x, y):
                total += p * q
            dot[k : k + (1 << 16)] = total
        found = [np.concatenate(z) for z in zip(best, (i + at, j, dot))]
        r = _rounded(found[2])
        x, y = ids_a[found[0]], ids_b[found[1]]
        order = np.lexsort((np.maximum(x, y), np.minimum(x, y), -r))[:n]
        key, best = r[order], tuple(z[order] for z in found)
    return best


def top_pairs_within(vectors: DataFrame, id_col: str, vector: str, groups: Sequence[str], n: int = 500, block: int = BLOCK) -> DataFrame:
    """The same rows as ``top_pairs`` of ``pairs_within``, without a row for each pair.

    A group's rows are dealt into blocks of about ``block`` rows; any two blocks of a group meet in one task, which
    keeps its ``n`` best pairs.  All pairs are compared, so the time grows with the square of a group,
    but as matrix products.  Vectors of another length than the longest, or with an element that is null or not
    finite, have no place in a matrix: their pairs are joined plainly.
    """
    u = first = checkpoint(_prepared(vectors, id_col, vector, groups))
    longest = u.agg(F.max(F.size("__u")).alias("__l"))
    finite = F.forall("__u", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    ok = F.coalesce(finite & (F.size("__u") == F.col("__l")), F.lit(False))
    u = checkpoint(u.crossJoin(F.broadcast(longest)).withColumn("__ok", ok).drop("__l"))  # one row on the right; read several times
    forget(first)
    plain, odd = u.filter("__ok"), u.filter("NOT __ok")
    out = _joined(odd, u, groups).unionByName(_joined(plain, odd, groups))
    sides = [(c, f"{c}_{s}" if c == "id" else f"__{c}_{s}") for s in "ab" for c in ("id", *groups)]
    schema = T.StructType([*[T.StructField(name, u.schema[c].dataType) for c, name in sides], T.StructField("__dot", T.DoubleType())])

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        matrix = pc.list_flatten(table["__u"]).to_numpy().reshape(len(table), -1)
        ids = np.unique(table["id"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        kept = table.select(["id", *groups])
        blocks, low, high = table["__b"].to_numpy(), table["__i"][0].as_py(), table["__j"][0].as_py()
        at, to = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        i, j, dot = best_of_blocks(matrix[at], matrix[to], ids[at], ids[to], n, low == high)
        i, j = at[i], to[j]
        turned = ids[i] > ids[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        a, b = kept.take(pa.array(i)), kept.take(pa.array(j))
        return pa.table([*a.columns, *b.columns, pa.array(dot)], names=[f.name for f in schema])

    for k, g in enumerate(groups):
        rows = plain.filter(F.col(g).isNotNull())
        sizes = rows.groupBy(g).agg(F.ceil(F.count("*") / block).alias("__n"))
        dealt = rows.join(sizes, g).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__n")))
        met = dealt.select("id", "__u", *groups, "__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__o"))
        met = met.select("id", "__u", *groups, "__b", F.least("__b", "__o").alias("__i"), F.greatest("__b", "__o").alias("__j"))
        found = met.groupBy(g, "__i", "__j").applyInArrow(best, schema)
        out = out.unionByName(_shown(found.filter(_first(groups, k)), groups))
    return top_pairs(out, n)


def shifts(vectors: DataFrame, id_col: str, vector: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """key, id_prior, id_current, cosine_similarity and semantic_distance of each row and the one before it."""
    w = Window.partitionBy(*key).orderBy(*order)
    u = _unit(vectors, vector).select(*key, F.col(id_col).alias("id_current"), F.col("__u").alias("__ub"), F.lag(id_col).over(w).alias("id_prior"), F.lag("__u").over(w).alias("__ua")).filter("id_prior IS NOT NULL")
    return u.select(*key, "id_prior", "id_current", F.round(_dot(), 8).alias("cosine_similarity"), F.round(1 - _dot(), 8).alias("semantic_distance"))


def paired_cosine(df: DataFrame, a: str, b: str, into: str = "similarity") -> DataFrame:
    return df.withColumn(into, cosine(F.col(a), F.col(b)))


#: Tokens of TF-IDF: two word characters or more.
TERM = r"(?U)\b\w\w+\b"


def _terms(text: str):
    """Single words and neighbouring pairs of them."""
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))
    grams = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, grams)


def tfidf_pair_cosine(pairs: DataFrame, a: str, b: str, key: Sequence[str], digits: int = 6) -> DataFrame:
    """key and similarity: 100 times the cosine of TF-IDF vectors of words and word pairs, fitted on the two texts of each row alone.

    A term's weight is its count times ln(3 / (1 + n)) + 1, n the sides that have it.  0 where a side has no term.
    Terms are counted per row before they meet, so a shuffle carries counts, not texts.
    """
    long = pairs.select(*key, F.explode_outer(_terms(a)).alias("term"), F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(pairs.select(*key, F.explode_outer(_terms(b)).alias("term"), F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    counts = long.filter("term IS NOT NULL").groupBy(*key, "term").agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"))
    idf = F.log(3 / (1 + (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int"))) + 1
    w = counts.select(*key, (F.col("a") * idf).alias("x"), (F.col("b") * idf).alias("y"))
    sums = w.groupBy(*key).agg(F.sum(F.col("x") * F.col("y")).alias("d"), (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("n"))
    return pairs.select(*key).join(sums, list(key), "left").select(*key, F.when(F.col("n") > 0, F.round(100 * F.col("d") / F.col("n"), digits)).otherwise(F.lit(0.0)).alias("similarity"))
