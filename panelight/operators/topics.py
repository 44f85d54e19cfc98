"""Topics: TF-IDF in long form and a non-negative factorisation of it.

Counting, weighting and pruning are DataFrame operations.  The factorisation
alternates between documents and terms: the terms-by-topics matrix is small (at
most ``features`` rows) and travels with each step; document rows stay on the
executors and only sums of topics by terms come back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.operators.vectors import TERM

# How terms are chosen, and the factorisation's size.
FEATURES, LEAST_DOCS, LARGEST_SHARE, TOPICS = 2500, 5, 0.85, 8


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: int = FEATURES, least: int = LEAST_DOCS, share: float = LARGEST_SHARE, stop_words: Sequence[str] = (), pairs: bool = True) -> DataFrame:
    """id, term, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of length 1 for each document.

    Terms are words and neighbouring pairs without stop words, in ``least`` documents or more and at most the share of
    them; of these the ``features`` most frequent stay (ties by term).
    """
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0)), lambda x: ~x.isin(*stop_words) if stop_words else F.lit(True))
    base = docs.select(F.col(id_col).alias("id"), w.alias("w"))
    grams = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    terms = base.select("id", F.explode_outer(F.concat("w", grams) if pairs else F.col("w")).alias("term")).filter("term IS NOT NULL")
    tf = terms.groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(n).filter((F.col("df") >= least) & (F.col("df") <= share * F.col("n")))  # one row on the right
    kept = df.orderBy(F.desc("total"), "term").limit(features)
    raw = tf.join(F.broadcast(kept), "term").select("id", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("weight"))


def factorised(weights: DataFrame, topics: int = TOPICS, steps: int = 60, tolerance: float = 1e-4, seed: int = 42, extra: dict | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """(id, scores, dominant_topic), (topic_id, rank, term, weight) of each topic's 12 strongest terms, and the error of each step.

    Multiplicative updates: each step passes the documents once, solving their scores against the present topics.
    ``weights`` is read in each step, so it should be a written or cached table.
    """
    spark = weights.sparkSession
    terms = [r[0] for r in weights.select("term").distinct().orderBy("term").limit(FEATURES * 4).collect()]  # pruned before, a bounded number
    code = {t: i for i, t in enumerate(terms)}
    rows = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v"))  # at most one entry for each term
    rng = np.random.default_rng(seed)
    h = rng.uniform(0.1, 1.0, (topics, len(terms)))

    def scored(v: list, base: np.ndarray, gram: np.ndarray) -> tuple:
        at, x = np.array([code[e[0]] for e in v]), np.array([e[1] for e in v])
        b = base[:, at] @ x
        s = np.full(topics, b.mean() / max(gram.mean(), 1e-12) / topics + 1e-9)
        for _ in range(50):
            s = s * b / np.maximum(gram @ s, 1e-12)
        return at, x, s

    sums = T.StructType([T.StructField("num", T.BinaryType()), T.StructField("den", T.BinaryType()), T.StructField("err", T.DoubleType())])
    errors: list[float] = []
    for _ in range(steps if terms else 0):
        gram = h @ h.T

        def part(batches: Iterator[pd.DataFrame], h=h, gram=gram) -> Iterator[pd.DataFrame]:
            num, den, err = np.zeros(h.shape), np.zeros((topics, topics)), 0.0
            for batch in batches:
                for v in batch["v"]:
                    at, x, s = scored([(e["term"], e["weight"]) for e in v], h, gram)
                    num[:, at] += s[:, None] * x
                    den += np.outer(s, s)
                    err += float(x @ x - 2 * s @ (h[:, at] @ x) + s @ gram @ s)
            yield pd.DataFrame([(num.tobytes(), den.tobytes(), err)], columns=sums.names)

        num, den, err = np.zeros(h.shape), np.zeros((topics, topics)), 0.0
        for r in rows.select("v").mapInPandas(part, sums).toLocalIterator():  # one small row for each partition
            num += np.frombuffer(r["num"]).reshape(h.shape)
            den += np.frombuffer(r["den"]).reshape(den.shape)
            err += r["err"]
        errors.append(float(np.sqrt(max(err, 0.0))))
        if len(errors) > 1 and errors[-2] - errors[-1] < tolerance * errors[0]:
            break
        h = h * num / np.maximum(den @ h, 1e-12)
    gram = h @ h.T
    out = T.StructType([rows.schema["id"], T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "scores": [scored([(e["term"], e["weight"]) for e in v], h, gram)[2].round(8).tolist() for v in batch["v"]]})

    scores = rows.mapInPandas(last, out)
    scores = scores.select("id", "scores", F.concat(F.lit("nmf_topic_"), F.array_position("scores", F.array_max("scores"))).alias("dominant_topic"))
    strongest = [(f"nmf_topic_{k + 1}", r + 1, terms[i], round(float(h[k, i]), 8)) for k in range(topics if terms else 0) for r, i in enumerate(sorted(range(len(terms)), key=lambda i: (-h[k, i], i))[:12])]
    return scores, spark.createDataFrame(strongest, "topic_id string, rank int, term string, weight double"), errors
