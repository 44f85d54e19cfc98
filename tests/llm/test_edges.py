"""Named cases of every operator and stage: empty tables, nulls, clashing names, brute force of what SQL can't say."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_ops import ODD_TEXTS, SCHEMA


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en" if t else None, "s", 0, 0.5, "x") for i, t in rows], SCHEMA)


def test_empty_tables(spark):
    import public_tokenizers

    from panelight.llm import bpe, chat, decontam, licences, quality_crf, quality_rules, tokencount, urlfilter
    from panelight.llm.queries import vocabulary

    none = docs_of(spark, []) if False else spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        bpe.digests(bpe.encode_decode(none, vocabulary("word_bpe_49k.json"))), tokencount.count_tokens(none, vocabulary("piece_bpe_32k.model")), quality_rules.judge(none),
        quality_crf.report(none, labels), chat.format_digests(turns, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), decontam.report(none, bench),
        decontam.decontaminate(none, bench), licences.scan(none), urlfilter.judge(pages),
    ]
    for df in results:
        assert df.collect() == [] and df.columns


def test_clashing_names_are_kept_or_give_way(spark):
    from panelight.llm import decontam, langid, licences, quality_crf, quality_rules

    rows = docs_of(spark, [(1, "plain words of a text " * 20), (2, None)])
    more = rows.selectExpr("*", "1 AS key_a", "2 AS spans", "3 AS n_words", "4 AS h", "5 AS found", "6 AS form", "7 AS __text", "8 AS predicted", "9 AS held_out", "10 AS lang_pred", "11 AS licence", "12 AS w", "13 AS __made")
    bench = spark.createDataFrame([(1, "plain words of a text plain words of a text plain words of a text")], "item_id long, text string")
    left = decontam.decontaminate(more, bench)
    assert left.columns == more.columns and [r["doc_id"] for r in left.collect()] == [2]
    cut = {r["doc_id"]: r for r in decontam.decontaminate(more, bench, remove="spans").collect()}
    assert cut[1]["text"] == "" and cut[2]["text"] is None and cut[1]["spans"] == 2
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (quality_crf.report(more, labels), langid.report(more), licences.scan(more), quality_rules.judge(more), decontam.report(more, bench)):
        assert df.count() == 2


def test_line_features_and_score_are_plain_loops():
    from panelight.llm.quality_crf import _CLASSES, OWN, WIDTH, Field, line_features

    texts = [t for t in ODD_TEXTS if t is not None and len(t) < 400] + ["One line.\none LINE two\n\nOne line.\n#### 12 $$", "é漢\n\n"]

    def own(line, seen):
        n = max(len(line), 1)
        words = line.split()
        shares = [sum(c in k for c in line) / n for k in _CLASSES]
        return [*shares, math.log1p(len(line)) / 8, math.log1p(len(words)) / 6, len(set(words)) / max(len(words), 1), math.log1p(n / max(len(words), 1)) / 4, float(line in seen and bool(words)), float(not line)]

    want, sizes, counts = [], [], []
    for t in texts:
        lines, seen, rows = t.encode("utf-8", "surrogatepass").split(b"\n"), set(), []
        for line in lines:
            rows.append(own(line, seen))
            seen.add(line)
        zero = [0.0] * OWN
        for i in range(len(rows)):
            want.append(rows[i] + (rows[i - 1] if i else zero) + (rows[i + 1] if i + 1 < len(rows) else zero) + [float(i == 0), float(i + 1 == len(rows)), 1.0])
            sizes.append(len(lines[i]) + 1)
        counts.append(len(rows))
    x, size, n = line_features(texts)
    assert np.allclose(x, want, atol=1e-6) and size.tolist() == sizes and n.tolist() == counts
    rng = np.random.default_rng(4)
    field = Field(rng.normal(size=WIDTH) * 0.5, rng.normal(size=(2, 2)))
    p, _, _ = field.marginals(x, n)
    at, scores = 0, field.scores(texts)
    for i, c in enumerate(counts):
        weights = sizes[at : at + c]
        assert scores[i] == pytest.approx(sum(a * b for a, b in zip(p[at : at + c], weights)) / sum(weights), abs=1e-6)
        at += c


def test_field_gradient_is_a_difference():
    """One step of ``fit`` without momentum moves along the numerical gradient of the mean log-likelihood."""
    from panelight.llm.quality_crf import WIDTH, Field

    rng = np.random.default_rng(6)
    counts, labels = np.array([3, 1, 2]), np.array([1, 0, 1])
    x = rng.normal(size=(6, WIDTH)).astype(np.float32) * 0.3

    def loss(w, pairs):
        total, at = 0.0, 0
        f = Field(w, pairs)
        for n, y in zip(counts, labels):
            u = x[at : at + n] @ f.weights
            import itertools

            z = [sum(u[i] for i in range(n) if s[i]) + sum(f.pairs[a, b] for a, b in zip(s, s[1:])) for s in itertools.product((0, 1), repeat=int(n))]
            own = sum(u) + (n - 1) * f.pairs[1, 1] if y else (n - 1) * f.pairs[0, 0]
            total += (own - math.log(sum(map(math.exp, z)))) / n
            at += n
        return -total / len(counts)

    f = Field()
    f.fit(x, counts, labels, steps=1, rate=1.0)
    step, zero = 1e-5, np.zeros((2, 2))
    for i in rng.permutation(WIDTH)[:12]:
        w = np.zeros(WIDTH)
        w[i] = step
        slope = (loss(w, zero) - loss(-w, zero)) / (2 * step)
        if abs(slope) > 1e-4:
            assert np.sign(f.weights[i]) == -np.sign(slope)


def test_long_words_in_bpe_are_the_library():
    from tokenizers import Tokenizer

    from panelight.llm.bpe import SHORT, tokenizer
    from panelight.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    bpe, rnd = tokenizer(vocabulary("word_bpe_49k.json")), random.Random(2)
    for letters in ("ab", "aab", "eta", "etaoinshrdlu", "é漢a"):
        for n in (SHORT - 1, SHORT, SHORT + 1, 200, 1500):
            word = "".join(rnd.choices(letters, k=n))
            assert bpe.encode(word).tolist() == t.encode(word, add_special_tokens=False).ids


def test_too_many_notices_are_an_error(spark):
    from panelight.llm import licences

    rows = [("line", "X", f"notice number {i}") for i in range(licences.PLAN_ROWS + 1)]
    df = spark.createDataFrame([(1, "notice number 7\nother")], "doc_id long, text string")
    assert licences.scan(df, licences.known_licences(spark, rows[:-1])).first()["notices"] == "X"
    with pytest.raises(ValueError, match="known notices"):
        licences.scan(df, licences.known_licences(spark, rows))
    assert licences.scan(df, licences.known_licences(spark, [])).first()["n_notices"] == 0


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    text = "These are some plain words of a good text, and more of them follow here. " * 3
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100, text), (101, text), (101, text + " other end"), (102, None), (None, text)]
    bench = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(15)))], "item_id long, text string")
    for name, docs in (("odd", docs_of(spark, rows)), ("empty", docs_of(spark, rows).limit(0))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        got = C.run(spark, d)
        assert got.columns == ["doc_id", "ids", "decoded"]
        ids = [r["doc_id"] for r in got.collect()]
        assert (ids == []) if name == "empty" else (100 in ids and 101 not in ids and 102 not in ids and None in ids)
    none = spark.read.parquet(f"{d}/documents.parquet")
    for stage in (C.quality, C.language, C.near_dedup, C.decontamination):
        out = stage(spark, none, d)
        assert out.columns == none.columns and out.collect() == []


def test_each_stage_bounds_its_batches(spark, sf):
    import corpus_pipeline as C

    before = spark.conf.get(C.BATCH_CONF)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for stage in (C.quality, C.encoding):  # by itself, as a caller other than run() does
            spark.conf.set(C.BATCH_CONF, "64m")
            stage(spark, docs, sf)
            assert spark.conf.get(C.BATCH_CONF) == C.BATCH
    finally:
        spark.conf.set(C.BATCH_CONF, before)


def test_task_with_a_bounded_table_leaves_no_tokenizer(spark):
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import functions as F

    from panelight.llm import bpe
    from panelight.llm.queries import vocabulary

    docs = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f":{k}")), 256) for k in range(4)]).alias("text"))
    path = vocabulary("word_bpe_49k.json")
    rows = lambda **x: bpe.encode_decode(docs, path, **x).orderBy("doc_id").collect()
    whole = rows(table=5)

    @F.arrow_udf("int")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import gc

        for b in batches:
            yield pa.array([sum(type(x).__name__ == "Bpe" for x in gc.get_objects())] * len(b), type=pa.int32())

    # the one worker that took the task above, and others that may wait
    assert {r[0] for r in spark.range(8, numPartitions=1).select(held("id")).collect()} == {0}
    assert whole == rows() and len(whole) == 40
