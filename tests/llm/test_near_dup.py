import random

import numpy as np
import pytest

from test_ops import brute_classes


def words(rnd, n, prefix="w"):
    return [f"{prefix}{rnd.randrange(10**9)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies of every edit rate, chains, and a passage that a third of all texts hold."""
    rnd = random.Random(11)
    texts, passage = [], words(rnd, 60)
    for size in (2, 3, 8, 40):
        base = words(rnd, 120)
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(9)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**9)}"
            texts.append(w)
    chain = words(rnd, 100)
    for i in range(20):
        texts.append(chain[3 * i :] + words(rnd, 3 * i, f"c{i}_"))
    texts += [words(rnd, 20) + passage + words(rnd, rnd.randrange(5, 40)) for _ in range(60)]
    texts += [passage + words(rnd, rnd.randrange(1, 14)) for _ in range(30)]
    texts += [words(rnd, rnd.randrange(1, 9)) for _ in range(20)]
    rnd.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("k", [4, 5])
def test_planted_groups_are_brute_force(spark, planted, k):
    from panelight.llm.neardup import classes, deduplicated

    df = spark.createDataFrame(planted, "doc_id long, text string")
    want, _ = brute_classes(planted, k, 80)
    assert {r["doc_id"]: r["component_id"] for r in classes(df, k=k).collect()} == want
    assert sorted(r["doc_id"] for r in deduplicated(df, k=k).collect()) == sorted(i for i, c in want.items() if i == c)


def test_texts_of_one_id_join_their_links(spark):
    from panelight.llm.neardup import classes, deduplicated

    rnd = random.Random(3)
    a, b = " ".join(words(rnd, 50)), " ".join(words(rnd, 50))

    def of(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return {(r["doc_id"], r["component_id"]) for r in classes(df).collect()}, sorted(map(tuple, deduplicated(df).collect()), key=str)

    got, left = of([(3, a), (9, a), (9, b), (12, b + " more")])
    assert got == {(3, 3), (9, 3), (12, 3)}
    assert left == [(3, a), (9, b)]  # texts are judged apart, none is lost
    got, left = of([(5, a), (5, b), (7, a + " x"), (8, b + " x")])
    assert got == {(5, 5), (7, 5), (8, 5)} and left == sorted([(5, a), (5, b)], key=str)
    got, left = of([(3, a), (9, a), (9, b), (20, "c d e"), (20, "c d e"), (-4, b), (21, ""), (21, ""), (None, a), (None, None)])
    assert got == {(3, -4), (9, -4), (-4, -4), (20, 20), (21, 21), (None, None)}
    assert left == sorted([(3, a), (-4, b), (20, "c d e"), (21, ""), (21, ""), (None, a), (None, None)], key=str)


def test_clashing_columns_and_empty_tables(spark):
    from panelight.llm.neardup import classes, deduplicated

    df = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y")], "doc_id long, text string, rep long, label string").selectExpr("*", "1 AS n", "2 AS a", "3 AS node", "4 AS id", "5 AS `first`", "6 AS `odd name`", "doc_id AS __id")
    assert [r["kept"] for r in classes(df).orderBy("doc_id").collect()] == [True, False]
    left = deduplicated(df)
    assert left.columns == df.columns and [r["label"] for r in left.collect()] == ["x"]
    twice = deduplicated(df.unionAll(df))
    assert twice.columns == df.columns and [r["label"] for r in twice.collect()] == ["x"]
    assert classes(df.limit(0)).collect() == [] and deduplicated(df.limit(0)).collect() == []


def test_bands_miss_no_pair_at_the_threshold():
    from panelight.llm.neardup import bands, signature

    rng = np.random.default_rng(5)
    misses = 0
    for union in (5, 10, 50, 500):
        for _ in range(250):
            x = rng.integers(0, 1 << 63, size=union, dtype=np.uint64) * np.uint64(2)
            cut = union // 5
            p, q = np.sort(x[: union - cut]), np.sort(x)
            s = bands(np.stack([signature(p), signature(q)]))
            misses += not (s[0] == s[1]).any()
    assert misses == 0


def test_components_that_do_not_settle_raise(spark):
    from panelight.llm.neardup import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long")
    assert {r["label"] for r in components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, max_steps=1)
