import hashlib
import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
ODD_TEXTS = [None, "", " ", "\n\n", "a", "same text here now", "same text here now", "İstanbul Σίσυφος ß ﬁ   x", "<|endoftext|> <|startoftext|>Hi <|x", "#" * 300, "ab " * 30_000, "1 2 3 " * 10, "ﷺ" * 50, "x" * 5000, "\x00 a\x0b b\x1c c d", "🙂👩‍👩‍👧 é é"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with names of outputs."""
    rows = [(i, t, "en" if i % 3 else None, None, None, None, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "no id at all", "en", "s", 1, 0.5, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return df.collect()


def text_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_is_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    from panelight.llm.bpe import digests, encode_decode
    from panelight.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    for df in (docs, odd):
        want = []
        for i, x in text_of(df):
            ids = t.encode(x, add_special_tokens=False).ids
            want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        got = [tuple(r) for r in rows_of(digests(encode_decode(df, vocabulary("word_bpe_49k.json"))))]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_token_counts_are_the_library(spark, docs, odd):
    import sentencepiece

    from panelight.llm.queries import vocabulary
    from panelight.llm.tokencount import count_tokens

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for df in (docs, odd):
        want = [(i, len(x.encode()), len(sp.encode(x)), len(sp.encode(x)) > 4096) for i, x in text_of(df)]
        got = [tuple(r) for r in rows_of(count_tokens(df, vocabulary("piece_bpe_32k.model")))]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_long_runs_are_the_library():
    import random
    import time

    import sentencepiece

    from panelight.llm import tokencount
    from panelight.llm.queries import vocabulary

    rnd = random.Random(4)
    c = tokencount.PieceCounter(vocabulary("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = ["".join(rnd.choices(letters, k=n)) for letters in ("ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "etaoin é漢🙂", "一二三的") for n in (tokencount.LONG - 1, tokencount.LONG + 1, 5000, 40_000)]
    texts += ["a" * 20_000, "the" * 9000, " " * 5000 + "x"]
    assert c.count(texts) == [len(sp.encode(t)) for t in texts]
    word = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1500))
    assert c.merge_long(word) == c.merge([word])[0]
    start = time.time()
    assert c.count(["".join(rnd.choices("acgt", k=1_000_000))])[0] > 0 and time.time() - start < 60


def brute_classes(items, k, percent):
    sets = {}
    for i, x in items:
        w = [p for p in re.split("[\x20\x09-\x0d]+", x.translate({c: c + 32 for c in range(65, 91)})) if p]
        s = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_brute_force(spark, docs, odd, k):
    from panelight.llm.neardup import classes

    base = " ".join(f"w{i}" for i in range(60))
    planted = [(9000 + i, base.replace(f"w{10 * i} ", "zz ", 1)) for i in range(6)] + [(9100 + i, base + f" tail{i}" * i) for i in range(14)]
    extra = spark.createDataFrame(planted, "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionByName(extra), odd):
        want, sets = brute_classes(text_of(df), k, 80)
        got = rows_of(classes(df, k=k))
        assert len(got) == df.count()
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
                assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_chat_is_read_back(spark, sf):
    from panelight.llm import chat
    from panelight.llm.queries import CONTROL, op7_chat_format, vocabulary

    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]

    def want(rows):
        out = {}
        for c, t, r, x in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1] or 0, q[2] or "", q[3] or "")):
            out.setdefault(c, []).append((r or "", x or ""))
        return {c: (len(v), sha("".join(f"{r}\n{x}\n" for r, x in v)), sum(len(x) for r, x in v if r == "assistant"), sha("".join(x for r, x in v if r == "assistant"))) for c, v in out.items()}

    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows_of(op7_chat_format(spark, sf))}
    assert got == want(turns)
    odd = [(1, 0, "assistant", x) for x in ODD_TEXTS] + [(2, 0, "a\nb\\n<|im_end|>", "<\\|im_end|> <\\\\|"), (None, 0, None, None), (3, None, "assistant", "<|im_start|>")]
    import public_tokenizers

    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows_of(chat.format_digests(df, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))}
    assert got == want(odd)
    for s in ("<|", "<\\|", "<\\\\|x<|<<||"):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)


def brute_rules(x):
    words = [w for w in re.split("[\x20\x09-\x0d]+", x) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    from collections import Counter

    c = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(3)}
    lines, dup, seen = x.split("\n"), 0, set()
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(hit), failed


def test_quality_rules_are_brute_force(spark, docs, odd):
    from panelight.llm.quality_rules import judge

    for df in (docs, odd):
        want = [(i, *brute_rules(x)) for i, x in text_of(df)]
        got = rows_of(judge(df))
        assert sorted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got], key=str) == sorted(want, key=str)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_bands_reject_alone(spark, docs):
    import random
    import string

    from panelight.llm.quality_rules import judge

    rnd = random.Random(5)

    def noise(letters, n):
        return " ".join("".join(rnd.choices(letters, k=rnd.randint(3, 10))) for _ in range(n))

    base64, cjk, ascii_ = string.ascii_letters + string.digits + "+/", [chr(c) for c in range(0x4E00, 0x9FA5)], string.printable[:94]
    prose = [r["text"] for r in judge(docs, keep=["text"]).filter("kept").collect()]
    long = max(prose, key=len)
    clean = "\n".join(prose)[: 11 * 4096]
    one = "The same sentence again, word for word. "
    texts = [noise(a, n) for a in (base64, cjk, ascii_) for n in (60, 300, 1500, 5000)]
    texts += [clean + one * (9 * 4096 // len(one)), clean[: 5 * 4096] + noise(base64, 500)[:3000], long[:2000] + " " + noise(base64, 150)]
    rows = {r["doc_id"]: r for r in rows_of(judge(spark.createDataFrame(list(enumerate([*texts, long, clean])), "doc_id long, text string")))}
    assert len(clean) > 10 * 4096 and not any(r["base_failed"] for r in rows.values())
    assert [i for i in rows if rows[i]["kept"]] == [len(texts), len(texts) + 1]
    assert rows[len(texts) + 1]["n_bad_chunks"] == 0 and rows[len(texts) - 2]["n_bad_chunks"] >= 1


def test_language_held_out(spark, sf, docs, odd):
    from panelight.llm import langid
    from panelight.llm.queries import op5_language_id

    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = rows_of(op5_language_id(spark, sf))
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    odd_got = {r["doc_id"]: r for r in rows_of(langid.report(odd))}
    assert odd_got[0]["lang_pred"] == odd_got[1]["lang_pred"] == odd_got[9]["lang_pred"] == "und"
    assert rows_of(langid.report(odd.limit(0))) == []


def test_every_labelled_language_is_learnt(spark):
    from pyspark.sql import functions as F

    from panelight.llm.langid import labelled

    rows = [(i, f"words of l{i % 250}", f"l{i % 250}") for i in range(260)] + [(1000 + i, "many", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (40, 300, 6000):
        got = labelled(docs, F.lit(True), sample, 2 * sample)
        assert {r["lang"] for r in got} == {r[2] for r in rows} and len(got) <= 2 * sample + 251
        assert all(r["lang"] == "en" or bytes(r["window"]).decode() == f"words of {r['lang']}" for r in got)
    long = spark.createDataFrame([(1, "abcdefgh" * 5000, "x"), (2, "", "empty"), (3, None, "none")], "doc_id long, text string, lang string")
    got = labelled(long, F.lit(True), 100, 50)
    assert len(got) == 50 and all(r["lang"] == "x" and len(r["window"]) in (64, 256) for r in got)


def test_network_is_plain_loops():
    import math

    import numpy as np

    from panelight.llm.langid import WINDOW, ByteNet, predict

    net = ByteNet(["aa", "bb", "cc"], seed=2)
    net.bias = np.random.default_rng(1).normal(0, 0.2, net.bias.shape).astype(np.float32)

    def loops(data):
        scores = []
        for f in range(net.filters.shape[1]):
            width = net.WIDTHS[f // net.FILTERS]
            best = -math.inf
            for at in range(WINDOW):
                total = 0.0
                for k in range(width):
                    byte = data[at + k] if at + k < len(data) and at + k < WINDOW else 0
                    for d in range(net.DIM):
                        total += float(net.embed[byte, d]) * float(net.filters[k * net.DIM + d, f])
                best = max(best, total)
            scores.append(max(0.0, best + float(net.bias[f])))
        z = [sum(s * float(net.out[i, c]) for i, s in enumerate(scores)) + float(net.out_bias[c]) for c in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    texts = ["short text", "ä" * 150 + " and more", "1 2 3", ""]
    names, score = predict(net, texts)
    for t, name, got in zip(texts, names, score):
        data = t.encode()
        parts = [(data[i : i + WINDOW], len(data[i : i + WINDOW])) for i in range(0, len(data), WINDOW)]
        if not any(c.isalpha() for c in t):
            assert (name, got) == ("und", 0.0)
            continue
        p = [sum(loops(d)[c] * n for d, n in parts) / len(data) for c in range(3)]
        assert name == net.languages[p.index(max(p))] and abs(got - max(p)) < 1e-4


def test_network_gradients_are_differences():
    import numpy as np

    from panelight.llm.langid import WINDOW, ByteNet

    rng = np.random.default_rng(8)
    net = ByteNet(["aa", "bb", "cc"], seed=3)
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x = rng.integers(1, 256, size=(5, WINDOW)).astype(np.uint8)
    x[1, 40:] = 0
    y, weight = np.array([0, 1, 2, 1, 0]), rng.uniform(0.5, 2, 5)
    for name, g in zip(("embed", "filters", "bias", "out", "out_bias"), net.gradients(x, y, weight)):
        p = getattr(net, name)
        for at in rng.permutation(p.size)[:60]:
            i = np.unravel_index(at, p.shape)
            if name == "embed" and i[0] == 0 or name == "filters" and not net.mask[i]:
                assert g[i] == 0
                continue
            old, step = p[i], 1e-6
            p[i] = old + step
            up = net.loss(x, y, weight)
            p[i] = old - step
            down = net.loss(x, y, weight)
            p[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 1e-4


def test_quality_held_out(spark, sf, docs, odd):
    from panelight.llm import quality_crf
    from panelight.llm.queries import op10_quality_classifier

    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = rows_of(op10_quality_classifier(spark, sf))
    held = [r for r in got if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.85 * len(held)
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 0), (9, 0, 0), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_crf.report(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0.5 for r in rows_of(quality_crf.report(odd, labels.limit(0))))


def test_field_marginals_are_brute_force():
    import itertools

    import numpy as np

    from panelight.llm.quality_crf import WIDTH, Field

    rng = np.random.default_rng(3)
    f = Field(rng.normal(size=WIDTH) * 0.2, rng.normal(size=(2, 2)))
    counts = np.array([1, 4, 2])
    x = rng.normal(size=(7, WIDTH)).astype(np.float32)
    p, _, _ = f.marginals(x, counts)
    at = 0
    for n in counts:
        u = x[at : at + n] @ f.weights
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(u[i] for i in range(n) if y[i]) + sum(f.pairs[a, b] for a, b in zip(y, y[1:])))
            total += s
            good += s * np.array(y)
        assert np.allclose(p[at : at + n], good / total)
        at += n


def test_url_rules_and_propagation(spark):
    from panelight.llm.urlfilter import judge

    pages = [(1, "https://A.example.org/es/5?x", '<a href="http://friend.net/">'), (2, "http://friend.net/x", None), (3, "http://far.net", '<a class=x href="http://a.example.org/">'), (4, None, None), (5, "nothing", "x"), (6, "http://x.com/fr/1", '<a href="//good.net/p">'), (7, "http://good.net/p#a", ""), (8, "http://EXAMPLE.org/en/12", ""), (8, "http://EXAMPLE.org/en/12", ""), (9, "http://notorg/en/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS verdict", "3 AS rule")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(judge(df))}
    assert got[1] == ("a.example.org", "/es/5", "example.org/es/", "block")
    assert got[3] == ("far.net", "", None, "block")  # links to a blocked host
    assert got[2] == ("friend.net", "/x", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[7] == ("good.net", "/p", None, "allow")
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2] is None
    assert judge(df.limit(0)).count() == 0


def test_url_flow_of_a_host_with_more_links_than_score(spark):
    from panelight.llm.urlfilter import FINE, UNIT, judge, spread

    edges = spark.createDataFrame([("hub", "a", 3 * UNIT), ("hub", "b", 1), ("a", "a2", 7), ("a2", "hub", 1)], "src string, dst string, n long")
    got = {r["host"]: int(r["score"]) for r in spread(spark.createDataFrame([("hub",)], "host string"), edges, steps=1).collect()}
    assert got == {"hub": 15 * UNIT * FINE // 100, "a": UNIT * FINE * 85 * 3 * UNIT // (100 * (3 * UNIT + 1)), "b": UNIT * FINE * 85 // (100 * (3 * UNIT + 1))}
    chain = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(12)], "src string, dst string, n long")
    got = {r["host"]: int(r["score"]) for r in spread(spark.createDataFrame([("h0",)], "host string"), chain).collect()}
    assert len(got) == 13 and abs(got["h11"] / (UNIT * FINE) - 0.15 * 0.85**11) < 1e-12
    rules = [("bad.net", "/", "block"), *[(f"w{i}.net", "/", "block") for i in range(6)]]
    pages = [(1, "http://bad.net/", ""), (2, "http://one.net/", '<a href="http://bad.net/">'), (3, "http://two.net/", '<a href="http://bad.net/">' * 3), *[(10 + i, f"http://w{i}.net/", "") for i in range(6)]]
    rows = {r["page_id"]: r for r in rows_of(judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules))}
    seed = UNIT // 7
    assert rows[2]["verdict"] == rows[3]["verdict"] == "block" and (rows[2]["distrust"], rows[3]["distrust"]) == (seed * 85 * 15 // 40000, seed * 85 * 3 * 15 // 40000)
    assert rows[1]["distrust"] == seed * 15 // 100


def test_seeds_of_both_sides_weigh_alike(spark):
    from panelight.llm.urlfilter import judge

    for others in ("good", "bad"):
        rules = [("x.com", "/fr/", "allow"), ("x.com", "/de/", "block"), ("good.net", "/", "allow"), ("bad.net", "/", "block")]
        pages = [(1, "http://x.com/fr/1", ""), (2, "http://x.com/de/1", ""), (3, "http://x.com/", "")] + [(9 + i, f"http://h{i}.{others}.net/", "") for i in range(3)]
        got = {r["page_id"]: r for r in rows_of(judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules))}
        assert got[3]["verdict"] == "allow" and got[3]["trust"] == got[3]["distrust"]  # a tie, whatever other hosts there are


def test_licences(spark, odd):
    from panelight.llm.licences import TEXTS, known_licences, scan

    mit = TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Some One\n" + mit.upper().replace('"', "'")), (2, "text\nreleased under the MIT Licence\nmore"), (3, None), (4, "Copyright 2001 A"), (5, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in rows_of(scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[2]["licence"] is None and got[2]["notices"] == "MIT" and got[2]["n_notices"] == 1
    assert got[3]["licence"] is None and got[4]["licence"] is None
    assert got[5]["licence"] == "CC-BY-NC-4.0"
    one = rows_of(scan(spark.createDataFrame([(1, "COPYRIGHT 2020 Some One\n\n" + mit)], "doc_id long, text string")))
    assert one[0]["licence"] == "MIT"
    assert scan(odd).count() == odd.count() and scan(odd.limit(0)).count() == 0
    assert known_licences(spark, []).count() == 0


def test_whole_licences_and_ids(spark):
    import os

    from panelight.llm.licences import TEXTS, scan

    mit = TEXTS["MIT"].split("\n\n", 1)[1]
    bsd = 'Copyright (c) 2020, Some One\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer.\n\n* Redistributions in binary form must reproduce the above copyright notice,\n  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.\n\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\nFOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR\nSERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER\nCAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,\nOR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE\nOF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\n'
    third = "* Neither the name of the copyright holder nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n\n"
    texts = [("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + mit), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + bsd.format("")), ("BSD-3-Clause", bsd.format(third)), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd.format(third))]
    texts += [("GPL-3.0", "// SPDX-License-Identifier: GPL-3.0-only"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later")]
    for licence, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        at = f"/usr/share/common-licenses/{name}"
        if os.path.exists(at):
            with open(at) as f:
                texts.append((licence, f.read()))
            texts.append((licence, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t\f]*\n", texts[-1][1]))))
    got = {r["doc_id"]: r["licence"] for r in rows_of(scan(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id long, text string")))}
    assert [got[i] for i in range(len(texts))] == [k for k, _ in texts]


@pytest.mark.parametrize("broadcast_bytes", [0, 64 << 20])
def test_decontamination_edges(spark, odd, broadcast_bytes):
    from panelight.llm.decontam import decontaminate, report

    passage = " ".join(f"p{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (2, "Tiny Item"), (3, None), (4, ""), (5, passage)], "item_id long, text string")
    more = spark.createDataFrame([(100, "x y " + passage.upper() + " z", None, None, None, None, None), (101, "a tiny, item!", None, None, None, None, None), (102, " ".join(f"p{i}" for i in range(12)), None, None, None, None, None)], SCHEMA)
    df = odd.unionByName(more)
    got = {r["doc_id"]: r for r in rows_of(report(df, bench, broadcast_bytes=broadcast_bytes))}
    assert got[100]["n_hit"] == 20 and got[100]["n_items"] == 2 and got[100]["contaminated"]
    assert got[101]["n_hit"] == 2 and got[102]["n_hit"] == 0 and got[0]["n_words"] == 0
    left = {r["doc_id"] for r in decontaminate(df, bench, broadcast_bytes=broadcast_bytes).collect()}
    assert 100 not in left and 102 in left
    cut = {r["doc_id"]: r["text"] for r in decontaminate(df, bench, remove="spans").collect()}
    assert cut[100] == "x y z" and cut[0] is None
    assert report(df.limit(0), bench.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [0, 64 << 20])
def test_decontamination_of_greek_capitals(spark, broadcast_bytes):
    from panelight.llm.decontam import report

    bench = spark.createDataFrame([(1, "ΕΛΛΑΣ.ΤΟ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ΕΛΛΑΣ.ΤΟ y"), (2, "ΕΛΛΑΣ ΤΟ"), (3, "ελλας το")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in rows_of(report(docs, bench, broadcast_bytes=broadcast_bytes))}
    assert got == {1: (2, True), 2: (2, True), 3: (0, False)}


@pytest.mark.parametrize("broadcast_bytes", [0, 64 << 20])
def test_decontamination_is_brute_force(spark, broadcast_bytes):
    """Items of every length up to 40 words in a small vocabulary, so that windows overlap, repeat and begin anywhere."""
    import random

    from panelight.llm.decontam import report

    rnd = random.Random(9)

    def some(n):
        return " ".join(rnd.choices("abcd", k=n))

    items = [(i, some(n)) for i, n in enumerate([0, 1, 2, 3, 5, 8, 12, 13, 14, 20, 40])][2:]
    docs = [(i, some(rnd.randrange(60))) for i in range(60)] + [(100 + i, some(i) + " x " + x + " " + some(i)) for i, x in items] + [(7, items[-1][1]), (7, items[-1][1])]

    def brute(text):
        w, hit, seen = text.split(), set(), set()
        for i, x in items:
            v = x.split()
            size = min(13, len(v))
            grams = {tuple(v[j : j + size]) for j in range(len(v) - size + 1)} if v else set()
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in grams:
                    hit.update(range(j, j + size))
                    seen.add(str(i))
        return len(w), len(hit), len(seen), sha(",".join(sorted(seen))), len(hit) > 0 and 20 * len(hit) >= len(w)

    got = rows_of(report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast_bytes))
    assert sorted(map(tuple, got)) == sorted((i, *brute(x)) for i, x in docs)


def test_pipeline(spark, sf):
    import corpus_pipeline as C
    from panelight.llm import bpe, decontam
    from panelight.llm.queries import vocabulary

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows_of(C.run(spark, sf))
    kept = docs.cache()
    for _, stage in C.STAGES[:2]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    items = text_of(kept)
    want, _ = brute_classes(items, 5, 80)
    firsts = [(i, x) for i, x in items if want[i] == i]
    bad = {r["doc_id"] for r in decontam.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").collect()}
    t = bpe.tokenizer(vocabulary("word_bpe_49k.json"))
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: t.encode(x).tolist() for i, x in firsts if i not in bad}
