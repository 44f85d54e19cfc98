"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's maximum over the window goes into a softmax.  The network is
trained in numpy on a bounded sample of windows of labelled texts, drawn from any
place of whole texts and with every language in it, and is applied to every
window of a text; windows are averaged by their bytes.

A null text, or one without a letter, is ``und`` with score 0.0.  With no labelled
row to learn from, every text is ``und``.  Of languages with equal probability the
first in string order wins.  Repeated rows get equal results; a text of any length is
read whole, in windows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.llm.common import crc_mod, map_texts

#: Labelled rows whose windows a network is fitted on, and at most so many of these windows, besides one window of each language that these miss.
SAMPLE, SAMPLE_WINDOWS = 6_000, 18_000
#: Bytes of a window.
WINDOW = 256
UNKNOWN = "und"


class ByteNet:
    """Embedding, filters of widths 2, 3 and 4, max pooling, softmax."""

    WIDTHS, FILTERS, DIM = (2, 3, 4), 8, 8
    #: windows handled at once
    GO = 128

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        wide = max(self.WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, self.DIM)).astype(np.float32)
        self.embed[0] = 0
        #: a narrow filter is a wide one whose last rows are zero
        self.mask = np.concatenate([np.repeat((np.arange(wide * self.DIM) < w * self.DIM)[:, None], self.FILTERS, 1) for w in self.WIDTHS], axis=1).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, wide * DIM) neighbourhoods of the bytes of (windows, WINDOW)."""
        wide = max(self.WIDTHS)
        e = self.embed[np.pad(x, ((0, 0), (0, wide - 1)))]
        a, b, c = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, wide * self.DIM), (a, b, c), writeable=False)

    def pooled(self, cols: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(cols).reshape(-1, cols.shape[2]) @ self.filters
        return flat.reshape(len(cols), WINDOW, -1)

    def softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [self.softmax(np.maximum(self.pooled(self.columns(x[i : i + self.GO])).max(axis=1) + self.bias, 0)) for i in range(0, len(x), self.GO)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def loss(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        return float((-np.log(self.predict(x)[np.arange(len(x)), y]) * weight).mean())

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
        """Those of ``loss`` by embedding, filters, bias, output weights and output bias."""
        wide, n = max(self.WIDTHS), len(x)
        cols = self.columns(x)
        act = self.pooled(cols)
        top = act.argmax(axis=1)  # (n, filters)
        h = np.take_along_axis(act, top[:, None], 1)[:, 0] + self.bias
        r = np.maximum(h, 0)
        p = self.softmax(r)
        p[np.arange(n), y] -= 1
        p *= weight[:, None] / n
        d = (p @ self.out.T) * (h > 0)
        near = cols[np.arange(n)[:, None], top]  # (n, filters, wide * DIM)
        back = (d[:, :, None] * self.filters.T[None]).reshape(-1, self.DIM)
        places = (top[:, :, None] + np.arange(wide)).reshape(n, -1)
        seen = np.take_along_axis(np.pad(x, ((0, 0), (0, wide - 1))), places, 1).ravel()
        g_e = np.zeros_like(self.embed)
        np.add.at(g_e, seen, back)
        g_e[0] = 0
        return g_e, np.einsum("nf,nfk->kf", d, near) * self.mask, d.sum(axis=0), r.T @ p, p.sum(axis=0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 6) -> None:
        """Adam on the cross-entropy; classes weigh alike."""
        rng = np.random.default_rng(seed)
        counts = np.bincount(y, minlength=len(self.languages))
        weight = (len(y) / (len(self.languages) * np.maximum(counts, 1)))[y].astype(np.float32)
        weight = np.minimum(weight, 10)
        params = [self.embed, self.filters, self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                k = order[at : at + batch]
                step += 1
                lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for q, g, a, b in zip(params, self.gradients(x[k], y[k], weight[k]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= (lr * a / (np.sqrt(b) + 1e-7)).astype(np.float32)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes, the text of each window, and its bytes; empty texts have none."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([-(-len(d) // WINDOW) for d in data], dtype=np.int64)
    flat = b"".join(d.ljust(c * WINDOW, b"\0") for d, c in zip(data, counts.tolist()))
    of = np.repeat(np.arange(len(data)), counts)
    size = np.full(len(of), WINDOW)
    some = counts > 0
    size[np.cumsum(counts)[some] - 1] = (np.array([len(d) for d in data], dtype=np.int64) - (counts - 1) * WINDOW)[some]
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), of, size


def predict(net: ByteNet | None, texts: list[str]) -> tuple[list[str], list[float]]:
    letters = [any(map(str.isalpha, t)) for t in texts]
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    x, of, size = windows([t if a else "" for t, a in zip(texts, letters)])
    total = np.zeros((len(texts), len(net.languages)))
    np.add.at(total, of, net.predict(x) * size[:, None])
    weight = np.bincount(of, weights=size, minlength=len(texts))
    p = total / np.maximum(weight, 1)[:, None]
    best = p.argmax(axis=1)
    return [net.languages[b] if a else UNKNOWN for a, b in zip(letters, best.tolist())], [min(1.0, float(p[i, b])) if letters[i] else 0.0 for i, b in enumerate(best)]


def labelled(docs: DataFrame, learn, sample: int = SAMPLE, sample_windows: int = SAMPLE_WINDOWS) -> list:
    """(lang, window) of at most ``sample_windows`` windows of about ``sample`` rows for which ``learn`` holds, and one of each language that is not among them.

    Rare languages keep a larger share of their rows.  A language whose texts are all empty is not learnt.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang", F.col("text").cast("binary").alias("b")).filter("octet_length(b) > 0")
    of = lambda *c: F.xxhash64(F.col("doc_id").cast("string"), *c)
    h, count = of(F.lit(17)), F.ceil(F.octet_length("b") / WINDOW)
    window = lambda i: F.expr(f"substring(b, cast({i} * {WINDOW} + 1 AS int), {WINDOW})")
    one = rows.select("lang", h.alias("h"), "b", F.pmod(of(F.lit(18)), count).alias("i")).select("lang", "h", window("i").alias("window"))
    languages = one.groupBy("lang").agg(F.count("*").alias("count"), F.min(F.struct("h", "window"))["window"].alias("window")).orderBy(F.desc("count"), "lang").collect()
    if not languages:
        return []
    each = sample // len(languages)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in languages], "lang string, share double")
    picked = rows.join(F.broadcast(shares), "lang").filter(F.pmod(h, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    every = picked.select("doc_id", "lang", "b", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"))
    found = every.select(of("i").alias("h"), "lang", window("i").alias("window")).orderBy("h", "lang", "window").limit(sample_windows).select("lang", "window").collect()
    seen = {r["lang"] for r in found}
    return found + [r for r in languages if r["lang"] not in seen]


def train(docs: DataFrame, learn, sample: int = SAMPLE, sample_windows: int = SAMPLE_WINDOWS) -> ByteNet | None:
    """A network from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds."""
    rows = labelled(docs, learn, sample, sample_windows)
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    x = np.frombuffer(b"".join(bytes(r["window"]).ljust(WINDOW, b"\0") for r in rows), np.uint8).reshape(-1, WINDOW)
    code = {name: i for i, name in enumerate(languages)}
    y = np.array([code[r["lang"]] for r in rows], dtype=np.int64)
    net = ByteNet(languages)
    if len(languages) > 1:
        # a window is as often cut short as a short text is
        rng = np.random.default_rng(7)
        short = x.copy()
        keep = rng.integers(24, WINDOW, size=len(x))
        short[np.arange(WINDOW)[None] >= keep[:, None]] = 0
        net.fit(np.concatenate([x, short]), np.concatenate([y, y]))
    return net


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, lang_pred and score of every whole text; the network (some 20 kB) goes with the function."""

    def make():
        return lambda texts: list(predict(net, texts))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, text_col, keep if keep is not None else ["doc_id"], fields, make)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32 modulo 4 is 2 are not learnt from."""
    docs = docs.select("doc_id", "text", "lang")
    out = crc_mod(F.col("doc_id"), 4) == 2
    net = train(docs, ~out)
    rows = identify(docs.select("doc_id", "text", out.alias("held_out")), net, keep=["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "lang_pred", "score")
