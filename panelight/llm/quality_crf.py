"""Quality classification by a linear-chain conditional random field over lines.

Each line of a text is good or bad.  Its features are counts of its own and
those of the lines next to it; neighbouring labels are tied by transition
weights.  A document's score is the mean of the lines' marginals (forward-
backward), weighted by line length.  Lines are trained with the label of their
document, on a bounded sample: ``SAMPLE`` labelled documents and of each at most
``SAMPLE_LINES`` consecutive lines, from a place of its own in the whole text.

Null and empty texts are one empty line.  With nothing to learn from, every
score is 0.5.  A document with several labels is learnt with each of them.  Repeated
rows get equal results; an empty table gives no rows.  A text of any length is scored whole, in one
task.  Of samples with equal hashes the least id counts first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.llm.common import bounded_sample, crc_mod, map_texts

#: Labelled documents that the field is fitted on.
SAMPLE = 4_000
#: Consecutive lines of such a document.
SAMPLE_LINES = 256
THRESHOLD = 0.3

#: Classes of bytes that are counted in a line.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)), b"0123456789", b"#*$%&|<>@^~=+{}[]\\_/", b"!?", b".,;:'\"()-", b" \t\r\x0b\x0c"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_c, np.uint8)] = _i
OWN = len(_CLASSES) + 6


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (own, of the line before, of the line after, ends, 1), its bytes, and the lines of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    lines = [d.split(b"\n") for d in data]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts
    kind = _CLASS[buf]
    x = np.zeros((len(ends), OWN), np.float32)
    n = np.maximum(size, 1).astype(np.float32)
    for i in range(len(_CLASSES)):
        x[:, i] = np.add.reduceat(kind == i, starts, dtype=np.int64) / n
    words, fresh, again = [], [], []
    for doc in lines:
        seen: set = set()
        for line in doc:
            w = line.split()
            words.append(len(w))
            fresh.append(len(set(w)))
            again.append(line in seen and bool(w))
            seen.add(line)
    words, fresh = np.array(words, np.float32), np.array(fresh, np.float32)
    k = len(_CLASSES)
    x[:, k] = np.log1p(size) / 8
    x[:, k + 1] = np.log1p(words) / 6
    x[:, k + 2] = fresh / np.maximum(words, 1)
    x[:, k + 3] = np.log1p(n / np.maximum(words, 1)) / 4
    x[:, k + 4] = again
    x[:, k + 5] = size == 0
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    edge = np.cumsum(counts)
    first[edge - counts], last[edge - 1] = True, True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], axis=1, dtype=np.float32), size + 1, counts


WIDTH = 3 * OWN + 3


class Field:
    """Weights of line features for "good", and log-potentials of neighbouring labels."""

    def __init__(self, weights=None, pairs=None):
        self.weights = np.zeros(WIDTH) if weights is None else weights
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line and the four joint probabilities with the next line (0 at the end of a text).

        Texts advance together, longest first, so a step is one vector operation.
        Messages are odds of good to bad.
        """
        e = np.exp(np.clip(x @ self.weights, -30, 30))
        m = np.exp(np.clip(self.pairs, -8, 8))
        order = np.argsort(-counts, kind="stable")
        starts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else np.zeros(0, int)
        ahead, back = e.copy(), np.ones(len(e))
        for t in range(1, len(active)):
            i = starts[: active[t]] + t
            o = ahead[i - 1]
            ahead[i] = np.clip(e[i] * (m[0, 1] + o * m[1, 1]) / (m[0, 0] + o * m[1, 0]), 1e-30, 1e30)
        for t in range(len(active) - 1, 0, -1):
            i = starts[: active[t]] + t
            o = e[i] * back[i]
            back[i - 1] = np.clip((m[1, 0] + m[1, 1] * o) / (m[0, 0] + m[0, 1] * o), 1e-30, 1e30)
        odds = ahead * back
        inner = np.ones(len(e), bool)
        inner[np.cumsum(counts) - 1] = False
        at = np.flatnonzero(inner)
        o, b = ahead[at], (e * back)[at + 1]
        joint = np.stack([np.full(len(at), m[0, 0]), m[0, 1] * b, m[1, 0] * o, m[1, 1] * o * b], axis=1)
        return odds / (1 + odds), joint / joint.sum(axis=1, keepdims=True), at

    def fit(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Adam on the conditional log-likelihood; a document counts once, whatever its lines."""
        y = np.repeat(labels, counts).astype(float)
        share = np.repeat(1 / counts / len(counts), counts)
        state = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
        for step in range(1, steps + 1):
            p, joint, at = self.marginals(x, counts)
            g = np.zeros(WIDTH + 4)
            g[:WIDTH] = ((p - y) * share) @ x + ridge * self.weights
            same = np.zeros_like(joint)
            same[np.arange(len(at)), np.where(y[at] > 0, 3, 0)] = 1
            g[WIDTH:] = ((joint - same) * share[at][:, None]).sum(axis=0) + 30 * ridge * self.pairs.ravel()
            state[0] += 0.1 * (g - state[0])
            state[1] += 0.001 * (g * g - state[1])
            move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
            self.weights = self.weights - move[:WIDTH]
            self.pairs = self.pairs - move[WIDTH:].reshape(2, 2)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, size, counts = line_features(texts)
        p, _, _ = self.marginals(x, counts)
        starts = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts), 0, 1)


def train(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> Field | None:
    """A field from at most ``sample`` documents with a label for which ``learn`` holds."""
    some = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).filter("__y IN (0, 1) AND __id IS NOT NULL")
    rows = docs.select("doc_id", "text").filter(learn)
    picked = bounded_sample(some.filter(crc_mod(F.col("__id"), 5) != 0), "__id", sample)
    data = rows.join(F.broadcast(picked), rows["doc_id"] == picked["__id"]).select("__y", "text")

    def make():
        import xxhash

        def f(texts: list[str]) -> list:
            x, _, counts = line_features(texts)
            cut = np.cumsum(counts) - counts
            start = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % max(1, n - SAMPLE_LINES + 1) for t, n in zip(texts, counts.tolist())]
            return [[x[c + s : c + min(s + SAMPLE_LINES, n)].astype(np.float16).tobytes() for c, s, n in zip(cut.tolist(), start, counts.tolist())]]

        return f

    made = map_texts(data, "text", ["__y"], [T.StructField("f", T.BinaryType())], make).collect()
    if len({r["__y"] for r in made}) < 2:
        return None
    made.sort(key=lambda r: (r["__y"], bytes(r["f"])))  # the same order on every run
    parts = [np.frombuffer(r["f"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in made]
    field = Field()
    field.fit(np.concatenate(parts), np.array([len(p) for p in parts]), np.array([r["__y"] for r in made]))
    return field


def score(docs: DataFrame, field: Field | None, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score and predicted (1 if score >= ``threshold``) of every whole text."""

    def make():
        return lambda texts: [field.scores(texts) if field else np.full(len(texts), 0.5)]

    out = map_texts(docs, text_col, keep if keep is not None else ["doc_id"], [T.StructField("score", T.DoubleType())], make)
    return out.select(*[c for c in out.columns if c.lower() != "predicted"], (F.col("score") >= threshold).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 modulo 5 is 0 are not learnt from."""
    docs = docs.select("doc_id", "text")
    out = crc_mod(F.col("doc_id"), 5) == 0
    field = train(docs, labels, ~out)
    return score(docs.select("doc_id", "text", out.alias("held_out")), field, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")
