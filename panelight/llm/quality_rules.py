"""Quality rules: counts of each whole text and zstandard compression bands.

A text is rejected by the base rules (too short, too much repetition) or when
a zstandard ratio (raw bytes / compressed bytes) leaves the band of its length:
a high ratio is repetitive text, a low one is noise.  The whole text and each
fixed chunk of it are compressed, so a repetitive or noisy part of a text shows.

Null and empty texts have no words, every count is 0, ratios are 0.0 and the
base rules fail.  Each row is judged alone: repeated rows get equal results, and an
empty table gives none.  A text of any length is compressed whole, in one task.  A ratio equal
to a limit (a tie) is inside the band.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.llm.common import map_texts

#: Level of the compressor, and bytes of a chunk of texts of so many bytes at least; shorter texts are one chunk.
LEVEL, CHUNKS = 3, (4096, 1024)
#: (up to so many bytes, least ratio, greatest ratio): longer texts compress better.  Fitted at level 3 to the
#: documents of sf0.1 that are labelled good (ratios 1.38 to 1.66 in the first class, 2.22 to 2.48 beyond 8192 bytes) and
#: to random words of base64 letters, printable ASCII and CJK (up to 1.16 in the first class, 1.39 beyond 8192 bytes).
BANDS = [(384, 1.25, 2.6), (512, 1.28, 2.8), (1024, 1.35, 3.0), (2048, 1.5, 3.3), (4096, 1.6, 3.5), (8192, 1.7, 3.7), (1 << 62, 1.7, 4.0)]
#: Of chunks, more than this share outside the band of their length rejects; clean texts have none.
CHUNK_SHARE = 0.1

_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated(words: list) -> int:
    """Words inside 3-word windows that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    code: dict = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=n)
    pair = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * len(code) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    hit = np.zeros(n, dtype=bool)
    for i in range(3):
        hit[i : i + n - 2] |= twice
    return int(hit.sum())


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for limit, low, high in bands if n_bytes <= limit)


def judged(text: str, compressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, n_chunks, n_bad_chunks of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    # code points: every byte that does not continue one
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    chars = int(((joined & 0xC0) != 0x80).sum())
    seen: set = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    n = next((c for c in CHUNKS if len(data) >= c), max(len(data), 1))
    low, high = band(n)
    bad, chunks = 0, -(-len(data) // n)
    for at in range(0, len(data), n):
        # the last one is as long as the others and begins before the end of the one before it
        part = data[min(at, len(data) - n) :][:n]
        bad += not low <= len(part) / len(compressor.compress(part)) <= high
    ratio = len(data) / len(compressor.compress(data)) if data else 0.0
    return len(words), chars, len(_SYMBOLS.findall(text)), dup, repeated(words), ratio, chunks, bad


def in_band(n_bytes: int, ratio: float, chunks: int, bad: int) -> bool:
    low, high = band(n_bytes)
    return low <= ratio <= high and bad <= CHUNK_SHARE * chunks


def judge(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the counts, zstd_ratio, n_chunks, n_bad_chunks, base_failed and kept for each row."""

    def make():
        import zstandard

        z = zstandard.ZstdCompressor(level=LEVEL)

        def f(texts: list[str]) -> list:
            rows = [judged(t, z) for t in texts]
            out = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(8)]
            verdict = [in_band(len(t.encode("utf-8", "surrogatepass")), r[5], r[6], r[7]) for t, r in zip(texts, rows)]
            return [*out, verdict]

        return f

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField("zstd_ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_bad_chunks", T.LongType()), T.StructField("in_band", T.BooleanType())]
    out = map_texts(df, text_col, keep if keep is not None else ["doc_id"], fields, make)
    out = out.select(*[c for c in out.columns if c.lower() not in ("base_failed", "kept")])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept"))
