"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as a list of its parts (the symbol between two boundaries) and a parallel list with the rank
of each adjacent pair.  The lowest rank is searched, leftmost first, the boundary inside it is
deleted (two parts become one) and the two neighbouring ranks are refreshed, until no pair has a
rank.  Words recur, so encoded words are kept in a bounded table.  Words over
``SHORT`` symbols use a heap over the same ranks, which gives the same parts
without the quadratic scan.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.llm.common import map_texts

#: Entries of one generation of a worker's table of encoded words (some 200 bytes each).
TABLE = 200_000
#: Words of more symbols than this are merged with a heap.
SHORT = 64
NONE = 1 << 60

#: Characters of which the plain pattern below isn't known to match as the full one does.
ODD = re.compile("[^\t-\r\x20-\x7eß-öø-ɏ]").search
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\\sa-z0-9ß-öø-ɏ]+").findall
#: How the byte-level tokenizer files split text into words.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others are numbered from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Ranks(dict):
    """Ranks of pairs; a pair without one is kept as such when it is met, up to ``KEPT`` of them."""

    KEPT = 300_000

    def __missing__(self, pair):
        if len(self) < self.KEPT:
            self[pair] = NONE
        return NONE


class _Table(dict):
    """string -> the bytes of its int32 ids; computes what is missing.

    Holds two generations of ``most`` entries: when the young one is full it
    becomes the old one, from which entries come back when they are used.
    """

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        self[key] = out = self.encode(key) if out is None else out
        return out


class Bpe:
    """A tokenizer read from a ``tokenizers`` file of byte-level BPE, with or without word ends.

    ``encode`` gives ids without added begin or end tokens; strings of special
    tokens in a text become those tokens when ``specials`` is true (the
    library's default) and ordinary text otherwise.  ``table`` bounds one
    generation of encoded words; it tells how much is computed again, not what.
    """

    def __init__(self, path: str, specials: bool = True, table: int = TABLE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *added]) + 1)
        for i, name in [*((i, s) for s, i in vocab.items()), *added.items()]:
            self.names[i] = name
        letters = byte_letters()
        #: pair of ids -> rank; the merged id is in ``merged``
        self.ranks = _Ranks()
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        self.single = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + self.end) for c in letters]
        self.lowered = self._lowers(spec.get("normalizer"))
        self.word_pattern = regex.compile(WORD_END_PATTERN if self.end else BYTE_PATTERN)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = _Table(self.encode_word, table)
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.byte_strings: list[bytes] | None = None

    @staticmethod
    def _lowers(normalizer: dict | None) -> bool:
        """Whether texts are put into NFC and lower case; any other normaliser is an error."""
        if normalizer is None:
            return False
        steps = normalizer.get("normalizers", [normalizer])
        kinds = [s["type"] for s in steps]
        blanks = [s for s in steps if s["type"] == "Replace"]  # white space is no part of a word
        if [k for k in kinds if k != "Replace"] != ["NFC", "Lowercase"] or any(s["content"] != " " for s in blanks):
            raise ValueError(f"normaliser that isn't known: {kinds}")
        return True

    def normalised(self, text: str) -> str:
        if not self.lowered:
            return text
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # letter by letter: the last sigma of a word is not treated apart
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def encode_word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.single[b] for b in data]
        if self.end:
            ids[-1] = self.last[data[-1]]
        return array("i", self.merge(ids) if len(ids) <= SHORT else self.merge_long(ids)).tobytes()

    def merge(self, ids: list[int]) -> list[int]:
        """The contiguous rank array: scan for the minimum, delete, refresh the neighbours."""
        rank_of, merged = self.ranks, self.merged
        ranks = [*map(rank_of.__getitem__, zip(ids, ids[1:])), NONE]
        while (low := min(ranks)) != NONE:
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of[ids[i - 1], ids[i]]
            if i + 1 < len(ids):
                ranks[i] = rank_of[ids[i], ids[i + 1]]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for long words: least rank, then leftmost, from a heap with stale entries skipped."""
        n, rank_of = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of[ids[i], ids[i + 1]]) != NONE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := rank_of[ids[x], ids[y]]) != NONE:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x, live in zip(ids, alive) if live]

    def _plain(self, text: str) -> bytes:
        text = self.normalised(text)
        find = PLAIN_WORDS if self.end and not ODD(text) else self.word_pattern.findall
        return b"".join(map(self.words.__getitem__, find(text)))

    def encode(self, text: str) -> np.ndarray:
        """int32 ids of a whole text."""
        if self.special_pattern is None or "<" not in text:
            return np.frombuffer(self._plain(text), dtype=np.int32)
        parts = self.special_pattern.split(text)
        return np.frombuffer(b"".join(np.int32(self.special[p]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: with no decoder in the file, token names joined by blanks; else the bytes as UTF-8."""
        if self.end:
            return " ".join(map(self.names.__getitem__, ids))
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: list[int]) -> bytes:
        if self.byte_strings is None:
            special = {*self.special.values()}
            self.byte_strings = [s.encode() if i in special or not all(c in self.bytes_of for c in s) else bytes(self.bytes_of[c] for c in s) for i, s in enumerate(self.names)]
        return b"".join(map(self.byte_strings.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(path: str, specials: bool = True) -> Bpe:
    """One tokenizer for each worker and file."""
    return Bpe(path, specials)


def encode_decode(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, table: int | None = None) -> DataFrame:
    """Ids of every whole text and the text that they decode to.

    Returns the ``keep`` columns, ``ids`` array<int> and ``decoded`` string.
    Null and empty texts have no ids and decode to "".  ``vocabulary`` is the
    path of a tokenizer file, the same on every executor.  A worker keeps its
    tokenizer and the words it met, unless ``table`` bounds them: then each task
    has a tokenizer of its own, which takes 0.3 s to load and leaves nothing behind.
    """

    def make():
        bpe = tokenizer(vocabulary) if table is None else Bpe(vocabulary, table=table)

        def f(texts: list[str]) -> list:
            ids = [bpe.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
            return [pa.ListArray.from_arrays(ends, flat), [bpe.decode(x.tolist()) for x in ids]]

        return f

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_texts(df, text_col, keep if keep is not None else ["doc_id"], fields, make)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from what ``encode_decode`` returns."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
