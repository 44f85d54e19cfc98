"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are held as ragged numpy arrays: one flat array of
symbols, one of adjacent ranks, and the sequence of each symbol.  In each
round every sequence that still has a ranked pair merges its lowest one (the
leftmost of equals) at the same time; what survives is counted.  A round costs
all symbols of the batch, and an unbroken run of n letters needs up to n
rounds, so pre-tokens over ``LONG`` symbols are merged one by one instead, in
the same order, with a heap over linked symbols: n log n steps.

Null and empty texts have no tokens; texts of any length are counted whole.  Of
equal ranks the leftmost pair merges first.  Repeated rows get equal results, an empty table gives none.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.llm.common import map_texts

#: Entries of one generation of a worker's table of counted pre-tokens.
TABLE = 200_000
#: Symbols of a pre-token that is merged with a heap.
LONG = 1024
#: Symbols merged in one go.
GO = 1 << 20
NONE = np.int64(1) << 40
SPACE = "▁"


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model with byte fallback makes of a text.

    The model must have the identity normaliser; a blank is put before every
    non-empty text if the model says so.  A character that is no piece counts
    its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = sp.get_score(i)
        #: the tokens of a blank alone tell whether one is put before texts
        self.prefix = " " if sp.encode("\n", out_type=str)[0] == SPACE else ""
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.symbols: dict[str, int] = {}
        for p in pieces:
            for s in (p, *p):
                self.symbols.setdefault(s, len(self.symbols))
        self.other = len(self.symbols)  # any character that no piece has
        #: tokens of a symbol when it survives
        self.weight = np.array([1 if s in pieces else len(s.encode()) for s in self.symbols] + [0], dtype=np.int64)
        pairs = {}
        for p, score in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (self.other + 1) + b] = (order[score], self.symbols[p])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank, self.into = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64).T
        inner = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c != " " and c not in inner)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a blank after a letter need another split")
        # No piece holds a blank after another character, nor a character of `alone` beside any other.
        self.split = re.compile(f"[{alone}]| *[^ {alone}]+| +").findall if alone else re.compile(" *[^ ]+| +").findall
        self.table: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * (self.other + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NONE), self.into[at]

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        texts = [w.replace(" ", SPACE) for w in words]
        length = np.array([len(t) for t in texts], dtype=np.int64)
        chars = "".join(texts)
        code = self.symbols.get
        flat = np.fromiter((code(c, self.other) for c in chars), dtype=np.int64, count=len(chars))
        seq = np.repeat(np.arange(len(words)), length)
        total = np.zeros(len(words), dtype=np.int64)
        # unknown characters: their bytes, counted at once
        for i in np.flatnonzero(flat == self.other):
            total[seq[i]] += len(chars[i].encode("utf-8", "surrogatepass"))
        rank, into = np.full(len(flat), NONE), np.zeros(len(flat), dtype=np.int64)
        if len(flat) > 1:
            rank[:-1], into[:-1] = self.ranks(flat[:-1], flat[1:])
            rank[:-1][seq[:-1] != seq[1:]] = NONE
        while len(flat):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            # finished sequences leave the arrays
            done = np.repeat(low == NONE, np.diff(np.r_[starts, len(flat)]))
            if done.any():
                np.add.at(total, seq[done], self.weight[flat[done]])
                flat, seq, rank, into = flat[~done], seq[~done], rank[~done], into[~done]
                if not len(flat):
                    break
                starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
                low = low[low != NONE]
            hit = np.flatnonzero(rank == np.repeat(low, np.diff(np.r_[starts, len(flat)])))
            first = hit[np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]]  # one pair a sequence
            flat[first] = into[first]
            stay = np.ones(len(flat), dtype=bool)
            stay[first + 1] = False
            at = first - np.arange(len(first))
            flat, seq, rank, into = flat[stay], seq[stay], rank[stay], into[stay]
            for i in (at, at[at > 0] - 1):
                last = i >= len(flat) - 1
                j = np.where(last, i, i + 1)
                r, t = self.ranks(flat[i], flat[j])
                rank[i], into[i] = np.where(last | (seq[i] != seq[j]), NONE, r), t
        return total

    def merge_long(self, word: str) -> int:
        """Tokens of one long pre-token: lowest rank, then leftmost, from a heap whose stale entries are skipped."""
        text = word.replace(" ", SPACE)
        ids = [self.symbols.get(c, self.other) for c in text]
        n, total = len(ids), sum(len(c.encode("utf-8", "surrogatepass")) for c, i in zip(text, ids) if i == self.other)
        pairs, width = self.pairs, self.other + 1
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := pairs.get(ids[i] * width + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = into, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := pairs.get(ids[x] * width + ids[y])):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return total + int(self.weight[[x for x, live in zip(ids, alive) if live]].sum())

    def learn(self, words: set[str]) -> None:
        go, size = [], 0
        for w in words:
            if len(w) > LONG:
                self.table[w] = self.merge_long(w)
                continue
            go.append(w)
            size += len(w)
            if size >= GO:
                self.table.update(zip(go, self.merge(go).tolist()))
                go, size = [], 0
        if go:
            self.table.update(zip(go, self.merge(go).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(self.prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = set().union(*parts)
        if len(self.table) > TABLE:
            self.old, self.table = self.table, {}
        new -= self.table.keys()
        for w in new & self.old.keys():
            self.table[w] = self.old[w]
        self.learn(new - self.table.keys())
        tokens = self.table.__getitem__
        return [sum(map(tokens, p)) for p in parts]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, model: str, limit: int = 4096, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``) of every whole text.

    Null and empty texts have no bytes and no tokens.
    """

    def make():
        c = counter(model)
        return lambda texts: [[len(t.encode("utf-8", "surrogatepass")) for t in texts], c.count(texts)]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    out = map_texts(df, text_col, keep if keep is not None else ["doc_id"], fields, make)
    return out.select(*[c for c in out.columns if c.lower() != "over_limit"], (F.col("n_tokens") > limit).alias("over_limit"))
