"""Chat formatting by token-level assembly.

Each role and each text is encoded by itself, reserved ids are spliced between
them, and the loss mask is a prefix sum over +1 and -1 marks at the ends of the
assistant's texts.  A text can't reach a reserved id: its own characters only
give ordinary ids, and control strings inside it are escaped as well, so that
the written-out form can be read back without ids.

Template of a turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
Escape: ``<|`` after which any backslashes may stand between ``<`` and ``|``
gets one backslash more; in roles, backslashes and newlines are escaped too.

Turns are dealt out by conversation, sorted within partitions and streamed, so
neither a long conversation nor many short ones are ever held as a whole.

A null text or role is empty; a null conversation id is a conversation of its
own.  Turns of equal number are ordered by role, then text; repeated rows are
repeated turns.  A conversation exists when it has a row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.llm.common import slices

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Codec:
    """Ordinary ids from a rank file; two reserved ids above them."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 2
        self.end = self.start + 1
        self.newline = self.coder.encode_ordinary("\n")

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids and loss mask of one turn."""
        encode = self.coder.encode_ordinary
        head, body = encode(escape_role(role)), encode(escape(text))
        ids = np.array([self.start, *head, *self.newline, *body, self.end, *self.newline], dtype=np.int32)
        marks = np.zeros(len(ids) + 1, dtype=np.int8)
        if role == TRAINED_ROLE:
            at = 1 + len(head) + len(self.newline)
            marks[at] += 1
            marks[at + len(body)] -= 1
        return ids, np.cumsum(marks[:-1], dtype=np.int8)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """role, text, text under the mask (all unescaped) and characters of a turn's written-out form."""
        decode = lambda x: self.coder.decode_bytes(x.tolist()).decode("utf-8", "surrogatepass")
        stop = int(np.flatnonzero(ids == self.end)[-1])
        inner, tail = decode(ids[1:stop]), decode(ids[stop + 1 :])
        role, _, text = inner.partition("\n")
        return unescape_role(role), unescape(text), unescape(decode(ids[mask.astype(bool)])), len(START) + len(inner) + len(END) + len(tail)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


SEGMENTS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType()))])


def format_turns(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """conv_id, turn, ids and mask of each turn; a conversation's turns are neighbours in order.

    Joined in this order, the ids (and masks) of a conversation are its sequence.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        c, target = codec(vocabulary, pattern), to_arrow_schema(SEGMENTS)
        for batch in batches:
            for part in slices(batch, "text"):
                made = [c.turn(r, t) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array([m[0] for m in made], target.field(2).type), pa.array([m[1] for m in made], target.field(3).type)], schema=target)

    return rows.mapInArrow(run, SEGMENTS)


DIGESTS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_loss_tokens", T.LongType())])


def digests(segments: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Reads the formatted turns back and digests each conversation, in one pass over its ordered rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        c, target = codec(vocabulary, pattern), to_arrow_schema(DIGESTS)
        now, state, done = object(), None, []

        def close():
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(target)], schema=target)
            done.clear()
            return out

        for batch in batches:
            ids, masks = batch.column("ids"), batch.column("mask")
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                x, m = ids[i].values.to_numpy(), masks[i].values.to_numpy()
                role, text, loss, chars = c.read(x, m)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += chars
                state[5] += len(x)
                state[6] += int(m.sum())
            yield flush()
        close()
        yield flush()

    return segments.mapInArrow(run, DIGESTS)


def format_digests(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    return digests(format_turns(turns, vocabulary, pattern), vocabulary, pattern)
