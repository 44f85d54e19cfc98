"""Reading tables, bounded Arrow batches and column helpers shared by the operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.sources.shared import checkpoint, forget, shared_folder  # noqa: F401

#: Text bytes handled at once in a Python worker; a longer single text is a batch of its own.
BATCH_BYTES = 1 << 20

#: ASCII lower-casing only: other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; read by Spark, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def slices(batch: pa.RecordBatch | pa.Array, column: str | None = None, limit: int = BATCH_BYTES) -> Iterator:
    """Cuts a batch (or an array of texts) so that the texts of each part have about ``limit`` bytes."""
    texts = batch if column is None else batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Returns a Python worker's unused memory to the machine: workers wait for later stages beside a JVM that needs it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``keep`` columns of ``df`` and the columns that a Python function computes from its texts.

    ``make()`` is called once a task and gives the function, which goes when the task ends: a list of texts
    (null is "") to one sequence for each of ``fields``.  Only the texts go to Python and
    only the computed columns come back.  A kept column whose name equals a
    computed one (names compare without case) gives way to it.
    """
    new = {f.name.lower() for f in fields}
    kept = [F.col(f"`{c}`") for c in keep if c.lower() not in new]
    schema = T.StructType(fields)

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, f = to_arrow_schema(schema), make()
        for batch in batches:
            for part in slices(batch):
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in zip(f(part.to_pylist()), target, strict=True)]
                yield pa.StructArray.from_arrays([x if x.type == t.type else x.cast(t.type) for x, t in zip(made, target)], fields=list(target))
            give_back()
            if not len(batch):
                yield pa.StructArray.from_arrays([pa.array([], type=t.type) for t in target], fields=list(target))
        f = batch = part = made = None  # the worker waits for other tasks without them
        gc.collect()
        give_back()

    # not repeated or moved by the optimiser: each text is computed once
    made = run.asNondeterministic()(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return df.select(*kept, made.alias("__made")).select(*kept, "__made.*")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as decimal text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def bounded_sample(df: DataFrame, key: str, n: int, salt: int = 17) -> DataFrame:
    """``n`` rows at most, the same ones on every run: those with the least hash of ``key``."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.col(key)).limit(n)
