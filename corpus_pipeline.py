"""A training-data pipeline over ``documents``.

Each stage takes what the one before it kept.  Null and empty texts are judged
by each stage as its operator says; repeated rows stay until near-duplicates go;
an empty table passes through.  Extra columns of ``documents`` stay to the last stage.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelight.llm import bpe, decontam, langid, neardup, quality_crf
from panelight.llm.common import crc_mod, shared_folder, table
from panelight.llm.queries import vocabulary


#: Text bytes that go to a Python worker at once while the stages run.
BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Encoded words that a task of the last stage keeps in one of two generations: some 200 bytes each, in each worker.
WORDS = 60_000


def _stage(make):
    """A stage sets the size of batches itself and leaves it so, as its rows are computed after it returned; ``run`` sets it back."""

    @wraps(make)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_CONF, BATCH)
        return make(spark, docs, sf_dir)

    return stage


def _with(docs: DataFrame, judged) -> DataFrame:
    """``docs`` packed into one column beside what ``judged`` says of its texts, filtered, and unpacked again."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").alias("__text"))
    return judged(packed).select("__doc.*")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good stay; a null text is judged as an empty one, and all stay where nothing can be learnt (score 0.5)."""
    field = quality_crf.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return _with(docs, lambda d: quality_crf.score(d, field, "__text", ["__doc"]).filter("predicted = 1"))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; texts without a letter go, also where nothing can be learnt."""
    net = langid.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return _with(docs, lambda d: langid.identify(d, net, "__text", ["__doc"]).filter(F.col("lang_pred") != langid.UNKNOWN))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the least id, of repeated rows one; texts without words and rows without an id all stay."""
    return neardup.deduplicated(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go; null and empty texts stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of what is left; a null text has no ids and decodes to ""."""
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), table=WORDS)


STAGES: list = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: SQL can't express the classifiers; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages; each one's rows are written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_CONF)
    try:
        for i, (name, stage) in enumerate(STAGES):
            at = f"{folder}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(at)
            docs = spark.read.parquet(at)
    finally:
        spark.conf.set(BATCH_CONF, before)
    return docs
