"""Tables written once in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where the session names none, a session on one machine (tests, a laptop) gets a
    temporary folder, and a cluster a folder in its warehouse, which is shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            import tempfile

            local = spark.sparkContext.master.startswith("local")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoint")
            made = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = made.get()
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table written once in the shared folder and read again.

    Unlike an eager ``DataFrame.checkpoint`` this computes the rows once, and later
    reads take only the columns they need.  ``forget`` deletes it.
    """
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``checkpoint`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        if at := getattr(df, "_written_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
