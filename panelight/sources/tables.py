"""Tables of the panel: typed scans of CSV, JSON, JSON lines and text files, and their writers.

Paths are whatever Spark's file systems can open.  A missing path of an
optional table is an empty table with the declared schema.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelight.functions import urls
from panelight.functions.text import stripped
from panelight.sources.schemas import CANDIDATE, COMPANY, EVENT, EVIDENCE, SEMANTIC, TARGET


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV with every column a string, as it stands in the file: quoted line breaks, fields of any length, "" for empty ones."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return empty(spark, schema)
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, multiLine=True, escape='"', maxCharsPerColumn=-1, mode="FAILFAST", emptyValue="", nullValue="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of strings to those of ``schema``; "" and what can't be read is null."""
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return typed(read_strings(spark, path, schema.names), schema)


def items(column: Column | str, separator: str = ";") -> Column:
    """The trimmed, non-empty parts of a list in one column."""
    c = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return F.filter(F.transform(F.split(c, separator), stripped), lambda x: x != "")


def companies(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: one company a row, its domains as a list, rows without a ticker left out."""
    df = _scan(spark, path, COMPANY)
    df = df.select(*[F.trim(c).alias(c) for c in COMPANY.names])
    return df.withColumn("known_historical_domains", items("known_historical_domains")).filter(F.coalesce("ticker", F.lit("")) != "")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pages with their normalised URL; 2016 to 2024 where no years are given.  A URL that can't be read is an error."""
    df = _scan(spark, path, CANDIDATE)
    url = urls.normalised("candidate_url")
    checked = F.when(url.isNull(), F.raise_error(F.concat(F.lit("candidate_url can't be read: "), F.coalesce("candidate_url", F.lit(""))))).otherwise(url)
    return df.withColumns({"normalized_url": checked, "valid_from_year": F.coalesce("valid_from_year", F.lit(2016)), "valid_to_year": F.coalesce("valid_to_year", F.lit(2024))}).orderBy("ticker", "candidate_url")


def targets(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, TARGET).orderBy("ticker", "year")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Progress events of JSON lines; blank lines are skipped, a missing log has none."""
    if not exists(spark, path):
        return empty(spark, EVENT)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def cache_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents, one a file, by a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else empty(spark, schema)


def split_by_status(df: DataFrame, metrics: T.DataType | None = None) -> tuple[DataFrame, DataFrame]:
    """(collected rows with their JSON columns decoded, other rows): two filters of one scan."""
    got = F.coalesce(F.col("collection_status") == "collected", F.lit(False))
    decoded = df.filter(got).withColumn("theme_evidence", F.from_json("theme_evidence", EVIDENCE))
    if metrics is not None:
        decoded = decoded.withColumn("linguistic_metrics", F.from_json("linguistic_metrics", metrics))
    return decoded, df.filter(~got)


def last_counts(evidence: Column | str, ids: Sequence[str]) -> Column:
    """Counts by theme of decoded evidence as a map; of repeats the last counts."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    one = lambda t: F.coalesce(F.try_element_at(F.filter(e, lambda x: x["theme_id"] == t), F.lit(-1))["match_count"].try_cast("long"), F.lit(0).cast("long"))
    return F.create_map(*[x for t in ids for x in (F.lit(t), one(t))])


def with_sidecars(df: DataFrame, folder: str, path_col: str = "text_path", into: str = "sidecar_text") -> DataFrame:
    """Adds the whole text of the file that ``path_col`` names below ``folder``; "" where there is none."""
    spark = df.sparkSession
    if not exists(spark, folder):
        return df.withColumn(into, F.lit(""))
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    named = files.select(F.col("value").alias("__v"), F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/+", "/")).alias("__p"))
    base = folder.rstrip("/")
    base = base.split("://", 1)[-1] if "://" in base else base
    base = base if base.startswith("/") else "/" + base.split("/", 1)[-1]
    wanted = F.concat(F.lit(base + "/"), F.regexp_replace(F.coalesce(path_col, F.lit("")), "^/+", ""))
    return df.withColumn("__w", wanted).join(named, F.col("__w") == F.col("__p"), "left").select(*df.columns, F.coalesce("__v", F.lit("")).alias(into))


def with_text(df: DataFrame, full: DataFrame, sidecar: str | None = None, key: Sequence[str] = ("ticker", "year"), text: str = "page_text_clean") -> DataFrame:
    """Adds the text of the full table, else that of the sidecar column, else ""."""
    joined = df.join(full.select(*key, F.col(text).alias("__t")), list(key), "left")
    other = F.col(sidecar) if sidecar else F.lit("")
    return joined.select(*[c for c in df.columns if c != text], F.coalesce(F.nullif("__t", F.lit("")), other, F.lit("")).alias(text))


def semantic(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, SEMANTIC)


# Writers


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence[str] = (), single: bool = False) -> None:
    """A CSV of the named columns in their order, others left out; sorted by ``order`` over all files, which ``single`` joins to one.

    A table without a row has its header in one file.
    """
    out = df.select(*columns) if columns else df
    out = out.orderBy(*order) if order else out
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").csv(path, header=True, escape='"', lineSep="\n", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def compact(df: DataFrame, texts: Sequence[str] = ("page_text_clean",)) -> DataFrame:
    """The table without its long texts."""
    return df.drop(*texts)


def download_log(results: DataFrame) -> DataFrame:
    return results.select(*[c for c in ("ticker", "year", "collection_status", "sec_archive_url", "raw_file_path", "raw_file_bytes", "raw_content_sha256") if c in results.columns])


def extraction_log(results: DataFrame) -> DataFrame:
    return results.select(*[c for c in ("ticker", "year", "collection_status", "extraction_quality", "word_count", "sentence_count", "clean_text_sha256") if c in results.columns])


def review_queue(results: DataFrame) -> DataFrame:
    """What a person should look at: rows that weren't collected, with the reason."""
    return results.filter(~F.coalesce(F.col("collection_status") == "collected", F.lit(False))).select("ticker", "year", "collection_status", F.coalesce(F.nullif(F.trim("gap_reason"), F.lit("")), F.lit("sample_for_quality_review")).alias("review_reason"))


def document(payload: Mapping[str, object]) -> str:
    """A JSON document with sorted keys."""
    return json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False, default=str)


def write_document(spark: SparkSession, payload: Mapping[str, object], path: str) -> None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True)
    stream.write(bytearray(document(payload).encode()))
    stream.close()


def append_events(rows: DataFrame, log: str, state: str | None = None) -> None:
    """Appends events as JSON lines; ``state`` is overwritten with the latest one, so a reader finds it without the log."""
    rows.write.mode("append").json(log)
    if state:
        rows.orderBy(F.desc("timestamp")).limit(1).coalesce(1).write.mode("overwrite").json(state)


def _cells(df: DataFrame, rows: int, digits: int) -> list[list[str]]:
    """At most ``rows`` rows for a printed table."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return [[show(v) for v in r] for r in df.limit(rows).collect()]


def markdown(df: DataFrame, rows: int = 50, digits: int = 3) -> str:
    """A printed table of the first rows; a report, not a sink."""
    body = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in _cells(df, rows, digits)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *body])


def latex(df: DataFrame, caption: str = "", rows: int = 50, digits: int = 3) -> str:
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    safe = lambda s: "".join(special.get(c, c) for c in s)
    lines = [" & ".join(map(safe, r)) + r" \\" for r in [df.columns, *_cells(df, rows, digits)]]
    return "\n".join([r"\begin{table}", rf"\caption{{{safe(caption)}}}", r"\begin{tabular}{" + "l" * len(df.columns) + "}", lines[0], r"\hline", *lines[1:], r"\end{tabular}", r"\end{table}"])


def write_vectors(df: DataFrame, path: str, id_col: str, vector: str) -> DataFrame:
    """Vectors as Parquet, and the SHA-256 of each row's vector (id, sha256)."""
    out = df.select(id_col, F.col(vector).cast("array<float>").alias(vector))
    out.write.mode("overwrite").parquet(path)
    return out.select(id_col, F.sha2(F.array_join(F.col(vector).cast("array<string>"), ","), 256).alias("sha256"))


# Filing lists


def ticker_ciks(spark: SparkSession, path: str) -> DataFrame:
    """ticker (normal form) and cik (10 digits) of a JSON document of numbered companies; of repeats the first by name stays."""
    from panelight.functions.text import normal_ticker

    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))).alias("c"))
    return rows.select(normal_ticker(F.col("c.ticker")).alias("ticker"), F.lpad(F.col("c.cik_str").cast("string"), 10, "0").alias("cik")).groupBy("ticker").agg(F.min("cik").alias("cik"))


def submission_rows(pages: Sequence[DataFrame], columns: str = "columns") -> DataFrame:
    """Filing rows of the recent page and of older ones, each a struct of parallel arrays; columns that a page lacks are null."""
    from functools import reduce

    from panelight.operators.captures import columnar_rows

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [columnar_rows(p, columns) for p in pages])


def smoke_subset(df: DataFrame, tickers: Sequence[str] | None = None, rows: int | None = None, order: Sequence[str] = ("ticker", "year")) -> DataFrame:
    """The rows of some tickers, or the first ones in order: for trying a run out, never for its results."""
    some = df.filter(F.col("ticker").isin(*tickers)) if tickers else df
    return some if rows is None else some.orderBy(*order).limit(rows)
