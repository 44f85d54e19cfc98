"""Tables that the queries begin with, as DataFrames and, written apart from them, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelight.functions.vocabularies import CORPUS_THEMES
from panelight.operators.themes import theme_counts

KEYS = ["doc_id", "ticker", "year", "sector", "side"]
THEME_IDS = [t.id for t in CORPUS_THEMES]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, path: str) -> DataFrame:
    """Rows of a table of fewer files than cores, dealt over the cores: a file of one row group is else read by one task.

    The number of files comes from the file system's own summary; larger tables are left as they lie.
    """
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getFileCount()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if files < cores else df


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a panel: the source is the ticker, the year 2016 + doc_id modulo 9; blocks of 20 ids are the two sides by turns."""
    x = spread(read(spark, d, "documents").select("doc_id", "source", "text"), f"{d}/documents.parquet")
    sector = F.concat(F.lit("sector"), (F.substring("source", 4, 10).cast("int") % 5).cast("string"))
    return x.select("doc_id", F.col("source").alias("ticker"), (2016 + F.col("doc_id") % 9).cast("int").alias("year"), sector.alias("sector"), (F.floor(F.col("doc_id") / 20) % 2).alias("side"), "text")


OBS = """obs AS (SELECT doc_id, source AS ticker, cast(2016 + doc_id % 9 AS INTEGER) AS year,
 'sector' || cast(cast(substr(source, 4) AS INTEGER) % 5 AS VARCHAR) AS sector, cast(floor(doc_id / 20) AS BIGINT) % 2 AS side, text FROM documents)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    return theme_counts(observations(spark, d), KEYS, CORPUS_THEMES)


TOKEN_SQL = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"


def _count_sql(phrase: str) -> str:
    return r"len(regexp_extract_all(z, '(?i)\b" + phrase.replace(" ", r"\s+") + r"\b'))"


COUNTS = (
    "plain AS MATERIALIZED (SELECT doc_id, ticker, year, sector, side, cast(len(regexp_extract_all(coalesce(text, ''), '" + TOKEN_SQL + "')) AS BIGINT) AS n_words, regexp_replace(coalesce(text, ''), '[À-ÖØ-öø-ɏ]', 'z', 'g') AS z FROM obs),\n"
    "counts AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, ticker, year, sector, side, n_words, '{t.id}' AS theme, cast({' + '.join(map(_count_sql, t.phrases))} AS BIGINT) AS cnt FROM plain" for t in CORPUS_THEMES) + ")"
)
RATE = "CASE WHEN n_words > 0 THEN 10000 * cast(cnt AS DOUBLE) / n_words ELSE 0e0 END"


def sparse(df: DataFrame) -> DataFrame:
    """One document of each ticker and year, the least id, and gaps: some cells are left out."""
    from panelight.operators.selection import top_of_each

    one = top_of_each(df, ["ticker", "year"], ["doc_id"], 1, "__n").drop("__n")
    return one.filter((F.substring("ticker", 4, 10).cast("int") + F.col("year")) % 4 != 0)


SPARSE = "sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY doc_id) AS n1 FROM obs) WHERE n1 = 1 AND (cast(substr(ticker, 4) AS INTEGER) + year) % 4 <> 0)"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Customers as scored rows: ticker, year (the nation), sector (the segment), x (balance) and y (largest order; null for every sixth customer)."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_nationkey").alias("year"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("x"))
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.when(F.col("o_custkey") % 6 != 0, F.max("o_totalprice")).alias("y"), F.count("*").alias("n_orders"))
    return c.join(o, "ticker", "left")


METRICS = """metrics AS MATERIALIZED (SELECT c_custkey AS ticker, c_nationkey AS year, c_mktsegment AS sector, c_acctbal AS x, y, n_orders FROM customer
 LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey % 6 <> 0 THEN max(o_totalprice) END AS y, count(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey)"""


def sides(spark: SparkSession, d: str) -> DataFrame:
    """ticker, year, sector, both sides' counts as arrays in the order of the themes, and statuses: every seventh cell of a side is not there."""
    c = counts(spark, d).groupBy("ticker", "year", "theme").agg(F.min("sector").alias("sector"), F.sum(F.when(F.col("side") == 0, F.col("cnt")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("cnt")).otherwise(0)).alias("b"))
    one = lambda x: F.array(*[F.sum(F.when(F.col("theme") == t, F.col(x)).otherwise(0)) for t in THEME_IDS])
    rows = c.groupBy("ticker", "year").agg(F.min("sector").alias("sector"), one("a").alias("stated"), one("b").alias("disclosure"))
    n = F.substring("ticker", 4, 10).cast("int") + F.col("year")
    return rows.withColumns({"observation_status": F.when(n % 7 == 0, "retrieval_failed").otherwise("usable"), "collection_status": F.when(n % 7 <= 1, "missing").otherwise("collected")})


SIDES = """sides AS MATERIALIZED (SELECT *, CASE WHEN (cast(substr(ticker, 4) AS INTEGER) + year) % 7 = 0 THEN 'retrieval_failed' ELSE 'usable' END AS s1,
 CASE WHEN (cast(substr(ticker, 4) AS INTEGER) + year) % 7 <= 1 THEN 'missing' ELSE 'collected' END AS s2
 FROM (SELECT ticker, year, theme, min(sector) AS sector, sum(CASE WHEN side = 0 THEN cnt ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN cnt ELSE 0 END) AS b FROM counts GROUP BY ticker, year, theme)),
totals AS (SELECT *, sum(a) OVER (PARTITION BY ticker, year) AS ta, sum(b) OVER (PARTITION BY ticker, year) AS tb FROM sides),
idx AS MATERIALIZED (SELECT ticker, year, min(sector) AS sector, min(ta) AS ta, min(tb) AS tb,
 CASE WHEN min(s1) <> 'usable' AND min(s2) <> 'collected' THEN 'missing_both' WHEN min(s1) <> 'usable' THEN 'missing_part1' WHEN min(s2) <> 'collected' THEN 'missing_part2'
  WHEN min(ta) = 0 THEN 'insufficient_stated_theme_signal' WHEN min(tb) = 0 THEN 'insufficient_disclosure_theme_signal' ELSE 'scored' END AS score_status,
 round(100 * sum(least(a * 1e0 / nullif(ta, 0), b * 1e0 / nullif(tb, 0))), 6) AS overlap,
 round(100 * sum(a * 1e0 * b) / nullif(sqrt(sum(a * 1e0 * a)) * sqrt(sum(b * 1e0 * b)), 0), 6) AS cosine,
 round(100 * (1 - sum(abs(a * 1e0 / nullif(ta, 0) - b * 1e0 / nullif(tb, 0))) / 2), 6) AS l1,
 round(100e0 * sum(CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a > 0 OR b > 0 THEN 1 ELSE 0 END), 0), 6) AS jaccard FROM totals GROUP BY ticker, year)"""


def with_tables(sql: str, *tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + sql
