"""Small helpers of the operators in this subpackage: written steps, input tables and repartitioned scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import session

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of rows that go to a Python worker at once, however long the texts are.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that these operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return session.prepare(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; the shuffle files of the job that wrote it are removed at its end."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return session.materialise(df, name)
    finally:
        conf.set(CLEAN_UP, before)


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in gone (doc_id, row_hash), with their columns.

    A row is its ``doc_id``, null or not, together with its text: other texts of the same ``doc_id`` stay.
    """
    keys = gone.select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(keys["gone_id"]) & (row_hash(docs["text"]) == keys["gone_hash"])
    return docs.join(keys, same, "left_anti")
