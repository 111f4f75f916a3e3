"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Read parquet, csv (with header) or json lines.

    Give a schema for csv and json: inferring one reads the data twice.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.load(path)


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append to the risk history, partitioned by date so look-backs prune."""
    df.write.mode("append").partitionBy("date").parquet(path)


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, key: str = "symbol", whole: bool = False) -> DataFrame:
    """Rows from JSON objects ``{key: {...}, ...}``.

    One object per line splits like any text file. ``whole`` reads each file as
    one object, for small artifacts written by other tools.
    """
    text = spark.read.text(path, wholetext=whole)
    entries = F.from_json("value", f"map<string, struct<{value_schema}>>")
    return text.select(F.explode(entries).alias(key, "_v")).select(key, "_v.*")


def write_keyed_json(df: DataFrame, path: str, key: str = "symbol", mode: str = "overwrite") -> None:
    """One line ``{key: {...}}`` per row."""
    rest = F.struct(*[c for c in df.columns if c != key])
    df.select(F.to_json(F.create_map(F.col(key), rest)).alias("value")).write.mode(mode).text(path)
