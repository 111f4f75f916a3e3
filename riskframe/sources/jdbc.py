"""Relational source and sink. Connection settings come only from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    split_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 16,
) -> DataFrame:
    """Read a table; with a split column each task reads its own range of it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if split_column and bounds:
        reader = (
            reader.option("partitionColumn", split_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def write_table(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    mode: str = "append",
    connections: int = 16,
    batch_rows: int = 10_000,
) -> None:
    """Write in batches over ``connections`` connections.

    A repartition rather than a coalesce, which would also squeeze the stages
    that compute the rows into that few tasks.
    """
    writer = (
        df.repartition(connections)
        .write.format("jdbc")
        .mode(mode)
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", batch_rows)
    )
    for key, value in (properties or {}).items():
        writer = writer.option(key, value)
    writer.save()
