"""Sinks and the runs that drain a stream into them."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.scale import latest_by, previous_value
from riskframe.session import prepare, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def stream_conf(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Settings a stateful query reads when it starts.

    The number of state partitions is fixed for the life of a checkpoint: on a
    cluster set it from the expected state size.
    """
    prepare(spark)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is None and spark.sparkContext.master.startswith("local"):
        partitions = 4
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain_to_files(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Process everything available into parquet files (append mode) and read them back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    with stream_conf(spark, partitions):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    mode: str = "append",
    checkpoint: str | None = None,
    partitions: int | None = None,
) -> None:
    """Process everything available, handing each micro-batch to ``handle(frame, batch_id)``."""
    spark = stream.sparkSession
    with stream_conf(spark, partitions):
        query = (
            stream.writeStream.foreachBatch(handle)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


# ---- upsert log ---------------------------------------------------------------------------


def upsert_sink(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Keep the last row per key across batches.

    Each batch writes its own reduced rows under its batch id, replacing
    whatever an earlier attempt of that batch wrote; readers merge. A batch
    never rewrites the table.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest_by(batch, list(keys), list(order)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def read_upserted(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The merged table: the last row per key over all batches."""
    log = spark.read.schema(schema).parquet(f"{path}/batch_id=*")
    return latest_by(log.select(*schema.names), list(keys), list(order))


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], out: str) -> None:
    """Write the merged table as the first batch of a new log."""
    read_upserted(spark, path, schema, keys, order).write.mode("overwrite").parquet(f"{out}/batch_id=-1")


# ---- new keys only ----------------------------------------------------------------------------


def dedup_sink(path: str, schema: T.StructType, key: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Store each key once, at its first row, however long ago that was.

    A batch is reduced to one row per key before the shuffle, then compared with
    the stored keys; a retried batch ignores what its own earlier attempt wrote.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = latest_by(batch.select(*schema.names), [key], list(order), first=True)
        if batch_id > 0:
            stored = spark.read.schema(schema).parquet(*[f"{path}/batch_id={i}" for i in range(batch_id)])
            first = first.join(stored.select(key), key, "left_anti").select(*schema.names)
        first.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


# ---- change feed ------------------------------------------------------------------------------

SNAPSHOT_EVERY = 20


def earlier_state(batch_id: int, every: int) -> list[int]:
    """The batches that hold the state before ``batch_id``: the last snapshot and what followed."""
    return list(range((batch_id - 1) // every * every, batch_id)) if batch_id > 0 else []


def change_feed_sink(
    path: str, state: str, schema: T.StructType, key: str = "symbol", every: int = SNAPSHOT_EVERY
) -> Callable[[DataFrame, int], None]:
    """Previous and new score of every update.

    Inside a batch the previous row comes from the batch, cut into hours so that
    no symbol is sorted as a whole; a symbol's first row takes it from the last
    rows that earlier batches left. A batch leaves its own last rows, and every
    ``every``-th batch those of all symbols, so a batch reads a bounded number
    of earlier ones. Both outputs are written under the batch id.
    """
    order = ["ts", "event_id"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*schema.names)
        last = latest_by(rows, [key], order)
        feed = rows.withColumn("_new", F.lit(True))
        earlier = earlier_state(batch_id, every)
        if earlier:
            held = spark.read.schema(schema).parquet(*[f"{state}/batch_id={i}" for i in earlier])
            held = latest_by(held, [key], order)
            known = held.join(rows.select(key).distinct(), key, "left_semi").select(*schema.names)
            feed = feed.unionByName(known.withColumn("_new", F.lit(False)))
            if batch_id % every == 0:
                last = latest_by(held.select(*schema.names).unionByName(last), [key], order)
        hour = F.date_trunc("hour", "ts")
        fed = previous_value(feed, [key], hour, order, {"risk_score": "prev_score"}).where("_new").drop("_new")
        fed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        last.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return handle
