"""Session construction and the shared folder for checkpoints."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every query relies on. They are session settings, so they
# can be applied to a session the caller built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs another exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Window stages compute much per byte: keep their partitions when small.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "riskframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
            .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_conf(input_bytes: int, cores: int, target: int = 128 * 2**20, per_task_shuffle: int = 256 * 2**20) -> dict[str, str]:
    """Settings for an input of a known size.

    Adaptive execution merges small shuffle partitions but never adds any, so
    their number starts from the bytes that may be shuffled.
    """
    partitions = max(2 * cores, math.ceil(input_bytes / target))
    return {
        **RUNTIME_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(per_task_shuffle),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false" if input_bytes > 2**40 else "true",
    }


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder: on a
    cluster a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = os.path.join(tempfile.gettempdir(), f"riskframe-{os.getpid()}")
    os.makedirs(path, exist_ok=True)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
