"""The scheduled refresh: steps in order, each on what arrived since the last run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Step = tuple[str, Callable[[], DataFrame | None]]

# Fixed order of the daily run.
STEPS = ["bars", "sentiment", "documents", "scores", "alerts"]


def run_steps(spark: SparkSession, steps: Sequence[Step]) -> DataFrame:
    """Run the steps in order; a failed step does not stop later ones.

    Returns one row per step: its position, whether it succeeded, the rows it
    wrote and the error. A step returns the frame it wrote, or nothing.
    """
    report = []
    for i, (name, step) in enumerate(steps):
        try:
            written = step()
            report.append((i, name, True, written.count() if written is not None else 0, None))
        except Exception as error:  # noqa: BLE001 - reported, later steps still run
            report.append((i, name, False, 0, f"{type(error).__name__}: {error}"[:500]))
    return spark.createDataFrame(report, "position int, step string, ok boolean, rows bigint, error string")
