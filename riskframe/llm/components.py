"""Connected components of links, by label propagation with shortcuts over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of the links (a, b); the label is the smallest id reachable.

    Each round takes the smallest label of the neighbours, combined in the map tasks, and then the label of the label,
    which halves the distance to the smallest id. The loop ends when no label changes.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = written(lower, "labels")
        roots = lower.select(F.col("id").alias("root"), F.col("label").alias("root_label"))
        jumped = lower.join(roots, lower["label"] == roots["root"]).select(
            "id", F.least("label", "root_label").alias("label"), (F.least("label", "root_label") < F.col("was")).alias("moved")
        )
        jumped = written(jumped, "labels")
        labels = jumped.select("id", "label")
        if jumped.where("moved").isEmpty():
            return labels
