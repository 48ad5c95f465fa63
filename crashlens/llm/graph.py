"""Connected components of links, as joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``links`` (a long, b long); a component is named by its smallest id.

    Each round takes the smallest label among an id and its neighbours, then the label of that label, so paths halve. A
    round reads and writes tables; ids, labels and links never meet on the driver, which sees the number of changes.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), f"{name}-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        next_label = labels.select(F.col("id").alias("at"), F.col("label").alias("then"))
        jumped = lower.join(next_label, F.col("label") == F.col("at"), "left").select(
            "id", "was", F.least("label", F.coalesce("then", "label")).alias("label")
        )
        rounds = stored(jumped, f"{name}-labels")
        if rounds.where("label <> was").isEmpty():
            return rounds.select("id", F.col("label").alias("component"))
        labels = rounds.select("id", "label")
