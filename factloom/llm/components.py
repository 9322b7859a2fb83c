"""Connected components of a graph given by its edges, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (columns ``a`` and ``b``).

    The component is its smallest id.  Every round lowers each label to the
    smallest one among the neighbours, then to the label of that label, so
    paths shorten by half; minima are combined before each shuffle, and each
    round is written to the shared folder.  NULL ends and loops are ignored;
    without edges the result is empty.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    links = saved(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = links.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("component")
    )
    labels = saved(labels, "labels")
    while True:
        near = links.join(labels, links["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select(
            "id", "component", F.least("component", "near").alias("fresh")
        )
        roots = labels.select(F.col("id").alias("root"), F.col("component").alias("above"))
        fresh = saved(
            lower.join(roots, lower["fresh"] == roots["root"], "left").select(
                "id", F.least("fresh", "above").alias("component"), F.col("component").alias("before")
            ),
            "labels",
        )
        labels = fresh.select("id", "component")
        if fresh.where("component < before").isEmpty():
            return labels
