"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.llm._io import saved


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices(id, label) and edges(a, b): each vertex with the smallest label that reaches it.

    Labels go along edges, then each label is replaced by the label of the vertex that it names, which
    halves the way that is left, until nothing changes. Every round's labels are written to the shared
    folder; joins read plain tables, so that Spark can split the partition of a vertex of many edges.
    label must be the id of a vertex of the same component; a label found in an earlier call counts as an
    edge, so that new edges join all members of both components.
    """
    known = vertices.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    edges = edges.select("a", "b").union(known)
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(vertices.select("id", "label"), "labels")
    while True:
        sent = both.join(labels.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("sent"))
        near = saved(labels.join(sent, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("sent", "label")).alias("label")), "labels-near")
        jump = near.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = saved(near.join(jump, "label", "left").select("id", F.coalesce("further", "label").alias("label"), (F.coalesce("further", "label") != F.col("old")).alias("changed")), "labels")
        labels = new.select("id", "label")
        if new.filter("changed").limit(1).count() == 0:
            return labels
