"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.shared import written


def relabelled(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """df with column replaced by its label (node, comp), where it has one."""
    own = labels.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    joined = df.join(own, df[column] == own["_node"], "left")
    return joined.withColumn(column, F.coalesce("_comp", column)).drop("_node", "_comp")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b): one comp for all nodes that are connected.

    Every step hooks each node to the smallest of its neighbours and itself, follows the hooks to
    their ends by pointer jumping, and contracts the links to what is left between different
    ends. Labels only fall, so hooks make no circles. A chain of n hooks takes log n jumps; a node
    that hooks to none has, after a step, only neighbours that are smaller, so every other step
    halves the nodes that have links. Links and labels are written between steps. Nodes without
    links are not in the result.
    """
    edges = written(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges"
    )
    steps = []
    while True:
        up = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
        labels = followed(written(up, "hooks"))
        steps.append(labels)
        edges = written(relabelled(relabelled(edges, "a", labels), "b", labels).where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            break
    found = steps[0]
    for labels in steps[1:]:
        found = relabelled(found, "comp", labels)
    return found if len(steps) == 1 else written(found, "labels")


def followed(labels: DataFrame) -> DataFrame:
    """labels (node, comp) with comp at the end of its chain: each jump doubles how far a label sees."""
    while True:
        once = labels.withColumn("before", F.col("comp"))
        labels = written(relabelled(once, "comp", labels), "labels")
        moved = labels.where("comp <> before")
        labels = labels.select("node", "comp")
        if moved.isEmpty():
            return labels
