"""Connected components of a link table by joins: hook to the smallest neighbour, shorten, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspan.llm.common import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame | None:
    """(node, component) for every node of the links (a, b): the smallest node it reaches. None without links.

    In a round every node hooks to its smallest neighbour, if that is smaller, chains
    are shortened by pointer jumping, and the links are contracted to the roots. A
    round leaves at most half of the nodes that still have links, so their number is
    logarithmic; neighbours are only ever reduced to a minimum, never listed. Links of
    a node with itself and links with a null are ignored; repeats do no harm. Every
    table is written to the shared folder, so a lost executor costs one step.
    """
    edges = stages.keep(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parent = stages.keep(parent.select("node", F.least("node", "least").alias("root"), F.lit(True).alias("moved")), "parent")
        while not parent.where("moved").isEmpty():
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = parent.select("node", "root").join(up, "root")
            parent = stages.keep(jumped.select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parent")
        parent = parent.select("node", "root")
        if labels is None:
            labels = stages.keep(parent.withColumnRenamed("root", "component"), "labels")
        else:
            onward = parent.withColumnsRenamed({"node": "component", "root": "next"})
            labels = labels.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            labels = stages.keep(labels, "labels")
        of_a = parent.withColumnsRenamed({"node": "a", "root": "root_a"})
        of_b = parent.withColumnsRenamed({"node": "b", "root": "root_b"})
        contracted = edges.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        edges = stages.keep(contracted.where("a <> b").distinct(), "edges")
    stages.drop("edges", "parent")
    return labels
