"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node in the columns a and b of ``links``; the component is its smallest node.

    Each round points every node at the smallest of itself and its neighbours
    and contracts the links along these pointers; a star takes one round, a
    path a logarithmic number.  Null ends are left out.  The plan of ``links`` runs
    once.
    """
    links = cut_lineage(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))
    state = cut_lineage(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    links = cut_lineage(links.where("a != b").distinct())
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = cut_lineage(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")).where("to != a"))
        low = lambda column, df: df.join(down.withColumnRenamed("a", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")
        state = cut_lineage(low("component", state).select("node", "component"))
        links = cut_lineage(low("b", low("a", links)).where("a != b").select("a", "b").distinct())
    return state
