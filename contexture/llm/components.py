"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contexture.llm.tables import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; component is its smallest node.

    Every round renames each node to the least of itself and its neighbours. An
    edge keeps joining its renamed ends, so nothing is lost; edges whose ends
    have become one are dropped, and when none are left the names are the
    components. A star takes one round and a chain about the logarithm of its
    length. A node that many edges meet is combined on the map side, and its
    joins lie directly on their shuffles, where adaptive execution splits them.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = both.where("a <> b").unionByName(both.selectExpr("b AS a", "a AS b").where("a <> b"))
    left = written(both.distinct(), "edges")
    names: DataFrame | None = None
    while not left.isEmpty():
        least = left.groupBy("a").agg(F.min("b").alias("b"))
        least = least.select(F.col("a").alias("node"), F.least("a", "b").alias("name"))
        least = written(least, "names")
        if names is None:
            names = least
        else:
            newer = least.select(F.col("node").alias("name"), F.col("name").alias("newer"))
            names = names.join(newer, "name", "left").select(
                "node", F.coalesce("newer", "name").alias("name")
            )
            names = written(names, "names")
        ends = left.join(least.toDF("a", "left_name"), "a").join(least.toDF("b", "right_name"), "b")
        ends = ends.where("left_name <> right_name")
        left = written(ends.selectExpr("left_name AS a", "right_name AS b").distinct(), "edges")
    if names is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return names.toDF("node", "component")
