"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node that can be reached.

    Edges have long columns a and b; loops and repeats do no harm. Each round points every node at
    its smallest neighbour, follows the pointers once more and contracts the edges to what they
    point at, so stars end after one round and paths shrink by half at least. Sums by node combine
    on the map side, and the joins on a hub are plain joins that Spark can split. Nothing goes to
    the driver but whether edges are left.
    """
    edges = materialize(edges.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a < b").distinct(), "edges")
    found = None
    while True:
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).selectExpr("node", "least(node, low) as parent")
        point = materialize(point, "pointers")
        up = point.selectExpr("node as up", "parent as above")
        jump = point.join(up, point["parent"] == up["up"], "left").selectExpr("node", "coalesce(above, parent) as parent")
        jump = materialize(jump, "jumped")
        pa, pb = jump.selectExpr("node as a", "parent as pa"), jump.selectExpr("node as b", "parent as pb")
        left = edges.join(pa, "a").join(pb, "b").where("pa <> pb").selectExpr("least(pa, pb) as a", "greatest(pa, pb) as b").distinct()
        if found is None:
            found = jump.withColumnRenamed("parent", "root")
        else:
            step = jump.selectExpr("node as root", "parent")
            found = found.join(step, "root", "left").selectExpr("node", "coalesce(parent, root) as root")
        edges = materialize(left, "edges")
        if edges.isEmpty():
            return found
        found = materialize(found, "found")
