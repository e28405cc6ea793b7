"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star steps: every step links vertices to the
smallest neighbour, so stars and chains shrink fast; the per-vertex minima are
partial aggregates, and joins back to the edges are shuffle joins that adaptive
execution can split where one vertex has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex of the edges; component is the smallest vertex reachable.

    The rounds end when the edges no longer change, however many that takes.
    Loops and edges with a null end are left out; an empty table has no vertices.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = materialize(e)
    state = None
    while True:
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = materialize(small.where("u > v").distinct())
    tops = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().join(tops.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return tops.unionAll(roots)
