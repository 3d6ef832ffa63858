"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import discard, shuffles_removed, staged


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (a, b).

    Every round is two aggregations with map-side partial results and two joins, which Spark may split where a node
    has many edges; its outcome is written to the shared folder, where only the last one stays. The number of edges never grows. Loops, repeated
    edges and nulls add nothing.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "edges")
        discard(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = staged(small, "edges")
        discard(large)
        with shuffles_removed(now.sparkSession):
            new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = staged(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own), "components")
    discard(now)
    return found
