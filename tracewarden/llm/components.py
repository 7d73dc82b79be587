"""Connected components by alternating large-star and small-star steps.

Every step is a group-by and a join on node ids; no list of neighbours is gathered in one
task and nothing but two numbers a round comes to the driver. Nodes are longs; edges with
a null end or equal ends are ignored, repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import discard, materialise


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its v as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without an edge are absent."""
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now, "edges")
    spark = edges.sparkSession

    def summary(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    state = summary(now)
    rounds = rounds if state[0] else 0
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = materialise(small, "edges")
        discard(spark, now)
        now, before, state = after, state, summary(after)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not converge")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
