"""Dense positions in a global order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.sources.scratch import durable


def with_position(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """df with the row's place from 0 by `order`, which must be unique.

    Rows are range-partitioned and sorted; the ranges' sizes, one number a partition, give
    each its offset. The sorted rows are written first: ranges come from samples, and two
    runs may draw them differently.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranged = durable(ranged.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "_part long, _from long")
    out = ranged.withColumn("_part", part).join(F.broadcast(table), "_part")
    return out.withColumn(name, F.col("_from") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_from", "_place")
