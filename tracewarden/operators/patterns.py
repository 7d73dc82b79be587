"""Building blocks of rules and rankings: hits that re-arm, places in the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The coded columns in the order in which a row's values enter the dictionary.
CODED = ("user_id", "device_id", "app_id", "resource_id")


def greedy_gap(hits: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Of the hits (number `_i`, in run `_run`) of each key, in order: the first, then always the first at least `gap` rows later.

    Consecutive hits form runs, inside which every gap-th is taken, so only runs matter. Runs
    less than a gap apart form islands, each folded alone: the first hit of an island is taken
    whatever came before. What is gathered is an island's runs, not its rows. The gap is the
    same in all rows of a key.
    """
    runs = hits.groupBy(*keys, "_run").agg(F.min("_i").alias("s"), F.max("_i").alias("e"), F.min(gap).alias("k"))
    r = Window.partitionBy(*keys).orderBy("s")
    fresh = (F.col("s") - F.lag("e").over(r)) >= F.col("k")
    runs = runs.withColumn("_island", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(r))
    islands = runs.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(F.struct("s", "e", "_run", "k"))).alias("runs"))

    def fold(acc: Column, run: Column) -> Column:
        at = F.greatest(run["s"], acc["next"])
        some = at <= run["e"]
        after = at + (F.floor((run["e"] - at) / run["k"]).cast("long") + 1) * run["k"]
        return F.struct(
            F.when(some, after).otherwise(acc["next"]).alias("next"),
            F.when(some, F.concat(acc["out"], F.array(F.struct(run["_run"].alias("_run"), at.alias("_at"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<_run:bigint,_at:bigint>>").alias("out"))
    taken = islands.select(*keys, F.explode(F.aggregate("runs", start, fold, lambda acc: acc["out"])).alias("t")).select(*keys, "t._run", "t._at")
    out = hits.join(taken, [*keys, "_run"])
    return out.filter((F.col("_i") >= F.col("_at")) & ((F.col("_i") - F.col("_at")) % F.col(gap) == 0)).drop("_run", "_at")


def entries(events: DataFrame) -> DataFrame:
    """(value, at, k): every value of the coded columns with its place in the log and its column."""
    each = [F.struct(F.col(c).alias("value"), (F.col("seq") * 4 + k).alias("at"), F.lit(k).alias("k")) for k, c in enumerate(CODED)]
    return events.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def dictionary_places(events: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): where each of the column's values first appeared, in any coded column.

    One dictionary serves all four columns, so a resource named like an earlier user has the
    place of that user. Orders values as the dictionary filled in file order numbers them.
    """
    own = F.max(F.when(F.col("k") == CODED.index(column), True)).alias("own")
    return entries(events).groupBy("value").agg(F.min("at").alias(name), own).filter("own").select(F.col("value").alias(column), name)
