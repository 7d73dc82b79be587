"""A seeded synthetic access log with planted attacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.ordering import with_position
from tracewarden.schema import EVENT_TYPES, FIELDS, LOCATIONS

# Weights of the event types and of the locations, in their order above.
EVENT_WEIGHTS = (10, 5, 20, 40, 5, 10, 8, 2)
LOCATION_WEIGHTS = (30, 20, 10, 10, 5, 5, 5, 5, 2, 2, 2, 1, 1, 1, 1)
START = 1_767_254_400  # 2026-01-01 08:00:00 UTC
PERIOD = 1_000_000  # rows between attacks


def _pick(values: tuple[str, ...], weights: tuple[int, ...], draw: Column) -> Column:
    total, out = 0, F.lit(values[-1])
    edges = []
    for v, w in zip(values, weights, strict=True):
        total += w
        edges.append((total, v))
    for edge, v in reversed(edges):
        out = F.when(draw * total < edge, v).otherwise(out)
    return out


def generate(spark: SparkSession, rows: int = 10_000_000, seed: int = 42) -> DataFrame:
    """Events in file order (seq), 1 to 5 seconds apart; every PERIOD rows three attacks follow a row.

    All draws are hashes of the seed and the row's number, so any partitioning gives the same rows.
    """

    def draw(name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1 << 30)) / (1 << 30)

    def number(name: str, most: int) -> Column:
        return (F.floor(draw(name) * most) + 1).cast("string")

    base = spark.range(rows).select(
        "id",
        F.lit(0).alias("k"),
        F.concat(F.lit("U"), F.lpad(number("user", 19_999), 5, "0")).alias("user_id"),
        F.concat(F.lit("D"), F.lpad(number("device", 4_999), 5, "0")).alias("device_id"),
        F.concat(F.lit("APP"), F.lpad(number("app", 499), 4, "0")).alias("app_id"),
        F.concat(F.lit("R"), F.lpad(number("resource", 9_999), 5, "0")).alias("resource_id"),
        _pick(EVENT_TYPES, EVENT_WEIGHTS, draw("event")).alias("event_type"),
        _pick(LOCATIONS, LOCATION_WEIGHTS, draw("place")).alias("location"),
        # the mean gap is 3 seconds; a row's own offset keeps gaps between 1 and 5
        (F.lit(START) + F.col("id") * 3 + F.floor(draw("gap") * 3) - 1).cast("long").alias("timestamp"),
    )
    night = (F.floor(F.col("timestamp") / 86_400) * 86_400 + 86_400 - 5 * 3600).cast("long")  # 02:00 at UTC+7
    at = base.filter((F.col("id") % PERIOD) == PERIOD - 1)

    def planted(first: int, n: int, **columns) -> DataFrame:
        some = at.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))
        step = F.col("k") - first
        for c, v in columns.items():
            some = some.withColumn(c, v(step) if callable(v) else v)
        return some

    attack = F.floor(F.col("id") / PERIOD)

    def text(prefix: str, each: int = 0) -> object:
        """Numbered names; `each` new ones in every attack."""
        return lambda s: F.concat(F.lit(prefix), F.lpad((attack * each + s + 1).cast("string"), 4, "0"))

    theft = planted(1, 6, event_type=F.lit("DOWNLOAD"), resource_id=text("RX"), timestamp=lambda s: night + s * 10)
    lateral = planted(7, 5, event_type=F.lit("OPEN_APP"), app_id=text("APPX"), timestamp=lambda s: F.col("timestamp") + s * 5)
    device = planted(12, 4, event_type=F.lit("LOGIN"), user_id=text("UX", 4), device_id=F.concat(F.lit("DX"), F.lpad((attack + 1).cast("string"), 4, "0")), timestamp=lambda s: F.col("timestamp") + 30 + s * 10)
    every = base.unionByName(theft).unionByName(lateral).unionByName(device)
    return with_position(every, "id", "k").select(*FIELDS, "seq")


def write_log(events: DataFrame, path: str, header: bool = True) -> None:
    """Events as lines of a log, in order; the header is the first line of each part file."""
    ordered = events.repartitionByRange("seq").sortWithinPartitions("seq").select(*FIELDS)
    ordered.write.mode("overwrite").option("header", header).option("quote", "").csv(path)
