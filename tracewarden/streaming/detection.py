"""Alerts over an unbounded log: each micro-batch re-examines the users and devices it touches.

Rules need whole timelines in time order, which count-bounded state can't promise when
events come late. So the stream keeps the events twice, in buckets of users and of devices,
and each batch reads the buckets that it touches, no others, runs the batch rules on the
timelines of its users (and, for the rules of devices, its devices) and logs what changes:
alerts that are new, and alerts that a late event has made untrue. `current_alerts` nets the
log; at any time it gives what the batch rules give for all events so far, devices by time.
A batch costs what the touched buckets hold; their number is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewarden.operators.rules import ALERT, ON_DEVICES, RULES, detect
from tracewarden.schema import DEFAULTS, EVENTS, Thresholds

# a late event may change an alert's place among those of its event (LONG_SESSION at a logout) and nothing else, so all columns name it
KEY = list(ALERT)
ON_USERS = tuple(r for r in RULES if r not in ON_DEVICES)
LAYOUTS = {"user_id": ON_USERS, "device_id": ON_DEVICES}
_PARTITIONS = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
STORED = T.StructType(EVENTS.fields + _PARTITIONS)
CHANGES = T.StructType([T.StructField(c, T.LongType() if c in ("seq", "timestamp") else T.IntegerType() if c in ("rule_ord", "fire_no") else T.StringType()) for c in ALERT] + [T.StructField("change", T.IntegerType())] + _PARTITIONS)


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def standing(changes: DataFrame) -> DataFrame:
    """The alerts that stand after all changes."""
    return changes.groupBy(*ALERT).agg(F.sum("change").alias("n")).filter("n > 0").select(*ALERT)


def current_alerts(spark: SparkSession, alerts_path: str) -> DataFrame:
    """All alerts that stand."""
    found = [standing(_table(spark, f"{alerts_path}/{key}", CHANGES)) for key in LAYOUTS]
    return found[0].unionByName(found[1])


def watch(stream: DataFrame, events_path: str, alerts_path: str, checkpoint: str, t: Thresholds = DEFAULTS, buckets: int = 64, **trigger) -> StreamingQuery:
    """Starts the query. A batch that runs again after a failure overwrites what it wrote, so rows come once."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*EVENTS.names).persist()
        for key, rules in LAYOUTS.items():
            bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
            touched = rows.select(key).distinct()
            # at most `buckets` numbers
            which = [r["b"] for r in touched.select(bucket.alias("b")).distinct().collect()]
            rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{events_path}/{key}/batch={number}")
            history = _table(spark, f"{events_path}/{key}", STORED).filter(F.col("bucket").isin(which))
            history = history.join(touched, key, "left_semi").select(*EVENTS.names)
            now = detect(history, t, "time", only=rules)
            before = _table(spark, f"{alerts_path}/{key}", CHANGES).filter(F.col("bucket").isin(which) & (F.col("batch") < number))
            before = standing(before.join(touched, key, "left_semi"))
            new = now.join(before.select(*KEY), KEY, "left_anti").select(*ALERT, F.lit(1).alias("change"))
            gone = before.join(now.select(*KEY), KEY, "left_anti").select(*ALERT, F.lit(-1).alias("change"))
            new.unionByName(gone).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{alerts_path}/{key}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
