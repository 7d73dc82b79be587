"""Reports over alerts: counts, riskiest users, emission order, CSV and text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.timeparse import epoch_text
from tracewarden.operators.patterns import dictionary_places
from tracewarden.schema import SEVERITIES
from tracewarden.sources.scratch import shared_folder


def by_type(found: DataFrame) -> DataFrame:
    """Alerts of each type that has any."""
    return found.groupBy("anomaly_type").agg(F.count("*").alias("alerts"))


def by_severity(found: DataFrame) -> DataFrame:
    """Alerts of each of the four severities, 0 included."""
    spark = found.sparkSession
    all_four = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return all_four.join(found.groupBy("severity").agg(F.count("*").alias("alerts")), "severity", "left").fillna(0, ["alerts"])


def riskiest_users(found: DataFrame, events: DataFrame, n: int = 5) -> DataFrame:
    """The n users with most alerts; ties: the one with the lower place in the dictionary."""
    counts = found.groupBy("user_id").agg(F.count("*").alias("alerts")).join(dictionary_places(events, "user_id", "place"), "user_id")
    order = [F.desc("alerts"), F.col("place")]
    top = counts.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", "user_id", "alerts")


def in_order(found: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts in the order in which one pass over the users would raise them."""
    ranked = found.join(dictionary_places(events, "user_id", "_user_rank"), "user_id")
    return ranked.orderBy("_user_rank", "timestamp", "seq", "rule_ord", "fire_no").drop("_user_rank")


def export(found: DataFrame, events: DataFrame) -> DataFrame:
    """The five columns of the CSV report, in emission order."""
    return in_order(found, events).select(epoch_text(F.col("timestamp")).alias("timestamp"), "user_id", "device_id", "anomaly_type", "severity")


CSV_HEADER = "timestamp,user_id,device_id,anomaly_type,severity"


def csv_lines(found: DataFrame, events: DataFrame) -> DataFrame:
    """The lines of the CSV report without its header, in emission order; values are written as they are."""
    return export(found, events).select(F.concat_ws(",", *CSV_HEADER.split(",")).alias("value"))


def write_csv(found: DataFrame, events: DataFrame, path: str, single_file: bool = False) -> None:
    """The report as CSV: a folder of sorted parts, each with the header, or one plain file.

    Parts are written by as many tasks as there are; for one file they are put together in
    order, a stream at a time, so no task holds the report.
    """
    spark = found.sparkSession
    if not single_file:
        export(found, events).write.mode("overwrite").option("header", True).option("quote", "\u0000").csv(path)
        return
    parts = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    csv_lines(found, events).write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    source, sink = folder.getFileSystem(conf), target.getFileSystem(conf)
    if sink.exists(target):
        sink.delete(target, True)
    out = sink.create(target)
    try:
        out.write(bytearray((CSV_HEADER + "\n").encode()))
        for at in sorted((f.getPath() for f in source.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda x: x.getName()):
            piece = source.open(at)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 16, False)
            piece.close()
    finally:
        out.close()
    source.delete(folder, True)


def report_lines(found: DataFrame, events: DataFrame) -> list[str]:
    """The report's lines: severities, types by number, riskiest users, total."""
    types = {r["anomaly_type"]: r["alerts"] for r in by_type(found).collect()}
    counts = {r["severity"]: r["alerts"] for r in by_severity(found).collect()}
    lines = ["ANOMALY REPORT", *[f"{s}: {counts[s]}" for s in SEVERITIES]]
    lines += [f"  {t}: {n}" for t, n in sorted(types.items(), key=lambda x: (-x[1], x[0]))]
    users = sorted((r["rank"], r["user_id"], r["alerts"]) for r in riskiest_users(found, events).collect())
    return [*lines, *[f"{k}. {user}: {n}" for k, user, n in users], f"TOTAL: {sum(types.values())}"]


def render(found: DataFrame, events: DataFrame) -> str:
    """The report as text."""
    return "\n".join(report_lines(found, events))
