"""Access-log files: lines of seven comma-separated fields, strictly checked, each line once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.ordering import with_position
from tracewarden.schema import EVENT_TYPES, FIELDS, HEADER, LOCATIONS


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): lines split at \\n alone, blank ones left out, with their place in the input."""
    lines = spark.read.option("lineSep", "\n").text(path)
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(pos.alias("pos"), F.col("value").alias("line")).filter(F.length("line") > 0)


def parsed(line: str = "line") -> list[Column]:
    """reason (null: accepted) and the fields of a line; a last field may end in one carriage return."""
    parts = F.split(F.regexp_replace(line, "\r$", ""), ",", -1)
    n = F.size(parts)
    kind, place, time = F.get(parts, 4), F.get(parts, 5), F.get(parts, 6)
    seconds = F.when(time.rlike("^[0-9]+$"), time.try_cast("long"))
    reason = (
        F.when(n != len(FIELDS), "fields")
        .when(F.exists(parts, lambda p: p == ""), "empty field")
        .when(~kind.isin(*EVENT_TYPES), "event type")
        .when(~place.isin(*LOCATIONS), "location")
        .when(seconds.isNull(), "timestamp")
    )
    return [reason.alias("reason"), *[F.get(parts, k).alias(c) for k, c in enumerate(FIELDS[:-1])], seconds.alias("timestamp")]


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): accepted rows with `seq` in file order; other lines with why they aren't.

    Of equal lines, carriage returns included, the first counts; the first line of a file
    that is the header is no row. A missing path raises, an empty file has no rows.
    """
    lines = read_lines(spark, path).select("pos", "line", *parsed())
    good = lines.filter("reason is null")
    # counting the first place of each line combines before the shuffle, so a hot line is no hot task
    first = good.groupBy("line").agg(F.min("pos").alias("pos"), F.count("*").alias("copies"))
    events = with_position(first.select("pos", *parsed()).drop("reason"), "pos").select(*FIELDS, "seq")
    heads = lines.groupBy("pos.file").agg(F.min_by(F.struct("pos", "line"), "pos").alias("head"))
    heads = heads.filter(F.regexp_replace("head.line", "\r$", "") == HEADER).select(F.col("head.pos").alias("pos"))
    bad = lines.filter("reason is not null").join(heads, "pos", "left_anti").select("line", "reason")
    again = first.filter("copies > 1").select("line", F.lit("duplicate").alias("reason"), F.explode(F.sequence(F.lit(2).cast("long"), "copies")).alias("k")).drop("k")
    return events, bad.unionByName(again)


def ingest_counts(events: DataFrame, rejects: DataFrame) -> DataFrame:
    """(outcome, lines): accepted lines, and those of each reason."""
    accepted = events.agg(F.lit("accepted").alias("outcome"), F.count("*").alias("lines"))
    return accepted.unionByName(rejects.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("lines")))
