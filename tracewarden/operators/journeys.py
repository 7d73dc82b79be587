"""Journeys, top resources, default keys and the dictionary of an access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators.ordering import with_position
from tracewarden.operators.patterns import CODED, entries
from tracewarden.schema import EARLIEST, LATEST


def in_range(events: DataFrame, start: int = EARLIEST, end: int = LATEST) -> DataFrame:
    """Events whose time lies in the range, both ends included; swapped ends are put in order."""
    return events.filter(F.col("timestamp").between(min(start, end), max(start, end)))


def user_journey(events: DataFrame, user: str, start: int = EARLIEST, end: int = LATEST) -> DataFrame:
    """A user's events by time, ties in file order."""
    rows = in_range(events.filter(F.col("user_id") == user), start, end)
    return rows.select("timestamp", "event_type", "device_id", "app_id", "resource_id", "location", "seq").orderBy("timestamp", "seq")


def resource_history(events: DataFrame, resource: str, start: int = EARLIEST, end: int = LATEST) -> DataFrame:
    """A resource's events by time, ties in file order."""
    rows = in_range(events.filter(F.col("resource_id") == resource), start, end)
    return rows.select("timestamp", "event_type", "user_id", "device_id", "app_id", "location", "seq").orderBy("timestamp", "seq")


def device_history(events: DataFrame, device: str, start: int = EARLIEST, end: int = LATEST) -> DataFrame:
    """A device's events by time, ties in file order."""
    rows = in_range(events.filter(F.col("device_id") == device), start, end)
    return rows.select("timestamp", "event_type", "user_id", "app_id", "resource_id", "location", "seq").orderBy("timestamp", "seq")


def app_history(events: DataFrame, app: str, start: int = EARLIEST, end: int = LATEST) -> DataFrame:
    """An app's events by time, ties in file order."""
    rows = in_range(events.filter(F.col("app_id") == app), start, end)
    return rows.select("timestamp", "event_type", "user_id", "device_id", "resource_id", "location", "seq").orderBy("timestamp", "seq")


def without(events: DataFrame, column: str, value: str) -> DataFrame:
    """The log but the events of one user, device, app or resource; places stay."""
    if column not in CODED:
        raise ValueError(f"{column} is none of {CODED}")
    return events.filter(F.col(column) != value)


def status(events: DataFrame, column: str, value: str, start: int = EARLIEST, end: int = LATEST) -> str:
    """'unknown' if the value never occurs, 'empty' if not in the range, else 'found'."""
    of = events.filter(F.col(column) == value)
    if of.isEmpty():
        return "unknown"
    return "empty" if in_range(of, start, end).isEmpty() else "found"


def page(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of an ordered result, from 0."""
    return rows.offset(number * size).limit(size)


def top_resources(events: DataFrame, start: int = EARLIEST, end: int = LATEST, n: int = 10, buckets: int | None = None) -> DataFrame:
    """The n resources with most events in the range; ties: the one with the lower place in the dictionary.

    One aggregation counts in the range and finds places over all rows and coded columns.
    With `buckets`, ties go to the lower id modulo that number, then to the resource whose
    first event in the range is later: the order of a hash table of so many chains, which
    differs from the other once the dictionary holds more values than that.
    """
    inside = F.col("timestamp").between(min(start, end), max(start, end))
    each = [F.struct(F.col(c).alias("value"), (F.col("seq") * 4 + k).alias("at"), F.when(inside, F.col("seq") if c == "resource_id" else F.lit(None).cast("long")).alias("hit")) for k, c in enumerate(CODED)]
    seen = events.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    seen = seen.groupBy("value").agg(F.count("hit").alias("accesses"), F.min("at").alias("at"), F.min("hit").alias("hit"))
    order = [F.desc("accesses"), F.col("at")]
    if buckets:
        seen = with_position(seen, "at", name="id")
        order = [F.desc("accesses"), F.col("id") % buckets, F.desc("hit")]
    top = seen.filter("accesses > 0").orderBy(*order).limit(n)
    # n rows: their ranks need no partitions
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", F.col("value").alias("resource_id"), "accesses")


def default_keys(events: DataFrame) -> DataFrame:
    """User and resource of the first event."""
    return events.agg(F.min_by("user_id", "seq").alias("user_id"), F.min_by("resource_id", "seq").alias("resource_id"))


def dictionary(events: DataFrame) -> DataFrame:
    """(value, id): one dictionary for the four coded columns, ids dense in the order of first appearance."""
    return with_position(entries(events).groupBy("value").agg(F.min("at").alias("at")), "at", name="id").select("value", "id")


def decode(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows with the ids in a column replaced by their values, '' where there is none."""
    out = rows.join(ids.select(F.col("id").alias("_id"), F.col("value").alias("_value")), F.col(column) == F.col("_id"), "left")
    return out.withColumn(column, F.coalesce("_value", F.lit(""))).drop("_id", "_value")


def dedup_rows(events: DataFrame) -> DataFrame:
    """Of rows equal in all log fields the first by seq."""
    fields = [c for c in events.columns if c != "seq"]
    return events.groupBy(*fields).agg(F.min("seq").alias("seq"))
