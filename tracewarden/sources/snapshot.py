"""Snapshots of a loaded log: Parquet sorted by time, and a manifest that ties it to its source."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.schema import EVENTS

MAGIC, VERSION = "tracewarden-log", 1


def snapshot_path(source: str) -> str:
    """Where a log's snapshot lies: beside it, its extension replaced."""
    return _beside(source, "_snapshot")


def report_path(source: str) -> str:
    """Where its alerts go: one CSV file beside it."""
    return _beside(source, "_anomaly_report.csv")


def _beside(source: str, ending: str) -> str:
    scheme, mark, rest = source.rpartition("://")
    path = PurePosixPath(rest)
    return scheme + mark + str(path.with_name(path.stem + ending)) if path.name else source + ending


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def source_state(spark: SparkSession, source: str) -> dict | None:
    """Size and time of change of a file or folder; None if it isn't there."""
    at, fs = _files(spark, source)
    if not fs.exists(at):
        return None
    return {"size": fs.getContentSummary(at).getLength(), "mtime": fs.getFileStatus(at).getModificationTime()}


def checksum(events: DataFrame) -> tuple[int, int]:
    """Rows, and the exclusive or of their hashes over all columns."""
    row = events.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*EVENTS.names)), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def write_snapshot(events: DataFrame, path: str, source: str) -> None:
    """Writes beside the place, then moves the old snapshot aside and the new one in, so that a failed write leaves the old one."""
    spark = events.sparkSession
    new = f"{path}.{uuid.uuid4().hex}"
    ranged = events.select(*EVENTS.names).repartitionByRange("timestamp", "seq").sortWithinPartitions("timestamp", "seq")
    ranged.write.parquet(f"{new}/rows")
    rows, xor = checksum(spark.read.schema(EVENTS).parquet(f"{new}/rows"))
    manifest = {"magic": MAGIC, "version": VERSION, "rows": rows, "checksum": xor, "source": source_state(spark, source)}
    at, fs = _files(spark, f"{new}/manifest.json")
    out = fs.create(at)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    target, _ = _files(spark, path)
    old, _ = _files(spark, f"{new}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(_files(spark, new)[0], target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't rename {new} to {path}")
    if had:
        fs.delete(old, True)


def manifest(spark: SparkSession, path: str) -> dict | None:
    at, fs = _files(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        return None
    try:
        got = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    except (ValueError, Py4JJavaError, PySparkException):  # cut short, overwritten or unreadable
        return None
    return got if isinstance(got, dict) and got.get("magic") == MAGIC else None


def is_fresh(spark: SparkSession, path: str, source: str) -> bool:
    """Whether the snapshot was made of the source as it is now."""
    found, state = manifest(spark, path), source_state(spark, source)
    return found is not None and state is not None and found.get("source") == state


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows; ValueError if the manifest is missing or of another version, or rows don't match it."""
    found = manifest(spark, path)
    if found is None:
        raise ValueError(f"{path} has no manifest")
    if found.get("version") != VERSION:
        raise ValueError(f"{path} has version {found.get('version')}, not {VERSION}")
    events = spark.read.schema(EVENTS).parquet(f"{path}/rows")
    if checksum(events) != (found["rows"], found["checksum"]):
        raise ValueError(f"the rows of {path} don't match its manifest")
    return events


def open_log(spark: SparkSession, source: str, reload: bool = False) -> DataFrame:
    """The log's events: of its snapshot if that is fresh and whole, else read and written anew."""
    from tracewarden.sources.log_text import read_log

    path = snapshot_path(source)
    if not reload and is_fresh(spark, path, source):
        try:
            return load_snapshot(spark, path)
        except ValueError:
            pass
    write_snapshot(read_log(spark, source)[0], path, source)
    return spark.read.schema(EVENTS).parquet(f"{path}/rows")
