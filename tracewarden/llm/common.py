"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set, and only on a local master."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not own:
        own = spark.conf.get("spark.tracewarden.scratch", None)
    if not own:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="tracewarden-")
        spark.conf.set("spark.tracewarden.scratch", own)
    return own.rstrip("/")


_made: list[str] = []


def materialise(df: DataFrame, tag: str, pack: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage. Hashes need no packing: it costs time and saves little."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd" if pack else "none")
    (writer if pack else writer.option("parquet.enable.dictionary", "false")).parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that materialise returned and that is no longer read."""
    _delete(spark, df.scratch)


def materialise_alone(make, tag: str) -> DataFrame:
    """The table of make(), a frame, without the tables that were stored on the way to it."""
    before = set(_made)
    df = make()
    out = materialise(df, tag)
    for path in [p for p in _made if p not in before and p != out.scratch]:
        _delete(df.sparkSession, path)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, made: tuple[str, ...]) -> list[str]:
    """Columns that aren't named like those an operator makes (names don't differ by case alone)."""
    return [c for c in df.columns if c.lower() not in made]


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow that takes columns of any name."""
    names = df.columns

    def named(batches):
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(named, schema)


MOST_NAMES = 60_000


def part_names(parts: int) -> tuple[int, int]:
    """Names (of 16 bits) and parts of one name: a part is name * subs + sub."""
    names = min(parts, MOST_NAMES)
    return names, -(-parts // names)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key: its name and the upper 48 bits tell the keys of a part apart, and give the sub."""
    names, subs = part_names(parts)
    return (keys % np.uint64(names)).astype(np.int64) * subs + (keys >> np.uint64(16)).astype(np.int64) % subs


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo the number of folds; null counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def word_bytes(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; holds at most `limit` words between calls of trim()."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` consecutive word hashes; order matters."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def split_count(total: int, per_part: int, least: int = 1) -> int:
    """Parts of bounded size: grows with the input."""
    return max(least, -(-int(total or 0) // per_part))
