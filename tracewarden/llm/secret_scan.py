"""Secrets in texts: known patterns, and strings that a battery of randomness tests takes for random.

Candidates are runs of 20 or more characters of base-64 alphabets, split at '=' but for the
padding at their end. Each gets the narrowest encoding that holds its characters (hex, base
32, base 36, base 62, base 64 and its URL form). Where none does, since '+' or '/' and '-'
or '_' occur, the parts between '+' and '/', those between '-' and '_' and those between any
of the four are candidates, if they have 20 or more characters; they may overlap.
A candidate's battery is the chi-squared statistic of uniformity over its alphabet plus the
squared deviates of Wald-Wolfowitz runs about the middle symbol and of lag-one serial
correlation: one sum, with k + 1 degrees of freedom for k symbols, if it is random.
 * Could it be random? The sum's upper tail must keep p >= `battery_p`.
 * Could it be language? If its symbols follow those of prose, all three tests are off by an
   amount that grows with the length, so the sum is a non-central chi-squared variable whose
   mean and spread are known for each encoding and length. Its lower tail gives a p value,
   which only long strings can make small. Within each length stratum of all candidates of
   the table, Benjamini-Hochberg picks the p value that holds the false-discovery rate at `fdr`.
Random strings that aren't language are added to the pattern spans as kind `random`.

Null and empty texts have no spans. Texts of any length are searched whole. Repeated rows each
get their spans, and each counts in the strata. Spans that tie in start and kind go by end. An
empty table gives an empty table. Columns named like a result (`spans`) are replaced, all
others kept, whatever their names. Only a histogram of p values (a fixed number of cells)
comes to the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import column, materialise, others

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
PART = re.compile("[^=]+(?:=+$)?")
MIXED = tuple(re.compile(p) for p in ("[^+/=]+(?:=+$)?", "[^_=-]+(?:=+$)?", "[^+/_=-]+(?:=+$)?"))
RUN = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

DIGITS, LOWERS, UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPERS + "234567"),
    ("base36", DIGITS + LOWERS),
    ("BASE36", DIGITS + UPPERS),
    ("base62", DIGITS + UPPERS + LOWERS),
    ("base64", UPPERS + LOWERS + DIGITS + "+/"),
    ("base64url", UPPERS + LOWERS + DIGITS + "-_"),
)
# Relative frequencies (per cent) of the letters a to z in English prose.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
# What runs and serial correlation of English prose add to their squared deviates per symbol.
RUNS_SHIFT, SERIAL_SHIFT = 0.01, 0.01
STRATA = (20, 28, 40, 64)  # least lengths
CELL, CELLS = 0.05, 400  # of -log10 p


def natural_profile(alphabet: str) -> float:
    """Sum of squared symbol shares of language written in the alphabet, times its size, less 1."""
    share = {}
    for c in alphabet:
        if c.isdigit():
            share[c] = 0.6
        elif c.isalpha():
            both = c.swapcase() in alphabet
            share[c] = LETTERS[ord(c.lower()) - 97] * ((0.08 if c.isupper() else 0.92) if both else 1.0)
        else:
            share[c] = 1.5
    total = sum(share.values())
    return len(alphabet) * sum((v / total) ** 2 for v in share.values()) - 1


PROFILES = tuple(natural_profile(a) for _, a in ENCODINGS)
INDEX = tuple({c: k for k, c in enumerate(a)} for _, a in ENCODINGS)


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_of(total: float, degrees: float, shift: float = 0.0) -> float:
    """The standard normal deviate of a (non-central) chi-squared variable, by the cube root of its ratio to its mean."""
    mean = degrees + shift
    spread = 2 * (degrees + 2 * shift) / (9 * mean * mean)
    return ((total / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)


def battery(token: str) -> tuple[str, float, float]:
    """Encoding, p of the three tests together if the token is random, and -log10 of their p if it is language."""
    body = token.rstrip("=")
    chars = set(body)
    at = next((k for k, index in enumerate(INDEX) if chars <= index.keys()), None)
    if at is None or not body:
        return "none", 0.0, 0.0
    k, n = len(INDEX[at]), len(body)
    x = np.fromiter((INDEX[at][c] for c in body), dtype=np.int64, count=n)
    seen = np.bincount(x, minlength=k)
    total = float(((seen - n / k) ** 2).sum() * k / n)
    high = x >= k / 2
    ups = int(high.sum())
    if not 0 < ups < n:  # symbols of one half only
        return ENCODINGS[at][0], 0.0, 0.0
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * ups * (n - ups) / n
    total += (runs - mean) ** 2 * (n - 1) / max(1e-9, (mean - 1) * (mean - 2))
    d = x - x.mean()
    total += (float((d[1:] * d[:-1]).sum() / (d * d).sum()) + 1 / n) ** 2 * n
    p_language = 1.0
    if PROFILES[at] > 0.02:
        p_language = max(1e-30, upper_tail(-normal_of(total, k + 1, n * (PROFILES[at] + RUNS_SHIFT + SERIAL_SHIFT))))
    return ENCODINGS[at][0], upper_tail(normal_of(total, k + 1)), -math.log10(p_language)


def candidates(run: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that are tested: each in one alphabet, STRATA[0] characters or more."""
    out = set()
    for part in PART.finditer(run):
        a, token = part.start(), part.group()
        mixed = any(c in token for c in "+/") and any(c in token for c in "-_")
        found = [m.span() for p in MIXED for m in p.finditer(token)] if mixed else [(0, len(token))]
        out |= {(a + b, a + e) for b, e in found if e - b >= STRATA[0]}
    return sorted(out)


def find_patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern spans, in code points."""
    out = []
    low = text.lower()
    if any(s in low for s in STEMS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


SCAN = "array<struct<start:long,end:long,kind:int>>"
CANDIDATES = "array<struct<start:long,end:long,encoding:string,random:boolean,stratum:int,cell:int>>"


def scan(rows: DataFrame, keep_text: bool = True, battery_p: float = 0.001) -> DataFrame:
    """(row, text) with `base` (pattern spans) and `tested` (candidates and what the battery says)."""
    kept = ("row", "text") if keep_text else ("row",)
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("base", T._parse_datatype_string(SCAN)), T.StructField("tested", T._parse_datatype_string(CANDIDATES))])
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    tested_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("random", pa.bool_()), ("stratum", pa.int32()), ("cell", pa.int32())]))

    def one(text: str | None) -> tuple[list[dict], list[dict]]:
        if not text:
            return [], []
        spans, tested = find_patterns(text), []
        for run in RUN.finditer(text):
            a, token = run.start(), run.group()
            spans += [(a + m.start(), a + m.end(), 2) for m in HEX.finditer(token) if m.end() - m.start() >= 32]
            for b, e in candidates(token):
                encoding, p, away = battery(token[b:e])
                if encoding != "none":
                    stratum = sum(e - b >= s for s in STRATA) - 1
                    tested.append({"start": a + b, "end": a + e, "encoding": encoding, "random": p >= battery_p, "stratum": stratum, "cell": min(CELLS - 1, int(away / CELL))})
        return [dict(zip(("start", "end", "kind"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[0], s[2], s[1]))], tested

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(k) for k, _ in enumerate(kept)]
            columns += [pa.array([f[0] for f in found], base_type), pa.array([f[1] for f in found], tested_type)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("row", "text").mapInArrow(run, schema)


def discovery_cells(scanned: DataFrame, fdr: float) -> list[int]:
    """For each stratum the least cell whose candidates count as discoveries (CELLS: none)."""
    cells = scanned.select(F.explode("tested").alias("c")).groupBy("c.stratum", "c.cell").count().collect()
    counts = np.zeros((len(STRATA), CELLS))
    for row in cells:
        counts[row["stratum"], row["cell"]] += row["count"]
    return [step_up(c, fdr) for c in counts]


def step_up(counts: np.ndarray, fdr: float) -> int:
    """Benjamini-Hochberg over cells of -log10 p: the least cell with p * candidates <= fdr * candidates found there and beyond."""
    found = np.cumsum(counts[::-1])[::-1]
    p = 10.0 ** -(CELL * np.arange(len(counts)))
    fine = np.flatnonzero((found > 0) & (p * counts.sum() <= fdr * found))
    return int(fine[0]) if len(fine) else len(counts)


def with_spans(rows: DataFrame, keep_text: bool, fdr: float, battery_p: float) -> DataFrame:
    """(row, text) with `spans`, as a table of its own."""
    scanned = materialise(scan(rows, keep_text, battery_p), "secrets")
    least = F.array(*[F.lit(c) for c in discovery_cells(scanned, fdr)])

    def span(s: Column, kind: Column, encoding: Column) -> Column:
        return F.struct(s["start"].alias("start"), kind.alias("rank"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), kind + 1).alias("kind"), encoding.alias("encoding"))

    base = F.transform("base", lambda s: span(s, s["kind"], F.lit(None).cast("string")))
    picked = F.filter("tested", lambda c: c["random"] & (c["cell"] >= F.element_at(least, c["stratum"] + 1)))
    more = F.transform(picked, lambda c: span(c, F.lit(3), c["encoding"]))
    return scanned.withColumn("spans", F.array_sort(F.concat(base, more))).drop("base", "tested")


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True, fdr: float = 0.05, battery_p: float = 0.001) -> DataFrame:
    """docs with `spans`: array of (start, rank, end, kind, encoding), by start, then kind."""
    own = [c for c in others(docs, ("spans",)) if keep_text or c != text]
    found = with_spans(docs.select(F.struct(*map(column, own)).alias("row"), column(text).alias("text")), False, fdr, battery_p)
    return found.select("row.*", "spans")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", fdr: float = 0.05, battery_p: float = 0.001) -> DataFrame:
    """docs with every span of a secret replaced; overlapping spans become one mark. Null texts stay null, other columns as they are."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select((F.struct(*map(column, rest)) if rest else F.lit(0)).alias("row"), column(text).alias("text"))
    found = with_spans(rows, True, fdr, battery_p)

    def step(acc: Column, s: Column) -> Column:
        later = s["start"] >= acc["at"]
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(later, F.concat(acc["out"], piece, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    end = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    clean = F.when(F.size("spans") > 0, end).otherwise(F.col("text"))
    return found.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op1_randomness_battery(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, keep_text=False)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["rank"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        number(3).alias("n_random"),
    )
