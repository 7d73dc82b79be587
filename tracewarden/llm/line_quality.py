"""Quality rules, line first: lines that fail a rule go, then documents that lost too much.

Words are runs of characters other than ASCII white space. Per text: counts over the whole
text (words, their characters, symbols, repeated lines, words in repeated windows), the
kept lines, and a verdict. Line rules, by the first that a line fails: a boilerplate phrase,
a navigation line (several separators between short parts), over one symbol in two words,
few letters, no mark that ends a sentence at its end. Without such a mark stay headings
(lines of at most `heading_words` words before a line that has one) and list items (lines
that begin with a bullet or a number). A document is rejected if the lines it lost hold more
than `max_lost` of its word characters.

Null or empty texts have no words: all counts 0, rejected. Lines without a word stay. Equal
lines get equal verdicts but as headings; the later ones count as repeated. Repeated rows give
repeated results. Texts of any length are judged whole. An empty table gives an empty table.
Columns named like a result are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import WordHashes, map_arrow, others, window_hashes

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Thresholds; `phrases` are looked for in the lower-cased line."""

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    nav_separators: int = 3
    nav_words: float = 4.0
    min_letters: float = 0.4
    max_symbols: float = 0.5
    max_lost: float = 0.5
    heading_words: int = 8
    phrases: tuple[str, ...] = (
        "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies",
        "enable javascript", "click here", "sign up for", "subscribe to", "follow us on", "share this", "lorem ipsum",
        "skip to content", "back to top", "powered by", "licensed under", "spdx-license-identifier",
    )


ENDS = tuple(".!?…:;\"'”’»)]。！？")
MARKS = "|»›>•·/\t"
SPACES = b" \t\n\r\x0b\x0c"
PLAIN = bytes(b for b in range(33, 127) if not chr(b).isalpha())  # a line's bytes but for these count as letters
SEPARATOR = re.compile(r"\s[|»›>•·/]\s|\t")
ITEM = re.compile(r"[\x20\x09-\x0D]*(?:[-*•–]|[0-9]+[.)])[\x20\x09]")


def line_verdict(line: str, rules: LineRules, ended: bool = True, before_ended: bool = False) -> str:
    """'' if the line stays, else the rule that it fails. `ended`: its end is that of a sentence; `before_ended`: that of the next line with a word is."""
    low = line.lower()
    if any(p in low for p in rules.phrases):
        return "boilerplate"
    if sum(map(line.count, MARKS)) >= rules.nav_separators:
        found = len(SEPARATOR.findall(line))
        if found >= rules.nav_separators and len(line.split()) - found <= rules.nav_words * (found + 1):
            return "navigation"
    raw = line.encode("utf-8", "surrogatepass")
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols * len(raw.split()):
        return "symbols"
    solid = raw.translate(None, SPACES)
    if len(solid) - len(solid.translate(None, PLAIN)) > (1 - rules.min_letters) * len(solid):
        return "few letters"
    if not ended and not (before_ended and len(raw.split()) <= rules.heading_words) and not ITEM.match(line):
        return "punctuation"
    return ""


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: list[str | None], rules: LineRules, hashes: WordHashes) -> dict[str, list]:
    """Counts, verdicts and the lines kept, of texts."""
    out: dict[str, list] = {k: [] for k in (*COUNTS, "lines_failed", "lost", "base_failed", "kept", "clean_text")}
    for text in texts:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
        repeated = 0
        if n >= rules.window:
            w = window_hashes(hashes.of(words), rules.window)
            order = np.argsort(w, kind="stable")
            s = w[order]
            twice = np.zeros(len(s) + 1, dtype=bool)
            twice[1:-1] = s[1:] == s[:-1]
            hit = order[twice[:-1] | twice[1:]]
            if len(hit):
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + rules.window, -1)
                repeated = int((np.cumsum(edge)[:n] > 0).sum())
        seen: set[str] = set()
        dup = failed = lost = 0
        stay = []
        lines = text.split("\n")
        bare = [line.strip(" \t\n\r\x0b\x0c") for line in lines]
        ended = [b.endswith(ENDS) for b in bare if b]
        filled = 0
        for line, b in zip(lines, bare, strict=True):
            if not b:
                stay.append(line)
                continue
            dup += line in seen
            seen.add(line)
            filled += 1
            if line_verdict(line, rules, ended[filled - 1], filled < len(ended) and ended[filled]):
                failed += 1
                lost += len(line) - sum(map(line.count, " \t\r\x0b\x0c"))
            else:
                stay.append(line)
        base = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
        share = lost / chars if chars else 0.0
        row = (n, chars, sum(map(text.count, SYMBOLS)), dup, repeated, failed, share, base, not base and share <= rules.max_lost, "\n".join(stay))
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
        hashes.trim()
    return out


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with counts, `base_failed`, `kept`, `lines_failed`, `lost` and, if asked, `clean_text`."""
    from pyspark.sql import types as T

    made = [T.StructField(k, T.LongType()) for k in (*COUNTS, "lines_failed")]
    made += [T.StructField("lost", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    made += [T.StructField("clean_text", T.StringType())] if keep_text else []
    kept = set(others(docs, tuple(m.name for m in made)))
    own = [f for f in docs.schema.fields if f.name in kept]
    if not keep_text:
        own = [f for f in own if f.name != text]
    schema = T.StructType(own + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                got = measure(batch.column(batch.schema.get_field_index(text)).to_pylist(), rules, hashes)
                kinds = {"lost": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in own]
                columns += [pa.array(got[m.name], kinds.get(m.name, pa.int64())) for m in made]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(docs, run, schema)


def op9_line_first_cleaning(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdicts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = clean_lines(docs, keep_text=False)
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "lines_failed", F.round("lost", 9).alias("lost"))


def _sql() -> str:
    rules = LineRules()
    phrases = ", ".join(f"'{p}'" for p in rules.phrases)
    ends = ", ".join("'" + e.replace("'", "''") + "'" for e in ENDS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+4]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win WHERE n > 1) GROUP BY doc_id),
line AS (
  SELECT doc_id, k, l, right(rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN ({ends}) AS ended
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
),
seen AS (
  SELECT *, len(regexp_extract_all(l, '\s[|»›>•·/]\s|\t')) AS marks, len(list_filter(string_split_regex(l, '\s+'), lambda x: x <> '')) AS parts,
         octet_length(encode(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS size, length(regexp_replace(l, '[^!-@\[-`{{-~]', '', 'g')) AS odd,
         length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars, len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
         coalesce(lead(ended) OVER (PARTITION BY doc_id ORDER BY k), false) AS before_ended
  FROM line
), judged AS (
  SELECT *, (len(list_filter([{phrases}], lambda p: contains(lower(l), p))) > 0
    OR (marks >= {rules.nav_separators} AND parts - marks <= {rules.nav_words}::DOUBLE * (marks + 1))
    OR length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > {rules.max_symbols}::DOUBLE * n
    OR odd > (1 - {rules.min_letters}::DOUBLE) * size
    OR (NOT ended AND NOT (before_ended AND n <= {rules.heading_words}) AND NOT regexp_matches(l, '^[\x20\x09-\x0D]*([-*•–]|[0-9]+[.)])[\x20\x09]'))) AS bad
  FROM seen
), per AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (WHERE bad) AS lines_failed, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost
  FROM judged GROUP BY doc_id
), a AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lines_failed, 0) AS lines_failed, coalesce(lost, 0) AS gone
  FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id
), b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed, CASE WHEN word_chars > 0 THEN CAST(gone AS DOUBLE) / word_chars ELSE 0::DOUBLE END AS share FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND share <= {rules.max_lost}::DOUBLE AS kept,
       lines_failed, round(share, 9) AS lost
FROM b
"""


ORACLE = _sql()
