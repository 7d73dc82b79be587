"""Language identification by cross-parsing entropy against suffix automata.

Per language a bounded sample of labelled texts gives one suffix automaton. A text is
parsed greedily into the longest phrases that occur in a language's sample; phrases times
log2 of the sample's length, over the text's length, estimate the cross entropy, and the
language with the least wins (ties: the first by name). Letters are lower-cased, runs of
other characters count as one space. Texts are parsed in windows of `window` symbols, all
of them, many side by side: one table look-up a symbol, window and language. Every letter of
the samples has a symbol of its own; the table has a column for the `most_letters`
commonest, transitions by other letters lie in a sorted list.

Null texts and texts without a letter are `und` with score 0, as is everything if no
language was learned. Texts of any length are parsed whole. Repeated rows get equal results;
among the rows that may be samples each counts. An empty table gives an empty table. Columns
named like a result (lang_pred, score, entropy) are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import column, fold, map_arrow, others

SPACE, RARE = 0, 1


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


class Alphabet:
    """Code points as symbols: 0 for runs of non-letters, 1 for letters that no sample has; those from `size` on are of `more` letters."""

    def __init__(self, letters: list[str], more: list[str] | tuple = ()):
        self.size = len(letters) + 2
        self.total = self.size + len(more)
        self.of = {c: k + 2 for k, c in enumerate([*letters, *more])}
        kind = np.uint8 if self.total < 255 else np.uint32
        self.unknown = np.iinfo(kind).max
        self.table = np.full(0x110000, self.unknown, dtype=kind)

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        got = self.table[points]
        if (got == self.unknown).any():
            for p in np.unique(points[got == self.unknown]).tolist():
                c = chr(p)
                self.table[p] = self.of.get(c, RARE) if c.isalpha() else SPACE
            got = self.table[points]
        keep = got != SPACE
        keep[1:] |= got[:-1] != SPACE
        return got[keep]


class Parser:
    """Automata of all languages in one dense table; a miss holds the inverted state after a restart."""

    def __init__(self, samples: dict[str, list[str]], most_letters: int = 200):
        self.langs = sorted(samples)
        count: dict[str, int] = {}
        for texts in samples.values():
            for t in texts:
                for c in t.lower():
                    if c.isalpha():
                        count[c] = count.get(c, 0) + 1
        order = sorted(count, key=lambda c: (-count[c], c))
        self.alphabet = Alphabet(sorted(order[:most_letters]), sorted(order[most_letters:]))
        self.dead, keys, to_state = [], [], []
        size, tables, self.start, self.bits, at = self.alphabet.size, [], [], [], 0
        for lang in self.langs:
            joined = np.concatenate([np.append(self.alphabet.symbols(t), self.alphabet.table.dtype.type(SPACE)) for t in samples[lang]] or [np.zeros(1, np.uint8)])
            edges = automaton(joined.tolist())
            edges.append({})  # after a symbol that the sample hasn't: whatever comes starts a phrase
            table = np.empty((len(edges), size), dtype=np.int32)
            table[:] = [~(at + edges[0].get(c, len(edges) - 1)) for c in range(size)]
            for s, out in enumerate(edges):
                for c, to in out.items():
                    if c < size:
                        table[s, c] = at + to
                    else:
                        keys.append((at + s) * self.alphabet.total + c)
                        to_state.append(at + to)
            tables.append(table)
            self.start.append(at)
            self.dead.append(at + len(edges) - 1)
            self.bits.append(np.log2(len(joined) + 1))
            at += len(edges)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)

        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.to_state = np.array(keys, dtype=np.int64)[order], np.array(to_state, dtype=np.int32)[order]

    def listed(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Transitions by symbols that have no column: the state, or inverted the one after a restart."""

        def find(state: np.ndarray) -> np.ndarray:
            key = state.astype(np.int64) * self.alphabet.total + symbol
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.to_state[at], np.int32(-1))

        to, again = find(state), find(np.array(self.start, dtype=np.int32)[:, None])
        return np.where(to >= 0, to, ~np.where(again >= 0, again, np.array(self.dead, dtype=np.int32)[:, None]))

    def parse(self, texts: list[str | None], window: int = 512, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and symbols of each text."""
        symbols = [self.alphabet.symbols(t) if t else np.empty(0, np.uint8) for t in texts]
        length = np.array([len(s) for s in symbols], dtype=np.int64)
        phrases = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        parts = [(i, a) for i, s in enumerate(symbols) for a in range(0, len(s), window)]
        parts.sort(key=lambda p: p[1] + window - length[p[0]])  # whole windows first, then by length
        size = np.int32(self.alphabet.size)
        for k in range(0, len(parts), lanes):
            group = parts[k : k + lanes]
            wide = np.zeros((window, len(group)), dtype=np.int32)
            long = np.empty(len(group), dtype=np.int64)
            for j, (i, a) in enumerate(group):
                piece = symbols[i][a : a + window]
                wide[: len(piece), j] = piece
                long[j] = len(piece)
            active = np.searchsorted(-long, -np.arange(window), side="left")  # windows longer than the step
            state = np.repeat(np.array(self.start, dtype=np.int32)[:, None], len(group), axis=1)
            misses = np.zeros(state.shape, dtype=np.int32)
            for step in range(window):
                n = active[step]
                if not n:
                    break
                symbol = wide[step, :n]
                to = self.table[state[:, :n] * size + np.minimum(symbol, size - 1)]
                if len(self.keys) and len(rest := np.flatnonzero(symbol >= size)):
                    to[:, rest] = self.listed(state[:, rest], symbol[rest])
                sign = to >> 31
                if step:  # nothing ends at the first symbol
                    misses[:, :n] -= sign
                state[:, :n] = to ^ sign
            np.add.at(phrases, [i for i, _ in group], misses.T + 1)
        return phrases, length


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_chars: int = 30_000, total_chars: int = 240_000) -> Parser:
    """Samples of whole texts: at most `sample_chars` code points a language, `total_chars` in all."""
    named = docs.select(column(lang).alias("lang"), column(text).alias("text"), F.xxhash64(column(id_col), column(text)).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    named = named.withColumn("n", F.length("text"))
    counts = {r["lang"]: r["c"] for r in named.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    if not counts:
        return Parser({})
    most = min(sample_chars, total_chars // len(counts))
    rate = F.lit(1.0)
    for name, c in counts.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, 400 / c))).otherwise(rate)
    few = named.filter(F.pmod("h", F.lit(1_000_003)) < rate * 1_000_003)
    short = F.when(F.col("n") <= most // 4, 0).otherwise(1)
    w = Window.partitionBy("lang").orderBy(short, F.when(short == 0, F.col("h")).otherwise(F.col("n")), "h", "text")
    few = few.withColumn("k", F.row_number().over(w)).withColumn("sum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = few.filter((F.col("sum") <= most) | (F.col("k") == 1)).select("lang", "k", "text").collect()
    samples: dict[str, list[str]] = {name: [] for name in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        samples[r["lang"]].append(r["text"])
    return Parser({k: v for k, v in samples.items() if v})


def identify(docs: DataFrame, parser: Parser, text: str = "text", keep_text: bool = True, sharpness: float = 8.0) -> DataFrame:
    """docs with `lang_pred`, `score` (0 to 1: share of the winner among exp(-sharpness * entropy)) and `entropy` (bits a symbol)."""
    kept = set(others(docs, ("lang_pred", "score", "entropy")))
    own = [f for f in docs.schema.fields if f.name in kept and (keep_text or f.name != text)]
    schema = T.StructType(own + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        names = np.array([*parser.langs, "und"], dtype=object)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                n = len(texts)
                best, score, entropy = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n)
                if len(names) > 1:
                    phrases, length = parser.parse(texts)
                    some = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool) & (length > 0)
                    bits = phrases[some] * np.array(parser.bits) / length[some][:, None]
                    least = bits.argmin(axis=1) if len(bits) else np.empty(0, np.int64)
                    entropy[some] = bits.min(axis=1) if len(bits) else 0
                    score[some] = 1 / np.exp(-sharpness * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1) if len(bits) else 0
                    best[some] = least
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in own]
                columns += [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(entropy)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(docs, run, schema)


def op5_cross_parsing(spark, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learned from three folds of four."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold("doc_id", 4) == 2
    parser = learn(docs.filter(~held))
    out = identify(docs.select("doc_id", "text"), parser, keep_text=False)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "entropy")
