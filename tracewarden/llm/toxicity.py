"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words, all of them, of whole texts. A labelled sample of at most about
`sample_rows` rows (a documented bound) gives the index; its vocabulary has no limit. A term
weighs (1 + log tf) * idf * relevance, where relevance, 1 + z * z / `relevance_scale`, grows
with how far (z, in standard deviations) the share of label 1 among the sample's texts with
the term is from that among all: a weight of terms, which drops none. Words that no sample
text has take part in a text's length.

The sample's unit vectors lie in inverted lists, cut into blocks of neighbouring rows, with
the largest weight of every term in every block. A text's blocks are scored from the highest
upper bound down until none left can reach the k-th best, so the neighbours are exact (up to
the single precision that weights are stored in; sums are in double precision). Only
rows with a word in common are neighbours. Votes weigh 1 / (1 - cosine + `near`); isotonic
regression of the leave-one-out votes of up to about `calibration_rows` sample rows turns
them into probabilities. A text without any word of the sample (null and empty ones, too)
gets the sample's rate of label 1 among its texts without words, drawn to the whole rate.

Without labelled rows every score is 0; with one label only, the (smoothed) rate of label 1.
An empty table gives an empty table. Texts of any length are scored whole. Repeated rows get
equal scores, and of repeated ids in the sample the row of the least words counts; ties among
neighbours go to the lower row of the index, whose order depends on the rows alone. Columns
named like a result are replaced, all others kept.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import column, fold, map_arrow, others, release

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 4_000
    calibration_rows: int = 4_000
    relevance_scale: float = 10.0
    block: int = 64
    neighbours: int = 9
    near: float = 0.02
    threshold: float = 0.7


class TermCounter(dict):
    """word -> 64-bit hash, for counting the terms of texts."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the text's different words, rising, and their counts."""
        if len(self) > 50_000:
            self.clear()
        counts = Counter(WORD.findall(text.lower())) if text else {}
        terms = np.fromiter(map(self.__getitem__, counts), np.uint64, len(counts))
        order = np.argsort(terms)
        return terms[order], np.fromiter(counts.values(), np.int64, len(counts))[order]


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start up to its end, and how many each gives."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum())), sizes


class BlockIndex:
    """Inverted lists of unit vectors with block maxima, and dense lists for frequent terms.

    Row k has the terms term[start[k]:start[k + 1]], rising numbers below `size`, with their
    weights; `y` are labels, `ids` the rows' ids, `copies` how many rows of the corpus each
    stands for. Rows are put in an order of their own. A term of over 1 / `dense_share` of the
    rows has a weight for every row, so that a matrix product sums such terms for many texts.
    """

    def __init__(self, start: np.ndarray, term: np.ndarray, weight: np.ndarray, y: list[int], ids: list[str], copies: list[float], size: int, block: int, dense_share: int = 16):
        n = len(start) - 1
        heaviest = [int(term[a:b][np.argmax(weight[a:b])]) if b > a else -1 for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
        have = np.bincount(term, minlength=size)
        digest = [xxhash.xxh3_128_digest(term[a:b].tobytes() + weight[a:b].tobytes()) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
        order = sorted(range(n), key=lambda k: (-int(have[heaviest[k]]) if heaviest[k] >= 0 else 1, heaviest[k], digest[k], ids[k]))
        self.block, self.n, self.blocks = block, n, -(-n // block)
        self.y, self.ids = np.array([y[k] for k in order], np.float64), [ids[k] for k in order]
        self.copies = np.array([copies[k] for k in order], np.float64)
        at = np.array(order, np.int64)
        pick, sizes = spread(start[at], start[at + 1])
        row, term, weight = np.repeat(np.arange(n), sizes), term[pick], weight[pick]
        self.rows = np.concatenate([[0], np.cumsum(sizes)]), term.astype(np.int32), weight  # needed only where rows are asked for, see bare()
        frequent = np.flatnonzero(have * dense_share > n)
        self.slot = np.full(size, -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * block))
        thick = self.slot[term] >= 0
        self.dense[self.slot[term[thick]], row[thick]] = weight[thick]
        row, term, weight = row[~thick], term[~thick], weight[~thick]
        by = np.lexsort((row, term))
        self.row, self.weight, term = row[by].astype(np.int32), weight[by], term[by]
        # an entry is the part of a term's list that lies in one block
        key = term.astype(np.int64) * max(1, self.blocks) + self.row // block
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.cut = np.r_[first, len(key)].astype(np.int32)
        self.entry_block = (self.row[first] // block).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(size + 1)).astype(np.int32)

    def of_row(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a row."""
        start, terms, weights = self.rows
        return terms[start[row] : start[row + 1]], weights[start[row] : start[row + 1]]

    def frequent_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What frequent terms add to the cosine of each query with each row."""
        left = np.zeros((len(queries), len(self.dense)))
        for k, (terms, weights) in enumerate(queries):
            slot = self.slot[terms]
            thick = slot >= 0
            left[k, slot[thick]] = weights[thick]
        return left @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and cosines of the k nearest of positive cosine (ties: lower rows), and the blocks scored."""
        part = (self.frequent_part([(terms, weights)])[0] if part is None else part).copy()
        if skip >= 0:
            part[skip] = -np.inf
        thin = self.slot[terms] < 0
        terms, weights = terms[thin], weights[thin]
        entry, sizes = spread(self.entries[terms], self.entries[terms + 1])
        held, share = self.entry_block[entry], np.repeat(weights, sizes)
        bound = part.reshape(self.blocks, self.block).max(axis=1) + np.bincount(held, share * self.most[entry], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, cos = np.empty(0, np.int64), np.empty(0)
        done = 0
        while done < len(order):
            # a block whose bound equals the k-th cosine may hold a tie in a lower row
            ahead = order[done : done + 8] if len(cos) < k else order[done:][bound[order[done:]] >= cos[k - 1] - 1e-6]
            if not len(ahead):
                break
            blocks, done = ahead, done + len(ahead)
            place = np.full(self.blocks, -1)
            place[blocks] = np.arange(len(blocks))
            here = np.flatnonzero(place[held] >= 0)
            at, sizes = spread(self.cut[entry[here]], self.cut[entry[here] + 1])
            local = place[self.row[at] // self.block] * self.block + self.row[at] % self.block
            score = part.reshape(self.blocks, self.block)[blocks].ravel()
            score = score + np.bincount(local, np.repeat(share[here], sizes) * self.weight[at], minlength=len(score))
            found = np.flatnonzero(score > 0)
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], -k)[-k] - 1e-6]
            rows = np.concatenate([rows, blocks[found // self.block] * self.block + found % self.block])
            cos = np.concatenate([cos, score[found]])
            best = np.lexsort((rows, -np.round(cos, 6)))[:k]  # as exact as stored weights are
            rows, cos = rows[best], cos[best]
        return rows, cos, done


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising means of y (weighted by w) over x, by pooled adjacent violators, each drawn to the whole mean by one row of mean weight."""
    order = np.argsort(x, kind="stable")
    mean, one, pools = float((y * w).sum() / w.sum()), float(w.mean()), []
    for value, label, weight in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if pools and pools[-1][3] == value:
            pools[-1][0] += label * weight
            pools[-1][1] += weight
        else:
            pools.append([label * weight, weight, value, value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b = pools[-2], pools.pop()
            a[0], a[1], a[3] = a[0] + b[0], a[1] + b[1], b[3]
    at = np.array([v for p in pools for v in (p[2], p[3])])
    to = np.array([(p[0] + mean * one) / (p[1] + one) for p in pools for _ in range(2)])
    return at, np.maximum.accumulate(to)


class Model:
    """Vocabulary, weights, index and calibration; as large as the sample's texts, whatever the corpus holds."""

    def __init__(self, sample: list[tuple[str, int, np.ndarray, np.ndarray]], totals: tuple[int, int], s: Settings):
        """sample: (id, label, hashes of terms, counts); totals: labelled rows of label 0 and 1. The curve is still missing."""
        self.s, self.curve, self.index = s, None, None
        y = np.array([r[1] for r in sample], np.float64)
        n = len(sample)
        copies = np.array([totals[int(v)] / max(1, int((y == v).sum())) for v in y])  # rows that each stands for
        self.rate = (float((y * copies).sum()) + 0.5) / (float(copies.sum()) + 1) if n else 0.0
        bare = np.array([not len(r[2]) for r in sample], bool)
        self.plain = (float((y * copies)[bare].sum()) + self.rate) / (float(copies[bare].sum()) + 1) if n else 0.0
        self.vocabulary = np.unique(np.concatenate([r[2] for r in sample])) if n else np.zeros(0, np.uint64)
        start = np.concatenate([[0], np.cumsum([len(r[2]) for r in sample])]).astype(np.int64)
        term = np.searchsorted(self.vocabulary, np.concatenate([r[2] for r in sample])) if n else np.zeros(0, np.int64)
        size = len(self.vocabulary)
        have = np.bincount(term, minlength=size)
        toxic = np.bincount(term, np.repeat(y, np.diff(start)), minlength=size)
        share = float(y.mean()) if n else 0.0
        z = (toxic - have * share) / np.sqrt(np.maximum(1, have) * max(1e-9, share * (1 - share)))
        self.unknown = np.log(1 + n) + 1
        self.weight = (np.log((1 + n) / (1 + have)) + 1) * (1 + z * z / s.relevance_scale if 0 < share < 1 else 1.0)
        if size and 0 < share < 1:
            weight = (1 + np.log(np.concatenate([r[3] for r in sample]))) * self.weight[term]
            row = np.repeat(np.arange(n), np.diff(start))
            norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
            self.index = BlockIndex(start, term, weight / norm[row], y.astype(int).tolist(), [r[0] for r in sample], copies.tolist(), size, s.block)

    def stored(self) -> bytes:
        """The model without what only learning needs, weights in single precision, packed; see load()."""
        out = copy(self)
        if self.index is not None:
            out.index = copy(self.index)
            out.index.rows = None
            for name in ("weight", "most", "dense"):
                setattr(out.index, name, getattr(self.index, name).astype(np.float32))
        raw = pickle.dumps(out, 5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the terms that the sample has, as part of a unit vector over all terms."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms
        tf = 1 + np.log(counts)
        w = tf * np.where(known, self.weight[at], self.unknown)
        w /= np.sqrt((w * w).sum())
        return at[known], w[known]

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1, part: np.ndarray | None = None) -> tuple[float, list]:
        rows, cos, _ = self.index.nearest(terms, weights, self.s.neighbours, skip, part)
        if not len(rows):
            return self.rate, []
        w = 1 / (1 - np.minimum(cos, 1) + self.s.near)
        return float((w * self.index.y[rows]).sum() / w.sum()), [(self.index.ids[r], float(c)) for r, c in zip(rows[:3].tolist(), cos[:3].tolist(), strict=True)]

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list]]:
        """Probability and evidence of texts (hashes of terms, counts)."""
        out: list[tuple[float, list]] = [(self.plain, []) for _ in texts]
        if self.index is None:
            return out
        vectors = [(k, self.vector(*t)) for k, t in enumerate(texts) if len(t[0])]
        vectors = [(k, v) for k, v in vectors if len(v[0])]
        for a in range(0, len(vectors), 64):
            parts = self.index.frequent_part([v for _, v in vectors[a : a + 64]])
            for (k, v), part in zip(vectors[a : a + 64], parts, strict=True):
                vote, evidence = self.vote(*v, part=part)
                out[k] = float(np.interp(vote, *self.curve)), evidence
        return out


def counted_terms(rows: DataFrame) -> DataFrame:
    """(id, y, terms, counts) of (id, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter()
        for batch in batches:
            got = [counter.of(t) for t in batch.column(2).to_pylist()]
            terms = pa.array([t.view(np.int64) for t, _ in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, pa.array([c for _, c in got], pa.list_(pa.int64()))], names=["id", "y", "terms", "counts"])

    return rows.mapInArrow(run, "id string, y int, terms array<long>, counts array<long>")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> bytes:
    """A stored model, learned from the rows of docs that have a row (with a label that isn't null) in labels; an id with several labels has the highest."""
    marked = labels.select(column(id_col).alias("key"), (column(label).cast("int") != 0).cast("int").alias("y")).dropna().groupBy("key").agg(F.max("y").alias("y"))
    found = {r["y"]: r["c"] for r in marked.groupBy("y").agg(F.count("*").alias("c")).collect()}
    totals = found.get(0, 0), found.get(1, 0)
    # each label has half of the sample, or what it has and the other the rest: at most about sample_rows rows whatever the tables hold
    half = s.sample_rows // 2
    most = max(half, s.sample_rows - totals[1]), max(half, s.sample_rows - totals[0])
    shares = [min(1.0, m / max(1, t)) for m, t in zip(most, totals, strict=True)]
    marked = marked.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.when(F.col("y") == 1, shares[1]).otherwise(shares[0]) * 1_000_003)
    rows = docs.select(column(id_col).alias("key"), column(text).alias("text")).join(F.broadcast(marked), "key")
    # one row for each labelled id, however often its document is repeated
    one = counted_terms(rows.select(F.col("key").cast("string").alias("id"), "y", "text"))
    one = one.groupBy("id").agg(F.min(F.struct("terms", "counts", "y")).alias("r")).select("id", "r.y", "r.terms", "r.counts")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = [[x.values.to_numpy().copy() for x in batch.column(k)] for k in (2, 3)]
            sample += zip(ids, labels, [t.view(np.uint64) for t in lists[0]], lists[1], strict=True)
        model = Model(sorted(sample, key=lambda r: (len(r[0]), r[0])), totals, s)
        del sample
        if model.index is not None:
            at = calibrators(model)
            votes = np.array([model.vote(*model.index.of_row(r), skip=r)[0] for r in at.tolist()])
            model.curve = isotonic(votes, model.index.y[at], model.index.copies[at])
        stored = model.stored()
        del model
        yield pa.RecordBatch.from_arrays([pa.array([stored], pa.binary())], names=["model"])
        del stored
        release()

    # the sample is bounded, so one task takes it; the driver only passes on what that returns
    built = one.coalesce(1).mapInArrow(build, "model binary").collect()
    return bytes(built[0]["model"]) if built else Model([], totals, s).stored()


def load(stored: bytes) -> Model:
    """The model that fit() stored; sums are in double precision."""
    model = pickle.loads(pa.decompress(stored[8:], decompressed_size=int.from_bytes(stored[:8], "little"), codec="zstd", asbytes=True))
    if model.index is not None:
        model.index.dense = model.index.dense.astype(np.float64)
    return model


def calibrators(model: Model) -> np.ndarray:
    """Rows of the index that are asked for votes of the others: every one, or equally spaced ones."""
    n = model.index.n
    return np.unique(np.linspace(0, n - 1, min(n, model.s.calibration_rows)).astype(np.int64))


def score(docs: DataFrame, model: bytes, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with `score`, `predicted` and `evidence` (the three nearest examples as id:cosine), by a model that `fit` stored."""
    kept = set(others(docs, ("score", "predicted", "evidence")))
    own = [(k, f) for k, f in enumerate(docs.schema.fields) if f.name in kept and (keep_text or f.name != text)]
    schema = T.StructType([f for _, f in own] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        counter = TermCounter()
        known: dict = {}  # copies of a text are scored once
        for whole in batches:
            # few texts at a time are Python strings
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(place).to_pylist()
                keys = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
                for a in range(0, len(new), 64):
                    part = list(new)[a : a + 64]
                    scored = model.scores([counter.of(new[k]) for k in part])
                    known.update((k, (p, int(p >= model.s.threshold), ",".join(f"{i}:{c:.4f}" for i, c in evidence))) for k, (p, evidence) in zip(part, scored, strict=True))
                out = [known[k] for k in keys]
                if len(known) > 10_000:
                    known.clear()
                columns = [batch.column(k) for k, _ in own]
                columns += [pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        del model, counter, known
        release()

    return map_arrow(docs, run, schema)


def learned(spark, sf_dir: str) -> bytes:
    """The model of the folds that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(fold("doc_id", 3) != 1)
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: score and prediction of every document, learned from two folds of three."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, learned(spark, sf_dir), keep_text=False)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")
