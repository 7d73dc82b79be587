"""Deleted interpolation: bigram, unigram and uniform estimates mixed by context frequency.

P(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), b the power of two of
c(v). Tokens are words between ASCII white space (A-Z lower-cased) and one end a text; the
context of a first token is a start that occurs once a text. Weights are learned by
expectation-maximisation on deleted counts: each training token is held out from the
counts that predict it (c - 1), all training tokens take part.

Counts are exact and cover all training texts, and none is broadcast. Texts lie in blocks
of bounded size. Each block sends its distinct words and bigrams with their counts to parts
(by hash, each of bounded size); the parts add up and answer every block with the totals of
what it asked for, in the order asked. A hot word is one entry a block. Blocks then hold the
counts of their tokens; these, much smaller than the texts, serve learning and scoring.
For learning, pairs of probabilities are counted in a fixed grid, which the driver sees.

Null and empty texts are one end token. Repeated rows are scored each (and counted each in
training). A very long text is a block of its own. Nothing depends on the order of rows, so
ties have no effect. An empty table gives an empty table; without training texts N = V = 0.
Only the id and results are returned, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import WordHashes, column, discard, fold, materialise, mix, part_of, split_count, word_bytes

BLOCK_CHARS, PART_CHARS = 4_000_000, 10_000_000
END, START = np.uint64(0x5EED0FE2D0000001), np.uint64(0x5EED057A27000002)
BUCKETS, STEP, Q1, Q2 = 24, 0.1, 100, 100  # powers of two of c(v); cells of -log10 of the probabilities


def pack_blocks(docs: DataFrame) -> DataFrame:
    """One row per block of (id, text, train): its ids, texts and training flags."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("train", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        own, held, size = uuid.uuid4().hex, [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.chunked_array([h.column(k) for h in held]).combine_chunks() for k in range(3)]
            offsets = pa.array([0, len(columns[0])], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([f"{own}-{flush.n}"])] + [pa.ListArray.from_arrays(offsets, c) for c in columns], names=["block", "ids", "texts", "train"])

        flush.n = 0
        for batch in batches:
            sizes = np.cumsum([len(t or "") + 1 for t in batch.column(1).to_pylist()])
            at = 0
            while at < batch.num_rows:
                room = BLOCK_CHARS - size + (sizes[at - 1] if at else 0)
                to = max(at + (not held), int(np.searchsorted(sizes, room, side="right")))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += sizes[to - 1] - (sizes[at - 1] if at else 0)
                    at = to
                if at < batch.num_rows or size >= BLOCK_CHARS:
                    yield flush()
                    flush.n += 1
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, schema)


class Grams:
    """Tokens of a block's texts, its distinct words and bigrams in the order of (part, key), and where each token's are."""

    def __init__(self, texts: list[str | None], parts: int, hashes: WordHashes):
        pieces, lengths = [], []
        for t in texts:
            h = hashes.of(word_bytes(t))
            hashes.trim()
            pieces += [h, [END]]
            lengths.append(len(h) + 1)
        self.lengths = np.array(lengths, dtype=np.int64)
        token = np.concatenate([np.asarray(p, np.uint64) for p in pieces]) if pieces else np.empty(0, np.uint64)
        first = np.cumsum(self.lengths) - self.lengths
        before = np.r_[START, token[:-1]] if len(token) else token
        before[first] = START
        self.parts = parts
        self.keys, self.at, self.cuts = [], [], []
        for key in (token, mix(before * np.uint64(0x9E3779B97F4A7C15) + token)):
            distinct, back = np.unique(key, return_inverse=True)
            part = part_of(distinct, parts)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            self.keys.append(distinct[order])
            self.at.append(place[back])
            present, first = np.unique(part[order], return_index=True)
            self.cuts.append(list(zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=False)))


def narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each; the first byte says how many."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


ASKED = "part long, block string, kind int, keys binary, counts binary"
ANSWER = "block string, part long, kind int, counts binary, total long, distinct long"
COUNTED = "block string, ids {}, train array<boolean>, lengths binary, words binary, pairs binary"


def ask(blocks: DataFrame, parts: int) -> DataFrame:
    """What blocks send to the parts: distinct keys (words whole, bigrams without the 16 low bits) and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for block, texts, train in zip(*(batch.column(k) for k in range(3)), strict=True):
                grams = Grams(texts.as_py(), parts, hashes)
                taught = np.repeat(np.array(train.as_py(), dtype=bool), grams.lengths)
                rows: list[list] = [[], [], [], []]
                for kind in (0, 1):
                    count = np.bincount(grams.at[kind][taught], minlength=len(grams.keys[kind]))
                    for p, lo, hi in grams.cuts[kind]:
                        keys = grams.keys[kind][lo:hi].astype("<u8")
                        raw = keys.tobytes() if kind == 0 else np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
                        for values, value in zip(rows, (p, kind, raw, narrow(count[lo:hi])), strict=True):
                            values.append(value)
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array([block.as_py()] * n, pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["part", "block", "kind", "keys", "counts"])

    return blocks.select("block", "texts", "train").mapInArrow(run, ASKED)


def answer(table: pa.Table) -> pa.Table:
    """Totals of one part, for each block in the order it asked."""
    part = table.column("part")[0].as_py()
    kinds, blocks = table.column("kind").to_pylist(), table.column("block").to_pylist()
    keys, counts = table.column("keys"), table.column("counts")
    out: list[list] = [[], [], [], [], []]
    for kind in (0, 1):
        rows = [k for k, x in enumerate(kinds) if x == kind]
        if not rows:
            continue
        raw = [keys[k].as_py() for k in rows]
        if kind == 0:
            flat = np.frombuffer(b"".join(raw), "<u8")
            sizes = [len(r) // 8 for r in raw]
        else:
            wide = np.zeros((sum(map(len, raw)) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
            flat = wide.view("<u8").ravel()
            sizes = [len(r) // 6 for r in raw]
        distinct, back = np.unique(flat, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([widen(counts[k].as_py()) for k in rows]), minlength=len(distinct)).astype(np.int64)
        got = np.split(total[back], np.cumsum(sizes)[:-1])
        for j, (k, g) in enumerate(zip(rows, got, strict=True)):
            # the part's sums go with its first answer
            row = (blocks[k], kind, narrow(g), int(total.sum()) if not j else 0, int((total > 0).sum()) if not j else 0)
            for column, value in zip(out, row, strict=True):
                column.append(value)
    n = len(out[0])
    return pa.table({"block": pa.array(out[0], pa.string()), "part": pa.array([part] * n, pa.int64()), "kind": pa.array(out[1], pa.int32()), "counts": pa.array(out[2], pa.binary()), "total": pa.array(out[3], pa.int64()), "distinct": pa.array(out[4], pa.int64())})


def put_counts(parts: int, schema: pa.Schema):
    """The function that gives each token of a block its word's and its bigram's training count."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        grams = Grams(block.column("texts")[0].as_py(), parts, WordHashes(1 << 40))
        kinds, at = answers.column("kind").to_pylist(), answers.column("part").to_pylist()
        counts = answers.column("counts")
        per_token = []
        for kind in (0, 1):
            rows = sorted((p, k) for k, (p, x) in enumerate(zip(at, kinds, strict=True)) if x == kind)
            totals = np.concatenate([widen(counts[k].as_py()) for _, k in rows]) if rows else np.empty(0, np.int64)
            per_token.append(totals[grams.at[kind]])
        first = block.slice(0, 1)
        return pa.table([first.column("block"), first.column("ids"), first.column("train"), pa.array([narrow(grams.lengths)]), pa.array([narrow(per_token[0])]), pa.array([narrow(per_token[1])])], schema=schema)

    return run


def contexts(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Training counts of the contexts: of the token before, of the end for a text's first."""
    if not len(words):
        return words
    last = np.cumsum(lengths) - 1
    out = np.r_[0, words[:-1]]
    out[last - lengths + 1] = words[last]
    return out


def buckets(c: np.ndarray) -> np.ndarray:
    """0 for a context that never occurs, else 1 + floor(log2(c))."""
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1), 0)


def grid_cell(p: np.ndarray, cells: int) -> np.ndarray:
    """0 for a probability of 0, else 1 + the cell of -log10 p."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, cells - 2).astype(np.int64), 0)


def learn_weights(cells: dict[tuple[int, int, int], int], uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights (bucket x [bigram, unigram, uniform]) by expectation-maximisation on counts of (bucket, bigram cell, unigram cell)."""
    weights = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    by: dict[int, list] = {}
    for (b, q2, q1), n in cells.items():
        by.setdefault(b, []).append((0.0 if q2 == 0 else 10 ** (-(q2 - 1) * STEP), 0.0 if q1 == 0 else 10 ** (-(q1 - 1) * STEP), uniform, n))
    for b, rows in by.items():
        p, n = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows], dtype=float)
        w = weights[b]
        for _ in range(rounds):
            mixed = p * w
            new = (n[:, None] * mixed / mixed.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        # an unseen word must keep some probability
        w = np.maximum(w, [0, 0, 1e-4])
        weights[b] = w / w.sum()
    seen = sorted(by)
    for b in range(BUCKETS):
        if seen and b not in by and b:
            weights[b] = weights[min(seen, key=lambda s: (s == 0, abs(s - b)))]
    return weights


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, train, n_tokens, n_known, train_tokens, base_score and score of every row, learned from rows where `train` holds."""
    docs = docs.select(column(id_col).alias("id"), column(text).alias("text"), train.cast("boolean").alias("train"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = split_count(chars, PART_CHARS)
    blocks = materialise(pack_blocks(docs), "blocks")
    asked = ask(blocks, parts)
    answers = materialise(asked.repartition(parts, "part").groupBy("part").applyInArrow(answer, ANSWER), "answers")
    sums = answers.filter("kind = 0").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)
    id_type = docs.schema["id"].dataType
    spec = T.StructType([T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(id_type)), *T._parse_datatype_string("train array<boolean>, lengths binary, words binary, pairs binary").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spec)
    lanes = split_count(chars, BLOCK_CHARS)
    left = blocks.select("block", "ids", "texts", "train").repartition(lanes, "block").groupBy("block")
    right = answers.select("block", "part", "kind", "counts").repartition(lanes, "block").groupBy("block")
    counted = materialise(left.cogroup(right).applyInArrow(put_counts(parts, arrow), spec), "counted")
    discard(docs.sparkSession, answers)
    discard(docs.sparkSession, blocks)

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for train, lengths, words, pairs in zip(*(batch.column(k) for k in range(4)), strict=True):
                lengths, words, pairs = widen(lengths.as_py()), widen(words.as_py()), widen(pairs.as_py())
                taught = np.repeat(np.array(train.as_py(), dtype=bool), lengths)
                c = (contexts(words, lengths) - 1)[taught]
                p2 = np.where(c > 0, (pairs[taught] - 1) / np.maximum(c, 1), 0)
                p1 = (words[taught] - 1) / max(1, total - 1)
                cell = (buckets(c) * Q2 + grid_cell(p2, Q2)) * Q1 + grid_cell(p1, Q1)
                cell, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    found = counted.select("train", "lengths", "words", "pairs").mapInArrow(grid, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    uniform = 1 / (distinct + 1)
    weights = learn_weights({(r["cell"] // (Q1 * Q2), r["cell"] // Q1 % Q2, r["cell"] % Q1): r["n"] for r in found}, uniform)
    made = T._parse_datatype_string("train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    schema = T.StructType([T.StructField(id_col, id_type), *made.fields])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, train, lengths, words, pairs in zip(*(batch.column(k) for k in range(5)), strict=True):
                lengths, words, pairs = widen(lengths.as_py()), widen(words.as_py()), widen(pairs.as_py())
                c = contexts(words, lengths)
                w = weights[buckets(c)]
                p = w[:, 0] * np.where(c > 0, pairs / np.maximum(c, 1), 0) + w[:, 1] * words / max(1, total) + w[:, 2] * uniform
                base = np.log10((words + 0.5) / (total + 0.5 * (distinct + 1)))
                at = np.cumsum(lengths) - lengths
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, train.values, pa.array(lengths, pa.int64()), pa.array(np.add.reduceat(words > 0, at, dtype=np.int64), pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
                    names=schema.names,
                )

    return counted.select("ids", "train", "lengths", "words", "pairs").mapInArrow(scores, schema)


def op2_interpolated_lm(spark, sf_dir: str) -> DataFrame:
    """Contract query: scores of every document, learned from four folds of five."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, fold("doc_id", 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
