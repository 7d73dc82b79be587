"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes segments (white-space marks followed by other symbols); no piece of the
vocabulary crosses a segment, so segments are encoded apart and repeated ones once.
All distinct new segments of a batch lie in flat symbol arrays. In each round every
segment finds the least rank among its adjacent pairs, merges the leftmost pairs of that
rank at once, and the arrays are compacted, until no segment has a pair of the vocabulary.

Null and empty texts give the end id alone and decode to ''. Texts of any length are encoded
whole. Of pairs that tie in rank the leftmost is merged first. Repeated rows and further
columns, whatever their names, are kept as they are, but for columns named like a result
(`ids` and the one for decoded texts), which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import map_arrow, others

MARK = "▁"
NONE = np.int64(1 << 40)
FREE = 1 << 21  # symbols from here on are code points without a piece


class MergeTable:
    """The vocabulary as symbol ids, pair ranks and decoded pieces."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.end = model.eos_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        pieces = [model.id_to_piece(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece crosses a word start; segments can't be encoded apart")
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.char = {c: ids.get(c, FREE + ord(c)) for p in ids for c in p}
        scores = sorted({model.get_score(i) for i in ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {p: rank_of[model.get_score(i)] for p, i in ids.items()}
        shared = [0] * len(scores)
        for r in rank.values():
            shared[r] += 1
        pairs: dict[int, tuple[int, int]] = {}
        early = set()  # pieces inside a piece that ranks before them: merged one at a time
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                for q in (a, b):
                    if q in ids and len(q) > 1 and rank[p] <= rank[q]:
                        early.add(ids[q])
                if (a in ids or len(a) == 1) and (b in ids or len(b) == 1):
                    left = ids.get(a, FREE + ord(a[0]))
                    pairs[left << 22 | ids.get(b, FREE + ord(b[0]))] = (rank[p], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        alone = np.zeros(size, dtype=bool)
        alone[list(early)] = True
        alone[[i for p, i in ids.items() if shared[rank[p]] > 1]] = True
        self.alone = alone
        text = []
        for i, p in enumerate(pieces):
            if model.is_control(i):
                text.append("")
            elif model.is_byte(i):
                b = int(p[3:5], 16)
                text.append(chr(b) if b < 128 else "")
            else:
                text.append(" ⁇ " if model.is_unknown(i) else p.replace(MARK, " "))
        self.text = pa.array(text, pa.string())
        self.high = np.full(size, -1, dtype=np.int64)  # bytes from 128 on
        self.high[self.byte[128:]] = np.arange(128, 256)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 22 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], -1)


def merge_rounds(table: MergeTable, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and the offsets of the words in it."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    distinct, at = np.unique(points, return_inverse=True)
    sym = np.array([table.char.get(chr(c), FREE + c) for c in distinct.tolist()], dtype=np.int64)[at]
    word = np.repeat(np.arange(len(words)), sizes)
    done_sym, done_word = [], []

    def pair_ranks(s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(s), NONE), np.full(len(s), -1, dtype=np.int64)
        if len(s) > 1:
            inside = np.flatnonzero(w[1:] == w[:-1])
            rank[inside], made[inside] = table.look(s[inside], s[inside + 1])
        return rank, made

    rank, made = pair_ranks(sym, word)
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        length = np.diff(np.r_[first, len(word)])
        least = np.minimum.reduceat(rank, first)
        busy = np.repeat(least < NONE, length)
        if not busy.all():
            done_sym.append(sym[~busy])
            done_word.append(word[~busy])
            sym, word, rank, made = sym[busy], word[busy], rank[busy], made[busy]
            length, least = length[least < NONE], least[least < NONE]
            if not len(sym):
                break
            first = np.r_[0, np.cumsum(length)[:-1]]
        cand = np.flatnonzero(rank == np.repeat(least, length))
        w = word[cand]
        new_word = np.r_[True, w[1:] != w[:-1]]
        # in a run of overlapping pairs every second one merges, from the left
        starts = np.r_[True, cand[1:] != cand[:-1] + 1] | new_word
        run = np.maximum.accumulate(np.where(starts, np.arange(len(cand)), 0))
        take = (np.arange(len(cand)) - run) % 2 == 0
        take &= ~table.alone[made[cand]] | new_word
        here = cand[take]
        sym[here] = made[here]
        keep = np.ones(len(sym), dtype=bool)
        keep[here + 1] = False
        place = np.cumsum(keep) - 1
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        here = place[here]
        touched = np.zeros(len(sym) + 1, dtype=bool)
        touched[here] = True
        touched[here - 1] = True  # of the first one: the spare last place
        near = np.flatnonzero(touched[:-1])
        near_next = np.minimum(near + 1, len(sym) - 1)
        same = (near_next > near) & (word[near] == word[near_next])
        rank[near], made[near] = NONE, -1
        near = near[same]
        rank[near], made[near] = table.look(sym[near], sym[near + 1])
    sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int64)
    word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
    order = np.argsort(word, kind="stable")
    sym, word = sym[order], word[order]
    free = np.flatnonzero(sym >= FREE)
    if len(free):
        codes = {c: table.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(sym[free] - FREE).tolist()}
        spread = np.ones(len(sym), dtype=np.int64)
        spread[free] = [len(codes[c]) for c in (sym[free] - FREE).tolist()]
        begin = np.cumsum(spread) - spread
        flat, word = np.repeat(sym, spread), np.repeat(word, spread)
        where = np.repeat(begin[free], spread[free]) + np.concatenate([np.arange(k) for k in spread[free].tolist()])
        flat[where] = np.concatenate([codes[c] for c in (sym[free] - FREE).tolist()])
        sym = flat
    return sym, np.searchsorted(word, np.arange(len(words) + 1))


class Encoder:
    """Encodes texts; remembers the ids of at most `remember` segments."""

    SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def __init__(self, table: MergeTable, remember: int = 400_000, batch_symbols: int = 1_000_000):
        self.table, self.remember, self.batch_symbols = table, remember, batch_symbols
        self.known: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Keys of the segments: a word stands for mark and word, MARK before a key for the rest of it as it is."""
        if MARK in text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            found = self.SEGMENT.findall((MARK + text).replace(" ", MARK))
            return [s[1:] if len(s) > 1 and s[0] == MARK != s[1] else MARK + s for s in found]
        lines = text.split("\n")
        out = lines[0].split(" ") if lines[0] else [MARK + MARK]
        for line in lines[1:]:
            out.append(MARK + "\n")
            if line:
                words = line.split(" ")
                words[0] = MARK + words[0]
                out += words
        return out

    def learn(self, new: list[str]) -> None:
        part, size = [], 0
        for word in new + [""]:
            if part and (not word or size + len(word) > self.batch_symbols):
                ids, at = merge_rounds(self.table, [k[1:] if k[0] == MARK else MARK + k for k in part])
                raw, at = ids.astype("<i4").tobytes(), (at * 4).tolist()
                self.known.update(zip(part, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
                part, size = [], 0
            part.append(word)
            size += len(word)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets, an end id after each text."""
        if len(self.known) > self.remember:
            self.known.clear()
        parts = [self.segments(t) if t else [] for t in texts]
        self.learn(list(set().union(*parts).difference(self.known)))
        end, known = np.int32(self.table.end).tobytes(), self.known
        raw = [b"".join([known[s] for s in p]) + end for p in parts]
        at = np.r_[0, np.cumsum([len(r) // 4 for r in raw])] if raw else np.zeros(1, np.int64)
        return np.frombuffer(b"".join(raw), dtype="<i4"), at.astype(np.int32)


def decode_flat(table: MergeTable, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts of id lists: pieces joined, byte runs read as UTF-8, the first space taken off."""
    pieces = pc.take(table.text, pa.array(ids, pa.int32()))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pieces), "")
    high = table.high[ids] if len(ids) else np.empty(0, np.int64)
    slow = np.unique(np.searchsorted(at, np.flatnonzero(high >= 0), side="right") - 1)
    out = joined.to_pylist()
    for k in slow.tolist():
        part, run = [], bytearray()
        for piece, value in zip(pieces[at[k] : at[k + 1]].to_pylist(), high[at[k] : at[k + 1]].tolist(), strict=True):
            if value >= 0:
                run.append(value)
                continue
            if run:
                part.append(run.decode("utf-8", "replace"))
                run = bytearray()
            part.append(piece)
        part.append(run.decode("utf-8", "replace"))
        out[k] = "".join(part)
    return pa.array([t[1:] if t.startswith(" ") else t for t in out], pa.string())


def encode(docs: DataFrame, model_path: str, text: str = "text", decoded: str | None = None, rows_at_once: int = 1500) -> DataFrame:
    """Adds `ids` (array<int>, the end id last) to docs and, if asked, a column with the decoded text."""
    stay = set(others(docs, ("ids", *((decoded.lower(),) if decoded else ()))))
    schema = T.StructType([f for f in docs.schema.fields if f.name in stay])
    kept = schema.names
    schema = T.StructType(schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = T.StructType(schema.fields + [T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = MergeTable(model_path)
        encoder = Encoder(table)
        for whole in batches:
            for k in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(k, rows_at_once)
                ids, at = encoder.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                if decoded:
                    columns.append(decode_flat(table, ids, at))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(docs, run, schema)


def op10_piece_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
