"""Packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised once; only those longer than a sequence are cut. Pieces that fill a
sequence have one of their own. The others are dealt by a hash to regions of bounded size.
Several islands work on each region, each with a population of packings of all its pieces.
In a generation a child takes over whole well-filled bins of one parent; bins of the other
that share a document with them go, and the documents displaced are put in by best fit.
Fewer bins win, then fuller ones (the mean square of how full they are). Evolution goes on
while there may be fewer bins, until `patience` children in a row bring nothing better; where
there can't be fewer, `generations` make them fuller. After an epoch each island's elite packing migrates to the
next island of its region, where it joins the population. Bins of a region's best packing
that are full enough are final; documents of its other bins are dealt to new regions, and
evolve again, until few are left, which one last round packs.

Null and empty texts are the end id alone. Repeated rows and ids are packed each, by the
order of their rows; equal lengths are taken by that order, too. Strings of added tokens in
a text have the ids that the tokenizer gives them. Texts of any length are cut, never
dropped. An empty table gives no pieces. Bins are numbered uniquely, not densely. Columns
named like a result are replaced, all others stay with every piece, whatever their names.
"""

from __future__ import annotations

import json
import os
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewarden.llm.common import column, discard, materialise, others, split_count


#: How a tokenizer must normalise and split texts for its words to be handled one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class PartIds(dict):
    """part of a word (lower case) -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.model.tokenize
        self.numbers = [k.to_bytes(4, "little") for k in range(model.get_vocab_size(with_added_tokens=True))]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isalnum() and part.isascii() else part.encode().decode("latin-1").translate(self.byte_names)
        numbers = self.numbers
        self[part] = value = b"".join([numbers[t.id] for t in self.tokenize(shown)])
        return value


class TextIds:
    """Token ids of texts through a tokenizer, each distinct part of a word once.

    A tokenizer with the normaliser and the split above cuts texts of printable ASCII, Latin-1
    letters and ASCII white space at white space and into parts that are found here, which go
    straight to its BPE model. Other texts, those that hold the string of an added token, and
    all texts of any other tokenizer take its whole way: word by word, if its words don't
    depend on each other, so that each distinct word goes once.
    """

    PLAIN = re.compile("[\t-\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\t-\r\x20]+")

    def __init__(self, path: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", ())]
        split = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        self.by_word = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == split and not any(re.search(r"\s", t) for t in added)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.remember = remember
        self.parts = PartIds(self.model)
        self.words: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(g.ids, dtype="<u4").tobytes() for g in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then `end`."""
        if len(self.parts) > self.remember:
            self.parts.clear()
        if len(self.words) > self.remember:
            self.words.clear()
        last = end.to_bytes(4, "little")
        if not self.by_word:
            return [ids + last for ids in self.whole([t or "" for t in texts])]
        plain = [not t or (self.PLAIN.fullmatch(t) is not None and not self.added.search(t)) for t in texts]
        words = [None if p else t.encode("utf-8", "surrogatepass").split() for p, t in zip(plain, texts, strict=True)]
        new = list(set().union(*(w for w in words if w)).difference(self.words))
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            self.words.update(zip(some, self.whole([w.decode("utf-8", "replace") for w in some]), strict=True))
        part, word = self.parts.__getitem__, self.words.__getitem__
        return [b"".join(map(part, self.PART.findall(t.lower())) if p and t else map(word, w or ())) + last for t, p, w in zip(texts, plain, words, strict=True)]


PIECE = "piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, size: int, end: int = 0, text: str = "text", keep_ids: bool = False, rows_at_once: int = 1500) -> DataFrame:
    """One row per piece: the other columns of docs, piece, start, length, ids_crc32 and, if asked, ids."""
    own = [f for f in docs.schema.fields if f.name not in {text, "piece", "start", "length", "ids_crc32", "ids"}]
    schema = T.StructType(own + T._parse_datatype_string(PIECE).fields + ([T.StructField("ids", T.BinaryType())] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TextIds(path)
        for whole in batches:
            for k in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(k, rows_at_once)
                row, piece, raw = [], [], []
                for i, ids in enumerate(ids_of.encode(batch.column(batch.schema.get_field_index(text)).to_pylist(), end)):
                    for p, a in enumerate(range(0, len(ids), 4 * size)):
                        row.append(i)
                        piece.append(p)
                        raw.append(ids[a : a + 4 * size])
                at = pa.array(row, pa.int64())
                columns = [batch.column(batch.schema.get_field_index(f.name)).take(at) for f in own]
                columns += [pa.array(piece, pa.int32()), pa.array([p * size for p in piece], pa.int64()), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                columns += [pa.array(raw, pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


class Packing:
    """Bins of one island. `room` has a bit for every free size that some bin has."""

    def __init__(self, size: int):
        self.size, self.bins, self.free = size, [], []
        self.room, self.by_free = 0, [[] for _ in range(size + 1)]

    def _note(self, b: int) -> None:
        self.by_free[self.free[b]].append(b)
        self.room |= 1 << self.free[b]

    def add_bin(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.free.append(free)
        self._note(len(self.bins) - 1)

    def best_fit(self, item: int, length: int) -> None:
        fits = self.room >> length
        if not fits:
            self.add_bin([item], self.size - length)
            return
        at = length + (fits & -fits).bit_length() - 1
        b = self.by_free[at].pop()
        if not self.by_free[at]:
            self.room &= ~(1 << at)
        self.bins[b].append(item)
        self.free[b] = at - length
        self._note(b)

    def fitness(self) -> float:
        """Mean square of how full the bins are."""
        return sum((1 - f / self.size) ** 2 for f in self.free) / max(1, len(self.free))


class Population:
    """Packings of the same pieces; the fittest comes first."""

    def __init__(self, lengths: list[int], size: int, rnd: random.Random):
        self.lengths, self.size, self.rnd, self.packs = lengths, size, rnd, []
        # pieces over half a bin have one each
        self.least = max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))
        self.crossovers = 0

    def fill(self, into: Packing, items: list[int]) -> Packing:
        for i in items:
            into.best_fit(i, self.lengths[i])
        return into

    def start(self, count: int) -> None:
        """Best fit by falling length, and the same with noise in the order."""
        for k in range(count):
            noise = 0.08 * k
            self.packs.append(self.fill(Packing(self.size), sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i] * (1 + noise * self.rnd.random()))))

    def add(self, bins: list[int]) -> None:
        """A packing that came from elsewhere, as the number of each piece's bin."""
        held: dict[int, list[int]] = {}
        for i, b in enumerate(bins):
            held.setdefault(b, []).append(i)
        pack = Packing(self.size)
        for items in held.values():
            pack.add_bin(items, self.size - sum(self.lengths[i] for i in items))
        self.packs.append(pack)

    def rank(self) -> None:
        self.packs.sort(key=lambda p: (len(p.bins), -p.fitness()))

    def solved(self) -> bool:
        """No packing can be better: as few bins as can be, and all but one of them full."""
        best = self.packs[0]
        return len(best.bins) <= self.least and sum(f > 0 for f in best.free) <= 1

    def cross(self, a: Packing, b: Packing) -> Packing:
        """Well-filled bins of b go into a; bins of a that share a piece with them go, as do some with room; best fit puts back what is displaced."""
        rnd, n = self.rnd, len(self.lengths)
        full = sorted(range(len(b.bins)), key=lambda k: (b.free[k], rnd.random()))
        child, placed = Packing(self.size), bytearray(n)
        for k in full[: max(1, len(full) // 2)]:
            if rnd.random() < 0.7:
                child.add_bin(list(b.bins[k]), b.free[k])
                for i in b.bins[k]:
                    placed[i] = 1
        kept = [k for k, items in enumerate(a.bins) if not any(placed[i] for i in items) and (a.free[k] <= self.size // 50 or rnd.random() < 0.8)]
        for k in kept:
            child.add_bin(list(a.bins[k]), a.free[k])
            for i in a.bins[k]:
                placed[i] = 1
        displaced = [i for i in range(n) if not placed[i]]
        noise = rnd.choice((0.0, 0.1, 0.5))
        self.crossovers += 1
        return self.fill(child, sorted(displaced, key=lambda i: -self.lengths[i] * (1 + noise * rnd.random())))

    def evolve(self, generations: int, patience: int = 0) -> None:
        """Each generation a child of two of the better packings replaces the worst, if it isn't worse itself. After `generations`, until `patience` of them in a row bring nothing better or bins can't be fewer."""
        self.rank()
        done = idle = 0
        while len(self.packs) > 1 and not self.solved() and (done < generations or (idle < patience and len(self.packs[0].bins) > self.least)):
            best = self.packs[0]
            a, b = self.rnd.sample(self.packs[: max(2, len(self.packs) - 1)], 2)
            self.packs.append(self.cross(a, b))
            self.rank()
            self.packs.pop()
            done, idle = done + 1, idle + 1 if self.packs[0] is best else 0

    def bins_of(self, pack: Packing) -> list[int]:
        out = [0] * len(self.lengths)
        for b, items in enumerate(pack.bins):
            for i in items:
                out[i] = b
        return out


ISLAND = "region long, island int, uid array<long>, length array<long>, packs array<array<int>>, first_bins int, bins int, fitness double, crossovers int"


def evolve_islands(islands: DataFrame, size: int, generations: int, population: int, seed: int, patience: int = 0) -> DataFrame:
    """One epoch of every island; `guest` is the elite packing that has migrated to it."""
    kind = to_arrow_schema(T._parse_datatype_string(ISLAND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                there = Population(r["length"], size, random.Random(f"{seed}:{r['region']}:{r['island']}"))
                for bins in (r["packs"] or []) + ([r["guest"]] if r["guest"] else []):
                    there.add(bins)
                if not there.packs:
                    there.start(population)
                    r["first_bins"] = len(there.packs[0].bins)
                there.evolve(generations, patience)
                best = there.packs[0]
                packs = [there.bins_of(p) for p in there.packs[:population]]
                out.append(r | {"packs": packs, "bins": len(best.bins), "fitness": best.fitness(), "crossovers": (r["crossovers"] or 0) + there.crossovers})
            yield pa.RecordBatch.from_pylist([{f: o[f] for f in kind.names} for o in out], kind)

    return islands.mapInArrow(run, ISLAND)


def evolve_regions(pieces: DataFrame, size: int, region: int, islands: int, epochs: int, generations: int, population: int, seed: int, patience: int = 0) -> DataFrame:
    """The last state of all islands. Islands of a region hold the same pieces; after each epoch their elites move on to the next island."""
    total = pieces.count()
    regions = split_count(total, region, 1)
    dealt = pieces.withColumn("region", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(regions)))
    # a region has about `region` pieces, whatever their number
    rows = dealt.groupBy("region").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("order"), "uid", "length"))).alias("p"))
    first = rows.select("region", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("p.uid").alias("uid"), F.col("p.length").alias("length"))
    blank = {"packs": "array<array<int>>", "first_bins": "int", "bins": "int", "fitness": "double", "crossovers": "int", "guest": "array<int>"}
    state = first.select("*", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    # one island a task as far as 200 tasks go
    now = materialise(evolve_islands(state.repartition(max(1, min(regions * islands, 200)), "region", "island"), size, generations, population, seed, patience), "islands")
    for epoch in range(1, epochs if islands > 1 else 1):
        guests = now.select("region", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.element_at("packs", 1).alias("guest"))
        after = materialise(evolve_islands(now.join(guests, ["region", "island"]), size, generations, population, seed + 1000 * epoch, patience), "islands")
        discard(pieces.sparkSession, now)
        now = after
    return now


def placed_pieces(state: DataFrame, size: int) -> DataFrame:
    """(uid, length, sequence_id, offset, free) by the best packing of each region."""
    best = state.groupBy("region").agg(F.min_by(F.struct("uid", "length", F.element_at("packs", 1).alias("pack")), F.struct("bins", -F.col("fitness"), "island")).alias("b"))
    schema = "uid long, length long, sequence_id long, offset long, free long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                uid, length, pack = np.array(r["uid"]), np.array(r["length"]), np.array(r["pack"])
                order = np.argsort(pack, kind="stable")
                uid, length, pack = uid[order], length[order], pack[order]
                first = np.flatnonzero(np.r_[True, pack[1:] != pack[:-1]])
                sizes = np.diff(np.r_[first, len(pack)])
                before = np.cumsum(length) - length
                total = np.repeat(np.add.reduceat(length, first), sizes)
                # the least uid of its pieces names the bin, so no two bins of any round have the same name
                name = np.repeat(np.minimum.reduceat(uid, first), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (uid, length, name, before - np.repeat(before[first], sizes), size - total)], names=["uid", "length", "sequence_id", "offset", "free"])

    return best.select("b").mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int, region: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 4, population: int = 8, rounds: int = 3, settled: float = 0.995, patience: int = 32) -> DataFrame:
    """uid, sequence_id and offset of pieces (uid long, length long), which must be a table that reads the same again."""
    spark = pieces.sparkSession
    whole = pieces.filter(F.col("length") >= size).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < size).select("uid", "length")
    total = left.count()
    placed, tables = whole, []
    for n in range(rounds):
        if not total:
            break
        last = n == rounds - 1 or total <= region
        state = evolve_regions(left, size, region, islands, epochs, generations, population, n, patience)
        out = materialise(placed_pieces(state, size), "packed")
        discard(spark, state)
        final = F.lit(True) if last else F.col("free") <= int(size * (1 - settled))
        placed = placed.unionByName(out.filter(final).select("uid", "sequence_id", "offset"))
        tables.append(out)
        if last:
            break
        left = out.filter(~final).select("uid", "length")
        total = left.count()
    result = materialise(placed, "placed")
    for table in tables:
        discard(spark, table)
    return result


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end: int = 0, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of docs with sequence_id and offset; `keep_ids` adds the ids (unsigned, little-endian, 32 bits)."""
    made = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(("ids",) if keep_ids else ()))
    own = [c for c in others(docs, made) if c != text]
    rows = docs.select(F.struct(*map(column, own)).alias("row"), column(text).alias("text")) if own else docs.select(F.lit(None).cast("int").alias("row"), column(text).alias("text"))
    # numbers are written with their pieces, so that a lost executor can't number them anew
    pieces = materialise(cut_pieces(rows, path, size, end, keep_ids=keep_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("uid", "length"), size)
    return pieces.join(placed, "uid").select(*(["row.*"] if own else []), *made)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: every piece of every document with its place."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
