"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A text's set holds the hashes of its distinct runs of `width` words (lower-cased A-Z); with
fewer words, of the whole sequence. Equal sets form one class, and classes are joined:

1. Sets go out in blocks to parts of bounded size by their hashes. A part counts in how
   many classes each hash occurs and returns those that two classes or more share.
2. A class of n hashes of which fewer than the needed overlap t are shared can't link.
   The others order their hashes from rare to common. A pair that links shares at least l
   hashes among the first n - t + l of either (l: the less of the two classes' values), so
   each class lengthens its prefix, and asks for more shared hashes, as long as that lowers
   its estimated cost: postings read, plus verifications that l matches still let through.
3. Pairs are verified by whole sets. Classes first meet the centre of their prefix hashes;
   pairs inside a component found so are settled, since they change no component. All other
   pairs with enough shared prefix hashes are verified then, whatever their number: pairs
   of hashes with few classes one by one, and classes that hashes of many classes connect
   in tiles, which compare two blocks of whole sets at once.

Texts without words have empty sets and link with nothing, as do null texts. Texts of any
length go in whole. Repeated rows are members of one class. Hashes that tie in their number
of classes are ordered by value, which no link depends on. Rows with a null id are kept; a
component's id is the least non-null id among its members. An empty table gives an empty
table. Columns named like a result (n_shingles, class_id, component_id) are replaced, all
others kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import WordHashes, column, discard, materialise, others, part_names, part_of, split_count, window_hashes, word_bytes
from tracewarden.llm.components import components

PART_HASHES = 2_000_000  # hashes a part handles at once
MOST_MATCHES = 12
CENTRE_TURNS = 2
FEW, BLOCK = 64, 1024  # classes of a hash that pairs are listed for; classes of a block of a cluster


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = hashes.of(word_bytes(text))
    return np.unique(window_hashes(h, min(width, len(h)))) if len(h) else np.empty(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def class_rows(rows: DataFrame, width: int) -> DataFrame:
    """(row, id, n_shingles, class_id) of (row, id, text): the class is that of the set (null: empty)."""
    schema = T.StructType([rows.schema["row"], rows.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("class_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, classes = [], []
            for t in batch.column(2).to_pylist():
                s = shingle_set(t, width, hashes)
                sizes.append(len(s))
                classes.append(class_of(s) if len(s) else None)
                hashes.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], names=schema.names)

    return rows.select("row", "id", "text").mapInArrow(run, schema)


BLOCKS = "part long, classes binary, sizes binary, counts binary, hashes binary"


def deal_sets(docs: DataFrame, width: int, parts: int, text: str) -> DataFrame:
    """Blocks of sets for each part; a class goes out once a task."""

    def flush(classes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(sets)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        doc = np.repeat(np.arange(len(sets)), size)
        part = part_of(flat, parts)
        order = np.argsort(part, kind="stable")
        flat, doc, part = flat[order] >> np.uint64(16), doc[order], part[order]
        edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])
        run = np.diff(np.r_[edge, len(flat)]).astype("<u4")
        run_part, run_doc = part[edge], doc[edge]
        six = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        called = np.array(classes, dtype="<i8")
        out: list[list] = [[], [], [], [], []]
        present, first = np.unique(run_part, return_index=True)
        for p, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(run_part)], strict=True):
            lo, hi = edge[a], edge[b] if b < len(edge) else len(flat)
            row = (p, called[run_doc[a:b]].tobytes(), size[run_doc[a:b]].astype("<u4").tobytes(), run[a:b].tobytes(), np.ascontiguousarray(six[lo:hi]).tobytes())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=["part", "classes", "sizes", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        classes, sets, held = [], [], 0
        for batch in batches:
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                s = shingle_set(t, width, hashes)
                hashes.trim()
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                classes.append(c)
                sets.append(s)
                held += len(s)
                if held >= 1_500_000:
                    yield flush(classes, sets)
                    classes, sets, held = [], [], 0
        if sets:
            yield flush(classes, sets)

    return docs.select(text).mapInArrow(run, BLOCKS)


SHARED = "bucket long, classes binary, sizes binary, counts binary, hashes binary, found binary"


def shared_hashes(parts: int):
    """The function that keeps, of one part, what two classes or more share; dealt to as many buckets of classes."""
    _, subs = part_names(parts)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = np.uint64(frame["part"].iloc[0] // subs)
        classes = np.concatenate([np.frombuffer(b, "<i8") for b in frame["classes"]])
        size = np.concatenate([np.frombuffer(b, "<u4") for b in frame["sizes"]])
        run = np.concatenate([np.frombuffer(b, "<u4") for b in frame["counts"]]).astype(np.int64)
        raw = np.frombuffer(b"".join(frame["hashes"]), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        flat = wide.view("<u8").ravel() | part << np.uint64(48)
        del raw, wide
        _, first = np.unique(classes, return_index=True)  # a class may come from several tasks
        once = np.zeros(len(classes), dtype=bool)
        once[first] = True
        flat = flat[np.repeat(once, run)]
        classes, size, run = classes[once], size[once], run[once]
        doc = np.repeat(np.arange(len(classes), dtype=np.int32), run)
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        found = np.diff(np.r_[edge, len(flat)])
        each = np.repeat(found, found)
        keep = each > 1
        flat, doc, each = flat[keep], doc[keep], each[keep]
        bucket = (classes % parts)[doc]
        order = np.lexsort((doc, bucket))
        flat, doc, each, bucket = flat[order], doc[order], each[order], bucket[order]
        out = []
        names, first = np.unique(bucket, return_index=True)
        for b, lo, hi in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=False):  # nothing at all may be shared
            d = doc[lo:hi]
            at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            out.append((b, classes[d[at]].astype("<i8").tobytes(), size[d[at]].astype("<u4").tobytes(), np.diff(np.r_[at, len(d)]).astype("<u4").tobytes(), flat[lo:hi].astype("<u8").tobytes(), each[lo:hi].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["bucket", "classes", "sizes", "counts", "hashes", "found"])

    return run


def choose_matches(size: int, need: int, found: np.ndarray) -> tuple[int, int]:
    """The number l of matches asked for, and the length of that prefix among the shared hashes (rare first, counts `found`)."""
    alone = size - len(found)
    reach = np.minimum(np.maximum(size - need + np.arange(1, min(MOST_MATCHES, need) + 1) - alone, 0), len(found))
    read = np.r_[0, np.cumsum(found - 1)][reach]
    l = np.arange(1, len(reach) + 1)
    cost = read + size * (read / l)
    best = int(np.argmin(cost))
    return best + 1, int(reach[best])


PREPARED = "class_id long, n int, matches int, prefix array<long>, shared binary"


def prepare(numerator: int, denominator: int):
    """The function that turns a bucket into classes that may link: their shared hashes and prefixes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        classes = np.concatenate([np.frombuffer(b, "<i8") for b in frame["classes"]])
        size = np.concatenate([np.frombuffer(b, "<u4") for b in frame["sizes"]]).astype(np.int64)
        run = np.concatenate([np.frombuffer(b, "<u4") for b in frame["counts"]]).astype(np.int64)
        names, at, back = np.unique(classes, return_index=True, return_inverse=True)
        size = size[at]
        total = np.bincount(back, weights=run, minlength=len(names)).astype(np.int64)
        need = -(-numerator * size // denominator)
        may = total >= need
        doc = np.repeat(back, run)
        keep = may[doc]
        flat = np.concatenate([np.frombuffer(b, "<u8") for b in frame["hashes"]])[keep]
        found = np.concatenate([np.frombuffer(b, "<u4") for b in frame["found"]])[keep].astype(np.int64)
        doc = doc[keep]
        order = np.lexsort((flat, found, doc))
        flat, found, doc = flat[order], found[order], doc[order]
        out = []
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=False):
            k = doc[lo]
            l, reach = choose_matches(int(size[k]), int(need[k]), found[lo:hi])
            if reach:
                mine = flat[lo:hi].view(np.int64)
                out.append((int(names[k]), int(size[k]), l, mine[:reach].tolist(), np.sort(mine).tobytes()))
        return pd.DataFrame(out, columns=["class_id", "n", "matches", "prefix", "shared"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            out = []
            for x, y, n, m, s, t in zip(c["a"], c["b"], c["na"], c["nb"], c["sa"], c["sb"], strict=True):
                s, t = np.frombuffer(s, np.int64), np.frombuffer(t, np.int64)
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
                if denominator * both >= numerator * (n + m - both):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def fits(a: str, b: str, numerator: int, denominator: int):
    """Whether sizes a and b allow the similarity."""
    return (F.least(a, b) * denominator) >= (F.greatest(a, b) * numerator)


def linked_classes(docs: DataFrame, total: int, width: int, numerator: int, denominator: int, text: str, scratch: list[DataFrame]) -> DataFrame:
    """(node, root) of the classes that link with another. `scratch` gets the tables to delete when that is stored."""

    def keep(df: DataFrame, tag: str) -> DataFrame:
        scratch.append(materialise(df, tag))
        return scratch[-1]

    parts = split_count(total, PART_HASHES)
    blocks = deal_sets(docs, width, parts, text)
    shared = blocks.repartition(parts, "part").groupBy("part").applyInPandas(shared_hashes(parts), SHARED)
    ready = shared.repartition(parts, "bucket").groupBy("bucket").applyInPandas(prepare(numerator, denominator), PREPARED)
    ready = keep(ready, "sets")
    sets = ready.select("class_id", "n", "shared")
    index = ready.select(F.col("class_id").alias("c"), "n", "matches", F.explode("prefix").alias("h"))
    size = (numerator, denominator)

    def centre_links(entries: DataFrame, turn: int) -> DataFrame:
        """Each class against the centre of another component that it shares most prefix hashes with."""
        rank = F.struct(F.xxhash64("c", F.lit(turn)).alias("k"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
        centres = entries.groupBy("h").agg(F.min(rank).alias("lo"), F.max(rank).alias("hi")).filter("lo.b != hi.b")
        met = entries.join(centres, "h").select("c", "n", "root", F.explode(F.array("lo", "hi")).alias("o"))
        met = met.filter((F.col("o.rb") != F.col("root")) & fits("n", "o.nb", *size)).groupBy("c", F.col("o.b").alias("b")).agg(F.count("*").alias("k"))
        best = met.groupBy("c").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
        return verify(best.select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct(), sets, *size)

    def with_roots(links: DataFrame | None) -> DataFrame:
        if links is None:
            return index.withColumn("root", F.col("c"))
        roots = components(links).withColumnRenamed("node", "c")
        return index.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))

    links = None
    for turn in range(CENTRE_TURNS):
        new = centre_links(with_roots(links), turn)
        links = keep(new if links is None else links.unionByName(new), "links")
    entries = with_roots(links)
    mixed = entries.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo != hi").select("h", "size")
    entries = keep(entries.join(mixed, "h"), "open")
    few = entries.filter(F.col("size") <= FEW)
    one = few.select("h", F.col("c").alias("a"), F.col("n").alias("na"), F.col("matches").alias("la"), F.col("root").alias("ra"))
    two = few.select("h", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("matches").alias("lb"), F.col("root").alias("rb"))
    met = one.join(two, "h").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits("na", "nb", *size))
    # a pair that shares a hash of many classes, too, is among the tiles, so fewer matches than asked for mean nothing is lost
    rest = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.min(F.least("la", "lb")).alias("l")).filter("k >= l")
    links = links.unionByName(verify(rest, sets, *size)).unionByName(tile_links(entries.filter(F.col("size") > FEW), sets, *size))
    return components(links)


def tile_links(entries: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) that join what links among classes that share a hash of many classes.

    Classes that such hashes connect are a cluster; its classes are dealt to blocks, and each
    two blocks are compared in one task by counting common hashes of all their pairs in a
    matrix. No pair leaves the task but the links of a spanning forest.
    """
    stars = entries.groupBy("h").agg(F.min("c").alias("b")).join(entries.select("h", F.col("c").alias("a")), "h").select("a", "b").distinct()
    clusters = materialise(components(stars).select(F.col("node").alias("class_id"), F.col("root").alias("cluster")), "clusters")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class_id", F.lit(3)), F.col("blocks").cast("long")).cast("int")
    dealt = clusters.join(blocks, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("class_id", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("alone"))
    tiles = dealt.join(sets, "class_id").groupBy("cluster", "i", "j")

    def run(tile: pa.Table) -> pa.Table:
        side = np.array(tile.column("side").to_pylist())
        name = np.array(tile.column("class_id").to_pylist(), dtype=np.int64)
        n = np.array(tile.column("n").to_pylist(), dtype=np.int64)
        held = [np.frombuffer(s.as_py(), np.int64) for s in tile.column("shared")]
        left = np.flatnonzero(side == 0)
        right = left if tile.column("alone")[0].as_py() else np.flatnonzero(side == 1)
        both = common_counts([held[k] for k in left], [held[k] for k in right])
        hit = denominator * both >= numerator * (n[left][:, None] + n[right][None, :] - both)
        a, b = np.nonzero(hit)
        a, b = left[a], right[b]
        a, b = a[a != b], b[a != b]
        root = np.arange(len(name))
        while len(a):
            least, before = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            if (root == before).all():
                break
        some = np.flatnonzero(root != np.arange(len(name)))
        return pa.table({"a": pa.array(name[some], pa.int64()), "b": pa.array(name[root[some]], pa.int64())})

    return tiles.applyInArrow(run, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets: common elements in a matrix product, rare ones pair by pair."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if not len(left) or not len(right):
        return out
    names, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(map(len, left))
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    col = [at[:split], at[split:]]
    count = [np.bincount(c, minlength=len(names)) for c in col]
    many = count[0] * count[1] > 4000
    for lo in range(0, int(many.sum()), 1024):
        place = np.full(len(names), -1)
        chosen = np.flatnonzero(many)[lo : lo + 1024]
        place[chosen] = np.arange(len(chosen))
        dense = []
        for r, c, x in zip(row, col, (left, right), strict=True):
            m = np.zeros((len(x), len(chosen)), dtype=np.float32)
            k = place[c] >= 0
            m[r[k], place[c[k]]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    rare = ~many & (count[0] > 0) & (count[1] > 0)
    order = [np.argsort(c, kind="stable") for c in col]
    start = [np.cumsum(c) - c for c in count]
    chosen = np.flatnonzero(rare)
    for lo in range(0, len(chosen), 20_000):
        some = chosen[lo : lo + 20_000]
        a, b = count[0][some], count[1][some]
        total = a * b
        cell = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        wide = np.repeat(b, total)
        x = row[0][order[0][np.repeat(start[0][some], total) + cell // wide]]
        y = row[1][order[1][np.repeat(start[1][some], total) + cell % wide]]
        out += np.bincount(x * len(right) + y, minlength=out.size).reshape(out.shape)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """docs without text, with n_shingles, class_id and component_id (the least id reachable by links)."""
    own = [c for c in others(docs, ("n_shingles", "class_id", "component_id")) if c != text]
    docs = docs.select(F.struct(*map(column, own)).alias("row"), column(id_col).alias("id"), column(text).alias("text"))
    rows = materialise(class_rows(docs, width), "classes")
    classes = rows.filter("class_id is not null").groupBy("class_id").agg(F.min("id").alias("least"), F.max("n_shingles").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    scratch: list[DataFrame] = []
    roots = linked_classes(docs, total, width, numerator, denominator, "text", scratch)
    placed = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id")).select("class_id", "least", "root")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = materialise(placed.join(ids, "root").select("class_id", "component_id"), "placed")
    for table in scratch:
        discard(docs.sparkSession, table)
    out = rows.join(placed, "class_id", "left")
    return out.select("row.*", "n_shingles", "class_id", F.coalesce("component_id", "id").alias("component_id"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: set size and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, v FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS v FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach.r FROM reach JOIN edges e ON reach.x = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(r) AS component_id FROM reach GROUP BY x) c ON d.doc_id = c.x
"""
