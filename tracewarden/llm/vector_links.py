"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Unit vectors x, y at cosine c lie 2 - 2c apart (squared), so along a Gaussian direction they
differ by a normal variable of that variance.

* Counting. `projections` fixed directions are sorted. A query's window on each holds the
  others within the half-width that pairs at the least cosine meet with probability `meet`;
  windows are centred on the query. Pairs that meet in `count` windows or more, the largest
  number that keeps `recall` of pairs at the least cosine, are verified by their cosine in
  doubles.
* Who counts against whom. Windows of a fixed probability hold a fixed share of all vectors,
  so only vectors of one cell meet: a cell is a box of `axes` further projections, each cut
  into widths with a random shift, and `tables` of such boxes keep `cell_recall` of pairs at
  the least cosine. Axes, width and tables are those of least cost for this many vectors and
  for the distances in a bounded sample (`sample` vectors), so axes grow with the logarithm
  of the number of vectors, tables with a small power of it, and a cell holds about as many
  vectors at every size. A pair that shares cells of several tables counts in the first one.
* Large cells. Cells of one vector go nowhere. Cells of more than `tile` vectors are cut into
  blocks, of which each two meet, so no vector is left out and no task holds more than two
  blocks. Small cells go to tasks many at a time, which sort them all at once.

Equal vectors are one representative. A task returns, for each vector, its number of links
and one link that joins it to its part of the task's links: no list of pairs leaves a task.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
nor do vectors of different lengths. Repeated rows count as vectors; ties don't occur but
between equal ids, which both are kept if their component has that name. A null id can't be
a component's name. Columns named like a result are replaced; all others stay as they are,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import column, discard, materialise, mix, others, split_count
from tracewarden.llm.components import components

MOST_AXES, WIDTHS = 64, (1.0, 1.5, 2.0, 2.5, 3.0)
COPY_COST, PAIR_COST = 200.0, 0.5  # of sending a vector to a cell, and of counting it against another of the cell


def calibrate(projections: int, meet: float, recall: float) -> int:
    """The largest count that a binomial variable reaches with probability `recall`."""
    tail, count = 1.0, 0
    for k in range(projections + 1):
        tail -= math.comb(projections, k) * meet**k * (1 - meet) ** (projections - k)
        if tail < recall:
            break
        count = k + 1
    return max(1, count)


def half_width(meet: float, cosine: float) -> float:
    """P(|N(0, 2 - 2 cosine)| <= half-width) = meet."""
    lo, hi = 0.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < meet else (lo, mid)
    return lo * math.sqrt(2 - 2 * cosine)


def same_interval(distance: float, width: float) -> float:
    """Probability that two points this far apart lie in one interval of a randomly shifted direction."""
    if distance < 1e-9:
        return 1.0
    s = width / distance
    return math.erf(s / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


def plan_cells(total: int, distances: np.ndarray, cosine: float, recall: float) -> tuple[int, int, float]:
    """Axes, tables and width of least cost for `total` vectors whose pairs lie as far apart as the sample's."""
    share, edges = np.histogram(distances, bins=256, range=(0.0, 2.0))
    share = share / max(1, share.sum())
    mids = (edges[1:] + edges[:-1]) / 2
    best = (COPY_COST + PAIR_COST * total, 0, 1, 1.0)  # no axes: one cell of all vectors
    for width in WIDTHS:
        near = same_interval(math.sqrt(2 - 2 * cosine), width)
        far = np.array([same_interval(d, width) for d in mids.tolist()])
        for axes in range(1, MOST_AXES + 1):
            tables = math.ceil(math.log(1 - recall) / math.log(1 - near**axes))
            cost = tables * (COPY_COST + PAIR_COST * total * float((share * far**axes).sum()))
            best = min(best, (cost, axes, tables, width))
    return best[1:]


def unit_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the vectors, and for each length the rows and their unit vectors in doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    out = []
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return sizes, out


def cells_of(unit: np.ndarray, axes: int, tables: int, width: float, seed: int) -> np.ndarray:
    """The cell of each vector in each table, as a hash."""
    dim = unit.shape[1]
    out = np.empty((len(unit), tables), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng([seed, dim, 1, t])
        at = np.floor(unit @ (rng.standard_normal((dim, axes)) / width) + rng.random(axes)).astype(np.int64).view(np.uint64)
        h = np.full(len(unit), dim * 1_000_003 + t, np.uint64)
        for k in range(axes):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + at[:, k])
        out[:, t] = h
    return out.view(np.int64)


class Windows:
    """For the rows of many cells: rank in the cell and the window of ranks, per projection."""

    def __init__(self, unit: np.ndarray, cell: np.ndarray, start: np.ndarray, cosine: float, projections: int, meet: float, recall: float, seed: int):
        """Rows lie by cell; start is the first row of each row's cell."""
        axes = np.random.default_rng([seed, unit.shape[1], 0]).standard_normal((unit.shape[1], projections))
        # rounding must not narrow a window
        width, self.least = half_width(meet, cosine) + 1e-7, calibrate(projections, meet, recall)
        at = unit @ axes
        shape = (projections, len(unit))
        self.rank, self.lo, self.hi = (np.empty(shape, np.int32) for _ in range(3))
        gap = 4 * (float(np.abs(at).max(initial=0.0)) + width + 1)
        for j in range(projections):
            line = cell * gap + at[:, j]
            order = np.argsort(line, kind="stable")
            inv = np.empty(len(line), np.int64)
            inv[order] = np.arange(len(line))
            held = line[order]
            self.rank[j] = inv - start
            self.lo[j] = np.searchsorted(held, line - width, side="left") - start
            self.hi[j] = np.searchsorted(held, line + width, side="right") - start

    def often(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the window of a holds b, often enough; a and b broadcast."""
        count = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.int16)
        for rank, lo, hi in zip(self.rank, self.lo, self.hi, strict=True):
            r = rank[b]
            count += (r >= lo[a]) & (r < hi[a])
        return count >= self.least


def linked_rows(tile: np.ndarray, table: np.ndarray, side: np.ndarray, unit: np.ndarray, cells: np.ndarray, cosine: float, projections: int, meet: float, recall: float, seed: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile that are found and verified, each once. Rows lie by tile, then side.

    side is 0 or 1 for tiles of two blocks, whose rows meet those of the other side, and -1
    for tiles whose rows all meet each other. cells are the rows' cells in all tables, of which
    `table` is theirs here; pairs that share an earlier one have met there.
    """
    cut = np.flatnonzero(np.diff(tile)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(tile)]])
    sizes = ends - starts
    number = np.repeat(np.arange(len(starts)), sizes)
    windows = Windows(unit, number, np.repeat(starts, sizes), cosine, projections, meet, recall, seed)

    def met(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        before = np.zeros(np.broadcast_shapes(a.shape, b.shape), bool)
        for k in range(t):
            before |= cells[a, k] == cells[b, k]
        return before

    def verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, at_once * 8 // unit.shape[1])
        fine = [np.einsum("ij,ij->i", unit[a[k : k + step]], unit[b[k : k + step]]) >= cosine for k in range(0, len(a), step)]
        fine = np.concatenate(fine) if fine else np.zeros(0, bool)
        return a[fine], b[fine]

    small = (sizes <= 24) & (side[starts] < 0)
    for m in np.unique(sizes[small]).tolist():
        x, y = np.triu_indices(m, 1)
        for t in np.unique(table[starts[small & (sizes == m)]]).tolist():
            first = starts[small & (sizes == m) & (table[starts] == t)]
            step = max(1, at_once // max(1, len(x)))
            for k in range(0, len(first), step):
                at = first[k : k + step, None]
                a, b = (at + x).ravel(), (at + y).ravel()
                new = np.flatnonzero(~met(a, b, t))
                a, b = a[new], b[new]
                near = windows.often(a, b)
                yield verified(a[near], b[near])
    for a0, a1 in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        two = side[a0] >= 0
        middle = a0 + int(np.count_nonzero(side[a0:a1] == 0)) if two else a1
        members = np.arange(middle if two else a0, a1)
        step = max(1, at_once // max(1, len(members)))
        for k in range(a0, middle, step):
            q = np.arange(k, min(middle, k + step))
            near = ~met(q[:, None], members[None, :], int(table[a0]))
            if not two:
                near &= members[None, :] > q[:, None]
            if near.any():
                i, j = np.nonzero(near & windows.often(q[:, None], members[None, :]))
                yield verified(q[i], members[j])


def tile_links(cosine: float, projections: int, meet: float, recall: float, seed: int):
    """The function that handles the tiles of one task: per vector its links (weighted by copies) and a link towards its root."""

    def run(frame: pa.Table) -> pa.Table:
        rid, copies = (frame.column(c).to_numpy() for c in ("rid", "copies"))
        sizes, parts = unit_rows(frame.column("vec"))
        cells = np.array(frame.column("cells").combine_chunks().flatten().to_numpy(), np.int64).reshape(len(rid), -1)
        key = [frame.column(c).to_numpy() for c in ("t", "cell", "i", "j", "side")]
        out_rid, out_root, out_links = [], [], []
        for rows, unit in parts:
            order = np.lexsort([k[rows] for k in reversed(key)])
            rows, unit = rows[order], unit[order]
            t, cell, i, j, side = (k[rows] for k in key)
            new = np.zeros(len(rows), np.int64)
            new[1:] = (t[1:] != t[:-1]) | (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            found = list(linked_rows(np.cumsum(new), t, side, unit, cells[rows], cosine, projections, meet, recall, seed))
            a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            n, c = rid[rows], copies[rows]
            links = np.bincount(a, weights=c[b], minlength=len(rows)) + np.bincount(b, weights=c[a], minlength=len(rows))
            root = np.arange(len(rows))
            while len(a):
                before = root.copy()
                least = np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], least)
                np.minimum.at(root, root[b], least)
                root = root[root]
                if (before == root).all():
                    break
            some = links > 0
            out_rid.append(n[some])
            out_root.append(n[root[some]])
            out_links.append(links[some].astype(np.int64))
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in (("rid", out_rid), ("root", out_root), ("links", out_links))})

    return run


def with_cells(reps: DataFrame, axes: int, tables: int, width: float, seed: int) -> DataFrame:
    """reps with `cells`, the hash of the vector's cell in each table."""
    schema = T.StructType(reps.schema.fields + [T.StructField("cells", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.empty((batch.num_rows, tables), np.int64)
            for rows, unit in unit_rows(batch.column(batch.schema.get_field_index("vec")))[1]:
                cells[rows] = cells_of(unit, axes, tables, width, seed)
            lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, tables, dtype=np.int32), cells.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return reps.mapInArrow(run, schema)


def sampled_distances(reps: DataFrame, size: int) -> np.ndarray:
    """Distances of the pairs of a sample of at most `size` unit vectors of the commonest length."""
    rows = reps.select("vec").orderBy(F.xxhash64("vec")).limit(size).collect()
    if len(rows) < 2:
        return np.zeros(0)
    _, parts = unit_rows(pa.array([r["vec"] for r in rows], pa.list_(pa.float64())))
    x = max((p[1] for p in parts), key=len)
    cos = (x @ x.T)[np.triu_indices(len(x), 1)]
    return np.sqrt(np.maximum(0.0, 2 - 2 * cos))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cosine: float = 0.95, projections: int = 32, meet: float = 0.9, recall: float = 0.995, cell_recall: float = 0.99, sample: int = 1024, tile: int = 4096, rows_a_task: int = 16_384, seed: int = 7) -> DataFrame:
    """vectors without vec, with n_links, component_id and kept."""
    own = [c for c in others(vectors, ("n_links", "component_id", "kept")) if c != vec]
    kind = vectors.schema[vec].dataType
    whole = T.ArrayType(T.FloatType() if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.DoubleType())
    rows = vectors.select(F.struct(*map(column, own)).alias("row"), column(id_col).cast("long").alias("id"), column(vec).cast(whole).alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.coalesce((F.size("v") > 0) & ~odd & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    reps = rows.filter("v is not null").groupBy(F.col("v").alias("vec")).agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    plain = materialise(reps, "vectors")
    total = plain.count()
    axes, tables, width = plan_cells(total, sampled_distances(plain, sample), cosine, cell_recall)
    numbered = plain.withColumn("rid", F.monotonically_increasing_id())
    # numbers are written with their vectors, so that a lost executor can't number them anew
    reps = materialise(with_cells(numbered, axes, tables, width, seed), "cells")
    places = reps.select("rid", F.posexplode("cells").alias("t", "cell"))
    full = places.groupBy("t", "cell").agg(F.count("*").alias("c")).filter("c > 1")
    meets = materialise(places.join(full, ["t", "cell"]).groupBy("rid").agg(F.collect_list(F.struct("t", "cell", "c")).alias("meets")), "meets")
    half = max(1, tile // 2)
    blocks = F.when(F.col("m.c") > tile, F.ceil(F.col("m.c") / half)).otherwise(1).cast("int")
    dealt = reps.join(meets, "rid").select("rid", "copies", "vec", "cells", F.explode("meets").alias("m")).withColumn("blocks", blocks)
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("blk") == F.col("other"), -1).otherwise((F.col("blk") > F.col("other")).cast("int")).cast("int")
    dealt = dealt.select("rid", "copies", "vec", "cells", "m.t", "m.cell", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), side.alias("side"))
    sent = meets.select(F.explode("meets.c").alias("c")).agg(F.sum(F.when(F.col("c") > tile, F.ceil(F.col("c") / half)).otherwise(1))).first()[0]
    tasks = split_count(sent, rows_a_task)
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("t", "cell", "i", "j"), F.lit(tasks)))
    links = tile_links(cosine, projections, meet, recall, seed)
    found = dealt.repartition(tasks, "task").groupBy("task").applyInArrow(links, "rid long, root long, links long")
    found = materialise(found, "tiles")
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    placed = reps.select("rid", "vec", "least", "copies").join(counts, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "rid"))
    names = placed.groupBy("root").agg(F.min("least").alias("name"))
    placed = placed.join(names, "root").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "name")
    placed = materialise(placed, "placed")
    for table in (plain, reps, meets, found):
        discard(vectors.sparkSession, table)
    out = rows.join(placed, F.col("v") == F.col("vec"), "left")
    component = F.coalesce("name", "id")
    return out.select("row.*", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op7_collision_counting(spark, sf_dir: str) -> DataFrame:
    """Contract query: links and component of every vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return link_vectors(vectors)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x),
reach(x, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, reach.r FROM reach JOIN links l ON reach.x = l.x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.x JOIN (SELECT x, min(r) AS component_id FROM reach GROUP BY x) c ON e.vec_id = c.x
"""
