"""Embedding near-dedup: an exact range join of unit vectors under the Euclidean metric.

cosine(x, y) >= t is |x' - y'| <= r with x', y' scaled to length one and r = sqrt(2 - 2t).

1. Equal vectors are one class with a count.
2. Pivots, a bounded sample of the classes, cut space into cells by the nearest pivot. The triangle
   inequality in its Euclidean form sets what is replicated over a boundary: x of cell i can have a
   partner in cell j only if it lies within r of the plane halfway between the pivots,
   (|x - pj|^2 - |x - pi|^2) / (2 |pi - pj|) <= r.
   Of two cells the one with the smaller number takes the replicas, so each pair meets in one cell.
3. Cells join independently. A cell's own vectors and its replicas are dealt in blocks, each pair of
   blocks a task, so that a task's size is bounded however many vectors a cell holds; vectors travel
   packed, many in a row. Candidates come from a product in single precision with a margin; each is
   decided in double precision on the vectors as given.
4. A task gives counts and a spanning forest of its links, not pairs; forests are merged to
   components.

How much is replicated depends on the data: clustered vectors stay in few cells, while nothing
within r of all planes can be pruned by any pivot.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do vectors of different lengths with each other; they stand alone. Rows with a null
vec_id are returned with no links, a null component_id and kept, and count for no one. Repeated
rows are vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .scratch import materialize

COSINE = 0.9
#: Vectors of a cell that pivots aim at, pivots at most, and rows of a block.
CELL_ROWS = 4096
PIVOTS = 4096
#: Cells at least, so that small tables are joined the same way.
LEAST_CELLS = 16
BLOCK_ROWS = 8192
#: What single precision may be off by.
MARGIN = 1e-4


def levelled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to about 1: norms and products of any
    finite vectors then neither over- nor underflow, and cosines stay the same to the last bit."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _cells(batch: pa.RecordBatch, by_dim: dict, radius: float):
    """For the vectors of each length: (length, rows, vectors, (row, cell) pairs, home cells)."""
    lists = batch.column("vec")
    dims = np.asarray(lists.value_lengths())
    for dim in np.unique(dims):
        on = np.flatnonzero(dims == dim)
        raw = np.asarray(lists.take(pa.array(on)).flatten(), np.float64).reshape(-1, dim)
        unit = levelled(raw)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        base, points = by_dim.get(int(dim), (0, unit[:1]))
        points = levelled(points)
        points = points / np.linalg.norm(points, axis=1, keepdims=True)
        gap = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))
        for lo in range(0, len(raw), 2048):
            square = np.maximum(2 - 2 * unit[lo : lo + 2048] @ points.T, 0)
            row = np.arange(len(square))
            home = square.argmin(axis=1)
            near = square - square[row, home][:, None] <= 2 * radius * gap[home] + 1e-9
            near &= np.arange(len(points))[None, :] < home[:, None]
            yield int(dim), on[lo : lo + 2048], raw[lo : lo + 2048], np.argwhere(near) + [0, base], home + base


def _sizes(pivots, radius: float):
    """How many vectors each cell has of its own, and by replication."""

    def scan(batches):
        for batch in batches:
            for dim, _, _, near, home in _cells(batch, pivots.value, radius):
                for own, cells in ((True, home), (False, near[:, 1])):
                    cell, n = np.unique(cells, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"dim": np.full(len(cell), dim, np.int64), "cell": cell.astype(np.int64), "own": np.full(len(cell), own), "n": n.astype(np.int64)})

    return scan


def _deal(pivots, radius: float, blocks: dict):
    """Vectors packed by task: (dim, cell, x, y, replicas, side, reps, copies, vecs, wide)."""
    known = blocks

    def scan(batches):
        for batch in batches:
            reps, copies = np.asarray(batch.column("rep")), np.asarray(batch.column("copies"))
            for dim, on, raw, near, home in _cells(batch, pivots.value, radius):
                wide = bool((raw.astype(np.float32) != raw).any())
                flat = raw if wide else raw.astype(np.float32)
                salt = tx.mix(np.ascontiguousarray(reps[on]).view(np.uint64))
                row = np.concatenate((np.arange(len(on)), near[:, 0]))
                cell = np.concatenate((home, near[:, 1]))
                own = np.arange(len(row)) < len(on)
                out = []
                for c in np.unique(cell):
                    mine, replicas = (known.value.get((dim, int(c), o), 1) for o in (True, False))
                    for o, parts in ((True, mine), (False, replicas)):
                        rows = row[(cell == c) & (own == o)]
                        part = salt[rows] % np.uint64(parts)
                        for k in range(parts):
                            chosen = rows[part == k]
                            if not len(chosen):
                                continue
                            pack = (reps[on][chosen].tobytes(), copies[on][chosen].tobytes(), flat[chosen].tobytes(), wide)
                            if o:
                                tasks = [(k, y, False, 0) for y in range(k, mine)] + [(x, k, False, 1) for x in range(k)] + [(k, y, True, 0) for y in range(replicas if (dim, int(c), False) in known.value else 0)]
                            else:
                                tasks = [(x, k, True, 1) for x in range(mine)]
                            out += [(dim, int(c), *t, *pack) for t in tasks]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), TASK.types, strict=True)], schema=TASK)

    return scan


TASK = pa.schema([("dim", pa.int64()), ("cell", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("replicas", pa.bool_()), ("side", pa.int32()), ("reps", pa.binary()), ("copies", pa.binary()), ("vecs", pa.binary()), ("wide", pa.bool_())])


def _unpack(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    reps, copies = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("reps", "copies"))
    vecs = [np.frombuffer(v, np.float64 if w else np.float32).astype(np.float64) for v, w in zip(table["vecs"].to_pylist(), table["wide"].to_pylist(), strict=True)]
    return reps, copies, (np.concatenate(vecs) if vecs else np.zeros(0)).reshape(-1, dim)


def _join(cosine: float):
    """Links between the left rows and the right rows of one pair of blocks."""

    def task(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        alone = not table["replicas"][0].as_py() and table["x"][0].as_py() == table["y"][0].as_py()
        left = _unpack(table.filter(pa.compute.equal(table["side"], 0)), dim)
        right = left if alone else _unpack(table.filter(pa.compute.equal(table["side"], 1)), dim)
        (ra, ca, a), (rb, copies, b) = left, right
        a, b = levelled(a), levelled(b)
        la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        ua, ub = (a / la[:, None]).astype(np.float32), (b / lb[:, None]).astype(np.float32)
        links, back = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
        parent = list(range(len(ra)))
        owner = np.full(len(rb), -1, np.int64)  # a left row that each right row is linked with
        if alone:
            owner = np.arange(len(rb))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for lo in range(0, len(ra), 512):
            begin = lo if alone else 0
            flat = np.flatnonzero(ua[lo : lo + 512] @ ub[begin:].T >= np.float32(cosine - MARGIN))
            i, j = lo + flat // max(len(ub) - begin, 1), begin + flat % max(len(ub) - begin, 1)
            if alone:
                i, j = i[i < j], j[i < j]
            real = np.zeros(len(i), bool)
            for k in range(0, len(i), 50_000):
                x, y = i[k : k + 50_000], j[k : k + 50_000]
                real[k : k + 50_000] = np.einsum("ij,ij->i", a[x], b[y]) / (la[x] * lb[y]) >= cosine
            i, j = i[real], j[real]
            links += np.bincount(i, copies[j], len(ra)).astype(np.int64)
            back += np.bincount(j, ca[i], len(rb)).astype(np.int64)
            heads = np.flatnonzero(np.diff(i, prepend=-1))
            for s, e in zip(heads, np.append(heads, len(i))[1:], strict=True):
                x, mine = int(i[s]), j[s:e]
                known = owner[mine]
                for y in np.unique(known[known >= 0]).tolist():
                    p, q = find(x), find(y)
                    parent[max(p, q)] = min(p, q)
                owner[mine[known < 0]] = x
        tree = np.array([find(x) for x in range(len(ra))], np.int64)  # a block may be empty
        on = np.flatnonzero(owner >= 0)
        root = np.full(len(ra), np.iinfo(np.int64).max)
        np.minimum.at(root, tree, ra)
        np.minimum.at(root, tree[owner[on]], rb[on])
        some, on = np.flatnonzero(links), np.flatnonzero(back)
        return pa.table({"rep": np.concatenate((ra[some], rb[on])), "links": np.concatenate((links[some], back[on])), "root": np.concatenate((root[tree[some]], root[tree[owner[on]]]))})

    return task


def embedding_components(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.expr("vec_id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    rows = materialize(rows.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    classes = materialize(rows.where("fine").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")

    # A bounded sample: as many pivots as cells are wanted, dealt to the lengths that occur.
    total = classes.count()
    wanted = max(min(LEAST_CELLS, max(total, 1)), min(PIVOTS, -(-total // cell_rows)))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vec").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vec"]), []).append(r["vec"])
    pivots, base = {}, 1
    for dim, points in sorted(by_dim.items()):
        pivots[dim] = (base, np.array(points, np.float64))
        base += len(points)
    shared = spark.sparkContext.broadcast(pivots)
    radius = float(np.sqrt(2 - 2 * cosine))
    sizes = classes.mapInArrow(_sizes(shared, radius), "dim long, cell long, own boolean, n long").groupBy("dim", "cell", "own").agg(F.sum("n").alias("n"))
    # A row for each pivot at most, twice, and for each length of vectors.
    blocks = spark.sparkContext.broadcast({(r["dim"], r["cell"], r["own"]): -(-r["n"] // block_rows) for r in sizes.collect()})
    dealt = classes.mapInArrow(_deal(shared, radius, blocks), "dim long, cell long, x int, y int, replicas boolean, side int, reps binary, copies binary, vecs binary, wide boolean")
    found = materialize(dealt.groupBy("dim", "cell", "x", "y", "replicas").applyInArrow(_join(cosine), "rep long, links long, root long"), "links")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.selectExpr("rep as a", "root as b")).withColumnRenamed("node", "rep")
    named = materialize(classes.join(counts, "rep", "left").join(roots, "rep", "left").selectExpr("vec", "coalesce(links, 0) + copies - 1 as n_links", "coalesce(root, rep) as component_id"), "named")
    good = rows.where("fine").join(named, "vec").select("vec_id", "n_links", "component_id")
    bad = rows.where("not fine").selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
