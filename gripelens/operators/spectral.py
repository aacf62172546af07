"""Spectral reduction of a weighted neighbour graph by orthogonal iteration.

The wanted coordinates are the leading eigenvectors of S = D^-1/2 W D^-1/2, W the
symmetric weights and D their sums.  Each round applies a Chebyshev polynomial of S, which
is large above the least wanted eigenvalue and small below, then makes the block of vectors
orthonormal and turns it to the eigenvectors of S within its span.  The polynomial is a
product of factors S - r, and a round is one job.  The driver sees three small matrices of
inner products, whose size is that of the block and not that of the graph.

Nodes are in blocks by their ids, and a block's edges and its part of the vectors are packed
in a row each.  For a product with S, a block sends to each block it has edges to the rows
that these end at, and no others: what moves is bounded by the edges, whatever the number of
blocks.  The edges of a block with many, because it has a hub, are dealt to parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.operators import skew
from gripelens.operators.ranking import with_row_index
from gripelens.operators.skew import large_keys, spread_join
from gripelens.session import free_finished_shuffles, materialise, materialise_with, release

COMPONENTS = 15
# Further vectors of a block; the more, the fewer rounds.
GUARD = 5
# Products with S in a round.
DEGREE = 8
TOLERANCE = 1e-4
ROUNDS = 60
# Blocks of nodes, and nodes in a block; beyond these there are more blocks.
BLOCKS = 32
BLOCK_NODES = 4096
# A block's edges are in a part for every so many times ``LARGE``.
PART_EDGES = 4


def _columns(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(n)]


def _normalised(graph: DataFrame) -> tuple[DataFrame, DataFrame, int, list]:
    """(edges (src, dst, w, src_at, dst_at), nodes (id, degree, n, at), number, large).

    Edges go in both directions, ``n`` at each node.  ``at`` counts the nodes from 0 in the
    order of their ids; ``large`` are the hubs.
    """
    pairs = graph.filter("src <> dst").select("src", "dst", F.col("weight").alias("w"))
    both = pairs.union(pairs.select(F.col("dst"), F.col("src"), "w"))
    sums = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"), F.count("*").alias("n"))
    sums, seen = materialise_with(sums, "sums", n=F.count("*"), ends=F.sum("n"))
    large = large_keys(sums, "id", seen["ends"] or 0)
    nodes = materialise(with_row_index(sums, ["id"], "at"), "nodes")
    release(sums)
    near = nodes.select(F.col("id").alias("src"), F.col("degree").alias("_a"), F.col("at").alias("src_at"))
    far = nodes.select(F.col("id").alias("dst"), F.col("degree").alias("_b"), F.col("at").alias("dst_at"))
    edges = spread_join(spread_join(both, near, "src", large), far, "dst", large)
    weight = F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))
    edges = edges.select("src", "dst", weight.alias("w"), "src_at", "dst_at")
    return materialise(edges, "edges"), nodes, seen["n"], large


# Blocks of nodes and their edges ------------------------------------------------


@dataclass
class Grid:
    """The graph in blocks of ``rows`` nodes.

    ``cells``: (block, part, size, others, counts, places, cols, w, heads, starts, own_counts,
    own_places), one row for each part of a block's edges; arrays of numbers as bytes.  The
    rows that it needs are ``places`` of the blocks ``others``, ``counts`` of each; an edge
    ends at number ``cols`` of these and weighs ``w``; edges are sorted by where they start,
    ``heads``, from ``starts`` on.  ``own_places`` start its edges to each of ``others``.
    ``sends``: (block, to, part, places): which of its rows a block sends to a part of
    another; None if each block has one part, for then it sends ``own_places``.
    ``nodes``: (block, ids).
    """

    cells: DataFrame
    sends: DataFrame | None
    nodes: DataFrame
    rows: int


_INTS = ("others", "counts", "places", "cols", "heads", "starts", "own_counts", "own_places")
_CELL = "block long, part long, size long, w binary, " + ", ".join(f"{c} binary" for c in _INTS)
_PARCEL = "to long, part long, sender long, x binary"


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _ints(column: pa.ChunkedArray, at: int = 0) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), np.int64)


def _matrix(column: pa.ChunkedArray, at: int, width: int) -> np.ndarray:
    """A block's rows, side by side."""
    return np.frombuffer(column[at].as_buffer()).reshape(width, -1)


def _grid(edges: DataFrame, nodes: DataFrame, total: int) -> Grid:
    rows = max(min(BLOCK_NODES, -(-total // BLOCKS)), 1)
    block = F.floor(F.col("at") / rows)
    parts = F.ceil(F.sum("n") / F.lit(PART_EDGES * skew.LARGE))
    blocks = nodes.groupBy(block.alias("block")).agg(parts.alias("parts"))
    blocks, seen = materialise_with(blocks, "blocks", most=F.max("parts"))
    placed = edges.select(
        F.floor(F.col("src_at") / rows).alias("block"), "dst", "w",
        (F.col("src_at") % rows).alias("row"), F.floor(F.col("dst_at") / rows).alias("other"), (F.col("dst_at") % rows).alias("place"),
    )
    if seen["most"] > 1:
        placed = placed.join(blocks, "block")
    else:
        placed = placed.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("long")
    placed = placed.select("block", part.alias("part"), "other", "row", "place", "w")

    def pack(group: pa.Table) -> pa.Table:
        row, other, place, w = (group.column(c).to_numpy() for c in ("row", "other", "place", "w"))
        order = np.argsort(row, kind="stable")
        needed, cols = np.unique(other * rows + place, return_inverse=True)
        others, counts = np.unique(needed // rows, return_counts=True)
        own = np.unique(other * rows + row)
        heads, starts = np.unique(row[order], return_index=True)
        _, own_counts = np.unique(own // rows, return_counts=True)
        block, at = group.column("block")[0].as_py(), group.column("part")[0].as_py()
        size = min(rows, total - block * rows)
        ints = (others, counts, needed % rows, cols[order], heads, starts, own_counts, own % rows)
        return pa.table(
            {"block": [block], "part": [at], "size": [size], "w": _bytes(w[order])}
            | {c: _bytes(x.astype(np.int64)) for c, x in zip(_INTS, ints)}
        )

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                others, counts, places = (_ints(batch.column(c), i) for c in ("others", "counts", "places"))
                to, at = (np.full(len(others), batch.column(c)[i].as_py()) for c in ("block", "part"))
                each = [p.tobytes() for p in np.split(places, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(others), pa.array(to), pa.array(at), pa.array(each, pa.binary())],
                    names=["block", "to", "part", "places"],
                )

    cells = materialise(placed.groupBy("block", "part").applyInArrow(pack, _CELL), "cells")
    sends = None
    if seen["most"] > 1:
        needs = cells.select("block", "part", "others", "counts", "places")
        sends = materialise(needs.mapInArrow(told, "block long, to long, part long, places binary"), "sends")
    release(blocks)
    packed = nodes.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return Grid(cells, sends, materialise(packed, "node blocks"), rows)


def _parcels(block: int, x: np.ndarray, to: np.ndarray, part: np.ndarray, places: list[np.ndarray]) -> pa.Table:
    """What a block sends: all of its rows to its own part 0, and those at ``places``."""
    each = [x.tobytes(), *(x[:, p].tobytes() for p in places)]
    return pa.table({
        "to": pa.array(np.append(block, to)), "part": pa.array(np.append(0, part)),
        "sender": pa.array(np.append(-1, np.full(len(to), block))), "x": pa.array(each, pa.binary()),
    })


def _shares(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where a block of one part sends which rows."""
    others, counts, places = (_ints(cell.column(c)) for c in ("others", "own_counts", "own_places"))
    return others, np.zeros(len(others), np.int64), np.split(places, np.cumsum(counts)[:-1])


def _landed(parcels: pa.Table, cell: pa.Table, width: int) -> tuple[np.ndarray | None, np.ndarray]:
    """(x, S x) of a block: x, if it is its part 0, and the sums over the edges of the part."""
    order = np.argsort(parcels.column("sender").to_numpy())
    came = [_matrix(parcels.column("x"), i, width) for i in order]
    own = came.pop(0) if parcels.column("sender")[order[0]].as_py() < 0 else None
    rows = np.concatenate(came, axis=1)
    cols, heads, starts = (_ints(cell.column(c)) for c in ("cols", "heads", "starts"))
    w = np.frombuffer(cell.column("w")[0].as_buffer())
    out = np.zeros((width, cell.column("size")[0].as_py()))
    for k in range(width):
        out[k, heads] = np.add.reduceat(rows[k].take(cols) * w, starts)
    return own, out


def _shifted(own: np.ndarray | None, ahead: np.ndarray, root: float) -> np.ndarray:
    """(S - root) / (1 - root) times x."""
    return (ahead if own is None else ahead - root * own) / (1.0 - root)


def _sent(grid: Grid, x: DataFrame, work: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """The parcels of the blocks, whose vectors ``work`` makes of the rows of a block in ``x``."""

    def run(rows: pa.Table, shares: pa.Table) -> pa.Table:
        if apart:
            to, part = (shares.column(c).to_numpy() for c in ("to", "part"))
            where = to, part, [_ints(shares.column("places"), i) for i in range(len(to))]
        else:
            where = _shares(shares)
        return _parcels(rows.column("block")[0].as_py(), work(rows), *where)

    apart = grid.sends is not None
    shares = grid.sends if apart else grid.cells.select("block", "others", "own_counts", "own_places")
    return x.groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(run, _PARCEL)


def _sums(grid: Grid, parcels: DataFrame, width: int, root: float) -> DataFrame:
    """(block, part, x, z): x and (S - root) / (1 - root) x by part; the latter are to be added."""

    def run(came: pa.Table, cell: pa.Table) -> pa.Table:
        if cell.num_rows:
            own, ahead = _landed(came, cell, width)
        else:  # no edge is in part 0
            own = _matrix(came.column("x"), 0, width)
            ahead = np.zeros(own.shape)
        x = pa.nulls(1, pa.binary()) if own is None else _bytes(own)
        to, part = (came.column(c).slice(0, 1) for c in ("to", "part"))
        return pa.table({"block": to, "part": part, "x": x, "z": _bytes(_shifted(own, ahead, root))})

    left, right = parcels.groupBy("to", "part"), grid.cells.groupBy("block", "part")
    return left.cogroup(right).applyInArrow(run, "block long, part long, x binary, z binary")


def _added(parts: pa.Table, width: int) -> np.ndarray:
    return np.sum([_matrix(parts.column("z"), i, width) for i in range(parts.num_rows)], axis=0)


def _factor(grid: Grid, parcels: DataFrame, width: int, root: float) -> DataFrame:
    """The parcels of (S - root) / (1 - root) times the vectors whose parcels are given."""
    if grid.sends is not None:
        return _sent(grid, _sums(grid, parcels, width, root), lambda parts: _added(parts, width))

    def run(came: pa.Table, cell: pa.Table) -> pa.Table:
        x = _shifted(*_landed(came, cell, width), root)
        return _parcels(cell.column("block")[0].as_py(), x, *_shares(cell))

    return parcels.groupBy("to").cogroup(grid.cells.groupBy("block")).applyInArrow(run, _PARCEL)


def _ahead(grid: Grid, parcels: DataFrame, width: int) -> DataFrame:
    """(block, x, z, g): the vectors, S times them, and their inner products X'X, X'Z, Z'Z."""

    def packed(block: int, x: np.ndarray, z: np.ndarray) -> pa.Table:
        g = np.stack([x @ x.T, x @ z.T, z @ z.T]).ravel()
        g = pa.ListArray.from_arrays(pa.array([0, len(g)], pa.int32()), pa.array(g))
        return pa.table({"block": [block], "x": _bytes(x), "z": _bytes(z), "g": g})

    def joined(parts: pa.Table) -> pa.Table:
        at = parts.column("part").to_pylist().index(0)
        x = _matrix(parts.column("x"), at, width)
        return packed(parts.column("block")[0].as_py(), x, _added(parts, width))

    def run(came: pa.Table, cell: pa.Table) -> pa.Table:
        return packed(cell.column("block")[0].as_py(), *_landed(came, cell, width))

    schema = "block long, x binary, z binary, g array<double>"
    if grid.sends is not None:
        return _sums(grid, parcels, width, 0.0).groupBy("block").applyInArrow(joined, schema)
    return parcels.groupBy("to").cogroup(grid.cells.groupBy("block")).applyInArrow(run, schema)


def _products(both: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'Z and Z'Z, added over the blocks."""
    sums = both.select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(3 * n * n)
    for row in sums.collect():  # three times the square of the block's width
        out[row["k"]] = row["v"]
    return tuple(out.reshape(3, n, n))


def _ritz(gram: np.ndarray, mixed: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by, values, residuals): X by is orthonormal and made of Ritz vectors, largest
    first; Z is S X."""
    size, axes = np.linalg.eigh((gram + gram.T) / 2)
    keep = size > 1e-12 * size.max()
    basis = axes[:, keep] / np.sqrt(size[keep])
    values, turn = np.linalg.eigh(basis.T @ ((mixed + mixed.T) / 2) @ basis)
    by, values = basis @ turn[:, ::-1], values[::-1]
    return by, values, np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", by, square, by) - values**2, 0.0))


def _roots(low: float) -> list[float]:
    """The roots of the Chebyshev polynomial on [-1, low], each far from those before."""
    left = (low - 1) / 2 + (low + 1) / 2 * np.cos(np.pi * (np.arange(DEGREE) + 0.5) / DEGREE)
    out = [left[0]]
    while len(out) < DEGREE:
        rest = [r for r in left if r not in out]
        out.append(max(rest, key=lambda r: float(np.prod(np.abs(r - np.array(out))))))
    return [float(r) for r in out]


def _first(grid: Grid, nodes: DataFrame, width: int) -> DataFrame:
    """(block, x): the root of the degrees, and draws by the hash of an id."""
    draws = [((F.xxhash64("id", F.lit(k)) % 1_000_003) / 1_000_003.0) for k in range(1, width)]
    rows = nodes.select(F.floor(F.col("at") / grid.rows).alias("block"), "at", F.array(F.sqrt("degree"), *draws).alias("x"))

    def pack(group: pa.Table) -> pa.Table:
        x = group.sort_by("at").column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"block": group.column("block").slice(0, 1), "x": _bytes(x.T)})

    return rows.groupBy("block").applyInArrow(pack, "block long, x binary")


def _unpacked(grid: Grid, both: DataFrame, by: np.ndarray, key: str) -> DataFrame:
    """(id, x0, x1, ...): the vectors times ``by``, a row for each node."""
    names = _columns("x", by.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = by.T @ _matrix(batch.column("x"), i, len(by))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *map(pa.array, x)], names=["id", *names])

    rows = both.select("block", "x").join(grid.nodes, "block").select("ids", "x")
    return rows.mapInArrow(run, ", ".join([f"id {key}", *(f"{c} double" for c in names)]))


def _turned(by: np.ndarray) -> Callable[[pa.Table], np.ndarray]:
    return lambda rows: by.T @ _matrix(rows.column("x"), 0, len(by))


def spectral_axes(
    graph: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """(rows (id, x0, x1, ...), axes (axis, eigenvalue, residual)) of (src, dst, weight).

    ``x0`` belongs to the eigenvalue 1 and only tells the degrees of a connected graph.
    Vectors have length one and are orthogonal; the entry of largest size is positive, of
    equal ones that of the smallest id.  ``residual`` is the length of S x - eigenvalue x,
    at most ``tolerance`` unless ``ROUNDS`` rounds do not reach it.  A graph of few nodes
    has as many axes as nodes; without edges there are none.
    """
    spark = graph.sparkSession
    free_finished_shuffles(spark)
    edges, nodes, total, _ = _normalised(graph)
    wanted = min(components + 1, total)
    n = min(wanted + GUARD, total)
    if not n:
        empty = nodes.select("id").limit(0)
        return empty, spark.createDataFrame([], "axis int, eigenvalue double, residual double")
    grid = _grid(edges, nodes, total)
    both, by, roots = None, np.eye(n), []
    vectors = _first(grid, nodes, n)
    for turn in range(ROUNDS):
        parcels = _sent(grid, vectors, _turned(by))
        n = by.shape[1]
        for root in roots:
            parcels = _factor(grid, parcels, n, root)
        last, both = both, materialise(_ahead(grid, parcels, n), "both")
        release(last)
        by, values, left = _ritz(*_products(both, n))
        n = len(values)
        if left[:wanted].max() <= tolerance or n == total:
            break
        vectors = both.select("block", "x")
        roots = _roots(min(max(float(values[-1]), -0.9), 0.999))
    wanted = min(wanted, n)
    names = _columns("x", wanted)
    block = materialise(_unpacked(grid, both, by[:, :wanted], nodes.schema["id"].dataType.simpleString()), "axes")
    release(both, edges, nodes, grid.cells, grid.sends, grid.nodes)
    sign = [F.max_by(F.signum(c), F.struct(F.round(F.abs(c), 9), -F.col("id"))).alias(c) for c in names]
    largest = block.agg(*sign).first()
    fixed = [(F.col(c) * F.lit(float(largest[c] or 1.0))).alias(c) for c in names]
    axes = [(k, float(values[k]), float(left[k])) for k in range(wanted)]
    return block.select("id", *fixed), spark.createDataFrame(axes, "axis int, eigenvalue double, residual double")


def reduce_graph(graph: DataFrame, components: int = COMPONENTS, key: str = "feedback_id") -> DataFrame:
    """(key, reduced): each node's coordinates on the axes after the first."""
    rows, _ = spectral_axes(graph, components)
    names = [c for c in rows.columns if c not in ("id", "x0")]
    return rows.select(F.col("id").alias(key), F.array(*names).cast("array<double>").alias("reduced"))


def axis_checks(graph: DataFrame, rows: DataFrame, axes: DataFrame) -> DataFrame:
    """(axis, eigenvalue, residual, overlap): recomputed from the whole result.

    ``residual``: length of S x - eigenvalue x.  ``overlap``: the largest inner product
    with another axis, or how far the length is from one.
    """
    edges, nodes, _, large = _normalised(graph)
    names = [c for c in rows.columns if c != "id"]
    rows = materialise(rows.join(nodes.select("id"), "id"), "axes")
    ends = spread_join(edges.select("src", "dst", "w"), rows.withColumnRenamed("id", "dst"), "dst", large)
    sums = [F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in names]
    ahead = ends.groupBy(F.col("src").alias("id")).agg(*sums)
    each = [F.struct(F.lit(k).alias("axis"), F.col(c).alias("x"), F.col(f"s{c}").alias("s")) for k, c in enumerate(names)]
    values = rows.join(ahead, "id").select(F.inline(F.array(*each)))
    values = values.join(F.broadcast(axes.select("axis", "eigenvalue")), "axis")  # a row for each axis
    off = F.col("s") - F.col("eigenvalue") * F.col("x")
    residual = values.groupBy("axis", "eigenvalue").agg(F.sqrt(F.sum(off * off)).alias("residual"))
    inner = [F.sum(F.col(a) * F.col(b)) - (1.0 if a == b else 0.0) for a in names for b in names]
    overlap = rows.agg(F.array(*inner).alias("g")).select(F.posexplode("g").alias("k", "v"))
    overlap = overlap.groupBy(F.floor(F.col("k") / len(names)).cast("int").alias("axis")).agg(F.max(F.abs("v")).alias("overlap"))
    return residual.join(overlap, "axis")
