"""Exact distance searches over vectors in a tree of cells that Spark tables hold.

A cell with more points than a task should hold is split around at most ``FAN`` of its
own points, drawn by hash: each point goes to the nearest of these pivots.  Cells are
split round by round until all are small, so their number grows with the points and
their size does not.  Points of a leaf cell are packed into one row; the pivot, the
size and the distances from pivot to points are a table of cells.  Nothing of either
is on the driver.

A search starts with the pair (root, root) and replaces a pair of cells by the pairs of
their children, level by level.  The triangle inequality gives the least distance that
points of two cells can have; pairs beyond the needed radius are dropped, as are pairs
of cells whose points all carry the same mark.  Only the packed rows of the leaf pairs
that are left are joined and compared.  Few points are one leaf, the root itself.

For that, neighbouring leaf cells are groups, and a task compares one group with another:
a cell is sent once to each group that needs it and not to each cell.  The number of groups
is fixed until a group would not fit a task, so what is sent grows with the points.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gripelens.operators.ranking import with_row_index
from gripelens.session import materialise, materialise_with

FAN = 64
# Rows and bytes of vectors that a leaf cell holds at most.
CELL_ROWS = 2048
CELL_BYTES = 2 << 20
# Points of a cell that one task splits.
PART_ROWS = 8192
# Leaf cells that meet a cell in one task.
PARTNERS = 16
# Groups of leaf cells, and bytes of vectors in a group; beyond these there are more groups.
GROUPS = 8
GROUP_BYTES = 64 << 20
# Distances that are held at once.
SLICE = 1 << 20
PAIR_SLICE = 1 << 17
ROOT = "0"

_CELL = "cell string, parent string, n long, low double, high double, pivot_id {kind}, pivot array<double>"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as an (n, d) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1 or column.null_count or np.isnan(flat).any():
        raise ValueError("vectors must have one length and no nulls")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances; rounded, hence only for choosing candidates."""
    return np.maximum(
        np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * a @ b.T,
        0.0,
    )


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact distances of chosen pairs, the same in both directions."""
    out = np.empty(len(i))
    for start in range(0, len(i), PAIR_SLICE):
        s = slice(start, start + PAIR_SLICE)
        diff = a[i[s]] - b[j[s]]
        out[s] = np.sqrt(np.sum(diff * diff, axis=1))
    return out


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """How far rounded squared distances may be off."""
    largest = max(
        (float(np.einsum("ij,ij->i", m, m).max()) for m in (a, b) if len(m)), default=0.0
    )
    return 1e-12 * (1.0 + largest) * max(a.shape[1], 1)


def slices(rows: int, width: int) -> Iterator[slice]:
    """Pieces of ``rows`` whose product with ``width`` stays small."""
    step = max(1, SLICE // max(width, 1))
    for start in range(0, rows, step):
        yield slice(start, start + step)


def smallest_per_row(rows: np.ndarray, keys: list[np.ndarray], count: int) -> np.ndarray:
    """Positions of the ``count`` smallest entries of each row, by ``keys``."""
    order = np.lexsort([*reversed(keys), rows])
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(ordered)]]))
    place = np.arange(len(ordered)) - np.repeat(starts, lengths)
    return order[place < count]


# The tree -------------------------------------------------------------------


@dataclass
class CellTree:
    """Points by leaf cell, and the facts of all cells, as tables.

    ``packed``: (cell, ids, vecs, away, bound), one row for each leaf cell, its points by
    id and their vectors in a row.  ``away`` is a point's distance to the pivot of its
    cell, ``bound`` one within which it has ``near`` others (infinite if unknown).
    ``cells``: (cell, parent, n, low, high, pivot_id, pivot) of all cells but the root;
    all points of a cell are between ``low`` and ``high`` from its pivot.
    ``groups``: (cell, group) of the leaf cells; cells of a group are close in the tree.
    """

    packed: DataFrame
    cells: DataFrame
    groups: DataFrame
    kind: str
    split: bool


def cell_rows(dim: int) -> int:
    """Points that a leaf cell of vectors of this length may hold."""
    return max(min(CELL_ROWS, CELL_BYTES // (8 * max(dim, 1))), 4)


def build_cells(points: DataFrame, near: int = 0) -> CellTree:
    """A tree over ``points`` (id, vec); ids and vectors must be distinct.

    Which points become pivots affects only how much is pruned.
    """
    spark = points.sparkSession
    kind = points.schema["id"].dataType.simpleString()
    facts = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    rows = cell_rows(facts["dim"] or 1)
    open_ = points.select(
        "id", "vec", F.lit(ROOT).alias("cell"), F.lit(0.0).alias("away"), F.lit(float("inf")).alias("bound")
    )
    sizes = spark.createDataFrame([(ROOT, facts["n"])], "cell string, n long")
    state, leaves, levels = (facts["n"], 1), [], []
    turn = still = 0
    while state[0] > rows and still < 8:  # points that rounding cannot tell apart stay together
        turn += 1
        pivots = materialise(_drawn(open_, sizes, rows, turn), "pivots")
        split = materialise(_split(open_, pivots, state, near), "split")
        counts = split.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")
        )
        found, seen = materialise_with(
            counts, "sizes", largest=F.max("n"), many=F.count_if(F.col("n") > rows)
        )
        born = pivots.select(
            F.concat_ws(".", "cell", "at").alias("cell"), F.col("cell").alias("parent"),
            F.col("id").alias("pivot_id"), F.col("vec").alias("pivot"),
        )
        levels.append(born.join(found, "cell"))
        sizes = found.filter(F.col("n") > rows).select("cell", "n")
        leaves.append(split.join(sizes, "cell", "left_anti"))
        open_ = split.join(sizes, "cell", "left_semi")
        still = still + 1 if state == (seen["largest"], seen["many"]) else 0
        state = (seen["largest"], seen["many"])
    if state[0] > rows or not leaves:
        leaves.append(open_)
    every = leaves[0]
    for leaf in leaves[1:]:
        every = every.unionByName(leaf)
    packed, seen = materialise_with(
        every.groupBy("cell").applyInArrow(
            _pack, f"cell string, ids array<{kind}>, vecs array<double>, away array<double>, bound array<double>"
        ),
        "packed",
        n=F.count("*"),
    )
    groups = packed.select("cell", F.lit(0).cast("long").alias("group"))
    if levels:
        held = max(GROUP_BYTES // (8 * rows * max(facts["dim"], 1)), 1)
        held = min(-(-seen["n"] // GROUPS), held)
        places = with_row_index(packed.select("cell"), ["cell"], "place")
        groups = materialise(places.select("cell", F.floor(F.col("place") / held).alias("group")), "groups")
    cells = spark.createDataFrame([], _CELL.format(kind=kind))
    for level in levels:
        cells = cells.unionByName(level.select(cells.columns))
    cells = materialise(cells, "cells") if levels else cells
    return CellTree(packed, cells, groups, kind, bool(levels))


def _drawn(points: DataFrame, sizes: DataFrame, rows: int, turn: int) -> DataFrame:
    """(cell, at, id, vec): the pivots of each cell, those of its points that hash lowest.

    A hash threshold leaves about four times as many as are wanted, so that no cell is
    ranked as a whole.  A cell that draws fewer than two waits for the next round.
    """
    target = max(rows // 2, 1)
    unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 11).cast("double") * 2.0**-53
    wanted = F.least(F.lit(FAN), F.ceil(F.col("n") / target))
    most = 4 * (1 / target + 1 / rows)  # a threshold above those of all cells
    near = (
        points.select("cell", "id", "vec", unit.alias("unit"))
        .filter(F.col("unit") < most)
        .join(sizes, "cell")
        .filter(F.col("unit") < 4 * wanted / F.col("n"))
    )
    own = Window.partitionBy("cell")
    place = F.row_number().over(own.orderBy("unit", "id")) - 1
    ranked = near.withColumn("at", place).withColumn("drawn", F.count("*").over(own))
    return ranked.filter((F.col("at") < wanted) & (F.col("drawn") > 1)).select("cell", "at", "id", "vec")


def _split(points: DataFrame, pivots: DataFrame, state: tuple[int, int], near: int) -> DataFrame:
    """Points in the child cells of their nearest pivots.

    Cells of the first levels are few and large: they are dealt to several tasks, each
    with all pivots of the cell.
    """
    largest, many = state
    parts = max(1, min(-(-largest // PART_ROWS), (1 << 16) // max(many, 1)))
    left = points.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))

    def split(rows: pa.Table, around: pa.Table) -> pa.Table:
        rows = rows.drop(["part"])
        if not rows.num_rows or around.num_rows < 2:
            return rows
        around = around.sort_by("at")
        v, p = matrix(rows.column("vec")), matrix(around.column("vec"))
        kid, bound = np.empty(len(v), np.int64), rows.column("bound").to_numpy().copy()
        for s in slices(len(v), p.size):
            diff = v[s][:, None, :] - p[None, :, :]
            away = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
            kid[s] = np.argmin(away, axis=1)
            if near and len(p) > near:
                bound[s] = np.minimum(bound[s], np.partition(away, near, axis=1)[:, near])
        cell = rows.column("cell")[0].as_py()
        names = pa.array([f"{cell}.{at}" for at in around.column("at").to_pylist()])
        return pa.table(
            {
                "id": rows.column("id"),
                "vec": rows.column("vec"),
                "cell": names.take(pa.array(kid)),
                "away": pa.array(pair_distances(v, p, np.arange(len(v)), kid)),
                "bound": pa.array(bound),
            }
        )

    schema = points.select("id", "vec", "cell", "away", "bound").schema
    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(split, schema)


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("id").combine_chunks()

    def one(values: pa.Array | pa.ChunkedArray) -> pa.Array:
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    matrix(rows.column("vec"))
    return pa.table(
        {
            "cell": rows.column("cell").slice(0, 1),
            "ids": one(rows.column("id")),
            "vecs": one(rows.column("vec").combine_chunks().flatten()),
            "away": one(rows.column("away")),
            "bound": one(rows.column("bound")),
        }
    )


# Pairs of cells ---------------------------------------------------------------


def constant_facts(tree: CellTree, need: float) -> DataFrame:
    """Facts of the leaf cells with one radius for all, and no marks."""
    return tree.packed.select("cell", F.lit(need).alias("need"), *_no_marks())


def _no_marks() -> list[Column]:
    return [F.lit(0).cast("long").alias("low_mark"), F.lit(1).cast("long").alias("high_mark")]


def radius_facts(radii: DataFrame, radius: str = "radius") -> DataFrame:
    """Facts of leaf cells (cell, radius of each point as a list)."""
    return radii.select("cell", F.array_max(radius).alias("need"), *_no_marks())


def _families(tree: CellTree, facts: DataFrame) -> DataFrame:
    """(cell, kids): the children of each cell with their facts; a leaf is its own child.

    ``facts`` (cell, need, low_mark, high_mark) of the leaves are carried to all cells
    above: the largest need, the smallest and largest mark.
    """
    steps = F.split("cell", "[.]")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ".")
    )
    every = facts.select(F.explode(above).alias("cell"), "need", "low_mark", "high_mark").groupBy("cell")
    every = every.agg(F.max("need").alias("need"), F.min("low_mark").alias("low_mark"), F.max("high_mark").alias("high_mark"))
    inner = tree.cells.select("parent").distinct().select(F.col("parent").alias("cell"), F.lit(True).alias("inner"))
    known = tree.cells.join(every, "cell").join(inner, "cell", "left")
    kid = F.struct(
        "cell", F.col("inner").isNull().alias("leaf"), "pivot", "low", "high",
        F.coalesce("need", F.lit(float("-inf"))).alias("need"), "low_mark", "high_mark",
    )
    kids = known.select("parent", kid.alias("kid"))
    families = kids.groupBy(F.col("parent").alias("cell")).agg(F.sort_array(F.collect_list("kid")).alias("kids"))
    leaves = kids.filter("kid.leaf").select("kid.cell", F.array("kid").alias("kids"))
    return families.union(leaves)


def _kids(column: pa.Array) -> list[tuple]:
    """The children in each row of a batch: names, leaf, pivots, low, high, need, marks."""
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    name, leaf, pivot, *numbers = column.flatten().flatten()
    name = np.array(name.to_pylist(), object)
    leaf, pivot = leaf.to_numpy(zero_copy_only=False), matrix(pivot)
    numbers = [x.to_numpy(zero_copy_only=False) for x in numbers]
    return [tuple(x[a:b] for x in (name, leaf, pivot, *numbers)) for a, b in zip(ends[:-1], ends[1:])]


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of children that may hold points close enough."""
    for batch in batches:
        found: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in zip(_kids(batch.column("a_kids")), _kids(batch.column("b_kids"))):
            a_name, a_leaf, a_pivot, a_low, a_high, need, a_first, a_last = a
            b_name, b_leaf, b_pivot, b_low, b_high, _, b_first, b_last = b
            squares = squared_distances(a_pivot, b_pivot)
            away = np.sqrt(squares)
            least = away - a_high[:, None] - b_high[None, :]
            least = np.maximum(least, b_low[None, :] - away - a_high[:, None])
            least = np.maximum(least, a_low[:, None] - away - b_high[None, :])
            margin = 1e-6 * (1.0 + math.sqrt(max(float((p * p).sum(1).max()) for p in (a_pivot, b_pivot))))
            keep = (least <= (need + margin)[:, None]) & (need > -np.inf)[:, None]
            one = (a_first == a_last)[:, None] & (b_first == b_last)[None, :]
            keep &= ~(one & (a_first[:, None] == b_first[None, :]))
            i, j = np.nonzero(keep)
            for part, own in zip(found, (a_name[i], a_leaf[i], b_name[j], b_leaf[j])):
                part.append(own)
        columns = [np.concatenate(part) if part else np.zeros(0, object) for part in found]
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.tolist(), kind) for c, kind in zip(columns, kinds)], names=["a", "a_leaf", "b", "b_leaf"]
        )


def cell_pairs(tree: CellTree, facts: DataFrame) -> DataFrame:
    """(q_cell, p_cell): leaf pairs in which a point of q_cell may be within the need of
    q_cell of a point of p_cell; a cell is paired with itself as well.

    ``facts``: (cell, need, low_mark, high_mark) of the leaf cells.  A cell without a need
    asks nothing.  Two cells whose marks are all one and the same are no pair.
    """
    spark = tree.packed.sparkSession
    if not tree.split:
        return facts.filter("need IS NOT NULL AND low_mark <> high_mark").select(
            F.col("cell").alias("q_cell"), F.col("cell").alias("p_cell")
        )
    families = materialise(_families(tree, facts), "families")
    schema = "a string, a_leaf boolean, b string, b_leaf boolean"
    open_ = spark.createDataFrame([(ROOT, False, ROOT, False)], schema)
    first = families.select(F.col("cell").alias("a"), F.col("kids").alias("a_kids"))
    second = families.select(F.col("cell").alias("b"), F.col("kids").alias("b_kids"))
    done, left = None, 1
    while left:
        met = open_.select("a", "b").join(first, "a").join(second, "b").select("a_kids", "b_kids")
        pairs, seen = materialise_with(
            met.mapInArrow(_expanded, schema), "cell_pairs", left=F.count_if(~(F.col("a_leaf") & F.col("b_leaf")))
        )
        leaf = pairs.filter("a_leaf AND b_leaf").select(F.col("a").alias("q_cell"), F.col("b").alias("p_cell"))
        done = leaf if done is None else done.union(leaf)
        open_, left = pairs.filter("NOT (a_leaf AND b_leaf)"), seen["left"]
    return done


# Blocks -------------------------------------------------------------------------


@dataclass
class Block:
    """Points side by side: ids, vectors, and whatever else was joined to their cells."""

    ids: np.ndarray
    vec: np.ndarray
    more: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray | slice) -> Block:
        return Block(self.ids[at], self.vec[at], {k: v[at] for k, v in self.more.items()})

    def by_id(self) -> Block:
        """Points in ascending id order, so that row numbers break ties as ids do."""
        return self.take(np.argsort(self.ids, kind="stable"))


def blocks(table: pa.Table | pa.RecordBatch) -> list[Block]:
    """One block for each packed row."""
    out = []
    names = [n for n in table.schema.names if pa.types.is_list(table.schema.field(n).type) and n not in ("ids", "vecs")]
    for i in range(table.num_rows):
        ids = table.column("ids")[i].values.to_numpy(zero_copy_only=False)
        vec = table.column("vecs")[i].values.to_numpy().reshape(len(ids), -1)
        out.append(Block(ids, vec, {n: table.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names}))
    return out


def joined(parts: list[Block]) -> Block:
    return Block(
        np.concatenate([b.ids for b in parts]),
        np.concatenate([b.vec for b in parts]),
        {k: np.concatenate([b.more[k] for b in parts]) for k in parts[0].more},
    )


def dealt(tree: CellTree, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((q_cell, q_group, p_group), (of, part, cell, askers)): which cells a task compares.

    Each cell is in a side at most once for each group it meets; ``askers`` are the cells of
    the group ``of`` that ask the cell.
    """
    q_group, p_group = (tree.groups.toDF(f"{x}_cell", f"{x}_group") for x in "qp")
    met = pairs.join(q_group, "q_cell").join(p_group, "p_cell")
    right = met.groupBy(F.col("q_group").alias("of"), F.col("p_group").alias("part"), F.col("p_cell").alias("cell"))
    return met.select("q_cell", "q_group", "p_group").distinct(), right.agg(F.collect_list("q_cell").alias("askers"))


def search(
    tree: CellTree,
    pairs: DataFrame,
    reduce: Callable[[Block, Block], dict[str, np.ndarray]],
    schema: str,
    sides: DataFrame | None = None,
) -> DataFrame:
    """Run ``reduce(queries, points)`` for each q_cell against its p_cells, points by id.

    ``sides``: (cell, lists with a value for each point of the cell).  A task has the cells
    of one group that ask and those of another that are asked, so a cell's partners come in
    at most one part for each group.
    """
    rows = tree.packed.drop("away", "bound")
    if sides is not None:
        rows = rows.join(sides, "cell")
    left, right = dealt(tree, pairs)
    left = left.join(rows.withColumnRenamed("cell", "q_cell"), "q_cell")
    right = right.join(rows, "cell").drop("cell")
    # both sides stem from one table; renaming keeps their columns apart
    right = right.select(*[F.col(c).alias(f"p_{c}") for c in right.columns])

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return arrow.empty_table()
        p = p.rename_columns([c.removeprefix("p_") for c in p.column_names])
        partners = defaultdict(list)
        for at, askers in enumerate(p.column("askers").to_pylist()):
            for cell in askers:
                partners[cell].append(at)
        asked, last, points, out = blocks(p.drop(["askers"])), None, None, []
        for cell, block in zip(q.column("q_cell").to_pylist(), blocks(q)):
            if partners[cell] != last:
                last = partners[cell]
                points = joined([asked[at] for at in last]).by_id()
            found = reduce(block, points)
            out.append(pa.table({n: pa.array(found[n], arrow.field(n).type) for n in arrow.names}))
        return pa.concat_tables(out)

    arrow = _arrow_schema(schema)
    return left.groupBy("q_group", "p_group").cogroup(right.groupBy("p_of", "p_part")).applyInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
