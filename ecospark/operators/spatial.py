"""Spatial neighbours and autocorrelation on point tables ``id, x, y``.

Pairs within a radius come from a square grid of that size by an equi-join of cell numbers. All
other searches descend one balanced tree over the points (``packed_tree``): pairs of cells are
kept, or left out by bounds from their boxes, and the kept ones are replaced by the pairs of
their children, with one join per height. The tree follows the points, so neither dense
clusters nor stray points fill a cell; each height's pairs are checkpointed.

Neighbour searches join the pairs with ``families`` and lay out the children after it. Their tables are not
left to Spark's choice of a join: cell numbers take a byte or two a row in a file, so tables of
millions of rows look small enough to be broadcast, which builds them in the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.columns import ratio
from ..sources.tables import checkpointed
from .clean import first_per_key
from .joins import single_row
from .order import global_rank

SECTORS = 12
#: Rounding of a bound must not leave out a pair that an exact test would keep.
SLACK = 1e-9
#: Cells of a height that are sent to all tasks; beyond, they are exchanged.
SENT = 1024
BOX = ["x_lo", "x_hi", "y_lo", "y_hi"]


def points_of(df: DataFrame, id: str, x: str, y: str) -> DataFrame:
    """Points with distinct coordinates, the smallest id standing for its location."""
    rows = df.select(F.col(id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return first_per_key(rows.dropna("any"), ["x", "y"], ["id"]).select("id", "x", "y")


class _Grid:
    """Square cells over the extent of a point table."""

    def __init__(self, points: DataFrame) -> None:
        row = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).head()
        self.n = row[4]
        self.x0, self.y0 = row[0] or 0.0, row[1] or 0.0
        self.side = max(row[2] - row[0], row[3] - row[1]) or 1.0 if self.n else 1.0

    def cell(self, size: float, x="x", y="y") -> tuple[Column, Column]:
        return (
            F.floor((F.col(x) - F.lit(self.x0)) / F.lit(size)).cast("long"),
            F.floor((F.col(y) - F.lit(self.y0)) / F.lit(size)).cast("long"),
        )

    def placed(self, df: DataFrame, size: float) -> DataFrame:
        cx, cy = self.cell(size)
        return df.withColumns({"cx": cx, "cy": cy})

    def around(self, df: DataFrame, size: float) -> DataFrame:
        """Every row once per cell of its 3 x 3 block."""
        cx, cy = self.cell(size)
        shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        return df.withColumn("_s", F.explode(shifts)).withColumns({"cx": cx + F.col("_s.i"), "cy": cy + F.col("_s.j")}).drop("_s")


def _distance(ax="ax", ay="ay", bx="bx", by="by") -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def _named(df: DataFrame, p: str) -> DataFrame:
    return df.withColumnsRenamed({"id": f"{p}id", "x": f"{p}x", "y": f"{p}y"})


def band_edges(df: DataFrame, radius: float, id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """All pairs of points at most ``radius`` apart: ``src < dst, d``. A radius of zero gives the coincident points."""
    points = df.select(F.col(id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if radius <= 0:
        same = _named(points, "a").join(_named(points, "b"), (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")))
        return same.where((F.col("aid") < F.col("bid")) & F.lit(radius == 0)).select(
            F.col("aid").alias("src"), F.col("bid").alias("dst"), F.lit(0.0).alias("d"))
    grid = _Grid(points)
    left = grid.around(_named(points, "a").withColumnsRenamed({"ax": "x", "ay": "y"}), radius)
    left = left.withColumnsRenamed({"x": "ax", "y": "ay"})
    right = _named(grid.placed(points, radius), "b")
    pairs = left.join(right, ["cx", "cy"]).where(F.col("aid") < F.col("bid")).withColumn("d", _distance())
    return pairs.where(F.col("d") <= radius).select(F.col("aid").alias("src"), F.col("bid").alias("dst"), "d")


def near_cells(levels: list[DataFrame], kin: list[DataFrame], need) -> Iterator[tuple[int, DataFrame]]:
    """Per height, from a few cells down to the points: the cells b that points of a cell a must look at.

    ``need(height)`` nearest points, a point itself among them, lie within the distance at which the farthest
    corners of some cells enclose that many; cells that begin beyond it are left out. ``need`` must not
    grow downwards. Rows are ``a, b, near, reach``, and ``dx, dy``, twice the way between the middles of both boxes. A cell that
    spans empty space looks at many others, but such cells are few.
    """
    kept = _first_pairs(levels).withColumn("reach", F.lit(None).cast("double"))
    for height in _heights(levels):
        met = _families_met(kept, kin[height], kin[height], _above(levels, height)).select(
            "above", F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), F.col("b.cnt").alias("b_cnt"),
            _length(_gap, ".").alias("near"), _length(_span, ".").alias("far"), "reach",
            *[(F.col(f"b.{v}_lo") + F.col(f"b.{v}_hi") - F.col(f"a.{v}_lo") - F.col(f"a.{v}_hi")).alias(f"d{v}") for v in "xy"])
        # What enclosed the points of a cell encloses those of its children, so theirs do not look beyond.
        met = met.where(_within("reach")).drop("reach")
        # The children of a cell are in its task.
        enclosed = F.sum("b_cnt").over(Window.partitionBy("above", "a").orderBy("far", "b").rowsBetween(Window.unboundedPreceding, 0))
        reach = F.min(F.when(F.col("_sum") >= need(height), F.col("far"))).over(Window.partitionBy("above", "a"))
        bound = met.withColumn("_sum", enclosed).withColumn("reach", reach)
        kept = checkpointed(bound.where(_within("reach")).select("a", "b", "near", "reach", "dx", "dy"))
        yield height, kept
        kept = kept.select("a", "b", "reach")


def _within(reach: str) -> Column:
    return F.col(reach).isNull() | (F.col("near") <= F.col(reach) * (1 + SLACK))


def families(levels: list[DataFrame]) -> list[DataFrame]:
    """Per height of a search, its cells by the cell above them: ``cell, kids``. A root is the child of a cell 0."""
    return [checkpointed(_family(level, "cnt", *BOX)) for level in levels[:_heights(levels)[0] + 1]]


def _family(level: DataFrame, *columns: str) -> DataFrame:
    return level.groupBy(F.shiftright("cell", 2).alias("above")).agg(F.collect_list(F.struct("cell", *columns)).alias("kids")).withColumnRenamed("above", "cell")


def _heights(levels: list[DataFrame]) -> range:
    """Heights of a search, down to the points: the first has 64 cells or less."""
    return range(max(len(levels) - 4, 0), -1, -1)


def _first(levels: list[DataFrame]) -> Column:
    """The cells above those of the first height, up to 16; some may not exist."""
    return F.sequence(F.lit(0).cast("long"), F.lit(_above(levels, _heights(levels)[0]) - 1).cast("long"))


def _first_pairs(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].select(F.explode(_first(levels)).alias("a")).select("a", F.explode(_first(levels)).alias("b"))


def _above(levels: list[DataFrame], height: int) -> int:
    """The most cells that can be above those of a height."""
    return 4 ** max(len(levels) - 2 - height, 0)


def _joined(rows: DataFrame, table: DataFrame, on: str | list[str], few: bool = False, how: str = "inner") -> DataFrame:
    """A join that sends a table of few rows to all tasks, and exchanges any other."""
    return rows.join(F.broadcast(table) if few else table.hint("merge"), on, how)


def _families_met(pairs: DataFrame, kin_a: DataFrame, kin_b: DataFrame, cells: int) -> DataFrame:
    """Pairs of the children of both cells of a pair: ``above`` (the cell a), structs ``a, b`` of the children, the pair's other columns.

    They stay structs, as Spark takes seconds to plan a long condition on columns that are renamed. There are up to ``cells`` cells. A pair is few bytes and much work, so the number of tasks follows the cells.
    """
    more = [c for c in pairs.columns if c not in ("a", "b")]
    few, tasks = cells <= SENT, max(cells // 512, 8)
    met = _joined(pairs.repartition(tasks, "b"), kin_b.select(F.col("cell").alias("b"), F.col("kids").alias("_kb")), "b", few)
    met = _joined(met if few else met.repartition(tasks, "a"), kin_a.select(F.col("cell").alias("a"), F.col("kids").alias("_ka")), "a", few)
    met = met.select(F.col("a").alias("above"), *more, F.explode("_ka").alias("a"), "_kb")
    return met.select("above", *more, "a", F.explode("_kb").alias("b"))


def knn_edges(df: DataFrame, k: int, id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest neighbours of every point, ties to the smaller id: ``src, dst, d``. Fewer, if there are no more points."""
    levels = packed_tree(checkpointed(points_of(df, id, x, y)), "x")
    for _, kept in near_cells(levels, families(levels), lambda height: k + 1):
        pass
    names = levels[0].select("cell", "id")
    pairs = kept.where("a <> b").select("a", "b", F.col("near").alias("d"))
    pairs = pairs.join(names.withColumnsRenamed({"cell": "b", "id": "dst"}), "b")
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("d", "dst"))).where(F.col("_r") <= k)
    return ranked.join(names.withColumnsRenamed({"cell": "a", "id": "src"}), "a").select("src", "dst", "d")


def gabriel_edges(df: DataFrame, id: str = "id", x: str = "x", y: str = "y", around: int = 8) -> DataFrame:
    """Gabriel graph: pairs whose diametral disc holds no other point, ``src < dst, d``.

    A cell knows witnesses: one point in each of its ``around`` nearest cells or so, at most one per
    direction. A pair of cells is left out once a witness of either lies in the discs of all pairs
    of their points; for points that face each other across empty space, witnesses stand beside them on
    their own side. What is left at the height of points is tested against the tree, cell by cell.
    """
    levels = packed_tree(checkpointed(points_of(df, id, x, y)), "x")
    kin = families(levels)
    kept = _first_pairs(levels).where("a <= b")
    for height, near in near_cells(levels, kin, lambda height: (around + 1) << 2 * height):
        seen = checkpointed(_witnesses(near, levels[0], height))
        above = _above(levels, height)
        few = above <= SENT
        seeing = _family(_joined(levels[height], seen, "cell", few, "left"), *BOX, "seen")
        met = _families_met(kept, seeing, kin[height], above).where("a.cell <= b.cell").where(_unseen("a.seen"))
        met = met.select(F.struct("a.cell", *[f"a.{c}" for c in BOX]).alias("a"), "b", F.col("b.cell").alias("cell"))
        kept = _joined(met, seen, "cell", few, "left").where(_unseen("seen"))
        # The places of the points, in the end.
        kept = checkpointed(kept.select(
            F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), *[F.col(f"{p}.{v}_lo").alias(p + v) for p in "ab" for v in "xy" if not height]))
    return _empty_discs(levels, kin, kept.where("a <> b"))


def _unseen(seen: str) -> Column:
    return (F.col("a.cell") == F.col("b.cell")) | ~F.coalesce(F.exists(seen, _in_all_discs), F.lit(False))


def _sector(dx: Column, dy: Column) -> Column:
    turn = F.atan2(dy, dx) / F.lit(2 * math.pi) + F.lit(0.5)
    return F.least(F.floor(turn * SECTORS), F.lit(SECTORS - 1)).cast("int")


def _witnesses(near: DataFrame, points: DataFrame, height: int) -> DataFrame:
    """``cell, seen``: for each cell, a point of the nearest other cell in each direction."""
    dx, dy = F.col("dx"), F.col("dy")
    apart = F.struct((dx * dx + dy * dy).alias("d"), F.col("b"))
    nearest = near.where("a <> b").groupBy("a", _sector(dx, dy).alias("sector")).agg(F.min(apart).alias("_n"))
    # Points are numbered through, so cell c begins with point c 4^height.
    first = nearest.select(F.col("a"), F.shiftleft(F.col("_n.b"), 2 * height).alias("cell"))
    seen = _joined(first, points.select("cell", F.col("x_lo").alias("x"), F.col("y_lo").alias("y")), "cell")
    # At most one per sector.
    return seen.groupBy(F.col("a").alias("cell")).agg(F.collect_list(F.struct("x", "y")).alias("seen"))


def _in_all_discs(w: Column) -> Column:
    """Whether w lies in the disc of every pair: the largest (p - w)(q - w) of p in box a and q in box b is negative."""
    def most(v: str) -> Column:
        return F.greatest(*[(F.col(f"a.{v}_{i}") - w[v]) * (F.col(f"b.{v}_{j}") - w[v]) for i in ("lo", "hi") for j in ("lo", "hi")])

    return most("x") + most("y") < -SLACK * (_span("x", ".") * _span("x", ".") + _span("y", ".") * _span("y", "."))


def _empty_discs(levels: list[DataFrame], kin: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """Pairs of points without a point strictly inside the disc on their segment: ``src < dst, d``.

    The cells that a disc touches are followed down the tree; a pair ends where a whole cell lies inside.
    """
    ends = ["a", "b", "ax", "ay", "bx", "by"]
    touched = pairs.withColumn("cell", F.explode(_first(levels)))
    size = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2

    def of_disc(v: str, far: bool) -> Column:
        middle = (F.col(f"a{v}") + F.col(f"b{v}")) / 2
        low, high = F.col(f"{v}_lo") - middle, middle - F.col(f"{v}_hi")
        return F.greatest(F.abs(low), F.abs(high)) if far else F.greatest(low, high, F.lit(0.0))

    nearest, farthest = (4 * (of_disc("x", far) ** 2 + of_disc("y", far) ** 2) for far in (False, True))
    exact = ((F.col("x_lo") - F.col("ax")) ** 2 + (F.col("y_lo") - F.col("ay")) ** 2
             + (F.col("x_lo") - F.col("bx")) ** 2 + (F.col("y_lo") - F.col("by")) ** 2 < size)
    hits = []
    for height in _heights(levels):
        above = _above(levels, height)
        few, tasks = above <= SENT, max(above // 512, 8)
        met = _joined(touched if few else touched.repartition(tasks, "cell"), kin[height], "cell", few).select(*ends, F.explode("kids").alias("_k"))
        met = met.select(*ends, *[f"_k.{c}" for c in ("cell", *BOX)]).where(nearest <= size * (1 + SLACK))
        inside = farthest < size * (1 - SLACK) if height else exact & (F.col("cell") != F.col("a")) & (F.col("cell") != F.col("b"))
        met = met.select(*ends, "cell", inside.alias("_in")).withColumn("_hit", F.max("_in").over(Window.partitionBy("a", "b")))
        met = checkpointed(met.where(F.col("_in") | ~F.col("_hit")).drop("_in"))
        hits.append(met.where("_hit").select("a", "b"))
        touched = met.where(~F.col("_hit")).select(*ends, "cell")
    pairs = _joined(pairs, reduce(DataFrame.union, hits), ["a", "b"], how="left_anti")
    names = levels[0].select("cell", "id")
    for p, name in (("a", "one"), ("b", "two")):
        pairs = _joined(pairs, names.withColumnsRenamed({"cell": p, "id": name}), p)
    return pairs.select(F.least("one", "two").alias("src"), F.greatest("one", "two").alias("dst"), _distance().alias("d"))


def weights(edges: DataFrame) -> DataFrame:
    """Symmetric binary weights: each edge once per direction, ``src, dst, w``."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    return both.distinct().withColumn("w", F.lit(1.0))


def _test(n, s0, s1, s2, cross, m2, m4) -> dict[str, Column]:
    """Moran's I and its test under randomisation, from sums over points and weights."""
    i = ratio(n * cross, s0 * m2)
    expected = ratio(F.lit(-1.0), n - 1)
    b2 = ratio(F.col("_points") * m4, m2 * m2)
    spread = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    variance = ratio(spread, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected
    z = ratio(i - expected, F.sqrt(F.when(variance > 0, variance)))
    return {"i": i, "expected": expected, "variance": variance, "z": z, "p": normal.upper_tail(z)}


def moran(df: DataFrame, edges: DataFrame, col: str, id: str = "id") -> DataFrame:
    """Moran's I of a variable on binary symmetric neighbours, one-sided test, one row.

    ``n`` counts the points with a neighbour; the mean and the moments use all points.
    """
    values = df.select(F.col(id).alias("id"), F.col(col).cast("double").alias("v")).dropna("any")
    centre = values.agg(F.avg("v")).scalar()
    z = values.withColumn("m", centre).select("id", (F.col("v") - F.col("m")).alias("z"))
    w = weights(edges)
    lag = w.join(z.withColumnsRenamed({"id": "dst", "z": "zj"}), "dst").groupBy("src").agg(
        F.count("*").cast("double").alias("k"), F.sum("zj").alias("lag")
    )
    sums = lag.join(z.withColumnRenamed("id", "src"), "src").agg(
        F.count("*").alias("n"), F.sum("k").alias("s0"), F.sum(F.lit(4.0) * F.col("k") * F.col("k")).alias("s2"),
        F.sum(F.col("z") * F.col("lag")).alias("cross"),
    )
    moments = z.agg(
        F.count("*").alias("points"), F.sum(F.col("z") ** 2).alias("m2"), F.sum(F.col("z") ** 4).alias("m4")
    )
    row = sums.withColumn("_m", single_row(moments)).withColumn("_points", F.col("_m.points").cast("double"))
    n, s0 = F.col("n").cast("double"), F.col("s0")
    test = _test(n, s0, F.lit(2.0) * s0, F.col("s2"), F.col("cross"), F.col("_m.m2"), F.col("_m.m4"))
    return row.select("n", "s0", *[e.alias(c) for c, e in test.items()])


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull; only the lowest and highest point of each x can be one."""
    pts = np.unique(xy, axis=0)
    first = np.flatnonzero(np.diff(pts[:, 0], prepend=np.nan) != 0)
    last = np.append(first[1:], len(pts)) - 1 if len(pts) else first
    pts = np.unique(pts[np.concatenate([first, last])], axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out: list = []
        for px, py in rows:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (py - by) - (by - ay) * (px - bx) > 0:
                    break
                out.pop()
            out.append((px, py))
        return out[:-1]

    rows = pts.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def diameter(points: DataFrame) -> float:
    """Largest distance between two points: hulls per task, then the hull of the hulls."""

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hull = np.empty((0, 2))
        for pdf in batches:
            hull = _hull(np.vstack([hull, pdf[["x", "y"]].to_numpy(float)]))
        yield pd.DataFrame(hull, columns=["x", "y"])

    def widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hull = np.empty((0, 2))
        for pdf in batches:
            hull = _hull(np.vstack([hull, pdf[["x", "y"]].to_numpy(float)]))
        far = max((float(np.sqrt(((hull - p) ** 2).sum(axis=1)).max()) for p in hull), default=0.0)
        yield pd.DataFrame({"d": [far]})

    hulls = points.select("x", "y").mapInPandas(corners, "x double, y double")
    # A shuffle, for coalesce(1) would draw the read and the hulls into one task too.
    return hulls.repartition(1).mapInPandas(widest, "d double").head()[0]


#: Bits of a coordinate in a Z-order number; two of them fit a double exactly.
_BITS = 26


def packed_tree(points: DataFrame, value: str) -> list[DataFrame]:
    """A balanced tree over points, from the points up to one root: ``cell, cnt, s, x_lo, x_hi, y_lo, y_hi``.

    Points are numbered along the Z-order curve, so that cell c of a height holds the cells 4 c to 4 c + 3
    below it. Every cell has four children however the points cluster, and boxes are tight. Points carry
    their ``id`` besides.
    """
    grid = _Grid(points)
    whole = [F.least(F.floor((F.col(v) - F.lit(v0)) / F.lit(grid.side) * float(1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("long")
             for v, v0 in (("x", grid.x0), ("y", grid.y0))]
    z = F.lit(0).cast("long")
    for axis, at in enumerate(("_zx", "_zy")):
        for bit in range(_BITS):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(at, bit).bitwiseAND(F.lit(1)).cast("long"), 2 * bit + axis))
    keyed = points.withColumns({"_zx": whole[0], "_zy": whole[1]}).withColumn("_z", z.cast("double")).drop("_zx", "_zy")
    ranked = global_rank(keyed, "_z", F.col("id"), "_nr")
    below = checkpointed(ranked.select(
        (F.col("_nr") - 1).cast("long").alias("cell"), F.lit(1).cast("long").alias("cnt"), F.col(value).alias("s"), F.col("x").alias("x_lo"),
        F.col("x").alias("x_hi"), F.col("y").alias("y_lo"), F.col("y").alias("y_hi"), "id"))
    levels, n = [below], grid.n
    while n > 1:
        n = -(-n // 4)
        levels.append(checkpointed(levels[-1].groupBy(F.shiftright("cell", 2).alias("cell")).agg(
            F.sum("cnt").alias("cnt"), F.sum("s").alias("s"), F.min("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"),
            F.min("y_lo").alias("y_lo"), F.max("y_hi").alias("y_hi"))))
    return levels


def closest(points: DataFrame, leaves: DataFrame) -> float | None:
    """Smallest distance of two points, None if there are not two.

    Neighbours along the curve bound it; no aligned square whose diagonal is shorter than that
    bound holds two points, so the grid of the bound's size has few in each cell.
    """
    after = leaves.select((F.col("cell") - 1).alias("cell"), F.col("x_lo").alias("bx"), F.col("y_lo").alias("by"))
    bound = leaves.join(after, "cell").agg(F.min(_distance("x_lo", "y_lo"))).head()[0]
    if bound is None:
        return None
    return band_edges(points, bound).agg(F.min("d")).head()[0]


def _boxed(pairs: DataFrame, level: DataFrame) -> DataFrame:
    """Pairs of cells ``a, b`` with the counts, sums and boxes of both; pairs of cells that do not exist go."""
    out = pairs
    for p in ("a", "b"):
        names = ["cnt", "s", "x_lo", "x_hi", "y_lo", "y_hi"]
        out = out.join(level.select(F.col("cell").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in names]), p)
    return out


def _gap(v: str, of: str = "_") -> Column:
    """Least distance of two boxes along an axis. ``of`` stands between a cell and its edge: columns or structs."""
    return F.greatest(F.col(f"b{of}{v}_lo") - F.col(f"a{of}{v}_hi"), F.col(f"a{of}{v}_lo") - F.col(f"b{of}{v}_hi"), F.lit(0.0))


def _span(v: str, of: str = "_") -> Column:
    """Largest distance of two boxes along an axis."""
    return F.greatest(F.col(f"b{of}{v}_hi") - F.col(f"a{of}{v}_lo"), F.col(f"a{of}{v}_hi") - F.col(f"b{of}{v}_lo"))


def _length(along, of: str = "_") -> Column:
    return F.sqrt(along("x", of) * along("x", of) + along("y", of) * along("y", of))


def _children(cell: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col(cell) * 4 + i)).alias(cell)


def class_pairs(levels: list[DataFrame], class_of, leaf: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """Cell pairs ``a <= b`` all whose distances are of one ``class``, per height from ``leaf`` on, and the leaf pairs left.

    Descent of both sides at once: a pair of cells whose nearest and farthest corners are in one class stays
    as it is, with the counts and sums of both sides; others are replaced by the pairs of their children, down to
    the cells of height ``leaf`` (4^leaf points). Each pair of points is below exactly one of all these pairs.
    Pairs that are left carry their ``low`` and ``high`` class.
    """
    low, high = (class_of(_length(d)) for d in (_gap, _span))
    out: list[DataFrame] = []
    top = len(levels) - 1
    pairs = _boxed(levels[top].select(F.col("cell").alias("a"), F.col("cell").alias("b")), levels[top])
    for height in range(top, min(leaf, top) - 1, -1):
        seen = checkpointed(pairs.withColumns({"class": low, "_high": high}))
        out.append(seen.where(F.col("class") == F.col("_high")).drop("_high"))
        mixed = seen.where(F.col("class") != F.col("_high")).select("a", "b", F.col("class").alias("low"), F.col("_high").alias("high"))
        if height > leaf:
            below = mixed.select(_children("a"), "b").select("a", _children("b")).where("a <= b")
            pairs = _boxed(below, levels[height - 1])
    return out[::-1], mixed


def in_blocks(pairs: DataFrame, rows: DataFrame, columns: list[Column], leaf: int, made, schema: str) -> DataFrame:
    """``made(table of a, table of b)`` for each pair of leaf cells, of the points' ``columns``, which may use those of the pair."""
    block = F.shiftright("cell", 2 * leaf)
    left = rows.withColumn("a", block).join(pairs, "a").select("a", "b", *columns)
    right = rows.withColumn("b", block).join(pairs, "b").select("a", "b", *columns)
    # Names of its own, as both sides come from one table.
    right = right.withColumnsRenamed({c: f"{c}_b" for c in right.columns})

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return made(a, b.rename_columns(a.column_names))

    return left.groupBy("a", "b").cogroup(right.groupBy("a_b", "b_b")).applyInArrow(compare, schema)


class _Block:
    """Points of a leaf cell along the curve, cut in pieces of ``size`` with tight boxes."""

    def __init__(self, rows: pa.Table, size: int) -> None:
        self.order = np.argsort(rows["cell"].to_numpy())
        self.cell, self.x, self.y = (rows[c].to_numpy()[self.order] for c in ("cell", "x_lo", "y_lo"))
        self.n = len(self.order)
        self.starts = np.arange(0, self.n, size)
        self.sizes = np.diff(self.starts, append=self.n)
        self.low, self.high = ([f.reduceat(v, self.starts) for v in (self.x, self.y)] for f in (np.minimum, np.maximum))


class _Classes:
    """What the points of two blocks hand to each other by distance class; a point is handed nothing by itself.

    A class is a step function of the squared distance, so its steps are found once and pairs are compared
    with the few steps between them. Pieces of a block all of whose distances to a piece of the other are of
    one class are taken as a whole; the others meet as small matrices that stay in the processor's cache.
    """

    def __init__(self, nearest: float, width: float, k: int, piece: int = 128, wide: int = 4) -> None:
        self.nearest, self.width, self.k, self.piece, self.wide = nearest, width, k, piece, wide
        self.steps = self._steps()

    def _of(self, square: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil((np.sqrt(square) - self.nearest) / self.width), 1, self.k)

    def _steps(self) -> np.ndarray:
        """The largest squared distance of every class but the last: halving over all doubles, which sort like their bits."""
        if not self.width:
            return np.full(self.k - 1, np.inf)
        classes = np.arange(1, self.k)
        low, high = np.zeros(self.k - 1, np.int64), np.full(self.k - 1, np.array(np.inf).view(np.int64))
        while (high - low > 1).any():
            middle = low + (high - low) // 2
            inside = self._of(middle.view(np.float64)) <= classes
            low, high = np.where(inside, middle, low), np.where(inside, high, middle)
        return low.view(np.float64)

    def _bounds(self, a: _Block, i: int, b: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest class between piece i of a and every piece of b."""
        near, far = np.zeros(len(b.starts)), np.zeros(len(b.starts))
        for lo_a, hi_a, lo_b, hi_b in zip(a.low, a.high, b.low, b.high, strict=True):
            one, two = lo_b - hi_a[i], lo_a[i] - hi_b
            near += np.maximum(np.maximum(one, two), 0.0) ** 2
            far += np.maximum(hi_b - lo_a[i], hi_a[i] - lo_b) ** 2
        return tuple(np.searchsorted(self.steps, square) + 1 for square in (near, far))

    def handed(self, a: _Block, b: _Block, of_a, of_b) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """Per class, sums over the points of b for each point of a, and the reverse.

        ``of_a(class)`` and ``of_b(class)`` are matrices with a row for each point. A block that meets itself gives the first only.
        """
        same = a.cell[0] == b.cell[0]
        to_a: dict[int, np.ndarray] = {}
        to_b: dict[int, np.ndarray] = {}
        whole: dict[int, np.ndarray] = {}  # handed to whole pieces of b
        sums_a: dict[int, np.ndarray] = {}
        sums_b: dict[int, np.ndarray] = {}

        def cut(sums: dict[int, np.ndarray], block: _Block, of, c: int) -> np.ndarray:
            if c not in sums:
                sums[c] = np.add.reduceat(of(c), block.starts, axis=0)
            return sums[c]

        def place(out: dict[int, np.ndarray], c: int, n: int, like: np.ndarray) -> np.ndarray:
            if c not in out:
                out[c] = np.zeros((n, like.shape[1]))
            return out[c]

        # Matrices of one place each, as fresh memory costs more than the arithmetic.
        held = np.empty((3, self.piece * self.piece * self.wide))
        for i, (start, size) in enumerate(zip(a.starts, a.sizes, strict=True)):
            own = slice(start, start + size)
            low, high = self._bounds(a, i, b)
            mixed = low != high
            if same:
                mixed[i] = True
            for c in np.unique(low[~mixed]):
                pieces = np.flatnonzero(~mixed & (low == c))
                place(to_a, c, a.n, of_b(c))[own] += cut(sums_b, b, of_b, c)[pieces].sum(axis=0)
                if not same:
                    place(whole, c, len(b.starts), of_a(c))[pieces] += cut(sums_a, a, of_a, c)[i]
            open_ = np.flatnonzero(mixed)
            for first in range(0, len(open_), self.wide):
                pieces = open_[first:first + self.wide]
                columns = np.concatenate([np.arange(b.starts[p], b.starts[p] + b.sizes[p]) for p in pieces])
                least, most = int(low[pieces].min()), int(high[pieces].max())
                square, along, one_hot = held[:, :size * len(columns)].reshape(3, size, -1)
                for out, p, q in ((square, a.x, b.x), (along, a.y, b.y)):
                    np.subtract(p[own, None], q[None, columns], out=out)
                    np.multiply(out, out, out=out)
                square += along
                kind = np.uint8 if most - least < 255 else np.int32
                above = np.zeros(square.shape, kind)
                for step in self.steps[least - 1:most - 1]:
                    above += square > step
                if same and i in pieces:
                    above[columns[None, :] == np.arange(start, start + size)[:, None]] = np.iinfo(kind).max
                for c in range(least, most + 1):
                    np.equal(above, c - least, out=one_hot)
                    mine, others = of_a(c), of_b(c)[columns]
                    place(to_a, c, a.n, others)[own] += _weighted(one_hot, others)
                    if not same:
                        place(to_b, c, b.n, mine)[columns] += _weighted(one_hot.T, mine[own])
        for c, sums in whole.items():
            place(to_b, c, b.n, sums)[:] += np.repeat(sums, b.sizes, axis=0)
        return to_a, to_b

    def _listed(self, a: pa.Table, b: pa.Table, of, names: list[str]) -> pa.Table:
        """Rows (cell, class, *names) of what both blocks are handed; ``of(rows, block)`` gives the matrix of a class."""
        one, two = _Block(a, self.piece), _Block(b, self.piece)
        to_a, to_b = self.handed(one, two, of(a, one), of(b, two))
        cells, classes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros((0, len(names)))]
        for block, out in ((one, to_a), (two, to_b)):
            for c, sums in out.items():
                some = np.flatnonzero(sums[:, 0])
                cells.append(block.cell[some])
                classes.append(np.full(len(some), c, np.int32))
                values.append(sums[some])
        table = {"cell": np.concatenate(cells), "class": np.concatenate(classes)}
        return pa.table(table | dict(zip(names, np.concatenate(values).T, strict=True)))

    def counts(self, a: pa.Table, b: pa.Table) -> pa.Table:
        """(cell, class, cnt, sv) of the points of both blocks."""
        def of(rows: pa.Table, block: _Block):
            values = np.column_stack([np.ones(block.n), rows["s"].to_numpy()[block.order]])
            return lambda c: values

        out = self._listed(a, b, of, ["cnt", "sv"])
        return out.set_column(2, "cnt", out["cnt"].cast(pa.int64()))

    def weights(self, a: pa.Table, b: pa.Table) -> pa.Table:
        """(cell, class, u): what each point is handed by the other block, whose points carry ``us`` from the class ``low`` on."""
        def of(rows: pa.Table, block: _Block):
            us = rows["us"].combine_chunks().flatten().to_numpy().reshape(block.n, -1)[block.order]
            first = rows["low"][0].as_py()
            return lambda c: us[:, c - first:c - first + 1]

        return self._listed(a, b, of, ["u"])


def _weighted(met: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per row of zeros and ones, the sums of the values at the ones; a value that is no number reaches no one else."""
    if np.isfinite(values).all():
        return np.column_stack([met @ np.ascontiguousarray(v) for v in values.T])
    return np.column_stack([np.where(met > 0, v, 0.0).sum(axis=1) for v in values.T])


def both_sides(pairs: DataFrame, value_of_b: list[Column], value_of_a: list[Column]) -> DataFrame:
    """What each side of a pair hands to the other: (cell, class, own, ...); a pair of a cell with itself counts once, as ``own``."""
    own = (F.col("a") == F.col("b")).cast("long")
    return pairs.select(F.col("a").alias("cell"), "class", own.alias("own"), *value_of_b).unionByName(
        pairs.where("a <> b").select(F.col("b").alias("cell"), "class", F.lit(0).cast("long").alias("own"), *value_of_a))


def pushed_down(parts: list[DataFrame], leaves: DataFrame, leaf: int, names: list[str]) -> DataFrame:
    """(cell, class) sums of the points, from what was added at every height from ``leaf`` on: one aggregation per height."""
    total = None
    for height in range(len(parts) - 1, -1, -1):
        rows = parts[height]
        if total is not None:
            children = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("cell") * 4 + i))
            rows = rows.unionByName(total.withColumn("cell", children))
        total = rows.groupBy("cell", "class").agg(*[F.sum(c).alias(c) for c in names])
    points = leaves.select("cell", F.shiftright("cell", 2 * leaf).alias("_leaf"))
    return points.join(total.withColumnRenamed("cell", "_leaf"), "_leaf").select("cell", "class", *names)


def correlogram(
    df: DataFrame, col: str, id: str = "id", x: str = "x", y: str = "y", classes: int | None = None
) -> DataFrame:
    """Moran's I per distance class with row-standardised weights.

    ``class, lo, hi, pairs, i, p``. Classes of equal width span the distances between all
    pairs, their number following Sturges' rule unless given; if all distances are equal there is
    one class. Points without a neighbour in a class take no part in it. Counts and sums are added to whole
    cells by a descent of cell pairs and handed down the tree; only pairs of leaf cells near class
    borders are opened, block by block, and there only small pieces near a border are compared point by point. Fewer than two points give no rows.
    """
    points = df.select(
        F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        F.col(col).cast("double").alias("v"),
    ).dropna("any")
    points = checkpointed(first_per_key(points, ["x", "y"], ["id"]))
    levels = packed_tree(points, "v")
    nearest = closest(points, levels[0])
    widest = diameter(points) if nearest is not None else 0.0
    n_points = points.count()
    k = classes or math.ceil(math.log2(max(n_points * (n_points - 1) / 2, 1)) + 1)
    nearest = 0.0 if nearest is None else nearest
    width = max(widest - nearest, 0.0) / k

    def class_of(d: Column) -> Column:
        if width == 0:
            return F.lit(1)
        return F.least(F.greatest(F.ceil((d - F.lit(nearest)) / F.lit(width)), F.lit(1)), F.lit(k)).cast("int")

    # About 64 blocks or more: a block is sent to every other one it meets, so few are better, but each task needs some.
    leaf = min(len(levels) - 1, max(5, min(len(levels) - 4, 7)))
    met, mixed = class_pairs(levels, class_of, leaf)
    mixed = checkpointed(mixed)
    pairwise = _Classes(nearest, width, k)
    added = [both_sides(p, [F.col("b_cnt").alias("cnt"), F.col("b_s").alias("sv")], [F.col("a_cnt").alias("cnt"), F.col("a_s").alias("sv")]) for p in met]
    place = ["cell", "x_lo", "y_lo"]
    opened = in_blocks(mixed, levels[0], [*place, "s"], leaf, pairwise.counts, "cell long, class int, cnt long, sv double")
    near = (
        pushed_down(added, levels[0], leaf, ["cnt", "sv", "own"]).unionByName(opened.withColumn("own", F.lit(0).cast("long")))
        .groupBy("cell", "class").agg(F.sum("cnt").alias("cnt"), F.sum("sv").alias("sv"), F.sum("own").alias("own"))
        .join(levels[0].select("cell", F.col("s").alias("v")), "cell")
        .select("cell", "class", "own", "v", (F.col("cnt") - F.col("own")).cast("double").alias("k"),
                (F.col("sv") - F.col("own") * F.col("v")).alias("sv"))
        .where(F.col("k") > 0)
    )
    near = checkpointed(near)
    # Sums of 1 / k by cell at every height from the leaves on, then exchanged along the same pairs.
    height = F.explode(F.sequence(F.lit(leaf), F.lit(leaf + len(met) - 1))).alias("height")
    inverse = checkpointed(near.select("cell", "class", (F.lit(1.0) / F.col("k")).alias("u"), height).groupBy(
        "height", F.expr("shiftright(cell, 2 * height)").alias("cell"), "class").agg(F.sum("u").alias("u")))
    handed = []
    for h, pairs in enumerate(met):
        level = inverse.where(F.col("height") == leaf + h)
        a = level.select(F.col("cell").alias("a"), "class", F.col("u").alias("ua"))
        b = level.select(F.col("cell").alias("b"), "class", F.col("u").alias("ub"))
        narrow = pairs.select("a", "b", "class").join(a, ["a", "class"], "left").join(b, ["b", "class"], "left")
        handed.append(both_sides(narrow, [F.col("ub").alias("u")], [F.col("ua").alias("u")]).drop("own"))
    # One entry a class; a pair of blocks is sent those of its own classes.
    own_u = near.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("class", (F.lit(1.0) / F.col("k")).alias("u")))).alias("us"))
    all_u = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda c: F.coalesce(F.try_element_at("us", c), F.lit(0.0)))
    rows_u = checkpointed(levels[0].select(*place).join(own_u, "cell", "left").withColumn("us", all_u))
    some_u = F.slice("us", F.col("low"), F.col("high") - F.col("low") + 1).alias("us")
    opened_u = in_blocks(mixed, rows_u, [*place, "low", some_u], leaf, pairwise.weights, "cell long, class int, u double")
    columns = pushed_down(handed, levels[0], leaf, ["u"]).unionByName(opened_u).groupBy("cell", "class").agg(F.sum("u").alias("u"))
    means = near.groupBy("class").agg(F.avg("v").alias("m"))
    # One row per class.
    rows = near.join(columns, ["cell", "class"]).join(F.broadcast(means), "class").select(
        "class", "k", (F.col("v") - F.col("m")).alias("z"), ((F.col("sv") - F.col("k") * F.col("m")) / F.col("k")).alias("lag"),
        (F.col("u") - F.col("own") / F.col("k")).alias("c"),
    )
    sums = rows.groupBy("class").agg(
        F.count("*").cast("double").alias("_points"), F.sum("k").alias("k"), F.sum((F.lit(1.0) + F.col("c")) / F.col("k")).alias("s1"),
        F.sum((F.lit(1.0) + F.col("c")) ** 2).alias("s2"), F.sum(F.col("z") * F.col("lag")).alias("cross"),
        F.sum(F.col("z") ** 2).alias("m2"), F.sum(F.col("z") ** 4).alias("m4"),
    )
    n = F.col("_points")
    test = _test(n, n, F.col("s1"), F.col("s2"), F.col("cross"), F.col("m2"), F.col("m4"))
    return sums.select(
        "class", (F.lit(nearest) + F.lit(width) * (F.col("class") - 1)).alias("lo"), (F.lit(nearest) + F.lit(width) * F.col("class")).alias("hi"),
        (F.col("k") / 2).cast("long").alias("pairs"), test["i"].alias("i"), test["p"].alias("p"),
    )
