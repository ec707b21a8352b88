"""Points on grids at scale: neighbour joins, dilation, density clusters, outliers, components.

Neighbourhoods are equi-joins on grid cells with a fixed number of offsets, so
nothing is compared with everything. Cells are so small that all points of one
are neighbours; counts by cell stand for comparisons wherever they decide.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.session import materialize


def dilate(cells: DataFrame, x: str = "gx", y: str = "gy", radius: int = 1) -> DataFrame:
    """The cells within ``radius`` (square neighbourhood) of an occupied one."""
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    return cells.select(F.explode(F.transform(offsets, lambda o: F.col(x) + o)).alias(x), y).select(x, F.explode(F.transform(offsets, lambda o: F.col(y) + o)).alias(y)).distinct()


def erode(cells: DataFrame, x: str = "gx", y: str = "gy", radius: int = 1) -> DataFrame:
    """The cells whose whole square neighbourhood is occupied."""
    n = (2 * radius + 1) ** 2
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    spread = cells.select(x, y).distinct().select(F.explode(F.transform(offsets, lambda o: F.col(x) + o)).alias(x), y).select(x, F.explode(F.transform(offsets, lambda o: F.col(y) + o)).alias(y))
    return spread.groupBy(x, y).agg(F.count("*").alias("__n")).where(F.col("__n") == n).select(x, y)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over undirected ``edges`` (src, dst).

    Each round a node hears its neighbours' labels, and hands the least on to
    the node that its own label names, so a whole tree moves at once and the
    rounds grow with the logarithm of the longest chain; each round is cut by a
    written table. Labels only fall, so the rounds end by themselves.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    #: A node, its label, and its label's label.
    label = materialize(nodes.select("node", F.col("node").alias("component"), F.col("node").alias("up")).distinct())
    while True:
        heard = both.join(label.select(F.col("node").alias("dst"), "up"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("up").alias("heard"))
        said = F.explode(F.array(F.struct("node", F.col("component").alias("old"), F.least("component", "up", "heard").alias("to")), F.struct(F.col("component").alias("node"), F.lit(None).alias("old"), F.col("heard").alias("to"))))
        step = materialize(label.join(heard, "node", "left").select(said.alias("s")).groupBy("s.node").agg(F.max("s.old").alias("old"), F.min("s.to").alias("component")))
        if not step.where("old <> component").limit(1).count():
            return step.select("node", "component")
        above = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = materialize(step.select("node", "component").join(above, "component").select("node", "component", "up"))


SUB = 4


def _sides(axes: Sequence[str], radius: float) -> tuple[float, int]:
    """Side of a cell all of whose points are within the radius of each other, and how many cells away a neighbour can be."""
    side = radius / math.sqrt(len(axes)) * (1 - 1e-9)
    return side, math.ceil(radius / side)


def _with_cells(points: DataFrame, key: str, axes: Sequence[str], radius: float) -> DataFrame:
    """(key, axes, cell, sub): the cell of each point and the part of it, as arrays of numbers; points with a null or NaN coordinate are left out."""
    side, _ = _sides(axes, radius)
    numbers = lambda width: F.array(*[F.floor(F.col(a).cast("double") / width) for a in axes])
    whole = reduce(and_, [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in axes])
    return points.where(whole).select(key, *axes, numbers(side).alias("cell"), numbers(side / SUB).alias("sub"))


def _around(cell: str, axes: Sequence[str], radius: float) -> Column:
    """The cells in which neighbours of a cell's points may lie, as an array."""
    _, reach = _sides(axes, radius)
    offsets = F.array(*[F.lit(o) for o in range(-reach, reach + 1)])
    out = F.array(F.array().cast("array<bigint>"))
    for i in range(len(axes)):
        out = F.flatten(F.transform(out, _grow(cell, i, offsets)))
    return out


def _grow(cell: str, i: int, offsets: Column):
    return lambda done: F.transform(offsets, lambda o: F.concat(done, F.array(F.get(F.col(cell), F.lit(i)) + o)))


def _near(axes: Sequence[str], radius: float) -> Column:
    d2 = reduce(add, [F.pow(F.col(a) - F.col(f"o_{a}"), 2) for a in axes])
    return F.sqrt(d2) <= radius


def _other(points: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    return points.select("cell", F.col(key).alias("other"), *[F.col(a).alias(f"o_{a}") for a in axes])


def crowded(points: DataFrame, key: str, axes: Sequence[str], radius: float, least: int) -> DataFrame:
    """(key) of the points that have at least ``least`` points within the radius, themselves included.

    A cell that holds so many needs no comparison. Only points of emptier cells
    meet the points around them, so the pairs that are formed grow with the
    points, however dense they lie.
    """
    p = _with_cells(points, key, axes, radius)
    full = p.groupBy("cell").agg(F.count("*").alias("n"))
    dense = p.join(full.where(F.col("n") >= least), "cell", "left_semi").select(key)
    thin = p.join(full.where(F.col("n") < least), "cell", "left_semi").select(key, *axes, F.explode(_around("cell", axes, radius)).alias("cell"))
    near = thin.join(_other(p, key, axes), "cell").where(_near(axes, radius)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    return dense.unionByName(near)


def _links(p: DataFrame, key: str, axes: Sequence[str], radius: float) -> DataFrame:
    """(src, dst): enough links between points within the radius to join what they join.

    Points of one cell are linked to its least one. Of two cells one link is
    enough: parts of them that lie within the radius as wholes give it without a
    comparison; points are compared only for cells that have no such parts, and
    only of parts that may reach each other.
    """
    side, _ = _sides(axes, radius)
    width = side / SUB
    n = len(axes)
    own = p.join(p.groupBy("cell").agg(F.min(key).alias("src")), "cell").select("src", F.col(key).alias("dst")).where("src <> dst")
    subs = p.groupBy("cell", "sub").agg(F.min(key).alias("rep"))
    a = subs.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), F.col("rep").alias("a_rep"), F.explode(_around("cell", axes, radius)).alias("cell")).where(F.col("a_cell") < F.col("cell"))
    both = a.join(subs, "cell")
    apart = [F.abs(F.get("a_sub", F.lit(i)) - F.get("sub", F.lit(i))) for i in range(n)]
    most = F.sqrt(reduce(add, [F.pow((x + 1) * width, 2) for x in apart]))
    least = F.sqrt(reduce(add, [F.pow(F.greatest(x - 1, F.lit(0)) * width, 2) for x in apart]))
    both = materialize(both.select("a_cell", "cell", "a_sub", "sub", "a_rep", "rep", (most <= radius * (1 - 1e-9)).alias("sure"), (least <= radius * (1 + 1e-9)).alias("may")).where("sure or may"))
    sure = both.where("sure").groupBy("a_cell", "cell").agg(F.min(F.struct("a_rep", "rep")).alias("l"))
    open_ = both.where("may and not sure").join(sure.select("a_cell", "cell"), ["a_cell", "cell"], "left_anti").select("a_cell", "cell", "a_sub", "sub")
    left = p.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), F.col(key).alias("src"), *axes)
    right = p.select("cell", "sub", F.col(key).alias("dst"), *[F.col(x).alias(f"o_{x}") for x in axes])
    tried = open_.join(left, ["a_cell", "a_sub"]).join(right, ["cell", "sub"]).where(_near(axes, radius)).groupBy("a_cell", "cell").agg(F.min(F.struct("src", "dst")).alias("l"))
    return own.unionByName(sure.select(F.col("l.a_rep").alias("src"), F.col("l.rep").alias("dst"))).unionByName(tried.select("l.src", "l.dst"))


def density_clusters(points: DataFrame, key: str, axes: Sequence[str], radius: float, least: int) -> DataFrame:
    """(key, cluster): clusters of points with at least ``least`` neighbours (themselves included) and what they reach.

    Core points within the radius are connected; a border point joins its
    smallest core neighbour's cluster; the rest, and points with a null or NaN
    coordinate, are noise, cluster null. With ``least`` 1 the clusters are the
    components of all points within the radius.
    """
    core = materialize(crowded(points, key, axes, radius, least))
    p = _with_cells(points, key, axes, radius)
    inner = p.join(core, key, "left_semi")
    comp = components(_links(inner, key, axes, radius), core.withColumnRenamed(key, "node"))
    placed = inner.join(comp.withColumnRenamed("node", key), key)
    outer = p.join(core, key, "left_anti").select(key, *axes, F.explode(_around("cell", axes, radius)).alias("cell"))
    met = placed.select("cell", "component", *[F.col(a).alias(f"o_{a}") for a in axes])
    border = outer.join(met, "cell").where(_near(axes, radius)).groupBy(key).agg(F.min("component").alias("reached"))
    out = points.select(key).join(comp.withColumnRenamed("node", key), key, "left").join(border, key, "left")
    return out.select(key, F.coalesce("component", "reached").alias("cluster"))


def without_lonely(points: DataFrame, key: str, axes: Sequence[str], radius: float, least: int) -> DataFrame:
    """Points with at least ``least`` others within the radius."""
    return points.join(crowded(points, key, axes, radius, least + 1), key, "left_semi")
