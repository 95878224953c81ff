"""Delaunay edges of any number of points, tile by tile.

Each round triangulates the tiles of a square grid by themselves, with the points of a quarter of a side around. A triangle
whose circle lies within a tile and its surroundings is a triangle of the whole set and is final; the tile that holds the
circle's centre gives it out. A point that final triangles surround is done. The others, with the edges that have a final
triangle on one side only, go into a round of tiles of four times the side: there a triangle is final if its circle
fits and final triangles lead to it from such an edge, for then it belongs to what isn't covered yet. One tile ends
the rounds. The first tiles are so fine that none has more than `capacity` points, down to a millionth of the
extent.

What is left for the last tile is the hull, the rims of large holes and long thin triangles along them. Points on one circle
or line, all of which belong there, still meet in one task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.delaunay import FAR, Triangulation
from cellweave.plans.lineage import cached, checkpointed

CAPACITY = 20000
#: a task gets the tiles of some so many points; these are little data but much work, so tasks aren't merged by bytes
TASK_POINTS = 5000
#: the points around a tile that it sees, in sides
MARGIN = 0.25
#: the finest grid has 2^DEEPEST tiles a side
DEEPEST = 20


def _tile(c: str, low: float, side: float, tiles: int):
    """(place in sides, number of the tile) along c."""
    at = (F.col(c) - F.lit(low)) / F.lit(side)
    return at, F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(tiles - 1)).cast("int")


def _with_surroundings(points: DataFrame, low: tuple[float, float], side: float, tiles: int) -> DataFrame:
    """points once for each tile that sees them, at most four times."""

    def seen_by(c: str, least: float):
        at, own = _tile(c, least, side, tiles)
        return F.filter(F.array(own - 1, own, own + 1), lambda i: (i >= 0) & (i < tiles) & (at >= i - MARGIN) & (at <= i + 1 + MARGIN))

    for c, least, name in zip("xy", low, ("ti", "tj")):
        points = points.withColumn(name, F.explode(seen_by(c, least)))
    return points


def _circles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, radii, whether they can be relied on) of the circles through triangles t."""
    a = p[t[:, 0]]
    (bx, by), (cx, cy) = (p[t[:, 1]] - a).T, (p[t[:, 2]] - a).T
    one, two, b2, c2 = bx * cy, by * cx, bx * bx + by * by, cx * cx + cy * cy
    with np.errstate(all="ignore"):
        ux, uy = (cy * b2 - by * c2) / (2 * (one - two)), (bx * c2 - cx * b2) / (2 * (one - two))
    return np.column_stack([ux, uy]) + a, np.hypot(ux, uy), np.abs(one - two) > 1e-6 * (np.abs(one) + np.abs(two))


def _reached(t: np.ndarray, sure: np.ndarray, rim: set[tuple[int, int]]) -> np.ndarray:
    """The sure triangles to which sure triangles lead from the edges of rim, whose left sides are final."""
    at = {e: i for i, (u, v, w) in enumerate(t.tolist()) for e in ((u, v), (v, w), (w, u))}
    found = np.zeros(len(t), bool)
    todo = [at[v, u] for u, v in rim if (v, u) in at]
    while todo:
        i = todo.pop()
        if found[i] or not sure[i]:
            continue
        found[i] = True
        u, v, w = t[i].tolist()
        todo += [at[b, a] for a, b in ((u, v), (v, w), (w, u)) if (b, a) not in rim and (b, a) in at]
    return found


def final_edges(points: np.ndarray, rim: set[tuple[int, int]] | None, place: tuple[int, int], low: tuple[float, float], side: float, tiles: int) -> np.ndarray:
    """The directed edges (u, v) that have a final triangle on their left, of points in the order of (x, y).

    rim: directed edges whose left sides were final before; None if nothing was. In a single tile points on one line
    give the path along them.
    """
    none = np.zeros((0, 2), np.int64)
    if len(points) < 2:
        return none
    left = Triangulation(points).left
    t = np.array([(u, v, w) for (u, v), w in left.items() if FAR < u < v and u < w], np.int64).reshape(-1, 3)
    if not len(t):
        along = np.arange(len(points) - 1)
        return np.column_stack([along, along + 1]) if tiles == 1 and rim is None else none
    sure = own = np.ones(len(t), bool)
    if tiles > 1:
        centre, radius, sure = _circles(points, t)
        centre, radius = (centre - low) / side, radius / side
        for c, i in enumerate(place):
            # the bounds give way a little, for the rounding of centre and radius
            slack = 1e-9 + 1e-8 * (radius + np.abs(centre[:, c]))
            sure &= (centre[:, c] - radius - slack >= (i - MARGIN if i else -np.inf)) & (centre[:, c] + radius + slack <= (i + 1 + MARGIN if i < tiles - 1 else np.inf))
        own = (np.where(sure[:, None], np.clip(np.floor(np.nan_to_num(centre)), 0, tiles - 1), -1) == place).all(axis=1)
    kept = t[own & (sure if rim is None else _reached(t, sure, rim))]
    return np.concatenate([kept[:, [0, 1]], kept[:, [1, 2]], kept[:, [2, 0]]])


def _round(left: DataFrame, keys: tuple[str, ...], low: tuple[float, float], side: float, tiles: int, tasks: int) -> DataFrame:
    """(*keys, u, v, ux, uy, vx, vy): the edges of the round's final triangles, each with its triangle on the left."""
    kinds = dict(left.dtypes)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x", "y"], ignore_index=True)
        points = frame[["x", "y"]].to_numpy(float)
        rim = None
        if not frame["fresh"].iloc[0]:
            place = {p: i for i, p in enumerate(map(tuple, points.tolist()))}
            ends = ((i, place.get(q)) for i, (xs, ys) in enumerate(zip(frame["out_x"], frame["out_y"])) for q in zip(xs, ys))
            rim = {(i, j) for i, j in ends if j is not None}
        e = final_edges(points, rim, key[-2:], low, side, tiles)
        ids = frame["cell_id"].to_numpy()
        own = {c: pd.Series([None if pd.isna(value) else value] * len(e), dtype=object) for c, value in zip(keys, key)}
        (ux, uy), (vx, vy) = points[e[:, 0]].T, points[e[:, 1]].T
        return pd.DataFrame({**own, "u": ids[e[:, 0]], "v": ids[e[:, 1]], "ux": ux, "uy": uy, "vx": vx, "vy": vy})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "u string, v string, ux double, uy double, vx double, vy double"])
    by_tile = [*keys, "ti", "tj"]
    return _with_surroundings(left, low, side, tiles).repartition(tasks, *by_tile).groupBy(*by_tile).applyInPandas(run, schema)


def _equal(names: tuple[str, ...]):
    """Whether the named columns equal those of the other side, which are marked with underscores; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names], F.lit(True))


def _remaining(left: DataFrame, finals: DataFrame, rim: DataFrame | None, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(points that aren't surrounded yet, edges with a final triangle on one side only) after a round."""
    ends = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    every = finals if rim is None else finals.unionByName(rim)
    row = F.first(F.struct(*finals.columns)).alias("row")
    rim = checkpointed(every.groupBy(*keys, *ends).agg(F.count(F.lit(1)).alias("n"), row).where("n = 1").select("row.*"))
    started = rim.groupBy(*keys, F.col("u").alias("cell_id"), F.col("ux").alias("x"), F.col("uy").alias("y"))
    open_ = started.agg(F.collect_list("vx").alias("out_x"), F.collect_list("vy").alias("out_y"))
    touched = finals.select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("u").alias("__u")).distinct()
    bare = left.where(F.size("out_x") == 0).drop("fresh").join(touched, _equal(keys) & (F.col("cell_id") == F.col("__u")), "left_anti")
    rest = open_.unionByName(bare)
    if not keys:
        return checkpointed(rest.withColumn("fresh", F.lit(rim.isEmpty()))), rim
    begun = rim.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct().withColumn("__begun", F.lit(True))
    joined = rest.join(begun, _equal(keys), "left").withColumn("fresh", F.col("__begun").isNull())
    return checkpointed(joined.select(*rest.columns, "fresh")), rim


def tiled_delaunay(points: DataFrame, keys: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """(*keys, a, b, distance), a < b, of points(cell_id, x, y, *keys); each set of equal keys is triangulated by itself.

    Of coincident points the first by id stands for all, and the others are linked to it. Points without finite coordinates
    get no edges. Fewer than three distinct points, or points on one line, give the path along them. Where four points lie on
    one circle, the point that is smallest by (x, y) is left out of the shared edge, whatever tiles there are.
    """
    far = F.lit(float("inf"))
    usable = points.select(*keys, F.col("cell_id").cast("string").alias("cell_id"), "x", "y").where((F.abs("x") < far) & (F.abs("y") < far))
    sites = cached(usable.groupBy(*keys, "x", "y").agg(F.min("cell_id").alias("cell_id"), F.count(F.lit(1)).alias("__n")))
    crowds = sites.where("__n > 1").select(*(F.col(c).alias(f"__{c}") for c in (*keys, "x", "y")), F.col("cell_id").alias("__first"))
    coincident = usable.join(crowds, _equal((*keys, "x", "y"))).where(F.col("cell_id") != F.col("__first")).select(*keys, F.col("__first").alias("a"), F.col("cell_id").alias("b"), F.lit(0.0).alias("distance"))

    box = sites.agg(*[f(c) for f in (F.min, F.max) for c in "xy"]).first()
    low = (box[0] or 0.0, box[1] or 0.0)
    # a little more than the points take up, so that none lies on the far side of the last tile
    extent = max((box[2] or 0.0) - low[0], (box[3] or 0.0) - low[1]) * (1 + 1e-9) or 1.0

    def sizes(frame: DataFrame, depth: int) -> tuple[int, int]:
        """Points of the densest tile, and of all."""
        numbers = [_tile(c, least, extent / 2**depth, 2**depth)[1] for c, least in zip("xy", low)]
        most, every = frame.groupBy(*keys, *numbers).count().agg(F.max("count"), F.sum("count")).first()
        return most or 0, every or 0

    depth, (crowd, every) = 0, sizes(sites, 0)
    while crowd > capacity and depth < DEEPEST:
        depth = min(DEEPEST, depth + max(1, math.ceil(math.log(crowd / capacity, 4))))
        crowd, _ = sizes(sites, depth)
    nothing = F.array().cast("array<double>")
    left, rim, parts = sites.drop("__n").withColumns({"out_x": nothing, "out_y": nothing, "fresh": F.lit(True)}), None, []
    while True:
        finals = _round(left, keys, low, extent / 2**depth, 2**depth, every // TASK_POINTS + 1)
        if not depth:
            parts.append(finals)
            break
        finals = checkpointed(finals)
        parts.append(finals)
        left, rim = _remaining(left, finals, rim, keys)
        crowd, every = sizes(left, 0)
        depth = 0 if crowd <= capacity else max(depth - 2, 0)
    found = reduce(DataFrame.unionByName, parts)
    length = F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))
    edges = found.select(*keys, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), length.alias("distance")).dropDuplicates([*keys, "a", "b"])
    return edges.unionByName(coincident)
