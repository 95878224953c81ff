"""Delaunay by tiles against one triangulation of all points, for any tiles."""

import numpy as np
import pandas as pd
import pytest

from cellweave.operators.delaunay import delaunay_edges
from cellweave.operators.tiles import tiled_delaunay


def sets():
    rng = np.random.default_rng(5)
    even = rng.random((1500, 2)) * [30.0, 10.0]
    clumps = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.01, 700), ((50, 3), 1.0, 300), ((20, 90), 20.0, 60))])
    lattice = np.stack(np.meshgrid(np.arange(25.0), np.arange(25.0)), -1).reshape(-1, 2)
    angle = np.arange(300) * 2 * np.pi / 300
    ring = np.concatenate([np.column_stack([np.cos(angle), np.sin(angle)]) * 40, rng.normal(0, 3, (300, 2))])
    line = np.column_stack([np.arange(400.0), np.zeros(400)])
    return {"even": even, "clumps": clumps, "lattice": lattice, "ring": ring, "line": line, "twice": np.concatenate([even[:300], even[:40], even[:5]])}


def frame(p, sample="s"):
    # ids in the order of the rows, which is that of "the first of coincident points"
    return pd.DataFrame({"cell_id": [f"{sample}{i:05d}" for i in range(len(p))], "x": p[:, 0], "y": p[:, 1], "sample_id": sample})


def whole(points):
    return {tuple(sorted((points.cell_id[i], points.cell_id[j]))) for i, j in delaunay_edges(points.x.to_numpy(), points.y.to_numpy())}


@pytest.mark.parametrize("name", list(sets()))
@pytest.mark.parametrize("capacity", [150, 10**6])
def test_tiles_give_the_edges_of_the_whole(spark, name, capacity):
    points = frame(sets()[name])
    found = tiled_delaunay(spark.createDataFrame(points), (), capacity).toPandas()
    assert len(found) == len(set(zip(found.a, found.b)))
    assert set(zip(found.a, found.b)) == whole(points)
    at = points.set_index("cell_id")[["x", "y"]]
    apart = at.loc[found.b].to_numpy() - at.loc[found.a].to_numpy()
    assert np.allclose(found.distance, np.hypot(*apart.T))


def test_samples_are_apart_and_may_be_null(spark):
    """A dense sample sets the tiles; a sparse one, one of three points and one without a name are whole all the same."""
    rng = np.random.default_rng(6)
    parts = [frame(rng.random((600, 2)), "a"), frame(rng.random((50, 2)) * 1000, "b"), frame(rng.random((3, 2)), "c"), frame(rng.random((90, 2)) * 9, "n")]
    points = pd.concat(parts).astype({"sample_id": object})
    points.loc[points.sample_id == "n", "sample_id"] = None
    rows = spark.createDataFrame(points.astype(object).where(points.notna(), None), "cell_id string, x double, y double, sample_id string")
    found = tiled_delaunay(rows, ("sample_id",), 60).toPandas()
    assert set(zip(found.a, found.b)) == set().union(*map(whole, parts))
    assert (found.sample_id.fillna("n") == found.a.str[0]).all()


def test_few_points_and_points_without_a_place(spark):
    schema = "cell_id string, x double, y double"
    assert tiled_delaunay(spark.createDataFrame([], schema)).count() == 0
    assert tiled_delaunay(spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 1.0), ("c", float("nan"), 0.0), ("d", float("inf"), 0.0)], schema)).count() == 0
    two = tiled_delaunay(spark.createDataFrame([("a", 1.0, 1.0), ("b", 4.0, 5.0), ("c", None, 1.0)], schema)).collect()
    assert [tuple(r) for r in two] == [("a", "b", 5.0)]


def test_a_task_holds_a_part(spark, monkeypatch):
    """Of 30000 points no round gives a tile more than its capacity and surroundings, and the last tile few."""
    from cellweave.operators import tiles

    seen = []
    plain = tiles._with_surroundings

    def watched(points, low, side, n):
        out = plain(points, low, side, n)
        seen.append((n, out.groupBy("ti", "tj").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(tiles, "_with_surroundings", watched)
    points = frame(np.random.default_rng(7).random((30000, 2)))
    found = tiled_delaunay(spark.createDataFrame(points), (), 2000).toPandas()
    assert set(zip(found.a, found.b)) == whole(points)
    assert seen[0][0] > 1 and max(size for _, size in seen) <= 2000 * 2.5, seen
