"""Nearest points by blocks against all pairs in plain Python."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from tallyforge.operators import neighbours


def plain(rows, k):
    out = {}
    for i, g, v in rows:
        if g is not None and v is not None:
            out[i] = sorted(float(np.sqrt(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)))) for _, h, w in rows if h == g and w is not None)[:k]
    return out


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    # three clusters far apart, whole coordinates for ties, a third of all rows copies of one point, a group of two, gaps
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.integers(0, 5, 3) + 100 * (i % 3)]) for i in range(200)]
    rows += [(200 + i, "a", [7.0, 7.0, 7.0]) for i in range(100)]
    rows += [(300, "c", [1.0, 2.0, 3.0]), (301, "c", [1.0, 2.0, 5.0]), (302, None, [0.0] * 3), (303, "a", None)]
    return rows, spark.createDataFrame(rows, "id long, y string, v array<float>").repartition(3)


@pytest.mark.parametrize(("k", "block", "pivots"), [(4, 8, 5), (4, 512, 32), (10, 20, 1), (1, 3, 3)])
def test_distances_of_the_nearest(points, k, block, pivots):
    rows, df = points
    got = {r.id: r.dists for r in neighbours.nearest(df, "id", "v", k, "y", block, pivots).collect()}
    want = plain(rows, k)
    assert got.keys() == want.keys()
    for i, dists in want.items():
        assert got[i] == pytest.approx(dists, abs=1e-9), i


def test_blocks_that_cannot_hold_nearer_points_are_not_read(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 50
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8)]) for i in range(2400)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    points = df.select(F.lit(0).alias("g"), "id", "v")
    blocks = neighbours.point_blocks(points, neighbours.reference_points(points), 5, 50)
    sizes = {r.block: r.n for r in blocks.select("block", F.size("ids").alias("n")).collect()}
    assert sum(sizes.values()) == 2400 and max(sizes.values()) <= 50
    compared = sum(n * n for n in sizes.values()) + sum(sizes[r.block] * sizes[r.b] for r in neighbours.meetings(blocks).collect())
    assert compared < 0.15 * 2400**2
    x = np.array([v for _, v in rows])
    got = {r.id: r.dists for r in neighbours.nearest(df, "id", "v", 5, None, 50).collect()}
    for i in range(0, 2400, 97):
        assert got[i] == pytest.approx(np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[:5].tolist(), abs=1e-9)


def test_copies_do_not_meet(spark):
    """Blocks whose points have all their neighbours at no distance look nowhere else."""
    df = spark.createDataFrame([(0, i, [1.0, 2.0]) for i in range(300)], "g int, id int, v array<double>")
    blocks = neighbours.point_blocks(df, neighbours.reference_points(df), 3, 20)
    assert blocks.count() == 15 and neighbours.meetings(blocks).isEmpty()


def test_no_points_and_ids_of_text(spark):
    df = spark.createDataFrame([("b", [0.0]), ("a", [3.0]), ("c", [1.0])], "name string, v array<double>")
    assert neighbours.nearest(df.where("false"), "name", "v", 2).count() == 0
    assert sorted(map(tuple, neighbours.nearest(df, "name", "v", 2).collect())) == [("a", [0.0, 2.0]), ("b", [0.0, 1.0]), ("c", [0.0, 1.0])]


def test_blocks_are_copied_for_tiles_only(spark, monkeypatch):
    """Where nothing can be left out, blocks that meet many others don't travel once for each of them."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    monkeypatch.setattr(neighbours, "TILES", 1)
    seen, plan = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (seen.append(self), plan(self, *a))[1])
    got = {r.id: r.dists for r in neighbours.nearest(df, "id", "v", 3, None, 10, 4).collect()}
    x = np.array([v for _, v in rows])
    for i in range(0, 600, 41):
        assert got[i] == pytest.approx(np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[:3].tolist(), abs=1e-9)
    assert seen[-1].count() <= 60 * 2 * 5
