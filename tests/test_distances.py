"""Distances by blocks against all pairs in plain Python."""

import numpy as np
import pytest

from tallyforge.operators import distances, graph


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    # whole coordinates, so that many distances are equal; one class of one point, one without a name
    rows = [(i, "abc"[i % 3] if i < 70 else "d" if i == 70 else None, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(74)]
    return rows, spark.createDataFrame(rows, "id long, y string, v array<double>").repartition(3)


def plain(rows):
    return sorted((a[1], a[0], b[0], float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a[2], b[2], strict=True))))) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and a[0] < b[0])


@pytest.mark.parametrize(("few", "buckets", "at"), [(0, 4096, 0.37), (40, 7, 0.37), (20_000, 4096, 1.0)])
def test_percentiles_by_refinement(points, monkeypatch, few, buckets, at):
    rows, df = points
    monkeypatch.setattr(distances, "FEW", few)
    monkeypatch.setattr(distances, "BUCKETS", buckets)
    blocks = distances.point_blocks(df, "y", "id", "v", block=9)
    assert blocks.where("y = 'a'").count() == 3
    held = [p[3] for p in plain(rows)]
    assert distances.distance_quantile(blocks, "y", at) == pytest.approx(float(np.quantile(held, at)), abs=1e-12)


@pytest.mark.parametrize("at", [0.25, 1.0])
def test_close_pairs_are_all_pairs_up_to_the_percentile(points, at):
    rows, df = points
    want = plain(rows)
    limit = float(np.quantile([p[3] for p in want], at))
    got = sorted(map(tuple, graph.proximity(df, "y", "id", "v", at).collect()))
    assert got == [p for p in want if p[3] <= limit]


def test_no_pairs(points):
    _, df = points
    for some in ("y = 'd'", "false"):
        assert graph.proximity(df.where(some), "y", "id", "v", 0.5).count() == 0


def test_ids_of_any_kind(spark):
    df = spark.createDataFrame([("b", 1, [0.0]), ("a", 1, [3.0]), ("c", 2, [1.0])], "id string, y int, v array<float>")
    assert graph.proximity(df, "y", "id", "v", 1.0).collect() == [(1, "a", "b", 3.0)]


def kruskal(pairs):
    tree, out = {}, []
    for y, a, b, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        u, v = tree.get(a, {a}), tree.get(b, {b})
        if b not in u:
            out.append((y, a, b, d))
            tree |= dict.fromkeys(u | v, u | v)
    return sorted(out)


@pytest.mark.parametrize(("at", "most"), [(0.1, 10**6), (1.0, 10**6), (0.5, 0)])
def test_the_forest_comes_from_few_edges(points, at, most, monkeypatch):
    """Tasks hand on edges of their own forests, not the pairs; the forest of these is that of all pairs, ties too."""
    rows, df = points
    monkeypatch.setattr(distances, "STRIPE", 1)
    monkeypatch.setattr(graph, "FOREST_EDGES", most)
    held = plain(rows)
    limit = float(np.quantile([p[3] for p in held], at))
    assert sorted(map(tuple, graph.class_forest(df, "y", "id", "v", at).collect())) == kruskal(p for p in held if p[3] <= limit)
    if at == 1.0:
        few = distances.light_edges(distances.point_blocks(df, "y", "id", "v", block=9), "y", limit).count()
        assert few <= 3 * 6 * 20 < len(held)


def test_blocks_are_copied_for_stripes_only(spark):
    """The rows that are shuffled grow with the blocks, not with their pairs."""
    df = spark.range(6000).selectExpr("id", "0 AS y", "array(CAST(id % 97 AS double), CAST(id AS double)) AS v")
    blocks = distances.point_blocks(df, "y", "id", "v", block=20)
    scale = distances._scale(blocks, "y")
    count = lambda pairs: iter([distances.pa.record_batch([distances.pa.array([len({b.number for p in pairs for b in p[:2]})], distances.pa.int64())], names=["n"])])
    held = [r.n for r in distances._mapped(blocks, "y", scale, count, "n long").collect()]
    assert sum(held) < 12 * blocks.count() and max(held) <= 2 * scale.width
