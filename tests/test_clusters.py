"""k-means of all classes at once against plain loops."""

import numpy as np
import pyspark.sql.functions as F

from tallyforge import session
from tallyforge.operators import clusters


def plain(rows, start, rounds):
    """The chosen ids of one class, from given centres."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    centres = np.array(start)
    near = lambda: np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    for _ in range(rounds):
        to = near().argmin(1)
        centres = np.array([x[to == j].mean(0) if (to == j).any() else centres[j] for j in range(len(centres))])
    d = near()
    to = d.argmin(1)
    return {min((d[i, j], ids[i]) for i in np.flatnonzero(to == j))[1] for j in set(to.tolist())}


def test_rows_nearest_to_centres(spark):
    rng = np.random.default_rng(11)
    rows = [(i, ["a", "b", "c", None][i % 4], rng.normal(size=3).tolist()) for i in range(240)] + [(900, "d", [1.0] * 3), (901, "d", [1.0] * 3), (902, "a", None)]
    df = spark.createDataFrame(rows, "id long, y string, v array<double>").repartition(5)
    begin = lambda d: d.where("id < 16")
    got: dict = {}
    for y, i in clusters.diverse_per_class(df, "y", "id", "v", 4, rounds=3, start=begin).collect():
        got.setdefault(y, set()).add(i)
    for y in ("a", "b", "c", None):
        mine = [(i, v) for i, g, v in rows if g == y and v is not None]
        assert got[y] == plain(mine, [v for i, v in mine if i < 16], 3), y
    assert got["d"] == {900, 901} and got.keys() == {"a", "b", "c", "d", None}


def test_seeds_lie_apart(spark):
    """Well parted clumps get one centre each; copies give no second centre."""
    rows = [(i, i % 2, [100.0 * (i % 8) + 0.01 * (i % 5), 0.0]) for i in range(400)] + [(1000 + i, 7, [3.0, 3.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, y int, v array<double>")
    got = clusters.diverse_per_class(df, "y", "id", "v", 4).collect()
    assert {(r.y, r.id % 8) for r in got if r.y < 2} == {(i % 2, i) for i in range(8)}
    assert [r.id for r in got if r.y == 7] == [1000]
    again = clusters.diverse_per_class(df.repartition(7), "y", "id", "v", 4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_classes_in_slices_and_no_rows(spark, monkeypatch):
    rows = [(i, i % 5, [float(i * i % 17), float(i % 7)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, y int, v array<double>")
    whole = sorted(map(tuple, clusters.diverse_per_class(df, "y", "id", "v", 3).collect()))
    monkeypatch.setattr(clusters, "CENTRE_BYTES", 100)
    assert sorted(map(tuple, clusters.diverse_per_class(df, "y", "id", "v", 3).collect())) == whole
    assert clusters.diverse_per_class(df.where(F.lit(False)), "y", "id", "v", 3).count() == 0


def test_one_class_in_one_part_lies_in_many_tasks(spark, monkeypatch):
    seen, seeds = [], clusters.seeds
    monkeypatch.setattr(clusters, "seeds", lambda rows, *rest: seen.append(rows) or seeds(rows, *rest))
    monkeypatch.setattr(session, "TASK_ROWS", 50, raising=False)
    df = spark.createDataFrame([(i, "a", [float(i % 40), float(i % 7)]) for i in range(400)], "id int, y string, v array<double>").coalesce(1)
    got = clusters.diverse_per_class(df, "y", "id", "v", 3).collect()
    assert len(got) == 3 and len({r.id for r in got}) == 3
    assert seen[0].select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism


def test_equal_points_of_text_ids(spark):
    """The least id of rows equally near stays, whatever its type and the tasks that hold them."""
    df = spark.createDataFrame([(f"r{i:03}", 1, [float(i % 3 * 10)]) for i in range(90)], "id string, y int, v array<double>")
    assert {r.id for r in clusters.diverse_per_class(df.repartition(7), "y", "id", "v", 3).collect()} == {"r000", "r001", "r002"}
