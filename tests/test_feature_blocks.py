"""Blocks of features against blocks give what plain Python, and the plan of a join a pair, give."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyspark.sql.functions as F
import pytest

from tallyforge.operators import feature_blocks, pairbayes
from tallyforge.sources import writers
from tallyforge.streaming import increments

N = 6
NAMES = [f"f{i}" for i in range(N)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, N)).round(2) + (np.arange(90) % 3)[:, None] * 0.4
    made = [(i, *map(float, r), "abc"[i % 3] if i % 11 else None) for i, r in enumerate(x)]
    made[7] = (7, *([float("nan")] * 3), *made[7][4:])
    # a repeated row, and one whose id is there twice
    return spark.createDataFrame([*made, made[4], (5, *made[6][1:])], ["id", *NAMES, "y"]).repartition(3).cache()


@pytest.fixture(autouse=True)
def blocks(monkeypatch):
    monkeypatch.setattr(pairbayes, "JOINED_FEATURES", 2)


@pytest.fixture()
def narrow(monkeypatch):
    """Blocks of few features, shards of few rows, so that everything is split."""
    monkeypatch.setattr(feature_blocks, "TABLE", 3 * 10 * 10)
    monkeypatch.setattr(feature_blocks, "SHARD", 20)
    monkeypatch.setattr(feature_blocks, "FAN", 2)


def joined(monkeypatch, call):
    """What the plan of a join a pair gives."""
    with monkeypatch.context() as m:
        m.setattr(pairbayes, "JOINED_FEATURES", 100)
        return call()


def scores_of(df):
    return sorted(((r.id, [round(s, 8) for s in r.scores], r.predicted) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("most", "epochs"), [(0, 2), (pairbayes.BROADCAST_BYTES, 0)])
def test_blocks_agree_with_joins(rows, narrow, monkeypatch, epochs, most):
    config = pairbayes.ModelConfig(resol=4, max_epochs=epochs, patience=9, gain=3.0)
    monkeypatch.setattr(pairbayes, "BROADCAST_BYTES", most)
    plain = joined(monkeypatch, lambda: pairbayes.fit(rows, NAMES, "y", config))
    model = pairbayes.fit(rows, NAMES, "y", config)
    assert model.packed is not None and plain.packed is None and model.grid.blocks == 3
    assert sorted(map(tuple, model.net.collect())) == sorted(map(tuple, plain.net.collect()))
    assert [h["accuracy"] for h in model.history] == pytest.approx([h["accuracy"] for h in plain.history])
    if plain.weights is not None:
        want = {tuple(r)[:5]: r.w for r in plain.weights.collect() if r.w != 1}
        assert {tuple(r)[:5]: pytest.approx(r.w) for r in model.weights.collect()} == want and want
    got, said = (scores_of(m.score(rows)) for m in (model, plain))
    assert [(i, p) for i, _, p in got] == [(i, p) for i, _, p in said]
    assert all(a == pytest.approx(b, abs=1e-7) for (_, a, _), (_, b, _) in zip(got, said, strict=True))
    assert {c: str(t) for c, t in model.transform(rows).dtypes} == {c: str(t) for c, t in plain.transform(rows).dtypes}
    assert scores_of(model.without_weights().score(rows)) == scores_of(pairbayes.fit(rows, NAMES, "y", config if not epochs else pairbayes.ModelConfig(resol=4, max_epochs=0)).score(rows))


def test_blocks_against_plain_python(rows):
    model = pairbayes.fit(rows, NAMES, "y", pairbayes.ModelConfig(resol=4, max_epochs=0))
    held = [(r.id, [r[f"b{i}"] for i in range(N)], r.y) for r in pairbayes.binned(rows, model.bins, 4).collect()]
    net = Counter((i, x[i], j, x[j], y) for _, x, y in held if y for i, j in combinations(range(N), 2))
    assert {(r.i, r.bi, r.l, r.bl, "abc"[r.k - 1]): r.cnt for r in model.net.collect()} == dict(net)
    want = sorted((i, [round(sum(math.log((net[a, x[a], b, x[b], k] + 1) / (sum(net[a, x[a], b, x[b], q] for q in "abc") + 3)) for a, b in combinations(range(N), 2)), 7) for k in "abc"]) for i, x, _ in held)
    got = sorted((r.id, [round(s, 7) for s in r.scores]) for r in model.score(rows).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] == pytest.approx(w[1], abs=1e-6) for g, w in zip(got, want, strict=True))


def test_counts_of_parts_add_up(rows, narrow):
    config = pairbayes.ModelConfig(resol=4, max_epochs=0)
    frame = pairbayes.initialise(rows, NAMES, "y", config)
    whole = pairbayes.fit(rows, NAMES, "y", frame=frame)
    parts = [pairbayes.fit(rows.where(f"id % 3 = {i}"), NAMES, "y", frame=frame).packed for i in range(3)]
    merged = whole.with_packed(feature_blocks.merge(*parts))
    assert sorted(map(tuple, merged.net.collect())) == sorted(map(tuple, whole.net.collect()))


def test_saved_and_loaded(spark, rows, tmp_path):
    model = pairbayes.fit(rows, NAMES, "y", pairbayes.ModelConfig(resol=4, max_epochs=2))
    writers.save_model(model, str(tmp_path / "m"))
    assert scores_of(writers.load_model(spark, str(tmp_path / "m")).score(rows)) == scores_of(model.score(rows))


def test_streams_need_no_key(spark, rows, monkeypatch, tmp_path):
    model = pairbayes.fit(rows, NAMES, "y", pairbayes.ModelConfig(resol=4, max_epochs=0))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, model.transform(rows).select("id", "Prediction").collect()))
    increments.score_stream(stream, model).writeStream.format("memory").queryName("wide").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("wide").select("id", "Prediction").collect())) == want
    monkeypatch.setattr(pairbayes, "BROADCAST_BYTES", 0)
    with pytest.raises(ValueError, match="score_batches"):
        model.transform(stream)
    held = []
    increments.score_batches(stream, model, lambda batch, _: held.extend(map(tuple, batch.select("id", "Prediction").collect()))).trigger(availableNow=True).start().awaitTermination()
    assert sorted(held) == want


def test_no_rows_and_no_classes(rows):
    config = pairbayes.ModelConfig(resol=4, max_epochs=1)
    none = pairbayes.fit(rows.where("false"), NAMES, "y", config)
    assert none.classes == [] and none.accuracy is None
    one = pairbayes.fit(rows.where("y = 'a'"), NAMES, "y", config)
    assert one.accuracy == 1 and {r.predicted for r in one.score(rows).collect()} == {1} and one.score(rows.where("false")).count() == 0


def test_hundreds_of_features(spark):
    """160 features, resol 60: 12,720 pairs, counts held against numpy."""
    n = 160
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, n)).round(3)
    y = rng.integers(0, 2, 200)
    x[:, :40] += y[:, None]
    df = spark.createDataFrame([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y int")
    names = [f"f{i}" for i in range(n)]
    df = df.select("id", "y", *(F.get("v", i).alias(c) for i, c in enumerate(names)))
    model = pairbayes.fit(df, names, "y", pairbayes.ModelConfig(resol=60, max_epochs=0))
    bins = np.floor((x - x.min(0)) / (x.max(0) - x.min(0)) * 60 + 0.5).astype(int)
    pairs = [(0, 1), (5, 130), (158, 159), (30, 31), (0, 159)]
    held = model.net.where(" OR ".join(f"i = {i} AND l = {j}" for i, j in pairs)).collect()
    want = Counter((i, a, j, b, k) for i, j in pairs for a, b, k in zip(bins[:, i].tolist(), bins[:, j].tolist(), (y + 1).tolist(), strict=True))
    assert {tuple(r)[:5]: r.cnt for r in held} == dict(want) and model.accuracy > 0.9
