"""Files in and out, and streams that agree with tables."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from tallyforge.operators import graph, modality, pairbayes, selection, stats
from tallyforge.sources import fits, readers, writers
from tallyforge.streaming import increments


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "b.dat").write_text("x y\n1 2.5\n3 4\n")
    (tmp_path / "c.txt").write_text("x y z\n1 2 3\n")
    (tmp_path / "m.data").write_text("1 2 0\n3 4 1\n")
    assert readers.load(spark, str(tmp_path / "a.csv")).count() == 2
    assert [tuple(r) for r in readers.load(spark, str(tmp_path / "b.dat")).orderBy("x").collect()] == [(1.0, 2.5), (3.0, 4.0)]
    assert readers.load(spark, str(tmp_path / "c.txt")).columns == ["x", "y", "z"]
    assert readers.matrix(spark, str(tmp_path / "m.data")).columns == ["feature_0", "feature_1", "target"]
    assert readers.discover(spark, str(tmp_path), "a").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path / "none"), "a")


def test_configurations(spark, tmp_path):
    (tmp_path / "d.json").write_text("{not json")
    (tmp_path / "d.conf").write_text('{"resol": 5}')
    found, warnings = readers.config(spark, str(tmp_path), "d")
    assert found == {"resol": 5} and len(warnings) == 1
    assert readers.config(spark, str(tmp_path), "none") == ({}, [])
    assert "d" in readers.dataset_names(spark, str(tmp_path)) and len(readers.config_files(spark, str(tmp_path))) == 2
    writers.save_config(spark, {"a": 1}, str(tmp_path / "set.csv"))
    assert writers.load_config(spark, str(tmp_path / "set.csv")) == {"a": 1}


def test_fits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "ab"), (2, -1.0, "c")], "n long, x double, s string")
    path = str(tmp_path / "t.fits")
    writers.export(df, path, "demo")
    assert sorted(map(tuple, readers.load(spark, path).collect())) == [(1, 2.5, "ab"), (2, -1.0, "c")]
    assert {r.key: r.value for r in fits.header(spark, path, ["AUTHOR", "DATASET"]).collect()} == {"AUTHOR": "tallyforge", "DATASET": "demo"}


def test_fits_ascii_table_beside_an_image(spark, tmp_path):
    card, pad = fits._card, lambda raw, fill: raw.ljust(-(-len(raw) // 2880) * 2880, fill)
    image = fits._block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 2), card("NAXIS2", 2), card("OBJECT", "it's")]) + pad(b"abcd", b"\0")
    forms = [card("TTYPE1", "id"), card("TBCOL1", 1), card("TFORM1", "I4"), card("TNULL1", "-9"), card("TTYPE2", "mag"), card("TBCOL2", 6), card("TFORM2", "F6.2"), card("TTYPE3", "name"), card("TBCOL3", 13), card("TFORM3", "A3")]
    head = fits._block([card("XTENSION", "TABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 15), card("NAXIS2", 3), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 3), *forms])
    (tmp_path / "a.fits").write_bytes(image + head + pad(b"   1   1.25 ab   -9  1.5D1 c     3        de ", b" "))
    (tmp_path / "b.fits").write_bytes(fits.table_bytes({"id": [7], "mag": [0.5], "other": ["z"]}))
    got = {tuple(r) for r in readers.load(spark, str(tmp_path / "a.fits")).collect()}
    assert got == {(1, 1.25, "ab"), (None, 15.0, "c"), (3, None, "de")}
    both = {tuple(r) for r in fits.read(spark, str(tmp_path / "*.fits")).select("id", "mag", "name", "other").collect()}
    assert both == {(*r, None) for r in got} | {(7, 0.5, None, "z")}
    assert fits.header(spark, str(tmp_path / "a.fits")).first()["value"] == "it's"


def test_fits_image(spark, tmp_path):
    image = np.arange(12, dtype=">f8").reshape(3, 2, 2)
    cards = [fits._card("SIMPLE", True), fits._card("BITPIX", -64), fits._card("NAXIS", 3), *(fits._card(f"NAXIS{i}", n) for i, n in enumerate((2, 2, 3), 1))]
    (tmp_path / "i.fits").write_bytes(fits._block(cards) + image.tobytes().ljust(2880, b"\0"))
    df = readers.load(spark, str(tmp_path / "i.fits"))
    assert df.columns == [f"feature_{i}" for i in range(4)] and df.agg(F.sum("feature_3")).first()[0] == 3 + 7 + 11
    with pytest.raises(ValueError, match="header"):
        fits.units(b"SIMPLE  =" + b" " * 3000)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a", "train"), (2, 3.0, "b", "test")], "id int, x double, label string, part string")
    writers.export(df, str(tmp_path / "out"), "d")
    assert readers.exists(spark, str(tmp_path / "out.meta.json"))
    writers.feature_table(df, ["x"], "label", str(tmp_path / "ft"))
    assert readers.csv(spark, str(tmp_path / "ft")).columns == ["f0", "class"]
    writers.train_test(df, "part", str(tmp_path / "tt"))
    assert readers.csv(spark, str(tmp_path / "tt/test")).count() == 1
    assert writers.report(spark, {"accuracy": 0.5}, str(tmp_path / "r.txt")).count() == 1
    writers.save_experiment(spark, {"a": {"b": 1}}, str(tmp_path / "e.json"))
    assert writers.load_experiment(spark, str(tmp_path / "e.json")) == {"a": {"b": 1}}
    assert readers.arrays(spark, [[1, 2], [3, 4]], ["u", "v"]).columns == ["row_id", "f0", "f1", "label"]


def _labelled(n=80):
    rng = random.Random(1)
    return [(i, rng.random(), rng.random() * 3, "a" if rng.random() < 0.5 else "b") for i in range(n)]


def test_streams_agree_with_tables(spark, tmp_path):
    df = spark.createDataFrame(_labelled(), "id int, x double, y double, label string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    model = pairbayes.fit(df, ["x", "y"], "label", pairbayes.ModelConfig(resol=5, max_epochs=0))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda s, name, mode: s.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    run(increments.score_stream(stream, model).select("id", "Prediction"), "scored", "append")
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, model.transform(df).select("id", "Prediction").collect()))
    run(increments.count_stream(stream, model), "counted", "complete")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, model.net.collect()))


def test_windowed_counts(spark, sf_dir):
    n = increments.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], "1 day", "1 hour")
    assert n.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_spanning_forest(spark):
    rng = random.Random(4)
    points = [(i, i % 2, [rng.random(), rng.random()]) for i in range(24)]
    df = spark.createDataFrame(points, "id int, label int, v array<double>")
    edges = graph.class_pairs(df, "label", "id", "v").cache()
    got = {(r.src, r.dst) for r in graph.spanning_forest(edges, "label").collect()}
    want, parent = set(), list(range(24))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in sorted(edges.collect(), key=lambda r: (r.dist, r.src, r.dst)):
        if root(r.src) != root(r.dst):
            parent[root(r.src)] = root(r.dst)
            want.add((r.src, r.dst))
    assert got == want and len(got) == 22


def test_projection_of_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4)) * [5, 2, 1, 0.1] + 100
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    _, shares = graph.pca(df, "v", 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert shares == pytest.approx((values / values.sum())[:3].tolist(), abs=1e-6)


def test_items(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 10.0]), (2, []), (3, None)], "id int, item array<double>")
    rows = {r.id: r for r in modality.extract(df, "item", "time_series").collect()}
    assert rows[1].features == pytest.approx([4.0, 3.5355339, 1, 10, 2.5, 1.75, 4.75, 3.0, 2.8284271])
    assert rows[2].features is None and rows[3].problem == "no item"
    with pytest.raises(ValueError, match="smell"):
        modality.extract(df, "item", "smell")
    got = modality.run_pipeline(spark.createDataFrame([(i, [float(i % 2), float(i), 1.0], i % 2) for i in range(40)], "id int, item array<double>, label int"), "id", "item", "label", "vector", 3, resol=4, max_epochs=1)
    assert got["analysis"].first().constant_features == 1 and sum(r.n for r in got["test"].collect()) == 8


def test_selection_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, y string")
    split = selection.stratified_split(df, "y", selection.arithmetic_key("id", 1), "id").collect()
    assert sorted(r.part for r in split) == ["test", "train", "train"]
    assert selection.stratified_split(df.where("false"), "y", selection.arithmetic_key("id", 1), "id").count() == 0
    a = [r.id for r in selection.sample_rows(df.repartition(3), "id", 2, 5).collect()]
    assert sorted(a) == sorted(r.id for r in selection.sample_rows(df.coalesce(1), "id", 2, 5).collect())
    assert stats.class_separation(df.withColumn("x", F.lit(1.0)), ["x"], "y").first().score == 0
    p = spark.createDataFrame([([0.5, 0.5], [0.9, 0.1])], "p array<double>, q array<double>")
    kl, js = p.select(selection.divergence(F.col("p"), F.col("q")), selection.divergence(F.col("p"), F.col("q"), "js")).first()
    assert kl == pytest.approx(0.5108256) and js == pytest.approx(0.1017462, abs=1e-4)
