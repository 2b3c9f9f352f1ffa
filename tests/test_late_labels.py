"""Streams whose rows wait for others, fed batch by batch: late, missing and early labels, sessions, windows."""

import datetime as dt

from tallyforge.streaming import increments

START = dt.datetime(2024, 5, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def fed(spark, folder, schema, batches):
    """A stream that takes one file of rows after the other."""
    import os
    import time

    folder.mkdir()
    for i, rows in enumerate(batches):
        tmp = f"{folder}-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp)
        (part,) = (p for p in os.listdir(tmp) if p.endswith(".parquet"))
        os.rename(f"{tmp}/{part}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(stream, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


SAID, KNOWN = "id int, ts timestamp, p double", "id int, label_ts timestamp, label double"


def streams(spark, tmp_path):
    # 1 gets its label at once, 2 a batch later, 3 never, 4 too late by its time, 5 one before it was said, 6 without an id;
    # 8 comes behind the watermark of both; rows far ahead move the watermarks on
    said = [
        [(1, at(0), 1.0), (2, at(0.5), 2.0), (3, at(0.6), 3.0), (4, at(1), 4.0), (5, at(1), 5.0), (None, at(1), 6.0)],
        [(7, at(2), 7.0)], [(9, at(40), 9.0)], [(12, at(60), 0.0)], [(8, at(1), 8.0)], [(10, at(90), 0.0)], [(11, at(91), 0.0)],
    ]
    known = [
        [(1, at(0.2), 1.0), (4, at(3.5), 4.0), (5, at(0.5), 5.0), (None, at(1), 6.0)],
        [(2, at(2), 2.5), (7, at(4), 9.0), (7, at(3), 7.0)], [(99, at(40), 0.0)], [(99, at(60), 0.0)], [(8, at(1.5), 8.0)], [(98, at(90), 0.0)], [(97, at(91), 0.0)],
    ]
    return fed(spark, tmp_path / "said", SAID, said), fed(spark, tmp_path / "known", KNOWN, known)


def test_labels_that_come_later(spark, tmp_path):
    said, known = streams(spark, tmp_path)
    joined = increments.labelled_later(said, known, "id", "ts", "label_ts", "2 HOUR", "3 hours")
    got = drained(joined, "later").collect()
    assert joined.columns == ["id", "ts", "p", "label_ts", "label"]
    held = sorted((r.id, r.label) for r in got if r.ts < at(50) and r.label is not None)
    assert held == [(1, 1.0), (2, 2.5), (7, 7.0), (7, 9.0)]
    assert sorted(r.id for r in got if r.ts < at(50) and r.label is None) == [3, 4, 5, 9]


def test_accuracy_by_window_once(spark, tmp_path):
    said, known = streams(spark, tmp_path)
    joined = increments.labelled_later(said, known, "id", "ts", "label_ts", "2 HOUR", "3 hours")
    from pyspark.sql import functions as F

    n = drained(increments.accuracy_by_window(joined, "ts", F.col("label"), F.col("p"), 0.4, "1 day"), "accuracy").collect()
    assert sorted((r.window.start, r.n, r.labelled, r.correct) for r in n if r.window.end < at(50)) == [(at(0), 7, 4, 2), (at(24), 1, 0, 0)]


def test_sessions_over_batches(spark, tmp_path):
    rows = "ts timestamp, u string"
    batches = [[(at(0), "a"), (at(5), "b")], [(at(0.5), "a"), (at(1.4), "a"), (at(2.4), "a"), (at(3.5), "a")], [(at(40), "b")], [(at(60), "c")], [(at(1), "b")], [(at(90), "a")]]
    got = drained(increments.sessions(fed(spark, tmp_path / "rows", rows, batches), "ts", ["u"], "1 hour", "10 hours"), "runs").collect()
    # a row exactly a gap later still belongs to the session; the row behind the watermark is left out
    assert sorted((r.u, r.window.start, r.window.end, r.n) for r in got if r.window.end < at(50)) == [
        ("a", at(0), at(3.4), 4), ("a", at(3.5), at(4.5), 1), ("b", at(5), at(6), 1), ("b", at(40), at(41), 1),
    ]


def test_no_rows(spark, tmp_path):
    said, known = fed(spark, tmp_path / "said", SAID, [[]]), fed(spark, tmp_path / "known", KNOWN, [[]])
    assert drained(increments.labelled_later(said, known, "id", "ts", "label_ts", "2 HOUR", "3 hours"), "nothing").count() == 0
