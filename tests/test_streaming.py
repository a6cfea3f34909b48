from datetime import datetime, timedelta

from conftest import rows

from orefield.streaming import incremental

T0 = datetime(2025, 1, 1, 0, 0)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def source(spark, tmp_path, data):
    folder = str(tmp_path / "events")
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def run(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return rows(df.sparkSession.table(name))


def test_windows_and_sessions(spark, tmp_path):
    data = [(n, T0 + timedelta(minutes=10 * n), n % 2, "a", 1.0) for n in range(12)] + [(99, T0 + timedelta(hours=9), 1, "b", 2.0)]
    stream = source(spark, tmp_path, data)
    got = run(incremental.windowed_counts(stream), "windows")
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(T0, "a", 6, 6.0), (T0 + timedelta(hours=1), "a", 6, 6.0)]
    sessions = run(incremental.user_sessions(stream), "sessions")
    assert [(r[0], r[3]) for r in sessions] == [(0, 6), (1, 6)]


def test_batches_are_handled_once(spark, tmp_path):
    stream = source(spark, tmp_path, [(1, T0, 1, "a", 1.0)])
    seen = []
    for _ in range(2):
        query = incremental.apply_batches(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
        query.awaitTermination(120)
    assert seen == [1]


def test_changed_digests(spark):
    schema = "repository string, id string, content_hash string"
    known = spark.createDataFrame([("r", "a", "A" * 64), ("r", "b", "b" * 64)], schema)
    batch = spark.createDataFrame([("r", "a", "a" * 64), ("r", "b", "c" * 64), ("r", "n", None)], schema)
    assert rows(incremental.changed_digests(batch, known).select("id")) == [("b",), ("n",)]
