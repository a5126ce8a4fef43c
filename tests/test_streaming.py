"""Streams over small files."""
import datetime as dt

from pyspark.sql import functions as F

from quorate.streaming import live


def at(h, m=0):
    return dt.datetime(2025, 1, 1, h, m)


def rows(spark, tmp_path, name, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return str(tmp_path / name)


def drain(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    return q


def test_windows_close_at_the_watermark_and_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, method string, correct int"
    path = rows(spark, tmp_path, "e", [(at(1, 5), "a", 1), (at(1, 50), "a", 0), (at(2, 10), "a", 1)], schema)
    q = drain(live.windowed_accuracy(live.read_stream(spark, path, schema), "1 hour", "1 hour"), "windows", "append")
    try:
        rows(spark, tmp_path, "e", [(at(5), "a", 1)], schema)
        q.processAllAvailable()
        rows(spark, tmp_path, "e", [(at(1, 20), "a", 1), (at(9), "a", 1)], schema)
        q.processAllAvailable()
        got = {(r["window_start"].hour, r["n"], r["n_correct"], r["accuracy"]) for r in spark.table("windows").collect()}
    finally:
        q.stop()
    assert got == {(1, 2, 1, 0.5), (2, 1, 1, 1.0), (5, 1, 1, 1.0)}


def test_running_choice_keeps_state_across_batches(spark, tmp_path):
    schema = "problem_id string, candidate_index int, score double"
    path = rows(spark, tmp_path, "s", [("p", 1, 0.5), ("p", 0, 0.5), ("q", 3, 0.1)], schema)
    q = drain(live.running_choice(live.read_stream(spark, path, schema)), "choices", "update")
    try:
        first = {(r[0], r[1]) for r in spark.table("choices").collect()}
        rows(spark, tmp_path, "s", [("p", 2, 0.9), ("q", 9, 0.05)], schema)
        q.processAllAvailable()
        later = {(r[0], r[1]) for r in spark.table("choices").collect()} - first
    finally:
        q.stop()
    assert first == {("p", 0), ("q", 3)} and later == {("p", 2)}


def test_sessions_and_once(spark, tmp_path):
    schema = "ts timestamp, problem_id string"
    path = rows(spark, tmp_path, "x", [(at(1), "p"), (at(1, 10), "p"), (at(3), "p")], schema)
    q = drain(live.sessions(live.read_stream(spark, path, schema), "30 minutes", "10 minutes"), "sessions", "append")
    try:
        rows(spark, tmp_path, "x", [(at(8), "z")], schema)
        q.processAllAvailable()
        rows(spark, tmp_path, "x", [(at(8, 1), "z")], schema)
        q.processAllAvailable()
        got = {(r["problem_id"], r["session_start"].hour, r["n"]) for r in spark.table("sessions").collect()}
    finally:
        q.stop()
    assert {("p", 1, 2), ("p", 3, 1)} <= got
    q = drain(live.keep_once(live.read_stream(spark, path, schema), "problem_id"), "once", "append")
    try:
        assert sorted(r["problem_id"] for r in spark.table("once").collect()) == ["p", "z"]
    finally:
        q.stop()


def test_resume_adds_nothing_twice(spark, tmp_path):
    schema = "problem_id string, x int"
    path = rows(spark, tmp_path, "in", [("a", 1), ("b", 2)], schema)
    out = str(tmp_path / "out")
    for check in ("c1", "c2", "c1"):
        live.resume_into(live.read_stream(spark, path, schema), out, str(tmp_path / check)).awaitTermination()
    rows(spark, tmp_path, "in", [("c", 3), ("a", 9)], schema)
    live.resume_into(live.read_stream(spark, path, schema), out, str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["problem_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(out).filter(F.col("problem_id") == "a").first()["x"] == 1
