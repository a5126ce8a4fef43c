"""Sources, sinks, reports and timed steps on files."""
import json

import pytest
from pyspark.sql import functions as F

from quorate import reports
from quorate.operators import evaluation as ev
from quorate.operators import leaderboard
from quorate.plans.steps import Steps
from quorate.sources import jsonl

SCHEMA = "problem_id string, x int"


def write(path, *lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_keyed_scan(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '﻿{"problem_id": "a", "x": 1}', "", '{"problem_id": "b", "x": 2}', "  ", '{"problem_id": "a", "x": 3}')
    assert {r["problem_id"]: r["x"] for r in jsonl.read_keyed(spark, p, SCHEMA).collect()} == {"a": 3, "b": 2}
    assert {r["problem_id"]: r["x"] for r in jsonl.read_keyed(spark, p, SCHEMA, first=True).collect()} == {"a": 1, "b": 2}
    assert jsonl.read_rows(spark, p, SCHEMA).count() == 3
    with pytest.raises(Exception, match="missing"):
        jsonl.read_keyed(spark, write(tmp_path / "b.jsonl", '{"x": 1}'), SCHEMA).collect()
    with pytest.raises(Exception):
        jsonl.read_rows(spark, write(tmp_path / "c.jsonl", "{broken"), SCHEMA).collect()


def test_split_resolution(spark, tmp_path):
    d = tmp_path / "set"
    d.mkdir()
    write(d / "validation.jsonl", '{"problem_id": "v", "x": 1}')
    write(d / "test-0.jsonl", '{"problem_id": "t", "x": 1}')
    for want, split in (("v", "valid"), ("t", "test"), ("v", "train")):
        assert jsonl.resolve_split(spark, str(d), split).first()["problem_id"] == want
    with pytest.raises(FileNotFoundError):
        jsonl.resolve_split(spark, str(d), "other")
    assert jsonl.resolve_split(spark, str(d / "test-0.jsonl"), "any").count() == 1


def test_ids_settings_and_temperature(spark, tmp_path):
    assert sorted(r["problem_id"] for r in jsonl.read_ids(spark, write(tmp_path / "ids", " a ", "", "b")).collect()) == ["a", "b"]
    rows = spark.createDataFrame([(1, "# t=1"), (2, "a=1"), (3, "a=x"), (4, "a=2"), (5, "b")], "place int, value string")
    assert {r["name"]: r["value"] for r in jsonl.parse_settings(rows).collect()} == {"a": 2.0}
    js = spark.createDataFrame([('{"temperature": {"fitted": 2.0}}',), ('{"temperature": {"fitted": 0, "input": 3}}',), ("{}",)], "j string")
    assert [r[0] for r in js.select(jsonl.temperature(F.col("j"))).collect()] == [2.0, 3.0, 1.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], SCHEMA)
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    lines = sorted(x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"problem_id": "a", "x": 1}, {"problem_id": "b", "x": None}]
    text = jsonl.write_summary(df.agg(F.count(F.lit(1)).alias("n"), F.lit("é").alias("a")), str(tmp_path / "s.json"))
    assert (tmp_path / "s.json").read_text(encoding="utf-8") == text == '{\n  "a": "é",\n  "n": 2\n}\n'
    sink = str(tmp_path / "sink")
    assert jsonl.append_new(spark, df.limit(1), sink) == 0 and jsonl.append_new(spark, df, sink) == 1 and jsonl.append_new(spark, df, sink) == 2
    assert spark.read.parquet(sink).count() == 2
    jsonl.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).first()["split"] == "train"
    assert jsonl.inspect(df, 1, 1).count() == 2 and "spark" in jsonl.probe(spark)


def test_reports(spark):
    c = spark.createDataFrame([("p", 0, 1), ("p", 1, 0), ("q", 0, 0)], "problem_id string, candidate_index int, label int")
    sel = spark.createDataFrame([("p", 0), ("q", 0)], "problem_id string, chosen_index int")
    text = reports.evaluation(ev.evaluate(ev.decisions(c, sel)))
    assert "Problems: 2; accepted 2, abstained 0." in text and "- selected: 50.0% [" in text
    m = sel.withColumn("method", F.lit("a")).unionByName(sel.withColumn("method", F.lit("b")))
    d = leaderboard.method_decisions(c, m, ["a", "b"])
    s = leaderboard.summary(d)
    board = reports.leaderboard(s, leaderboard.frontier(s), leaderboard.paired_matrix(d), leaderboard.disagreements(d, "a"))
    assert board.startswith("# Leaderboard") and board.count("## ") == 4 and "| method |" in board
    a = d.filter("method = 'a'").select("problem_id", "correct")
    assert "p = 1." in reports.comparison(ev.paired(a, a), "a", "a")
    assert reports.cell(None) == "-" and reports.cell("a|b\nc") == "a\\|b c" and reports.cell(0.5) == "0.5000"


def test_steps(spark, tmp_path):
    run = Steps(spark, str(tmp_path))
    run.run("one", lambda _: spark.range(3))
    assert run.run("two", lambda r: r["one"].filter("id > 0")).count() == 2
    assert [(r["step"], r["rows"]) for r in run.timings().collect()] == [("one", 3), ("two", 2)] and run.settings_text().startswith("one=")
