"""The keyed store under concurrent and cut writers, the stored check cache, the cache data source, the table function, temperature by derivatives, and state that goes."""
import datetime as dt
import json
import math
import os
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorate import scratch
from quorate.operators import calibration as cal
from quorate.operators import scorers
from quorate.sources import cache, jsonl
from quorate.sources.store import KeyedStore
from quorate.streaming import live

SCHEMA = "problem_id string, x int"


def keyed(spark, ids, x=0):
    return spark.createDataFrame([(i, x) for i in ids], SCHEMA)


def ids(df):
    return sorted(r["problem_id"] for r in df.collect())


def test_two_writers_at_once_write_each_id_once(spark, tmp_path):
    """Every writer reads version -1 before any commits, so that all but the first lose a race."""
    path, meet, errors = str(tmp_path / "s"), threading.Barrier(3), []

    class Slow(KeyedStore):
        def _write(self, rows):
            out = super()._write(rows)
            if not getattr(self, "met", False):
                self.met = True
                meet.wait(60)
            return out

    def run(k):
        try:
            Slow(spark, path, SCHEMA, buckets=4).append_new(keyed(spark, [f"id{i}" for i in range(10 * k, 10 * k + 30)], k))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = KeyedStore(spark, path, SCHEMA, buckets=4)
    assert not errors and ids(store.read()) == sorted(f"id{i}" for i in range(50)) and store.version() == 2 and store.count() == 50
    assert not [n for n in os.listdir(tmp_path / "s" / "_log") if n.startswith(("tmp", ".tmp"))]


def test_a_run_cut_before_its_commit_leaves_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.append_new(keyed(spark, ["a", "b"]))

    class Cut(KeyedStore):
        def _commit(self, version, batches):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Cut(spark, store.path, SCHEMA, buckets=4).append_new(keyed(spark, ["b", "c", "d"], 1))
    assert ids(store.read()) == ["a", "b"]
    store.append_new(keyed(spark, ["b", "c", "d"], 2))
    assert {(r["problem_id"], r["x"]) for r in store.read().collect()} == {("a", 0), ("b", 0), ("c", 2), ("d", 2)}
    assert store.vacuum() == 1 and ids(store.read()) == ["a", "b", "c", "d"]


def test_lists_are_exclusive_on_any_file_system(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA)
    fs, a = store._fs(f"{store.path}/_log/a")
    for name in ("a", "b"):
        out = fs.create(store._fs(f"{store.path}/_log/{name}")[1], False)
        out.write(bytearray(name.encode()))
        out.close()
    target = store._fs(f"{store.path}/_log/000000000000.json")[1]
    assert store._rename(a, target) and not store._rename(store._fs(f"{store.path}/_log/b")[1], target)
    assert store._commit(0, []) is False and store._commit(1, []) and store.version() == 1


def test_empty_repeated_and_null_keys(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    assert store.read().count() == 0 and store.lookup(keyed(spark, ["a"])).count() == 0
    assert store.append_new(keyed(spark, [])) == -1 and store.append_new(keyed(spark, [None, None])) == -1
    store.append_new(keyed(spark, ["a", "a", None, ""]))
    assert ids(store.read()) == ["", "a"] and store.append_new(keyed(spark, ["a", ""])) == 0


def test_a_lookup_reads_its_own_buckets(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=16)
    store.append_new(keyed(spark, [f"k{i}" for i in range(400)]))
    store.append_new(keyed(spark, [f"m{i}" for i in range(400)]))
    found = store.lookup(keyed(spark, ["k7", "m9", "other"]))
    assert ids(found) == ["k7", "m9"]
    buckets = {f.split("__bucket=")[1].split("/")[0] for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len({r["b"] for r in keyed(spark, ["k7", "m9", "other"]).select(store._bucket(F.col("problem_id")).alias("b")).collect()}) <= 3 <= len(buckets)
    before = store.count()
    assert store.compact() == 2 and len(store.batches()) == 1 and store.count() == before == store.read().count() and len(store.batches(1)) == 2


@pytest.fixture
def calls(spark, tmp_path):
    """A checker that notes each text it is asked for in a file, and what was noted since it was last read."""
    folder = str(tmp_path / "asked")
    os.makedirs(folder)

    def checker(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(list(texts), f)
        return texts.str.len() % 2 == 0

    def noted():
        out = [t for n in os.listdir(folder) for t in json.load(open(f"{folder}/{n}"))]
        [os.remove(f"{folder}/{n}") for n in os.listdir(folder)]
        return sorted(out)

    return checker, noted


def test_a_stored_check_is_made_once(spark, tmp_path, calls):
    checker, noted = calls
    store = jsonl.memo_store(spark, str(tmp_path / "memo"))
    rows = [("p", 0, "ab"), ("p", 1, "abc"), ("q", 0, "ab"), ("q", 1, "")]
    df = spark.createDataFrame(rows, "problem_id string, candidate_index int, candidate string")
    want = {(p, i, len(t) % 2 == 0) for p, i, t in rows}
    got = lambda d: {(r["problem_id"], r["candidate_index"], r["typechecks"]) for r in scorers.checked_once(d, checker, store).collect()}
    assert got(df) == want and noted() == ["", "ab", "abc"]
    assert got(df) == want and noted() == []
    more = df.unionByName(spark.createDataFrame([("r", 0, "new"), ("r", 1, "abc")], df.schema))
    assert got(more) == want | {("r", 0, False), ("r", 1, False)} and noted() == ["new"]


# --- the cache data source ---------------------------------------------------------------------------------------------------------------


def test_cache_of_two_versions_of_two_sets(spark, tmp_path):
    root = str(tmp_path)
    for dataset in ("org/set", "org/set-b"):
        for rev, k in (("r1", 1), ("r2", 2)):
            cache.write_cached(spark.range(2_500).select(F.lit(f"{dataset} {rev}").alias("who"), "id"), root, dataset, rev, "test", ["test"], 1_000)
    for dataset in ("org/set", "org/set-b"):
        for rev in ("r1", "r2"):
            df = cache.read_cached(spark, root, dataset, "test", rev)
            assert df.rdd.getNumPartitions() == 3 and {(r["who"], r["n"]) for r in df.groupBy("who").agg(F.count_distinct("id").alias("n")).collect()} == {(f"{dataset} {rev}", 2_500)}
    assert cache.read_cached(spark, root, "org/set", "train").count() == 2_500  # test stands in for a missing training split
    for split, message in (("valid", r"\['test'\]"), ("test", "no cache of 'org/none'")):
        with pytest.raises(Exception, match=message):
            cache.find_split(root, "org/none" if split == "test" else "org/set", split)
    with pytest.raises(Exception, match="no cache at"):
        cache.find_split(f"{root}/nowhere", "a", "test")


def test_cache_with_faults(spark, tmp_path):
    folder = tmp_path / "own___x" / "default" / "0"
    folder.mkdir(parents=True)
    (folder / "dataset_info.json").write_text("{not json")
    other = tmp_path / "own___y"
    other.mkdir()
    (other / "dataset_info.json").write_text(json.dumps({"download_checksums": {"hf://datasets/own/x@1/f": {}}}))
    with pytest.raises(FileNotFoundError, match="no file of split 'test'"):
        cache.find_split(str(tmp_path), "own/x", "test")
    t = pa.table({"w": pa.array(["a", "b", "a"]).dictionary_encode()})
    with pa.OSFile(str(other / "x_test.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    path = cache.find_split(str(tmp_path), "own/x", "test")[0]
    assert cache.batches_of(path) == [-1] and sum(b.num_rows for b in cache.read_batch(path, -1)) == 3
    with pa.OSFile(str(other / "x.valid.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("n", pa.int64())])) as w:
        w.write_batch(pa.record_batch({"n": [1, 2]}))
        w.write_batch(pa.record_batch({"n": [3]}))
    assert sorted(r[0] for r in cache.read_cached(spark, str(tmp_path), "own/x", "valid").collect()) == [1, 2, 3]


def test_a_name_is_looked_for_in_order(spark, tmp_path):
    def write(folder, text):
        folder.mkdir(parents=True)
        (folder / "test.jsonl").write_text(json.dumps({"problem_id": text}) + "\n")

    write(tmp_path / "repo" / "org" / "d", "below the base")
    write(tmp_path / "mapped", "mapped")
    cache.write_cached(spark.createDataFrame([("cached",)], "problem_id string"), str(tmp_path / "cache"), "org/d", "1", "test", ["test"])
    said = lambda **kw: jsonl.resolve_split(spark, "org/d", "test", **kw).first()["problem_id"]
    names, base, at = {"org/d": str(tmp_path / "mapped")}, str(tmp_path / "repo"), str(tmp_path / "cache")
    assert said(names=names, base=base, cache=at) == "below the base"
    assert said(names=names, base=str(tmp_path), cache=at) == "mapped"
    assert said(base=str(tmp_path), cache=at) == "cached"


def test_paths_without_a_scheme_are_qualified(spark):
    assert scratch.qualified(spark, "/x/y") == "file:///x/y" and scratch.qualified(spark, "hdfs://a/b") == "hdfs://a/b"


# --- table function, temperature, state -----------------------------------------------------------------------------------------------------


def test_sampler_gives_as_many_rows_as_there_are_answers(spark):
    scorers.register_sampler(spark, "answers", lambda prompt, seed: None if seed == 3 else f"{prompt}{seed % 2}", "string")
    spark.createDataFrame([("a", "x", 5, 0), ("b", "y", 0, 0), ("c", "z", 1, 3), ("d", "w", None, 0)], "problem_id string, prompt string, n int, seed int").createOrReplaceTempView("asked")
    got = spark.sql("SELECT s.* FROM asked p, LATERAL answers(p.problem_id, p.prompt, p.n, p.seed) s").collect()
    assert sorted(map(tuple, got)) == [("a", 0, "x0"), ("a", 1, "x1")]


def by_halving(rows):
    a, b = math.log(cal.LOW_T), math.log(cal.HIGH_T)
    for _ in range(80):
        m = (a + b) / 2
        pull = sum((1 / (1 + math.exp(-s * math.exp(-m))) - y) * s for s, y in rows)
        a, b = (m, b) if pull > 0 else (a, m)
    return math.exp((a + b) / 2)


@pytest.mark.parametrize("scale, noise", [(0.2, 0.3), (1.0, 0.1), (1.0, 0.45), (8.0, 0.2), (3.0, 0.02)])
def test_temperature_in_few_passes(spark, monkeypatch, scale, noise):
    rng = random.Random(int(scale * 10 + noise * 100))
    rows = [(s := rng.gauss(0, 2) * scale, int((s > 0) != (rng.random() < noise))) for _ in range(3_000)]
    passes, real = [], cal._slopes
    monkeypatch.setattr(cal, "_slopes", lambda g, points: (passes.append(len(points)), real(g, points))[1])
    got = cal.fit_temperature(spark.createDataFrame(rows, "score double, label int"))
    assert abs(got / by_halving(rows) - 1) < 1e-9 and len(passes) <= 8


def test_temperature_at_the_ends_of_its_range(spark):
    fit = lambda rows: cal.fit_temperature(spark.createDataFrame(rows, "score double, label int"))
    assert fit([(1.0, 1), (2.0, 1), (-1.0, 0)]) == pytest.approx(cal.LOW_T, rel=0.5)
    assert fit([(1.0, 0), (2.0, 0), (-1.0, 1)]) == pytest.approx(cal.HIGH_T, rel=1e-6)
    with pytest.raises(ValueError, match="no scores"):
        fit([])


def test_closing_choice_forgets(spark, tmp_path):
    """Problems without rows for an hour are given out once, and the store holds the others alone; late rows change nothing."""
    own = spark.newSession()
    for k, v in {**live.STATE_STORE, "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC"}.items():
        own.conf.set(k, v)
    schema, path, start = "problem_id string, candidate_index int, score double, ts timestamp", str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    write = lambda rows: own.createDataFrame([(p, i, s, start + dt.timedelta(minutes=m)) for p, i, s, m in rows], schema).coalesce(1).write.mode("append").parquet(path)
    write([(f"p{k}", 1, 0.5, k % 5) for k in range(20)] + [("p0", 0, 0.5, 1), ("p1", 4, 0.9, 2)])
    q = live.closing_choice(live.read_stream(own, path, schema), 60, "10 minutes").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        held = [q.lastProgress["stateOperators"][0]["numRowsTotal"]]
        write([("z", 1, 0.1, 200)])
        q.processAllAvailable()
        write([("z", 2, 0.2, 201), ("p0", 9, 9.9, 3)])  # the second is late
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = {r["problem_id"]: (r["chosen_index"], r["score"], r["n"]) for r in own.table("closed").collect()}
    finally:
        q.stop()
    assert len(got) == 20 and got["p0"] == (0, 0.5, 2) and got["p1"] == (4, 0.9, 2) and got["p7"] == (1, 0.5, 1)
    assert held[0] >= 20 and held[1] < held[0] / 3
