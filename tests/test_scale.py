"""What must hold at any size: ordered prefixes, splits, joins of hot keys, intermediate tables; and operators against plain Python."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quorate import joins, scratch
from quorate.functions import stats as st
from quorate.operators import candidates as ca
from quorate.operators import etl, graph, grid, leaderboard
from quorate.operators import evaluation as ev
from quorate.operators import pairs as pr
from quorate.operators import selection as se
from quorate.operators.windows import first_in_order, global_prefix
from quorate.plans import fixtures as fx
from quorate.sources import jsonl


def last_stage(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(None)
    ids = [jobs.apply(i).stageIds() for i in range(jobs.size())]
    return max((x.apply(j) for x in ids for j in range(x.size())), default=-1)


def read_by_task(spark, after):
    """Rows that each task read from shuffles, of each stage behind ``after``."""
    store = spark.sparkContext._jsc.sc().statusStore()
    for stage in range(after + 1, last_stage(spark) + 1):
        tasks = store.taskList(stage, 0, 1000)
        rows = [m.get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if (m := tasks.apply(i).taskMetrics()).isDefined()]
        yield [r for r in rows if r]


def written_to_shuffles(spark, after):
    """Bytes that the stages behind ``after`` wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    tasks = [store.taskList(stage, 0, 1000) for stage in range(after + 1, last_stage(spark) + 1)]
    return sum(m.get().shuffleWriteMetrics().bytesWritten() for t in tasks for i in range(t.size()) if (m := t.apply(i).taskMetrics()).isDefined())


@pytest.mark.parametrize("value", ["same", "null", "two", "many"])
def test_prefixes_spread_equal_keys(spark, value):
    x = {"same": F.lit(1.0), "null": F.lit(None).cast("double"), "two": (F.col("id") % 2).cast("double"), "many": F.rand(3)}[value]
    df = scratch.table(spark.range(20_000).select("id", x.alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y")).repartition(8), "t")
    after = last_stage(spark)
    # small partitions would be read by one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = scratch.table(global_prefix(df, "x", "id", {"s": "y"}, range_rows=2_000), "t")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(max(r) for r in read_by_task(spark, after) if r) < 12_000 and sum(len(r) > 3 for r in read_by_task(spark, after)) >= 2
    rows = sorted(df.collect(), key=lambda r: (r["x"] is None, -(r["x"] or 0.0), r["id"]))
    want, s = {}, 0
    for k, r in enumerate(rows, 1):
        s += r["y"]
        want[r["id"]] = (k, 20_000, s)
    assert {r["id"]: (r["k"], r["n"], r["s"]) for r in out.collect()} == want


@pytest.mark.parametrize("n, bits", [(1, 16), (2, 16), (700, 16), (700, 4), (700, 1)])
def test_splits_by_counts_of_leading_bits(spark, n, bits):
    ids = spark.range(n).select(F.col("id").alias("problem_id")).withColumn("h", etl.order_hash(5, "problem_id"))
    upto = [F.floor(F.col("n") * 0.3), F.floor(F.col("n") * 0.3) + F.floor(F.col("n") * 0.5)]
    got = {r["problem_id"]: r["part"] for r in first_in_order(ids, "h", "problem_id", upto, bits).collect()}
    order = [r["problem_id"] for r in sorted(ids.collect(), key=lambda r: (r["h"], r["problem_id"]))]
    a, b = math.floor(n * 0.3), math.floor(n * 0.3) + math.floor(n * 0.5)
    assert got == {p: (k >= a) + (k >= b) for k, p in enumerate(order)}


def test_joins_of_hot_keys(spark):
    rows = scratch.table(spark.range(5_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id").repartition(6), "t")
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    for how in ("inner", "left"):
        got = joins.spread_join(rows, one.filter("k <> 3") if how == "left" else one, ["k"], "c", 5_000, how).collect()
        first = {r["k"]: r["first"] for r in one.collect()}
        assert Counter(map(tuple, [(r["k"], r["id"], r["first"]) for r in got])) == Counter((r["k"], r["id"], None if how == "left" and r["k"] == 3 else first[r["k"]]) for r in rows.collect())


def test_intermediate_tables_can_be_cleared(spark):
    import os

    t = scratch.table(spark.range(5).toDF("id"), "mine")
    where = t._quorate_path.removeprefix("file://").removeprefix("file:")
    assert t.count() == 5 and os.path.isdir(where)
    made = list(scratch._made[spark.sparkContext.applicationId])
    scratch._made[spark.sparkContext.applicationId] = [t._quorate_path]
    assert scratch.clear(spark) == 1 and not os.path.isdir(where)
    scratch._made[spark.sparkContext.applicationId] = [p for p in made if p != t._quorate_path]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda name, default=None: None)

    class Empty:
        isEmpty = staticmethod(lambda: True)

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(lambda: Conf)

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Empty)}))

    with pytest.raises(ValueError):
        scratch.root(type("Session", (), {"sparkContext": Context}))


def test_sign_test_of_many_pairs(spark):
    cases = [(3, 0), (30, 1), (500, 480), (5_000, 4_800), (3_000_000, 2_996_000), (40_000_000, 40_000_000), (0, 0), (1_000_000, 0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a long, b long").select("i", "a", "b", st.sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        n, k = r["a"] + r["b"], min(r["a"], r["b"])
        if n <= 10_000:
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        else:  # the normal approximation with its continuity correction
            want = min(1.0, math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 4) / math.sqrt(2)))
        assert r["p"] == pytest.approx(want, rel=1e-9 if n <= 10_000 else 2e-3, abs=1e-12)


def test_harmonic_numbers(spark):
    ns = [0, 1, 2, 64, 65, 1000, 54321]
    for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", st.harmonic(F.col("n")).alias("h")).collect():
        assert r["h"] == pytest.approx(sum(1 / k for k in range(1, r["n"] + 1)), rel=1e-13)


def brute_bleu(hyp, ref, max_n=4, smooth=1.0):
    if not hyp or not ref:
        return 1.0 if not hyp and not ref else 0.0 if not hyp else None
    logs = 0.0
    for n in range(1, max_n + 1):
        a, b = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (hyp, ref))
        total = max(len(hyp) - n + 1, 0)
        p = (sum((a & b).values()) + smooth) / (total + smooth) if total else 0.0
        logs += math.log(max(1e-12, p)) / max_n
    return (math.exp(1 - len(ref) / len(hyp)) if len(hyp) < len(ref) else 1.0) * math.exp(logs)


def test_bleu_in_both_directions(spark):
    rng = random.Random(2)
    texts = {(p, i): " ".join(rng.choice("abcde.") for _ in range(rng.randint(1, 14))) for p in range(4) for i in range(6)}
    df = spark.createDataFrame([(p, i, t) for (p, i), t in texts.items()], "problem_id int, candidate_index int, candidate string")
    got = {(r["problem_id"], r["hyp"], r["ref"]): r["score"] for r in pr.bleu_directed(df, normalize=False).collect()}
    assert len(got) == 4 * 30
    for (p, i, j), s in got.items():
        assert s == pytest.approx(brute_bleu(texts[p, i].split(), texts[p, j].split()), rel=1e-9)
    for r in pr.bleu_pairs(df, normalize=False).collect():
        assert r["score"] == pytest.approx((got[r["problem_id"], r["i"], r["j"]] + got[r["problem_id"], r["j"], r["i"]]) / 2)


def test_no_break_spaces_separate(spark):
    from quorate.functions import text as tx

    r = spark.createDataFrame([("lemma foo : 1 =　1",)], "t string").select(tx.normalize(F.col("t")).alias("n"), tx.tokens(F.lit("a b c")).alias("k")).first()
    assert r["n"] == ": 1 = 1" and r["k"] == ["a", "b", "c"]


def test_raw_violations_leave_sound_lines_alone(spark):
    lines = spark.createDataFrame([('{"problem_id": "p", "candidates": ["a"], "labels": [1], "more": {"x": [1]}}',), ('{"problem_id": "p", "candidates": ["a"]}',), ("no json",), (None,)], "value string")
    got = [(r["value"], r["problem"]) for r in ca.raw_violations(lines).collect()]
    assert sorted(got, key=str) == sorted([("no json", "not an object"), (None, "not an object")], key=str)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    rows = [("" if i % 7 == 0 else "\t" if i % 7 == 1 else '{"problem_id": %d}' % i if i % 5 else '{"x": 1}') for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("﻿" + "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted(r["line"] for r in jsonl.faulty_lines(spark, f"file://{tmp_path}/a.jsonl").collect())
        assert got == [i + 1 for i in range(4000) if i % 7 > 1 and i % 5 == 0]
        with pytest.raises(ValueError, match=rf"problem_id is missing at .*a.jsonl:{got[0]}$"):
            jsonl.require_keys(spark, f"file://{tmp_path}/a.jsonl")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_numbered_across_the_parts_of_a_file(spark, sf, tmp_path):
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("\n".join('{"problem_id": 1}' if i % 5 else '{"x": 1}' for i in range(10 * part, 10 * part + 10)) + "\n")
    assert sorted(r["line"] for r in jsonl.faulty_lines(spark, f"file://{tmp_path}", as_one=True).collect()) == [1, 6, 11, 16, 21, 26]
    # the query's numbers run over the whole table
    turns = [r["conv_id"] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").orderBy("conv_id").collect()]
    got = entry.queries()["OP-002_faulty_lines"](spark, sf).select("line").collect()
    assert sorted(r["line"] for r in got) == [3 * (i + 1) for i, c in enumerate(turns) if c % 5 == 0]


def test_first_rows_are_those_of_the_first_file(spark, tmp_path):
    # the larger file goes to the first task
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/t/a")
    spark.range(100, 60_000).coalesce(1).write.parquet(f"{tmp_path}/t/b")
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/t")
    got = [tuple(r) for r in jsonl.inspect(df, 3, order=jsonl.FILE_ORDER).orderBy("row").collect()]
    assert got == [(0, "id", "bigint", "0"), (1, "id", "bigint", "1"), (2, "id", "bigint", "100")]


def _many_documents(spark, tmp_path):
    """3,000 documents of one source and one of another."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 2999, "x").when(F.col("id") % 3 == 2, F.concat(F.lit("other text "), F.col("id"))).otherwise("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    d = d.unionByName(d.limit(1).withColumn("source", F.lit("t"))).repartition(3)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")


def test_a_source_is_one_problem_however_many_documents_it_has(spark, tmp_path):
    _many_documents(spark, tmp_path)
    rows = fx.doc_candidates(spark, str(tmp_path)).filter("problem_id = 'en|s'").select("candidate_index", "row_no").collect()
    assert sorted(map(tuple, rows)) == [(i, i) for i in range(3000)]
    got = entry.queries()["OP-104_majority"](spark, str(tmp_path)).collect()
    assert sorted((r["problem_id"], r["candidate_index"]) for r in got) == [("en|s", 0), ("en|t", 0)]


def test_first_and_shortest_of_a_source_are_of_all_its_documents(spark, tmp_path):
    _many_documents(spark, tmp_path)
    got = entry.queries()["OP-155_first_and_shortest"](spark, str(tmp_path)).collect()
    assert sorted((r["problem_id"], r["first_index"], r["shortest_index"]) for r in got) == [("en|s", 0, 2999), ("en|t", 0, 0)]


def test_first_and_shortest_move_no_texts(spark, tmp_path):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    after = last_stage(spark)
    got = entry.queries()["OP-155_first_and_shortest"](spark, str(tmp_path)).collect()
    assert [(r["problem_id"], r["first_index"], r["shortest_index"]) for r in got] == [("en|s", 0, 0)]
    # the texts have 1.6 MB
    assert 0 < written_to_shuffles(spark, after) < 100_000


def test_arrow_caches_by_split(spark, tmp_path):
    df = spark.range(1000).select("id", F.array(F.col("id"), F.lit(None)).alias("a"), F.concat(F.lit("é"), F.col("id")).alias("s")).repartition(3)
    jsonl.write_arrow_splits({"train": df.filter("id < 900"), "test": df.filter("id >= 900")}, str(tmp_path))
    assert len(list((tmp_path / "train").glob("*.arrow"))) == 3
    got = jsonl.resolve_split(spark, "org/x", "test", names={"org/x": f"file://{tmp_path}"})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.filter("id >= 900").collect()))
    assert jsonl.resolve_split(spark, f"file://{tmp_path}", "train").count() == 900


def test_miss_summary_by_hand(spark):
    misses = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25), (3, 7, 1.0), (4, 30, 0.25)], "problem_id int, best_rank int, gap double")
    r = ev.miss_summary(misses).first()
    assert (r["n"], r["le_2"], r["le_5"], r["le_10"], r["le_20"], r["mean_gap"], r["median_gap"]) == (4, 1, 2, 3, 3, 0.5, 0.5)


def test_global_medoid_mode_rejects_partial_pairs(spark):
    nodes = spark.createDataFrame([(1, i, 5) for i in range(3)], "problem_id int, candidate_index int, length int")
    pairs = spark.createDataFrame([(1, 0, 1, 0.9), (1, 0, 2, 0.9), (1, 1, 2, 0.1)], "problem_id int, i int, j int, score double")
    r = se.global_medoid_mode(nodes, pairs).first()
    assert (r["chosen_index"], r["size"]) == (0, 3) and r["cohesion"] == pytest.approx(1.9 / 3)
    with pytest.raises(ValueError):
        se.global_medoid_mode(nodes, pairs, pair_mode="knn")
    with pytest.raises(ValueError):
        se.fallback_choice("other", nodes, pairs, pairs)


def brute_selection(n, sim, threshold, tie, rank, k, lengths):
    """One configuration without pruning, in plain Python: (choice, size, cohesion)."""
    near = {i: {j for _, j in sorted((-sim[min(i, j), max(i, j)], j) for j in range(n) if j != i)[:k]} for i in range(n)}
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), s in sim.items():
        if s >= threshold and (not k or (j in near[i] and i in near[j])):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    comps = {}
    for i in range(n):
        comps.setdefault(find(i), []).append(i)
    coh = {c: (sum(sim[i, j] for i in m for j in m if i < j) / (len(m) * (len(m) - 1) / 2) if len(m) > 1 else 1.0) for c, m in comps.items()}
    key = (lambda c: (-len(comps[c]), -round(coh[c], 12), c)) if rank == "size_then_cohesion" else (lambda c: (-round(coh[c], 12), -len(comps[c]), c))
    best = min(comps, key=key)
    m = comps[best]
    if tie == "shortest":
        return min(m, key=lambda i: (lengths[i], i)), len(m), coh[best]
    cent = {i: (sum(sim[min(i, j), max(i, j)] for j in m if j != i) / (len(m) - 1) if len(m) > 1 else 1.0) for i in m}
    return min(m, key=lambda i: (-round(cent[i], 12), lengths[i], i)), len(m), coh[best]


def test_selection_grid_by_brute_force(spark):
    rng = random.Random(7)
    problems = {p: (n := rng.randint(1, 7), {(i, j): rng.randint(0, 20) / 20 for i in range(n) for j in range(i + 1, n)}, [rng.randint(1, 9) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]) for p in range(25)}
    nodes = spark.createDataFrame([(p, i, le[i], la[i]) for p, (n, _, le, la) in problems.items() for i in range(n)], "problem_id int, candidate_index int, length int, label int")
    pairs = spark.createDataFrame([(p, i, j, s) for p, (_, sim, _, _) in problems.items() for (i, j), s in sim.items()], "problem_id int, i int, j int, score double")
    configs = [(t, tie, rank, k, 0.0, 0.7) for t in (0.4, 0.8) for tie in ("medoid", "shortest") for rank in ("size_then_cohesion", "cohesion") for k in (0, 2)]
    rows = leaderboard.selection_grid(nodes, pairs, configs, {"first": se.first_candidate(nodes)}, ensemble="medoid").collect()
    by = {r["config"]: r for r in rows if r["strategy"] == "selection"}
    assert len(by) == len(configs) and {r["strategy"] for r in rows} == {"selection", "first", "ensemble"}
    for c, (t, tie, rank, k, _, _) in enumerate(configs):
        got = [(la, *brute_selection(n, sim, t, tie, rank, k, le)) for n, sim, le, la in problems.values()]
        assert by[c]["n_correct"] == sum(la[x] for la, x, _, _ in got), configs[c]
        assert by[c]["avg_size"] == pytest.approx(sum(s for _, _, s, _ in got) / len(got)) and by[c]["avg_cohesion"] == pytest.approx(sum(h for *_, h in got) / len(got))
        assert by[c]["n_any"] == sum(max(la) for _, _, _, la in problems.values())
    first = next(r for r in rows if r["strategy"] == "first")
    assert first["n_correct"] == sum(la[0] for *_, la in problems.values())


def test_selection_grid_sends_no_table_of_nodes_through_the_driver(spark, monkeypatch):
    nodes = spark.range(60).select((F.col("id") % 10).alias("problem_id"), F.expr("cast(id div 10 as int)").alias("candidate_index"), (F.col("id") % 7).alias("length"), (F.col("id") % 2).cast("int").alias("label"))
    a = nodes.select("problem_id", F.col("candidate_index").alias("i"))
    pairs = a.join(nodes.select("problem_id", F.col("candidate_index").alias("j")), "problem_id").filter("i < j").withColumn("score", (F.col("i") * 7 + F.col("j") * 3) % 10 / 10)
    nodes, pairs, plans, cut = scratch.table(nodes), scratch.table(pairs), [], grid.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(grid, "cut", lambda df: plans.append(plan(df)) or cut(df))
    configs = [(0.3, tie, "cohesion", k, m, 0.7) for tie in ("medoid", "shortest") for k in (0, 2) for m in (0.0, 0.1)]
    chosen = grid.choices(nodes, pairs, configs, {}, ensemble="medoid")
    plans.append(plan(grid.totals(chosen, nodes)))
    # but for the list of configurations, which is short
    assert len(plans) > 10 and not [x for x in plans if "BroadcastHashJoin" in x and "slot" not in x]


@pytest.mark.parametrize("mode", ["components", "support"])
def test_selection_grid_is_each_graph_by_itself(spark, mode):
    """All graphs go through one loop; pruned, thinned and rescued ones too give what each gives alone."""
    rng = random.Random(11)
    sizes = {p: rng.randint(1, 7) for p in range(12)}
    nodes = spark.createDataFrame([(p, i, rng.randint(1, 9), rng.randint(0, 1)) for p, n in sizes.items() for i in range(n)], "problem_id int, candidate_index int, length int, label int")
    pairs = spark.createDataFrame([(p, i, j, rng.randint(0, 20) / 20) for p, n in sizes.items() for i in range(n) for j in range(i + 1, n)], "problem_id int, i int, j int, score double")
    configs = [(0.4, "medoid", "size", 0, 0.2, 0.7), (0.4, "shortest", "cohesion", 2, 0.2, 0.5), (0.6, "first", "size_times_cohesion", 0, 0.0, 0.5)]
    by = {r["config"]: r for r in leaderboard.selection_grid(nodes, pairs, configs, {}, mode=mode).collect()}
    labels = {(r["problem_id"], r["candidate_index"]): r["label"] for r in nodes.collect()}
    for c, (t, tie, rank, k, margin, share) in enumerate(configs):
        comps, _ = graph.ranked_components(nodes.select("problem_id", "candidate_index"), pairs, t, rank=rank, mutual_k=k, margin=margin, mode=mode, support=share)
        alone = se.representatives(comps, nodes.select("problem_id", "candidate_index", "length"), pairs, tie).collect()
        best = comps.filter("rank = 1").collect()
        assert by[c]["n_correct"] == sum(labels[r["problem_id"], r["chosen_index"]] for r in alone)
        assert by[c]["problems"] == len(sizes) and by[c]["avg_size"] == pytest.approx(sum(r["size"] for r in best) / len(best))
        assert by[c]["avg_cohesion"] == pytest.approx(sum(r["cohesion"] for r in best) / len(best))
