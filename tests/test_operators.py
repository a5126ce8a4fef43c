"""Operators on small relations with known answers."""
import pytest
from pyspark.sql import functions as F

from quorate.operators import calibration as cal
from quorate.operators import candidates as ca
from quorate.operators import etl, graph, leaderboard, scorers
from quorate.operators import evaluation as ev
from quorate.operators import pairs as pr
from quorate.operators import selection as se
from quorate.operators import selective as sv
from quorate.operators.windows import global_prefix


def nodes(spark, *lengths, pid="p"):
    return spark.createDataFrame([(pid, i, n) for i, n in enumerate(lengths)], "problem_id string, candidate_index int, length int")


def pairs(spark, scores, pid="p"):
    return spark.createDataFrame([(pid, i, j, float(s)) for (i, j), s in scores.items()], "problem_id string, i int, j int, score double")


def scored(spark, groups):
    """{pid: [(score, label), ...]}"""
    return spark.createDataFrame([(p, i, float(s), y) for p, g in groups.items() for i, (s, y) in enumerate(g)], "problem_id string, candidate_index int, score double, label int")


def test_medoid_of_a_hub(spark):
    n, p = nodes(spark, 1, 2, 3), pairs(spark, {(0, 1): 0.9, (0, 2): 0.9, (1, 2): 0.1})
    r = se.medoid(pr.centrality(n, p), "length").first()
    assert r["chosen_index"] == 0 and r["centrality"] == pytest.approx(0.9) and r["gap"] == pytest.approx(0.4)


def test_largest_component(spark):
    n, p = nodes(spark, 1, 2, 3), pairs(spark, {(0, 1): 0.9, (0, 2): 0.1, (1, 2): 0.1})
    c, stats = graph.ranked_components(n, p, 0.5)
    top = c.filter("rank = 1").first()
    assert top["indices"] == [0, 1] and se.representatives(c, n, p, "shortest").first()["chosen_index"] == 0
    s = stats.first()
    assert (s["edges_before"], s["components_before"], s["isolated_before"]) == (1, 2, 1)


def test_simple_top_k(spark):
    c = spark.createDataFrame([("p", 0, 30, 0.9, 5.0), ("p", 1, 10, 0.85, 1.0), ("p", 2, 20, 0.2, 0.5)], "problem_id string, candidate_index int, length int, centrality double, pen double")
    assert se.medoid(c, "length", simple_k=2, penalty_col="pen").first()["chosen_index"] == 1
    assert se.medoid(c, "length", simple_k=2, max_drop=0.01, penalty_col="pen").first()["chosen_index"] == 0
    assert se.medoid(c, "length", simple_k=3, penalty_col="pen").first()["gap"] == pytest.approx(0.05)


@pytest.mark.parametrize("a, b, want", [("a b c", "a b c", 0.001), ("a b c d", "a b c d", 1.0), ("a b c d e", "a b c x e", 0.537284966), ("a b c d e f", "a b c d", 0.610659406), ("theorem t1 : 1 = 1 := rfl", "theorem t1 : 2 = 2 := rfl", 0.397635364), ("", "a", 0.0), ("", "", 1.0)])
def test_bleu(spark, a, b, want):
    df = spark.createDataFrame([("p", 0, a), ("p", 1, b)], "problem_id string, candidate_index int, candidate string")
    assert pr.bleu_pairs(df).first()["score"] == pytest.approx(want, abs=1e-9)


def test_jaccard_cosine_hybrid(spark):
    df = spark.createDataFrame([("p", 0, "a b", [1.0, 0.0]), ("p", 1, "b c", [1.0, 1.0]), ("p", 2, "", [0.0, 0.0])], "problem_id string, candidate_index int, candidate string, embedding array<double>")
    j = {(r["i"], r["j"]): r["score"] for r in pr.jaccard_pairs(df).collect()}
    assert j == {(0, 1): pytest.approx(1 / 3), (0, 2): 0.0, (1, 2): 0.0}
    c = {(r["i"], r["j"]): r["score"] for r in pr.cosine_pairs(df).collect()}
    assert c[0, 1] == pytest.approx(2**-0.5) and c[0, 2] == 0
    h = {(r["i"], r["j"]): r["score"] for r in pr.hybrid_pairs(pr.jaccard_pairs(df), pr.cosine_pairs(df), 0.25).collect()}
    assert h[0, 1] == pytest.approx(0.25 / 3 + 0.75 * 2**-0.5)
    with pytest.raises(ValueError):
        pr.hybrid_pairs(df, df, 1.5)


def test_mutual_and_union_neighbours(spark):
    p = pairs(spark, {(0, 1): 0.9, (0, 2): 0.8, (1, 2): 0.1, (0, 3): 0.7, (1, 3): 0.0, (2, 3): 0.6})
    as_set = lambda df: {(r["i"], r["j"]) for r in df.collect()}
    assert as_set(pr.knn_edges(p, 1, True)) == {(0, 1)} and as_set(pr.knn_edges(p, 1, False)) == {(0, 1), (0, 2), (0, 3)}
    assert {r["score"] for r in pr.knn_scored(p, pr.knn_edges(p, 1, True)).collect()} == {0.9, 0.0}


def test_triangle_prune_and_rescue(spark):
    n, p = nodes(spark, 1, 1, 1), pairs(spark, {(0, 1): 0.9, (1, 2): 0.8, (0, 2): 0.1})
    e = graph.threshold_edges(p, 0.5)
    left = graph.prune_triangles(e, p, 0.5, 0.2)
    assert [(r["i"], r["j"]) for r in left.collect()] == [(0, 1)]
    assert graph.prune_triangles(e, p, 0.5, 0.75).count() == 2 and graph.prune_triangles(e, p, 0.5, 0.0).count() == 2
    assert [tuple(r)[1:3] for r in graph.rescue_isolates(n, left, e).collect()] == [(1, 2)]
    tie = pairs(spark, {(0, 1): 0.8, (1, 2): 0.8, (0, 2): 0.1})
    assert [(r["i"], r["j"]) for r in graph.prune_triangles(graph.threshold_edges(tie, 0.5), tie, 0.5, 0.2).collect()] == [(1, 2)]
    _, stats = graph.ranked_components(n, p, 0.5, margin=0.2)
    s = stats.first()
    assert (s["edges_before"], s["edges_after"], s["edges_readded"], s["isolated_after"]) == (2, 2, 1, 0)


def test_rescue_is_sequential(spark):
    n = nodes(spark, 1, 1, 1, 1)
    eligible = pairs(spark, {(0, 1): 0.9, (1, 2): 0.95, (2, 3): 0.99})
    # 0 takes its pair with 1, so 1 needs none; 2 then takes 3
    assert {(r["i"], r["j"]) for r in graph.rescue_isolates(n, eligible.limit(0), eligible).collect()} == {(0, 1), (2, 3)}


def test_components_of_a_chain(spark):
    n = nodes(spark, *([1] * 12))
    e = pairs(spark, {(i, i + 1): 1.0 for i in range(0, 9)})
    got = {r["candidate_index"]: r["component"] for r in graph.components(n, e).collect()}
    assert got == {**{i: 0 for i in range(10)}, 10: 10, 11: 11}


def test_components_in_tasks_and_by_rounds(spark):
    import random

    rng = random.Random(3)
    links = {(p, *sorted(rng.sample(range(60), 2))) for p in ("a", "b", "c") for _ in range({"a": 20, "b": 45, "c": 0}[p])}
    n = spark.createDataFrame([(p, i) for p in ("a", "b", "c") for i in range(60) if i % 7] + [("a", 1)], "problem_id string, candidate_index int")
    e = spark.createDataFrame([(*x, 1.0) for x in links] + [("d", 0, 1, 1.0)], "problem_id string, i int, j int, score double")
    want = {}
    for p in ("a", "b", "c"):
        ids = [i for i in range(60) if i % 7]
        label = {i: i for i in ids}
        for _ in ids:
            for q, i, j in links:
                if q == p and i in label and j in label:
                    label[i] = label[j] = min(label[i], label[j])
        want |= {(p, i): label[i] for i in ids}
    # all in tasks; the two with the most rows by rounds; all by rounds
    for bound in (graph.LOCAL_ROWS, 60, 0):
        got = graph.components(n, e, local_rows=bound).collect()
        assert len(got) == len(want) and {(r["problem_id"], r["candidate_index"]): r["component"] for r in got} == want
    assert graph.components(n.limit(0), e).count() == 0


def test_support_clusters(spark):
    n = nodes(spark, 1, 1, 1, 1)
    p = pairs(spark, {(0, 1): 0.9, (0, 2): 0.9, (1, 2): 0.9, (0, 3): 0.6, (1, 3): 0.1, (2, 3): 0.1})
    got = {tuple(r["indices"]): r["cohesion"] for r in graph.support_clusters(n, graph.threshold_edges(p, 0.5), p, 0.7).collect()}
    assert (0, 1, 2) in got and got[0, 1, 2] == pytest.approx(0.9) and all(len(k) < 4 for k in got)


def test_densify(spark):
    e = pairs(spark, {(0, 1): 1, (0, 2): 1, (1, 2): 1, (2, 3): 1})
    c = spark.createDataFrame([("p", [0, 1, 2, 3]), ("p", [3]), ("q", [0, 1])], "problem_id string, indices array<int>")
    got = sorted((r["problem_id"], r["indices"]) for r in graph.densify(c, e, 0.75).collect())
    assert got == [("p", [0, 1, 2]), ("p", [3]), ("q", [1])]
    assert sorted(r["indices"] for r in graph.densify(c, e, 0.0).collect()) == [[0, 1], [0, 1, 2, 3], [3]]


def test_component_ranks(spark):
    df = spark.createDataFrame([("p", [0, 1], 2, 0.5), ("p", [2], 1, 1.0), ("p", [3, 4], 2, 0.7)], "problem_id string, indices array<int>, size int, cohesion double")
    order = lambda by: [r["indices"][0] for r in graph.rank_components(df, by).orderBy("rank").collect()]
    assert order("size") == [0, 3, 2] and order("cohesion") == [2, 3, 0] and order("size_times_cohesion") == [3, 0, 2] and order("size_then_cohesion") == [3, 0, 2]
    with pytest.raises(ValueError):
        order("other")


def test_vote_and_fallback(spark):
    v = spark.createDataFrame([("p", "a", 0, 3, 0.5, 0.5), ("p", "b", 1, 1, None, None), ("p", "c", 1, 1, 0.2, None)], "problem_id string, member string, chosen_index int, size int, cohesion double, centrality double")
    n = nodes(spark, 5, 5)
    assert se.vote(v, n, "majority").first()["chosen_index"] == 1 and se.vote(v, n, "weighted").first()["chosen_index"] == 1
    prim = spark.createDataFrame([("p", 4, 1, 1.0), ("q", 2, 5, 0.9)], "problem_id string, chosen_index int, size int, cohesion double")
    fb = spark.createDataFrame([("p", 0), ("q", 0)], "problem_id string, chosen_index int")
    got = {r["problem_id"]: (r["chosen_index"], r["fallback_used"]) for r in se.with_fallback(prim, fb, min_size=2).collect()}
    assert got == {"p": (0, "bleu_medoid"), "q": (2, None)}


def test_confidence_goldens(spark):
    c = spark.createDataFrame([("p", 0)], "problem_id string, chosen_index int")
    r = se.confidence(scored(spark, {"p": [(2, 0), (0, 0), (-1, 0)]}), c, temperature=2.0).first()
    assert r["chosen_probability"] == pytest.approx(0.7310585786) and r["runner_up_index"] == 1 and r["score_margin"] == 2 and r["probability_margin"] == pytest.approx(0.2310585786)
    s = scored(spark, {"p": [(0.1, 0), (0.2, 0), (5, 0)]}).withColumn("ok", F.col("candidate_index") > 0)
    r = se.confidence(s, spark.createDataFrame([("p", 1)], "problem_id string, chosen_index int"), minimize=True, mask="ok").first()
    assert r["runner_up_index"] == 2 and r["score_margin"] == pytest.approx(4.8) and r["eligible_count"] == 2
    r = se.confidence(scored(spark, {"p": [(1, 0)]}), c).first()
    assert r["runner_up_index"] is None and r["score_margin"] is None and r["probability_margin"] is None


def test_ranking_goldens(spark):
    s = scored(spark, {"p1": [(0.9, 1), (0.1, 0)], "p2": [(0.8, 0), (0.7, 1), (0.2, 0)], "p3": [(0.5, 0), (0.4, 0)]})
    r = ev.with_rank(s)
    m = ev.ranking_metrics(r, (1, 2)).first()
    assert m["mrr"] == pytest.approx(0.5) and m["hit1"] == pytest.approx(1 / 3) and m["hit2"] == pytest.approx(2 / 3)
    assert [x["auc"] for x in ev.within_auc(s).orderBy("problem_id").collect()] == [1.0, 0.5, None]
    miss = ev.reachable_misses(r).collect()
    assert [(x["problem_id"], x["best_rank"]) for x in miss] == [("p2", 2)]
    assert ev.pooled_auc(s).first()["auc"] == pytest.approx(0.9)


def test_evaluation_of_abstentions(spark):
    c = spark.createDataFrame([(p, i, y) for p, g in {"p1": (1, 0), "p2": (0, 1), "p3": (1, 0)}.items() for i, y in enumerate(g)], "problem_id string, candidate_index int, label int")
    sel = spark.createDataFrame([("p1", 0, True, None), ("p2", None, None, True), ("p3", 0, False, None)], "problem_id string, chosen_index int, accepted boolean, abstained boolean")
    e = ev.evaluate(ev.decisions(c, sel)).first()
    assert (e["accepted"], e["abstained"], e["abstained_with_choice"], e["abstained_correct"]) == (1, 2, 1, 1)
    e = ev.evaluate(ev.decisions(c, sel.filter("problem_id = 'p1'"), missing_as_abstain=True)).first()
    assert (e["accepted"], e["abstained"], e["missing_as_abstained"], e["selected_rate"]) == (1, 2, 2, 1.0)
    bad = spark.createDataFrame([("p1", 0, True, True)], "problem_id string, chosen_index int, accepted boolean, abstained boolean")
    with pytest.raises(Exception):
        ev.evaluate(ev.decisions(c, bad)).collect()


def test_paired_and_leaderboard(spark):
    mk = lambda s: spark.createDataFrame([(i, int(x == "T")) for i, x in enumerate(s)], "problem_id int, correct int")
    p = ev.paired(mk("TTFFF"), mk("TFTTF")).first()
    assert (p["both_correct"], p["a_only"], p["b_only"], p["neither"]) == (1, 1, 2, 1) and p["b_minus_a"] == pytest.approx(0.2)
    c = spark.createDataFrame([(p, i, int(i == 1)) for p in range(4) for i in range(2)], "problem_id int, candidate_index int, label int")
    sel = spark.createDataFrame([("weak", 0, 1), ("weak", 1, 0), ("weak", 2, 0), ("weak", 3, 0), ("strong", 0, 1), ("strong", 1, 1), ("strong", 2, 1), ("strong", 3, 0)], "method string, problem_id int, chosen_index int")
    d = leaderboard.method_decisions(c, sel, ["weak", "strong"])
    s = {r["method"]: r for r in leaderboard.summary(d).collect()}
    assert s["strong"]["place"] == 1 and s["strong"]["n_correct"] == 3 and s["weak"]["missed"] == 3
    m = leaderboard.paired_matrix(d).filter("a = 'weak'").first()
    assert (m["a_only"], m["b_only"]) == (0, 2)
    assert [r["method"] for r in leaderboard.frontier(leaderboard.summary(d)).collect()] == ["strong"]


def test_selective_goldens(spark):
    e = spark.createDataFrame([(f"p{i}", float(6 - i), int(c == "T"), 1) for i, c in enumerate("TTTFTF")], "problem_id string, confidence double, selected_correct int, has_any_correct int")
    curve = sv.prefix_curve(e)
    folds = sv.leave_one_out(e, 0.32, 2).collect()
    assert sorted(map(tuple, folds)) == sorted(map(tuple, sv.leave_one_out(e, 0.32, 2, chunk=2).collect()))
    for f in folds:
        rest = e.filter(F.col("problem_id") != f["omitted"])
        want = sv.recommend(sv.prefix_curve(rest), [0.32], 2).first()
        assert f["loo_threshold"] == want["threshold"] and f["meets_target"] == want["meets_target"]
    assert len({f["loo_threshold"] for f in folds}) > 1
    t = sv.coverage_table(curve, [0.5, 1.0]).orderBy("target").collect()
    assert [x["accepted"] for x in t] == [3, 6] and t[0]["accuracy"] == 1.0
    ten = spark.createDataFrame([(f"p{i}", float(10 - i), int(i < 9), 1) for i in range(10)], "problem_id string, confidence double, selected_correct int, has_any_correct int")
    r = {x["target"]: x for x in sv.recommend(sv.prefix_curve(ten), [0.55, 0.8]).collect()}
    assert r[0.55]["meets_target"] and r[0.55]["accepted"] == 10 and not r[0.8]["meets_target"] and r[0.8]["shortfall"] > 0
    with pytest.raises(ValueError):
        sv.with_confidence(ten, "other")
    assert sv.resolve_threshold(0.3, [], None) == 0.3
    with pytest.raises(ValueError):
        sv.resolve_threshold(None, [{"target": 0.5, "meets_target": False, "threshold": 1}], 0.5)


def test_calibration(spark):
    s = scored(spark, {f"p{i}": [(x, y)] for i, (x, y) in enumerate(zip((8, 7, -8, -7, 8, -8), (1, 0, 0, 1, 1, 0)))})
    assert cal.fit_temperature(s) > 1
    rel = cal.reliability(s, 10).orderBy("bin").collect()
    assert len(rel) == 10 and sum(r["n"] for r in rel) == 6 and all(r["abs_gap"] == 0 and r["mean_p"] is None for r in rel if r["n"] == 0)
    before, after = cal.report(s).orderBy(F.desc("stage")).collect()
    assert after["nll"] < before["nll"]
    with pytest.raises(ValueError):
        cal.report(s.filter("label = 1"))
    with pytest.raises(Exception):
        cal.finite(s.withColumn("score", F.lit(float("nan")))).collect()


def test_global_prefix_matches_one_window(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice((0.1, 0.5, rng.random())), rng.randint(0, 1)) for i in range(500)]
    got = {r["id"]: (r["k"], r["n"], r["s"]) for r in global_prefix(spark.createDataFrame(rows, "id int, x double, y int"), "x", "id", {"s": "y"}, range_rows=70).collect()}
    total = 0
    for k, (i, _, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += y
        assert got[i] == (k, 500, total)


def test_grouping_and_validation(spark):
    flat = spark.createDataFrame([("b", "x", 1, 0), ("a", "y", 0, 1), ("b", "x", 0, 2), ("b", "z", 0, 3)], "problem_id string, candidate string, label int, row_no int")
    g = {r["problem_id"]: (r["candidates"], r["labels"]) for r in ca.grouped(flat, "row_no", dedupe=True).collect()}
    assert g == {"b": (["x", "z"], [1, 0]), "a": (["y"], [0])}
    assert [r["problem_id"] for r in ca.grouped(flat, "row_no", max_problems=1).collect()] == ["b"]
    bad = spark.createDataFrame([("p", ["a"], None), ("q", ["a", "b"], [1]), ("r", ["a"], [2]), ("s", ["a"], [1])], "problem_id string, candidates array<string>, labels array<int>")
    assert {r["problem_id"]: r["problems"] for r in ca.violations(bad).collect()} == {"p": ["labels missing"], "q": ["lengths differ"], "r": ["label not 0 or 1"]}
    with pytest.raises(ValueError):
        ca.require_valid(bad)
    with pytest.raises(ValueError):
        ca.disjoint_union(flat, flat)


def test_splits_cover_ids_once(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("problem_id"))
    s = etl.split_by_id(ids, {"train": 0.7, "dev": 0.15, "test": 0.15}, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 70, "dev": 15, "test": 15}
    t = {r["split"]: r["count"] for r in etl.train_eval(ids.limit(3), 0.01, 1).groupBy("split").count().collect()}
    assert t == {"eval": 1, "train": 2}
    with pytest.raises(ValueError):
        etl.guard_skips(etl.build_stats(scored(spark, {"p": [(1, 0)], "q": [(1, 1), (2, 0)]})), 0.1)


def test_scorer_interfaces(spark):
    import pandas as pd

    df = spark.createDataFrame([("p", 0, "aa"), ("p", 1, "b")], "problem_id string, candidate_index int, candidate string")
    reg = pr.ScorerRegistry()
    reg.register_function("len", lambda a, b: (a.str.len() - b.str.len()).astype(float), "candidate")
    assert reg.score("len", df).first()["score"] == 1.0
    with pytest.raises(ValueError):
        reg.score("none", df)
    eq = scorers.equivalence_probability(df, "candidate", "candidate", lambda a, b: pd.DataFrame({0: [0.0] * len(a), 1: [2.0] * len(a)}), 2.0)
    assert eq.first()["score"] == pytest.approx(0.7310585786)
    e = scorers.embed(df, "candidate", lambda s: s.map(lambda t: [3.0, 4.0])).first()["embedding"]
    assert e == pytest.approx([0.6, 0.8])
    cache = scorers.checked(df, lambda s: s == "b").select(F.sha2(F.concat(F.lit("\n\n"), "candidate"), 256).alias("key"), F.col("typechecks").alias("ok")).filter("ok")
    got = {r["candidate"]: r["typechecks"] for r in scorers.checked(df, lambda s: s == "never", cache).collect()}
    assert got == {"aa": False, "b": True}
    samples = scorers.sample_candidates(df.withColumn("problem_id", F.col("candidate")), "candidate", 3, lambda p, s: p + "-" + s.astype(str))
    good, bad = scorers.typecheck_filter(df, lambda c: c == "b")
    assert [r["candidate"] for r in good.collect()] == ["b"] and [r["candidate"] for r in bad.collect()] == ["aa"]
    kept, _ = scorers.typecheck_filter(df, lambda c: c == "zz", drop_empty=False)
    assert kept.count() == 2
    both = scorers.proof_outcomes(spark.createDataFrame([("x", "x"), ("x", "xy")], "a string, b string"), lambda a, b: pd.Series([q.startswith(p) for p, q in zip(a, b)]))
    assert [r["ok"] for r in both.collect()] == [True, False]
    assert samples.count() == 6 and samples.select("candidate").distinct().count() == 6


def test_audit_of_a_pair(spark):
    n, p = nodes(spark, 1, 1, 1), pairs(spark, {(0, 1): 0.95, (0, 2): 0.2, (1, 2): 0.1})
    comps, stats = graph.ranked_components(n, p, 0.5)
    c = spark.createDataFrame([("p", i, t, y) for i, (t, y) in enumerate([("first text", 1), ("b", 1), ("c", 0)])], "problem_id string, candidate_index int, candidate string, label int")
    a = se.audit(c, comps, p, top_edges=1, snippet=8).first()
    assert stats.first()["edges_after"] == 1
    assert (a["components"][0]["indices"], a["components"][0]["n_labeled_correct"]) == ([0, 1], 2)
    assert [(e["i"], e["j"], e["score"]) for e in a["top_edges"]] == [(0, 1, 0.95)] and a["candidates"][0]["snippet"] == "first..."


def test_best_key_per_coverage(spark):
    rows = [("p1", 0.9, 0.8, 1.0, 1), ("p2", 0.8, 0.1, 1.0, 0), ("p3", 0.7, 0.7, 1.0, 1)]
    e = spark.createDataFrame(rows, "problem_id string, chosen_probability double, probability_margin double, score_margin double, selected_correct int")
    got = {round(r["target"], 3): (r["best_key"], r["accuracy"]) for r in sv.best_key_per_coverage(e, [2 / 3, 1.0]).collect()}
    assert got[0.667] == ("probability_margin", 1.0) and got[1.0][0] == "chosen_probability"


def test_seeds_and_pair_temperature(spark):
    from zlib import crc32

    from quorate.functions import stats as st

    df = spark.createDataFrame([("a",), ("problem 7",)], "problem_id string")
    assert [r[0] for r in df.select(st.crc_seed(17, F.col("problem_id"))).collect()] == [crc32(b"a") ^ 17, crc32(b"problem 7") ^ 17]
    s = scored(spark, {f"p{i}": [(x, y)] for i, (x, y) in enumerate(zip((4, 3, -4, -3, 4, -4), (1, 0, 0, 1, 1, 0)))})
    probs = s.select("label", st.sigmoid(F.col("score")).alias("prob"))
    assert cal.fit_pair_temperature(probs) == pytest.approx(cal.fit_temperature(s), rel=1e-4)


def test_verifier_choice(spark):
    """Of two clusters of the top five the one with the better mean is chosen; a sixth candidate that would link them does not take part."""
    texts = ["theorem a : 1 = 1 and much more text", "theorem b : 1 = 1", "x", "theorem c", "theorem d", "y"]
    scores = [0.9, 0.85, 0.95, 0.1, 0.2, 0.05]
    c = spark.createDataFrame([("p", i, t, v) for i, (t, v) in enumerate(zip(texts, scores))], "problem_id string, candidate_index int, candidate string, score double")
    p = pairs(spark, {(i, j): 0.9 if (i, j) in {(0, 1), (2, 3), (0, 5), (2, 5)} else 0.1 for i in range(6) for j in range(i + 1, 6)})
    run = lambda df=c, **kw: se.verifier_choice(df, p, 0.5, **{"top_m": 5, **kw}).collect()
    best = run()
    assert [(r["problem_id"], r["chosen_index"], r["size"]) for r in best] == [("p", 0, 2)] and best[0]["cluster_score"] == pytest.approx(0.875)
    assert run(rep="simple")[0]["chosen_index"] == 1 and run(rep="simple", delta=0.01)[0]["chosen_index"] == 0
    assert run(cluster="max")[0]["chosen_index"] == 2
    assert run(top_m=0)[0]["size"] == 5
    # ties of cluster scores go to the larger cluster, then to the earlier rank
    tied = spark.createDataFrame([("p", i, "t", 0.5) for i in range(6)], c.schema)
    assert [(r["chosen_index"], r["size"]) for r in run(tied, cluster="max")] == [(0, 2)]
    # candidates that do not typecheck take no part where another does
    assert run(c.withColumn("typechecks", F.col("candidate_index") >= 3))[0]["chosen_index"] == 4
    assert run(c.withColumn("typechecks", F.lit(False)))[0]["chosen_index"] == 0


def test_verifier_choice_is_catalogued(spark, sf):
    from quorate.plans import catalog, catalog2  # noqa: F401

    for rep in ("best", "simple"):
        rows = catalog.QUERIES[f"OP-153_choice_{rep}"](spark, sf).collect()
        assert len(rows) == len({r["problem_id"] for r in rows}) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()


def test_selection_grid(spark):
    """Every configuration is selected by itself, beside baselines and an ensemble."""
    n = nodes(spark, 5, 4, 3, 2, 1).withColumn("label", (F.col("candidate_index") == 3).cast("int"))
    p = pairs(spark, {(i, j): {(0, 1): 0.6, (0, 2): 0.6, (1, 2): 0.3, (3, 4): 0.9}.get((i, j), 0.1) for i in range(5) for j in range(i + 1, 5)})
    configs = [(0.5, "first", "size_then_cohesion", 0, 0.0, 0.7), (0.5, "first", "cohesion", 0, 0.0, 0.7), (0.5, "medoid", "size_then_cohesion", 0, 0.2, 0.7), (0.8, "first", "size_then_cohesion", 0, 0.0, 0.7)]
    g = leaderboard.selection_grid(n, p, configs, {"first": se.first_candidate(n)}, ensemble="first").cache()
    rows = {(r["config"], r["strategy"]): r for r in g.collect()}
    assert len(rows) == len(configs) + 2
    for k, (threshold, tie, rank, mutual, margin, _) in enumerate(configs):
        comps, _stats = graph.ranked_components(n, p, threshold, rank=rank, mutual_k=mutual, margin=margin)
        chosen = se.representatives(comps, n, p, tie).first()["chosen_index"]
        r = rows[k, "selection"]
        assert (r["threshold"], r["tie_break"], r["cluster_rank"], r["margin"]) == (threshold, tie, rank, margin)
        assert r["n_correct"] == int(chosen == 3) and r["avg_size"] == comps.filter("rank = 1").first()["size"]
    assert {r["n_correct"] for r in rows.values()} == {0, 1} and rows[None, "first"]["n_correct"] == 0
    best = leaderboard.top_selections(g, 3).collect()
    assert [(r["config"], r["accuracy"]) for r in best[:2]] == [(1, 1), (3, 1)] and len(best) == 3
