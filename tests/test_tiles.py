"""Pairs as tiles against plain loops, whatever the block; and that a large problem is no task of its own."""
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import graph, pairs, tiles
from quorate.operators.windows import cut


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "x", "y1", "+", "=", "(a", "b)", "forall", "z'"]) for _ in range(n))


@pytest.fixture(scope="module")
def statements(spark):
    rng = random.Random(1)
    rows = [(p, i, words(rng, rng.randint(0, 40))) for p, n in (("big", 61), ("small", 5), ("one", 1), (None, 3)) for i in range(n)]
    rows += [("big", 61 + i, text) for i, text in enumerate(["same words here"] * 30 + [None, "", " "])]
    rows += [("twice", 0, "alpha beta"), ("twice", 0, "alpha beta x"), ("twice", 7, "x y1 beta"), ("twice", 10**6, "alpha")]
    return rows, spark.createDataFrame(rows, "problem_id string, candidate_index int, candidate string")


def by_pairs(rows, fn):
    return Counter((p, min(i, j), max(i, j), round(fn(a, b) if i < j else fn(b, a), 8)) for k, (p, i, a) in enumerate(rows) for q, j, b in rows[k + 1:] if p == q and p is not None and i != j)


def found(df, *cols):
    return Counter((r["problem_id"], r["i"], r["j"], *[round(r[c], 8) for c in cols]) for r in df.filter("problem_id is not null").collect())


def tokens(text):
    return re.findall(r"[A-Za-z_][A-Za-z0-9_'.]*|[0-9]+|[^\s]", text or "")


def bleu(hyp, ref, max_n=4, smooth=1.0):
    h, r = tokens(hyp), tokens(ref)
    if not h or not r:
        return float(not h and not r) if not h else (lambda logs: math.exp(sum(logs) / max_n))([math.log(max(1e-12, smooth / (len(h) - n + smooth) if len(h) - n > 0 else 0)) for n in range(max_n)])
    logs = []
    for n in range(1, max_n + 1):
        a, b = (Counter(tuple(t[k:k + n]) for k in range(len(t) - n + 1)) for t in (h, r))
        total = sum(a.values())
        logs.append(math.log(max(1e-12, (sum((a & b).values()) + smooth) / (total + smooth) if total else 0)))
    return (math.exp(1 - len(r) / len(h)) if len(h) < len(r) else 1.0) * math.exp(sum(logs) / max_n)


@pytest.mark.parametrize("block", [512, 16])
def test_bleu_of_all_pairs(statements, block):
    rows, df = statements
    got = pairs._both_bleus(df, "candidate", 4, 1.0, False, block)
    assert found(got, "of_i") == by_pairs(rows, bleu)
    assert found(got, "of_j") == by_pairs(rows, lambda a, b: bleu(b, a))


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_of_all_pairs(statements, block):
    rows, df = statements

    def jaccard(a, b):
        a, b = set(tokens(a)), set(tokens(b))
        return len(a & b) / len(a | b) if a | b else 1.0

    assert found(pairs.jaccard_pairs(df, block=block), "score") == by_pairs(rows, jaccard)


@pytest.mark.parametrize("block", [512, 16])
def test_frame_of_all_pairs(statements, block):
    rows, df = statements
    got = Counter((r["problem_id"], r["i"], r["j"], r["candidate_i"], r["candidate_j"]) for r in tiles.pair_frame(df, "candidate", block=block).collect())
    want = Counter((p, i, j, a, b) if i < j else (p, j, i, b, a) for k, (p, i, a) in enumerate(rows) for q, j, b in rows[k + 1:] if p == q and p is not None and i != j)
    assert got == want


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(p, i, [float(x) for x in rng.integers(-2, 3, 6)]) for p, n in ((1, 70), (2, 4), (3, 1)) for i in range(n)]
    rows += [(1, 70, None), (1, 71, [0.0] * 6), (4, 0, None), (4, 1, None)]
    return rows, spark.createDataFrame(rows, "problem_id long, candidate_index int, embedding array<double>")


def cosine(a, b):
    if a is None or b is None or not any(a) or not any(b):
        return 0.0
    return float(np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b)))


@pytest.mark.parametrize("block", [512, 9])
def test_cosine_and_nearest(vectors, block):
    rows, df = vectors
    assert found(tiles.cosine_pairs(df, block=block), "score") == by_pairs(rows, cosine)
    got = {(r["problem_id"], r["node"], r["r"]): (r["other"], round(r["score"], 8)) for r in tiles.nearest(df, 3, block=block).collect()}
    want = {}
    for p, i, a in rows:
        near = sorted((-round(cosine(a, b), 9), j) for q, j, b in rows if q == p and j != i)
        want |= {(p, i, k): (j, round(-s, 8)) for k, (s, j) in enumerate(near[:3], 1)}
    assert got == want
    for mutual in (True, False):
        a, b = pairs.near_edges(tiles.nearest(df, 3, block=block), mutual), pairs.knn_edges(tiles.cosine_pairs(df).withColumn("score", F.round("score", 9)), 3, mutual)
        assert found(a, "score") == found(b, "score")


def test_vectors_of_two_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0, 2.0])], "problem_id long, candidate_index int, embedding array<double>")
    with pytest.raises(Exception, match="same length"):
        tiles.cosine_pairs(df).collect()


def test_no_candidates(spark):
    df = spark.createDataFrame([], "problem_id long, candidate_index int, candidate string, embedding array<double>")
    assert [x.count() for x in (pairs.bleu_pairs(df), pairs.jaccard_pairs(df), tiles.cosine_pairs(df), tiles.nearest(df, 2), tiles.pair_frame(df, "candidate"))] == [0] * 5


def stage_rows(spark, after):
    """Rows that the tasks of each stage behind ``after`` read from a shuffle, and the last stage."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(None)
    ids = sorted({x.apply(j) for i in range(jobs.size()) for x in [jobs.apply(i).stageIds()] for j in range(x.size())})
    out = []
    for stage in (k for k in ids if k > after):
        tasks = store.taskList(stage, 0, 5000)
        out.append([m.get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if (m := tasks.apply(i).taskMetrics()).isDefined()])
    return out, max(ids, default=-1)


def spread(rows, most=5):
    rows = [n for n in rows if n]
    return len(rows) > 20 and max(rows) <= most * np.median(rows)


def test_a_large_problem_is_many_tasks(spark):
    """One problem of 8,000 candidates, 32 million pairs: more than 20 tasks, none of which reads over 5 times the median."""
    df = cut(spark.range(8_000).select(F.lit(1).alias("problem_id"), F.col("id").cast("int").alias("candidate_index")))
    _, after = stage_rows(spark, -1)
    assert tiles.pair_frame(df).count() == 8_000 * 7_999 // 2
    met, _ = stage_rows(spark, after)
    assert any(spread(r) for r in met) and all(spread(r) for r in met if sum(r) > 50_000)


def test_nearest_writes_k_for_each_row_and_block(spark):
    n, k = 6_000, 3
    df = cut(spark.range(n).select(F.lit(1).alias("problem_id"), F.col("id").cast("int").alias("candidate_index"), F.array(*[F.rand(s) - 0.5 for s in range(8)]).alias("embedding")))
    _, after = stage_rows(spark, -1)
    assert tiles.nearest(df, k).count() == n * k
    met, _ = stage_rows(spark, after)
    blocks = -(-n // tiles.BLOCK)
    assert max(sum(r) for r in met) <= max(n * blocks, n * k * (blocks + 1))


def test_words_that_all_candidates_share_cost_no_pairs_in_one_row(spark):
    """One problem of 3,000 candidates that share most of their words."""
    rng = random.Random(3)
    rows = [(1, i, "the common words of all " + words(rng, 6) + f" w{i}") for i in range(3_000)]
    df = cut(spark.createDataFrame(rows, "problem_id int, candidate_index int, candidate string"))
    got = pairs.bleu_pairs(df, normalize=False)
    some = {(r["i"], r["j"]): r["score"] for r in got.filter("i % 500 = 3 and j % 500 = 7").collect()}
    assert len(some) == 21 and all(abs(s - (bleu(rows[i][2], rows[j][2]) + bleu(rows[j][2], rows[i][2])) / 2) < 1e-9 for (i, j), s in some.items())
    assert got.count() == 3_000 * 2_999 // 2


# --- support clusters ------------------------------------------------------------------------------------------------------------------


def grown_plainly(scores, link, share):
    """Every seed by itself, every mean summed anew."""
    n, out = len(scores), set()
    for seed in range(n):
        inside = [seed]
        while len(inside) < n:
            need = int(share * len(inside) + 0.999999)
            able = [(sum(scores[k][m] for m in inside) / len(inside), sum(link[k][m] for m in inside), -k) for k in range(n) if k not in inside and sum(link[k][m] for m in inside) >= need]
            if not able:
                break
            inside.append(-max(able)[2])
        while share > 0 and len(inside) >= 2:
            least = min((sum(link[k][m] for m in inside), k) for k in inside)
            if least[0] >= int(share * len(inside) + 0.999999):
                break
            inside.remove(least[1])
        out.add(tuple(sorted(inside)))
    return out


def test_support_clusters_grow_as_by_plain_loops():
    rng = np.random.default_rng(4)
    for n, share in ((1, 0.7), (2, 0.5), (9, 0.7), (25, 0.3), (25, 0.0), (40, 0.9)):
        s = rng.integers(0, 64, (n, n)) / 64  # ties are exact
        s = np.triu(s, 1) + np.triu(s, 1).T
        link = (s >= 0.4) | np.eye(n, dtype=bool)
        got = {tuple(int(k) for k in np.flatnonzero(c)) for c in graph._grown_sets(s, link, share)}
        assert got == grown_plainly(s, link, share)


def test_support_clusters_of_800_in_seconds():
    rng = np.random.default_rng(5)
    seconds = []
    for n in (200, 800):
        s = rng.random((n, n))
        s = np.triu(s, 1) + np.triu(s, 1).T
        began = time.process_time()
        graph._grown_sets(s, (s >= 0.3) | np.eye(n, dtype=bool), 0.6)
        seconds.append(time.process_time() - began)
    # all seeds times all members times a row each
    assert seconds[1] < 40 and seconds[1] < 4**3 * max(seconds[0], 0.1)


def test_components_leave_no_tables(spark):
    import os

    from quorate import scratch

    nodes = spark.range(30).select(F.lit(1).alias("problem_id"), F.col("id").cast("int").alias("candidate_index"))
    edges = spark.range(29).select(F.lit(1).alias("problem_id"), F.col("id").cast("int").alias("i"), (F.col("id") + 1).cast("int").alias("j"), F.lit(1.0).alias("score"))
    folder = scratch.root(spark).removeprefix("file:").replace("//", "/", 1)
    before = set(os.listdir(folder))
    assert {r["component"] for r in graph.components(nodes, edges).collect()} == {0}
    assert len(set(os.listdir(folder)) - before) == 1
