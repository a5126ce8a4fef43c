"""Probability calibration over (problem_id, candidate_index, label, score)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate import scratch
from quorate.functions import stats as st
from quorate.operators.windows import global_prefix

CLAMP = 1e-12
#: The range of the temperature search.
LOW_T, HIGH_T = 0.05, 20.0
#: Temperatures that the first pass over the scores looks at, and how near the search goes in ln T.
STARTS, NEAR = 13, 1e-10


def finite(scored: DataFrame) -> DataFrame:
    bad = F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()
    return scored.withColumn("score", F.when(bad, F.raise_error(F.concat(F.lit("score is not finite in problem "), F.col("problem_id").cast("string"))).cast("double")).otherwise(F.col("score")))


def nll_term(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1 - CLAMP))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def losses(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One row: n, positives, nll, brier."""
    p, y = st.sigmoid(F.col("score") / temperature), F.col("label").cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg(nll_term(p, y)).alias("nll"), F.avg(F.pow(p - y, 2)).alias("brier"))


def reliability(scored: DataFrame, bins: int = 10, temperature: float = 1.0) -> DataFrame:
    """(bin, lo, hi, n, mean_p, accuracy, abs_gap): [lo, hi), the last closed; empty bins have nulls and a gap of 0."""
    p = F.round(st.sigmoid(F.col("score") / temperature), 12)
    edges = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("lo"), ((F.col("id") + 1) / bins).alias("hi"))
    # the bin by comparison with the same edges, not by a product that rounds
    place = F.lit(0)
    for k in range(1, bins):
        place = place + F.when(F.col("p") >= k / bins, 1).otherwise(0)
    g = scored.select(p.alias("p"), "label").withColumn("bin", place).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("accuracy"))
    return edges.join(F.broadcast(g), "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "accuracy", F.coalesce(F.abs(F.col("mean_p") - F.col("accuracy")), F.lit(0.0)).alias("abs_gap"))


def ece_mce(rel: DataFrame) -> DataFrame:
    return rel.agg((F.sum(F.col("n") * F.col("abs_gap")) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"), F.max("abs_gap").alias("mce"))


def _slopes(g: DataFrame, points: list[float]) -> list[tuple[float, float, float]]:
    """(loss, slope, curvature) at each ln T of points, by one aggregate of one row for each score: loss in all, slope and curvature over 1 / T."""
    sums = []
    for x in points:
        b = math.exp(-x)
        p = st.sigmoid(F.col("score") * b)
        # a clamped probability does not move with T
        free = (p > CLAMP) & (p < 1 - CLAMP)
        sums += [F.sum(F.col("pos") * nll_term(p, F.lit(1.0)) + (F.col("n") - F.col("pos")) * nll_term(p, F.lit(0.0))),
                 F.sum(F.when(free, (F.col("n") * p - F.col("pos")) * F.col("score")).otherwise(0.0)), F.sum(F.when(free, F.col("n") * p * (1 - p) * F.col("score") * F.col("score")).otherwise(0.0))]
    row = g.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()
    if row[0] is None:
        raise ValueError("no scores")
    return [tuple(row[3 * i:3 * i + 3]) for i in range(len(points))]


def fit_temperature(scored: DataFrame, starts: int = STARTS) -> float:
    """The T with the least log loss.

    Scores are first reduced to one row for each distinct score.  One pass looks at the loss at ``starts`` temperatures; the least and its neighbours
    are the bracket.  Then each pass gives slope and curvature at a few points of it: Newton's steps from both ends and from the flattest
    point, the secant and the middle, all inside the bracket, which the signs of their slopes narrow.
    """
    g = scratch.table(scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")), "scores")
    low, high = math.log(LOW_T), math.log(HIGH_T)
    points = [low + (high - low) * i / (starts - 1) for i in range(starts)]
    known = dict(zip(points, _slopes(g, points)))
    best = min(range(starts), key=lambda i: known[points[i]][0])
    a, b = points[max(0, best - 1)], points[min(starts - 1, best + 1)]
    # the loss falls with T as long as its scores are pulled down, so that the least lies where the slope turns
    if known[a][1] <= 0 or known[b][1] > 0:
        a, b = (a, a) if known[a][1] <= 0 and best == 0 else (b, b) if known[b][1] > 0 and best == starts - 1 else (a, b)
    while b - a > NEAR:
        inside, steps = [(a + b) / 2], []
        for x in sorted((x for x in known if a <= x <= b), key=lambda x: abs(known[x][1]))[:3]:
            _, slope, curve = known[x]
            if curve > 0 and (beta := math.exp(-x) - slope / curve) > 0:
                steps.append((abs(-math.log(beta) - x), -math.log(beta)))
        u, v = math.exp(-a), math.exp(-b)
        if (rise := known[a][1] - known[b][1]) > 0:
            steps.append((b - a, -math.log(u - known[a][1] * (u - v) / rise)))
        for size, x in steps:
            # beside a step a point on either side of it, so that the bracket closes around it
            around = max(NEAR / 4, min(size * size, size / 8))
            inside += [y for y in (x - around, x, x + around) if a < y < b]
        new = [x for x in dict.fromkeys(inside) if x not in known]
        if not new:
            break
        known |= dict(zip(new, _slopes(g, new)))
        between = sorted(x for x in known if a <= x <= b)
        turn = next((x for x in between if known[x][1] <= 0), b)
        a, b = max((x for x in between if x < turn and known[x][1] > 0), default=a), turn
    scratch.discard(g)
    return math.exp((a + b) / 2)


def fit_pair_temperature(pairs: DataFrame, prob: str = "prob", clamp: float = 1e-6) -> float:
    """Temperature of pair probabilities: fit_temperature over their logits."""
    q = F.least(F.greatest(F.col(prob), F.lit(clamp)), F.lit(1 - clamp))
    return fit_temperature(pairs.select("label", F.log(q / (1 - q)).alias("score")))


def threshold_table(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(thr, tp, fp, fn, tn, precision, recall, f1, accuracy) at 0.01..0.99 and every distinct probability; a row is positive if p >= thr."""
    p = F.round(st.sigmoid(F.col("score") / temperature), 9)
    g = scored.groupBy(p.alias("thr")).agg(F.count(F.lit(1)).alias("n_at"), F.sum("label").alias("pos_at"))
    grid = scored.sparkSession.range(1, 100).select(F.round(F.col("id") / 100, 9).alias("thr"))
    g = g.unionByName(grid.withColumn("n_at", F.lit(0).cast("long")).withColumn("pos_at", F.lit(0).cast("long"))).groupBy("thr").agg(F.sum("n_at").alias("n_at"), F.sum("pos_at").alias("pos_at"))
    pre = global_prefix(g, "thr", "thr", {"called": "n_at", "tp": "pos_at"})
    tot = g.agg(F.sum("n_at").alias("n_all"), F.sum("pos_at").alias("pos_all"))
    t = pre.crossJoin(F.broadcast(tot))
    fp, fn = F.col("called") - F.col("tp"), F.col("pos_all") - F.col("tp")
    t = t.select("thr", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("n_all") - F.col("tp") - fp - fn).alias("tn"))
    pr, rc = st.rate(F.col("tp"), F.col("tp") + F.col("fp")), st.rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select("*", pr.alias("precision"), rc.alias("recall"), st.rate(2 * pr * rc, pr + rc).alias("f1"), st.rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def best_thresholds(table: DataFrame) -> DataFrame:
    """(which, thr, f1, accuracy): best by F1, best by accuracy, and at 0.5."""
    r = lambda c: F.round(c, 12)
    row = F.struct("thr", "f1", "accuracy")
    b = table.agg(F.max_by(row, F.struct(r("f1"), r("precision"), r("recall"), -F.col("thr"))).alias("f1"), F.max_by(row, F.struct(r("accuracy"), r("f1"), -F.col("thr"))).alias("acc"), F.max(F.when(F.col("thr") == 0.5, row)).alias("half"))
    return b.select(F.explode(F.array(F.struct(F.lit("best_f1").alias("which"), "f1.*"), F.struct(F.lit("best_accuracy").alias("which"), "acc.*"), F.struct(F.lit("at_half").alias("which"), "half.*"))).alias("x")).select("x.*")


def report(scored: DataFrame, bins: int = 10, temperature: float | None = None) -> DataFrame:
    """(stage, temperature, nll, brier, ece, mce) before and after fitting; both classes are needed."""
    both = scored.agg(F.count_distinct("label")).first()[0]
    if both < 2:
        raise ValueError("both classes are needed")
    t = temperature or fit_temperature(scored)
    rows = None
    for stage, temp in (("before", 1.0), ("after", t)):
        one = losses(scored, temp).crossJoin(F.broadcast(ece_mce(reliability(scored, bins, temp)))).select(F.lit(stage).alias("stage"), F.lit(float(temp)).alias("temperature"), "nll", "brier", "ece", "mce")
        rows = one if rows is None else rows.unionByName(one)
    return rows
