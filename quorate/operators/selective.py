"""Selective prediction: prefixes by confidence, certified thresholds, their stability, abstention.

Examples are (problem_id, confidence, selected_correct 0/1, has_any_correct 0/1); a null confidence counts as 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.joins import spread_join
from quorate.operators.windows import cut, global_prefix

KEYS = ("chosen_probability", "probability_margin", "score_margin")


def with_confidence(examples: DataFrame, key: str) -> DataFrame:
    if key not in KEYS:
        raise ValueError(f"unsupported confidence key {key!r}")
    return examples.withColumn("confidence", F.round(F.coalesce(F.col(key), F.lit(0.0)), 12))


def prefix_curve(examples: DataFrame) -> DataFrame:
    """One row per prefix in order of falling confidence: accepted, coverage, selected_correct, accuracy, risk, Wilson bounds, threshold."""
    p = global_prefix(examples, "confidence", "problem_id", {"correct_upto": "selected_correct"})
    low, high = st.wilson(F.col("correct_upto"), F.col("k"))
    acc = F.col("correct_upto") / F.col("k")
    return p.select("problem_id", F.col("k").alias("accepted"), (F.col("k") / F.col("n")).alias("coverage"), F.col("correct_upto").alias("correct"), acc.alias("accuracy"), (1 - acc).alias("risk"), low.alias("low"), high.alias("high"), F.col("confidence").alias("threshold"), "n", "selected_correct")


def coverage_table(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(target, accepted, coverage, accuracy, risk, threshold): the first prefix that covers each target."""
    wants = [F.greatest(F.lit(1), F.ceil(F.lit(min(1.0, max(0.0, float(x)))) * F.col("n"))).cast("long") for x in targets]
    # each place looks up which of the listed targets it is the answer to; nothing is multiplied
    hits = F.filter(F.array(*[F.when(F.col("accepted") == w, F.lit(float(x))) for x, w in zip(targets, wants)]), lambda x: x.isNotNull())
    return curve.withColumn("target", F.explode(hits)).select("target", "accepted", "coverage", "accuracy", "risk", "threshold")


def best_prefix(curve: DataFrame) -> DataFrame:
    return curve.agg(F.max_by(F.struct("accepted", "coverage", "accuracy", "threshold"), F.struct(F.round("accuracy", 12), "accepted")).alias("b")).select("b.*")


def confident_errors(examples: DataFrame, limit: int = 15) -> DataFrame:
    """A report: the most confident wrong choices."""
    return examples.filter("selected_correct = 0").orderBy(F.desc("confidence"), "problem_id").limit(limit)


def recommend(curve: DataFrame, targets: list[float], min_accepted: int = 1) -> DataFrame:
    """(target, meets_target, accepted, accuracy, low, threshold, shortfall): the largest prefix whose lower bound reaches the target, else the one with the best bound."""
    e = curve.filter(F.col("accepted") >= min_accepted)
    row = F.struct("accepted", "accuracy", "low", "threshold")
    r = lambda c: F.round(c, 12)
    best = F.max_by(row, F.struct(r("low"), r("accuracy"), "accepted", "threshold"))
    aggs = [best.alias("best")]
    for i, t in enumerate(targets):
        ok = r("low") >= t
        aggs.append(F.max_by(F.when(ok, row), F.when(ok, F.struct("accepted", r("low"), r("accuracy"), "threshold"))).alias(f"t{i}"))
    a = e.agg(*aggs)
    items = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"t{i}").isNotNull().alias("meets_target"), F.coalesce(F.col(f"t{i}"), F.col("best")).alias("row")) for i, t in enumerate(targets)])
    x = a.select(F.explode(items).alias("x")).select("x.target", "x.meets_target", "x.row.*")
    return x.withColumn("shortfall", F.when(F.col("meets_target"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("low"))))


def ranking_quality(curve: DataFrame) -> DataFrame:
    """One row: AUACC, risk area, full accuracy, lift, average precision, ideal and worst area, normalised area."""
    n, pos = F.max("n"), F.max("correct")
    x = curve.agg(n.alias("n"), pos.alias("pos"), F.avg("accuracy").alias("auacc"), F.avg("risk").alias("risk_area"), F.sum(F.when(F.col("selected_correct") == 1, F.col("accuracy")).otherwise(0.0)).alias("hits"))
    # ideal: 1 up to pos, then pos / k; worst: 0 up to n - pos, then (k - (n - pos)) / k; sums of 1 / k are harmonic numbers
    h = lambda m: st.harmonic(m)
    x = x.withColumn("tail_pos", h(F.col("n")) - h(F.col("pos"))).withColumn("tail_neg", h(F.col("n")) - h(F.col("n") - F.col("pos")))
    ideal = (F.col("pos") + F.col("pos") * F.col("tail_pos")) / F.col("n")
    worst = (F.col("pos") - (F.col("n") - F.col("pos")) * F.col("tail_neg")) / F.col("n")
    full = F.col("pos") / F.col("n")
    norm = F.when(ideal - worst > 1e-15, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("auacc") - worst) / F.nullif(ideal - worst, F.lit(0.0))))).otherwise(1.0)
    return x.select(F.col("n").alias("problems"), F.col("pos").alias("correct"), "auacc", "risk_area", full.alias("full_accuracy"), (F.col("auacc") - full).alias("lift"), st.rate(F.col("hits"), F.col("pos")).alias("average_precision"), ideal.alias("ideal_area"), worst.alias("worst_area"), norm.alias("normalized_area"))


def compare_signals(examples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """ranking_quality of each confidence key."""
    out = None
    for k in keys:
        one = ranking_quality(prefix_curve(with_confidence(examples, k))).withColumn("confidence_key", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def best_key_per_coverage(examples: DataFrame, targets: list[float], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(target, best_key, accuracy): of equally accurate keys the first listed."""
    rows = None
    for i, k in enumerate(keys):
        one = coverage_table(prefix_curve(with_confidence(examples, k)), targets).select("target", F.round("accuracy", 12).alias("accuracy"), F.lit(k).alias("key"), F.lit(i).alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("target").agg(F.max_by(F.struct("key", "accuracy"), F.struct("accuracy", -F.col("place"))).alias("b")).select("target", F.col("b.key").alias("best_key"), F.col("b.accuracy").alias("accuracy"))


def apply_threshold(examples: DataFrame, threshold: float | Column) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    ok = F.col("confidence") >= t
    return examples.withColumn("threshold", t).withColumn("accepted", ok).withColumn("abstained", ~ok)


def abstention_report(applied: DataFrame) -> DataFrame:
    a, ok, any_ = F.col("accepted"), F.col("selected_correct") == 1, F.col("has_any_correct") == 1
    c = applied.agg(F.count(F.lit(1)).alias("problems"), F.count_if(a).alias("accepted"), F.count_if(~a).alias("abstained"), F.count_if(a & ok).alias("accepted_correct"), F.count_if(a & any_).alias("accepted_any"),
                    F.count_if(~a & ok).alias("abstained_correct"), F.count_if(~a & any_).alias("abstained_any"), F.count_if(~a & any_ & ~ok).alias("abstained_missed"), F.count_if(a & any_ & ~ok).alias("accepted_missed"))
    low, high = st.wilson(F.col("accepted_correct"), F.col("accepted"))
    return c.select("*", st.rate(F.col("accepted"), F.col("problems")).alias("coverage"), st.rate(F.col("accepted_correct"), F.col("accepted")).alias("accuracy"), low.alias("low"), high.alias("high"))


def resolve_threshold(explicit: float | None, recommendations: list[dict], target: float | None, require_certified: bool = True) -> float:
    """An explicit threshold, or that of the recommendation for the target."""
    if explicit is not None:
        return float(explicit)
    for r in recommendations:
        if target is not None and abs(r["target"] - target) <= 1e-9:
            if require_certified and not r["meets_target"]:
                raise ValueError(f"the target {target} is not certified")
            return float(r["threshold"])
    raise ValueError(f"no recommendation for target {target}")


def leave_one_out(examples: DataFrame, target: float, min_accepted: int = 5, chunk: int = 50_000) -> DataFrame:
    """Every fold of the leave-one-out report, without recomputing it: omitted, loo_threshold, meets_target, omitted_confidence, omitted_accepted,
    omitted_correct, full_threshold, full_accepts_omitted, threshold_delta, applied to the full sample (full_accepted, full_correct), to the fold
    (train_accepted, train_correct), accepted_delta and jaccard of the accepted sets.

    Omitting the example at place r shortens every prefix that reaches r by one row, so a fold's answer is the better of two parts:
    full prefixes before r, and prefixes behind r with one row (and the example's correctness) less.  Both are running maxima over the
    ordered curve: within chunks of consecutive places, and over one row of maxima for each chunk.
    """
    c = cut(prefix_curve(examples))
    r = lambda x: F.round(x, 12)

    def keys(k: Column, ok: Column, last: Column, suffix: str) -> list[Column]:
        low, _ = st.wilson(ok, k)
        acc, able = st.rate(ok, k), k >= min_accepted
        return [F.when(able & (r(low) >= target), F.struct(k.alias("k"), r(low).alias("low"), r(acc).alias("acc"), last.alias("thr"))).alias(f"c{suffix}"),
                F.when(able, F.struct(r(low).alias("low"), r(acc).alias("acc"), k.alias("k"), last.alias("thr"))).alias(f"b{suffix}")]

    k, ok, thr = F.col("accepted"), F.col("correct"), F.col("threshold")
    rows = c.select("problem_id", "selected_correct", "threshold", "accepted", F.floor((k - 1) / chunk).alias("chunk"), *keys(k, ok, thr, "f"), *keys(k - 1, ok, thr, "0"), *keys(k - 1, ok - 1, thr, "1"))
    forward, backward = ("cf", "bf"), ("c0", "b0", "c1", "b1")

    def running(df: DataFrame, by: Column | str, order: str, prefix: str) -> list[Column]:
        # frames that grow with the row; one that shrinks would be computed anew for each row
        before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return [F.max(n).over(before).alias(f"{prefix}{n}") for n in forward] + [F.max(n).over(after).alias(f"{prefix}{n}") for n in backward]

    inside = rows.select("problem_id", "selected_correct", "threshold", "chunk", *running(rows, "chunk", "accepted", "i_"))
    tops = rows.groupBy("chunk").agg(*[F.max(n).alias(n) for n in (*forward, *backward)])
    outside = tops.select("chunk", *running(tops, F.lit(0), "chunk", "o_"))
    both = inside.join(outside, "chunk")
    top = lambda n: F.greatest(f"i_{n}", f"o_{n}")
    less = lambda n: F.when(F.col("selected_correct") == 1, top(f"{n}1")).otherwise(top(f"{n}0"))
    f = both.select("problem_id", "selected_correct", "threshold", F.greatest(top("cf"), less("c")).alias("certified"), F.greatest(top("bf"), less("b")).alias("best"))
    f = f.withColumn("loo", F.coalesce("certified.thr", "best.thr")).withColumn("meets_target", F.col("certified").isNotNull())
    # what a threshold accepts is the prefix that ends with the last row of its value
    ends = c.groupBy("threshold").agg(F.max(F.struct("accepted", "correct")).alias("e"))
    full = recommend(c, [target], min_accepted).select(F.col("threshold").alias("full_threshold"))
    # one row
    whole = full.join(ends, F.col("full_threshold") == F.col("threshold")).select("full_threshold", F.col("e.accepted").alias("n_full"))
    # many folds share a threshold
    f = cut(f)
    found = f.groupBy("loo").agg(F.count(F.lit(1)).alias("c")).join(ends.select(F.col("threshold").alias("loo"), F.col("e.accepted").alias("full_accepted"), F.col("e.correct").alias("full_correct")), "loo", "left")
    j = spread_join(f, cut(found), ["loo"], "c", f.count(), "left").join(F.broadcast(whole))
    took = F.coalesce(F.col("threshold") >= F.col("loo"), F.lit(False))
    one = lambda cond: cond.cast("long")
    # accepted sets are prefixes of one order, so one holds the other
    jaccard = F.least("full_accepted", "n_full") / F.nullif(F.greatest("full_accepted", "n_full"), F.lit(0))
    return j.select(
        F.col("problem_id").alias("omitted"), F.col("loo").alias("loo_threshold"), "meets_target", F.col("threshold").alias("omitted_confidence"), took.alias("omitted_accepted"), F.col("selected_correct").alias("omitted_correct"),
        "full_threshold", (F.col("threshold") >= F.col("full_threshold")).alias("full_accepts_omitted"), (F.col("loo") - F.col("full_threshold")).alias("threshold_delta"), "full_accepted", "full_correct",
        (F.col("full_accepted") - one(took)).alias("train_accepted"), (F.col("full_correct") - one(took & (F.col("selected_correct") == 1))).alias("train_correct"), (F.col("full_accepted") - F.col("n_full")).alias("accepted_delta"), F.coalesce(jaccard, F.lit(1.0)).alias("jaccard"))


def stability(folds: DataFrame) -> DataFrame:
    """One row: folds, changed, distinct thresholds (12 digits) with their range and mean, accepted ranges, Jaccard of accepted sets, held-out accuracy."""
    changed = F.abs("threshold_delta") > 1e-12
    a = folds.agg(F.count(F.lit(1)).alias("folds"), F.count_if(changed).alias("changed"), F.count_distinct(F.round("loo_threshold", 12)).alias("distinct_thresholds"), F.min("loo_threshold").alias("threshold_min"), F.max("loo_threshold").alias("threshold_max"),
                  F.avg("loo_threshold").alias("threshold_mean"), F.min("train_accepted").alias("train_accepted_min"), F.max("train_accepted").alias("train_accepted_max"), F.min("full_accepted").alias("full_accepted_min"), F.max("full_accepted").alias("full_accepted_max"),
                  F.min("jaccard").alias("jaccard_min"), F.avg("jaccard").alias("jaccard_mean"), F.count_if("meets_target").alias("meets_target"), F.count_if("omitted_accepted").alias("heldout_accepted"), F.count_if(F.col("omitted_accepted") & (F.col("omitted_correct") == 1)).alias("heldout_correct"))
    low, high = st.wilson(F.col("heldout_correct"), F.col("heldout_accepted"))
    return a.select("*", (F.col("folds") - F.col("heldout_accepted")).alias("heldout_rejected"), st.rate(F.col("heldout_correct"), F.col("heldout_accepted")).alias("heldout_accuracy"), low.alias("heldout_low"), high.alias("heldout_high"), st.rate(F.col("changed"), F.col("folds")).alias("changed_rate"))


def threshold_values(folds: DataFrame) -> DataFrame:
    """(threshold, resamples): how many folds settle on each threshold."""
    return folds.groupBy(F.round("loo_threshold", 12).alias("threshold")).agg(F.count(F.lit(1)).alias("resamples"))


def sensitive_omissions(folds: DataFrame, limit: int = 10) -> DataFrame:
    """A report: the folds that move the threshold most, then what is accepted most, then by id descending."""
    return folds.orderBy(F.desc(F.abs("threshold_delta")), F.desc(F.abs("accepted_delta")), F.desc("omitted")).limit(limit)


def case_kind() -> Column:
    """The kind of each applied decision."""
    a, ok, any_ = F.col("accepted"), F.col("selected_correct") == 1, F.col("has_any_correct") == 1
    return (F.when(a & ok, "accepted_correct").when(a & any_, "accepted_missed").when(a, "accepted_no_correct").when(ok, "abstained_correct").when(any_, "abstained_missed").otherwise("abstained_no_correct"))


def casebook(applied: DataFrame, ranked: DataFrame, top: int = 3) -> DataFrame:
    """applied decisions with their kind, distance from the threshold, best correct candidate and top candidates."""
    best = F.min_by(F.when(F.col("label") == 1, F.struct("candidate_index", "rank", "score")), F.when(F.col("label") == 1, F.col("rank")))
    tops = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "candidate_index", "score", "label"))))
    g = ranked.groupBy("problem_id").agg(best.alias("best_correct"), tops.alias("top_candidates"))
    return applied.withColumn("kind", case_kind()).withColumn("distance", F.col("confidence") - F.col("threshold")).join(g, "problem_id", "left")
