"""Published figures of the selective-prediction family, over 55 decisions (golden_decisions.csv: fixed values)."""
import os

import pytest

from quorate.operators import selective as sv


@pytest.fixture(scope="module")
def decisions(spark):
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "golden_decisions.csv")
    df = spark.read.option("header", True).schema("problem_id string, chosen_probability double, probability_margin double, score_margin double, selected_correct int, has_any_correct int").csv(f"file://{path}")
    return df.cache()


def test_ranking_quality(decisions):
    want = {"chosen_probability": (0.642471, 0.151562, 0.698427, 0.717632), "probability_margin": (0.515801, 0.024891, 0.556171, 0.532434), "score_margin": (0.523547, 0.032638, 0.559758, 0.543760)}
    for r in sv.compare_signals(decisions).collect():
        assert (r["auacc"], r["lift"], r["average_precision"], r["normalized_area"]) == pytest.approx(want[r["confidence_key"]], abs=1e-6)


@pytest.mark.parametrize("key, k, acc, thr", [("chosen_probability", 19, 0.789474, 0.914227), ("probability_margin", 2, 1.0, 0.654303), ("score_margin", 2, 1.0, 7.639973)])
def test_best_prefix(decisions, key, k, acc, thr):
    b = sv.best_prefix(sv.prefix_curve(sv.with_confidence(decisions, key))).first()
    assert (b["accepted"], b["accuracy"], b["threshold"]) == (k, pytest.approx(acc, abs=1e-6), pytest.approx(thr, abs=1e-6))


def test_recommendations(decisions):
    rec = lambda key, t: sv.recommend(sv.prefix_curve(sv.with_confidence(decisions, key)), [t], 5).first()
    for key, t, want in (("chosen_probability", 0.5, (True, 36, 0.666667, 0.503340, 0.541284)), ("probability_margin", 0.5, (False, 7, 0.857143, 0.486872, 0.403567)), ("score_margin", 0.5, (False, 8, 0.75, 0.409275, 4.158861)), ("chosen_probability", 0.6, (False, 32, 0.75, 0.578934, 0.752659))):
        r = rec(key, t)
        assert (r["meets_target"], r["accepted"]) == want[:2] and (r["accuracy"], r["low"], r["threshold"]) == pytest.approx(want[2:], abs=1e-6)


def test_leave_one_out(decisions):
    folds = sv.leave_one_out(sv.with_confidence(decisions, "chosen_probability"), 0.5, 5)
    s = sv.stability(folds).first()
    assert (s["folds"], s["changed"], s["distinct_thresholds"], s["heldout_accepted"], s["heldout_correct"]) == (55, 36, 3, 36, 24)
    counts = {round(r["loo_threshold"], 4): r["count"] for r in folds.groupBy("loo_threshold").count().collect()}
    assert counts == {0.6006: 24, 0.5413: 19, 0.5132: 12}
    assert round(s["jaccard_min"], 4) == 0.9722 and s["heldout_rejected"] == 19
    rows = decisions.orderBy("problem_id").collect()
    assert {r["threshold"]: r["resamples"] for r in sv.threshold_values(folds).collect()}.keys() == {round(r["loo_threshold"], 12) for r in folds.collect()}
    for f in folds.collect():
        kept = [r for r in rows if round(r["chosen_probability"], 12) >= f["loo_threshold"]]
        train = [r for r in kept if r["problem_id"] != f["omitted"]]
        assert (f["full_accepted"], f["full_correct"], f["train_accepted"], f["train_correct"]) == (len(kept), sum(r["selected_correct"] for r in kept), len(train), sum(r["selected_correct"] for r in train))
        full = [r for r in rows if round(r["chosen_probability"], 12) >= f["full_threshold"]]
        assert f["jaccard"] == pytest.approx(min(len(kept), len(full)) / max(len(kept), len(full))) and f["accepted_delta"] == len(kept) - len(full)
    top = sv.sensitive_omissions(folds, 5).collect()
    assert [abs(r["threshold_delta"]) for r in top] == sorted((abs(r["threshold_delta"]) for r in folds.collect()), reverse=True)[:5]


def test_abstention_policy(decisions):
    a = sv.apply_threshold(sv.with_confidence(decisions, "chosen_probability"), 0.5412)
    r = sv.abstention_report(a).first()
    assert (r["accepted"], r["abstained"], r["accepted_correct"]) == (36, 19, 24) and (r["low"], r["high"]) == (pytest.approx(0.503339979), pytest.approx(0.797853812))
    kinds = {x["kind"]: x["count"] for x in a.withColumn("kind", sv.case_kind()).groupBy("kind").count().collect()}
    assert sum(kinds.values()) == 55 and kinds["accepted_correct"] == 24
