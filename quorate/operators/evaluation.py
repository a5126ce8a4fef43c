"""Evaluating choices against 0/1 labels, ranking metrics and tables of agreement."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.operators.candidates import is_abstention


def labels_of(cands: DataFrame) -> DataFrame:
    """Per problem: n, any_correct, first_correct."""
    return cands.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("any_correct"), F.max(F.when(F.col("candidate_index") == 0, F.col("label"))).alias("first_correct"))


def label_at(df: DataFrame, cands: DataFrame, index: str = "chosen_index", name: str = "chosen_correct") -> DataFrame:
    """Adds the label of the candidate at an index column; null where the index is null."""
    lab = cands.select("problem_id", F.col("candidate_index").alias(index), F.col("label").alias(name))
    return df.join(lab, ["problem_id", index], "left")


def decisions(cands: DataFrame, selections: DataFrame, missing_as_abstain: bool = False) -> DataFrame:
    """One row per evaluated problem: any_correct, first_correct, is_abstained, is_missing, chosen_correct."""
    sel = selections
    for c in ("accepted", "abstained"):
        if c not in sel.columns:
            sel = sel.withColumn(c, F.lit(None).cast("boolean"))
    sel = label_at(sel.select("problem_id", "chosen_index", is_abstention().alias("is_abstained"), F.lit(True).alias("__there")), cands)
    out = labels_of(cands).join(sel, "problem_id", "left" if missing_as_abstain else "inner")
    missing = F.col("__there").isNull()
    return out.withColumn("is_missing", missing).withColumn("is_abstained", F.coalesce("is_abstained", missing)).drop("__there")


def proportion(k: Column, n: Column, name: str) -> list[Column]:
    low, high = st.wilson(k, n)
    return [st.rate(k, n).alias(f"{name}_rate"), low.alias(f"{name}_low"), high.alias(f"{name}_high")]


def evaluate(dec: DataFrame) -> DataFrame:
    """One row of counts and rates over decisions()."""
    ok, any_, ab = F.col("chosen_correct") == 1, F.col("any_correct") == 1, F.col("is_abstained")
    c = dec.agg(
        F.count(F.lit(1)).alias("problems"), F.count_if(~ab).alias("accepted"), F.count_if(ab).alias("abstained"), F.count_if(ab & ~F.col("is_missing")).alias("explicit_abstained"),
        F.count_if(F.col("is_missing")).alias("missing_as_abstained"), F.count_if(any_).alias("has_any"), F.count_if(~ab & any_).alias("accepted_any"), F.count_if(~ab & ok).alias("accepted_correct"),
        F.count_if(~ab & ok & any_).alias("accepted_correct_any"), F.count_if(ab & any_).alias("abstained_any"), F.count_if(ab & F.col("chosen_correct").isNotNull()).alias("abstained_with_choice"),
        F.count_if(ab & ok).alias("abstained_correct"), F.count_if(F.col("first_correct") == 1).alias("first_correct"))
    col = F.col
    return c.select(
        "*", *proportion(col("accepted"), col("problems"), "coverage"), *proportion(col("has_any"), col("problems"), "has_any"), *proportion(col("accepted_correct"), col("accepted"), "selected"),
        *proportion(col("accepted_correct_any"), col("accepted_any"), "selected_given_any"), *proportion(col("accepted_correct"), col("problems"), "counting_abstentions_incorrect"),
        *proportion(col("accepted_correct") + col("abstained_correct"), col("accepted") + col("abstained_with_choice"), "with_abstention_choices"),
        *proportion(col("abstained_any"), col("abstained"), "abstained_has_any"), *proportion(col("first_correct"), col("problems"), "first"))


def topk_any_correct(lists: DataFrame, cands: DataFrame, max_k: int) -> DataFrame:
    """(k, hits, problems): problems with a correct candidate among the first k of chosen_indices."""
    e = lists.select("problem_id", F.posexplode("chosen_indices").alias("pos", "candidate_index")).join(cands.select("problem_id", "candidate_index", "label"), ["problem_id", "candidate_index"])
    hit = e.groupBy("problem_id").agg(F.min(F.when(F.col("label") == 1, F.col("pos") + 1)).alias("first_hit"))
    ks = F.explode(F.sequence(F.lit(1), F.lit(max_k)))
    return hit.select("problem_id", "first_hit", ks.alias("k")).groupBy("k").agg(F.count_if(F.col("first_hit") <= F.col("k")).alias("hits"), F.count(F.lit(1)).alias("problems"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(problem_id, correct) of two methods -> both, a_only, b_only, neither, discordant, b_minus_a, p_value."""
    j = a.select("problem_id", F.col("correct").alias("a")).join(b.select("problem_id", F.col("correct").alias("b")), "problem_id")
    c = j.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_correct"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("a_only"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("b_only"),
              F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("neither"), F.count(F.lit(1)).alias("problems"))
    return c.withColumn("discordant", F.col("a_only") + F.col("b_only")).withColumn("b_minus_a", st.rate(F.col("b_only") - F.col("a_only"), F.col("problems"))).withColumn("p_value", st.sign_test(F.col("a_only"), F.col("b_only")))


def with_rank(scored: DataFrame, minimize: bool = False) -> DataFrame:
    w = Window.partitionBy("problem_id").orderBy(F.desc(st.oriented(F.col("score"), minimize)), "candidate_index")
    return scored.withColumn("rank", F.row_number().over(w))


def ranking_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """MRR, hit@k and binary NDCG@k over problems; problems without a correct candidate count 0."""
    gain = lambda k: F.sum(F.when((F.col("label") == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    p = ranked.groupBy("problem_id").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first"), F.sum("label").alias("pos"), *[gain(k).alias(f"dcg{k}") for k in ks])
    ideal = lambda k: F.aggregate(F.when(F.col("pos") > 0, F.sequence(F.lit(1), F.least(F.col("pos"), F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return p.agg(F.count(F.lit(1)).alias("problems"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), *[F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit{k}") for k in ks],
                 *[F.avg(F.when(F.col("pos") > 0, F.col(f"dcg{k}") / F.nullif(ideal(k), F.lit(0.0))).otherwise(0.0)).alias(f"ndcg{k}") for k in ks])


def within_auc(scored: DataFrame) -> DataFrame:
    """(problem_id, auc): share of correct-incorrect pairs in order, ties a half; null if a class is missing. From tie-averaged ranks, no pairs."""
    w = Window.partitionBy("problem_id").orderBy("score")
    peers = Window.partitionBy("problem_id", "score")
    r = scored.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2.0)
    g = r.groupBy("problem_id").agg(F.sum(F.when(F.col("label") == 1, F.col("r"))).alias("s"), F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    neg = F.col("n") - F.col("p")
    return g.select("problem_id", F.when((F.col("p") > 0) & (neg > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * neg, F.lit(0))).alias("auc"))


def tie_ranks(scored: DataFrame, score: str = "score") -> DataFrame:
    """(score, n, avg_rank) over the whole table, from one row per distinct score."""
    from quorate.operators.windows import global_prefix

    g = scored.groupBy(score).agg(F.count(F.lit(1)).alias("n_peers"), F.sum("label").alias("pos")).withColumn("__neg", -F.col(score))
    p = global_prefix(g, "__neg", "__neg", {"upto": "n_peers"})
    return p.select(score, "n_peers", "pos", (F.col("upto") - (F.col("n_peers") - 1) / 2.0).alias("avg_rank"))


def pooled_auc(scored: DataFrame) -> DataFrame:
    r = tie_ranks(scored)
    g = r.agg(F.sum(F.col("avg_rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n_peers").alias("n"))
    neg = F.col("n") - F.col("p")
    return g.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * neg, F.lit(0))).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("rows"))


def reachable_misses(ranked: DataFrame) -> DataFrame:
    """Problems whose top candidate is wrong though a correct one exists: its best correct index, rank, score and the gap to the top."""
    top = F.max_by(F.struct("candidate_index", "score", "label"), -F.col("rank"))
    best = F.min_by(F.when(F.col("label") == 1, F.struct("candidate_index", "score", "rank")), F.when(F.col("label") == 1, F.col("rank")))
    g = ranked.groupBy("problem_id").agg(top.alias("t"), best.alias("b")).filter((F.col("t.label") == 0) & F.col("b").isNotNull())
    return g.select("problem_id", F.col("t.candidate_index").alias("top_index"), F.col("t.score").alias("top_score"), F.col("b.candidate_index").alias("best_index"), F.col("b.score").alias("best_score"), F.col("b.rank").alias("best_rank"), F.abs(F.col("t.score") - F.col("b.score")).alias("gap"))


def miss_buckets(misses: DataFrame, bounds: tuple[int, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """(bucket, n, mean_gap) by the first bound that the best correct rank does not exceed."""
    b = F.lit(f">{bounds[-1]}")
    for x in reversed(bounds):
        b = F.when(F.col("best_rank") <= x, F.lit(f"<={x}")).otherwise(b)
    return misses.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"))


def miss_neighbours(misses: DataFrame, ranked: DataFrame, pairs: DataFrame, top_k: int = 10, threshold: float = 0.5) -> DataFrame:
    """Adds topk, near (of the top_k best-ranked, those as similar to the top choice as the threshold) and max_sim (0 without others)."""
    best = ranked.join(misses.select("problem_id", "top_index"), "problem_id").filter((F.col("rank") <= top_k)).select("problem_id", F.col("candidate_index").alias("other"), "top_index")
    sims = pairs.select("problem_id", F.col("i").alias("a"), F.col("j").alias("b"), "score")
    found = best.filter("other <> top_index").withColumn("a", F.least("other", "top_index")).withColumn("b", F.greatest("other", "top_index")).join(sims, ["problem_id", "a", "b"], "left")
    n = best.groupBy("problem_id").agg(F.count(F.lit(1)).alias("topk"))
    g = found.groupBy("problem_id").agg(F.count_if(F.col("score") >= threshold).alias("near"), F.max("score").alias("max_sim"))
    return misses.join(n, "problem_id").join(g, "problem_id", "left").withColumn("near", F.coalesce("near", F.lit(0))).withColumn("max_sim", F.coalesce("max_sim", F.lit(0.0)))


def miss_summary(misses: DataFrame, bounds: tuple[int, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """One row: n, how many best correct ranks are within each bound, mean and upper-median gap, and the means of near and max_sim if there."""
    from quorate.operators.windows import global_prefix

    more = [F.avg(c).alias(f"mean_{c}") for c in ("near", "max_sim") if c in misses.columns]
    a = misses.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("best_rank") <= b).alias(f"le_{b}") for b in bounds], F.avg("gap").alias("mean_gap"), *more)
    counts = misses.groupBy("gap").agg(F.count(F.lit(1)).alias("c")).withColumn("__neg", -F.col("gap"))
    # one row beside every distinct gap
    at = global_prefix(counts, "__neg", "__neg", {"upto": "c"}).join(F.broadcast(a.select(F.col("n").alias("n_all"))))
    median = at.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n_all") / 2), F.col("gap"))).alias("median_gap"))
    return a.join(F.broadcast(median))


def typecheck_stats(scored: DataFrame, conf: DataFrame | None = None) -> DataFrame:
    """One row: problems, top choices that typecheck (and their share), problems rescued by the filter and without survivors, and with
    confidence() rows the mean probability and margin."""
    t = scored.groupBy("problem_id").agg(F.max_by(F.coalesce("typechecks", F.lit(False)), F.struct("score", -F.col("candidate_index"))).alias("top1"), F.max(F.coalesce("typechecks", F.lit(False))).alias("any_tc"))
    if conf is not None:
        t = t.join(conf.select("problem_id", "chosen_probability", "probability_margin"), "problem_id", "left")
    more = [F.avg("chosen_probability").alias("mean_chosen_probability"), F.avg("probability_margin").alias("mean_probability_margin")] if conf is not None else []
    a = t.agg(F.count(F.lit(1)).alias("problems"), F.count_if("top1").alias("top1_ok"), F.count_if(~F.col("top1") & F.col("any_tc")).alias("rescued"), F.count_if(~F.col("any_tc")).alias("no_survivors"), *more)
    return a.withColumn("top1_rate", st.rate(F.col("top1_ok"), F.col("problems")))


def ab_metrics(cands: DataFrame, a: DataFrame, b: DataFrame, timing: DataFrame | None = None, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """One row of the A/B comparison: sizes of the data, percentages of each method, their difference, and select_<name>_seconds of a timing table
    (name, value). a and b: (problem_id, correct)."""
    per = cands.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("any"))
    j = per.join(a.select("problem_id", F.col("correct").alias("x")), "problem_id").join(b.select("problem_id", F.col("correct").alias("y")), "problem_id")
    any_ = F.col("any") == 1
    pct = lambda c, of: 100.0 * st.rate(F.coalesce(F.sum(F.when(of, c)), F.lit(0)), F.count_if(of))
    every = F.lit(True)
    m = j.agg(F.count(F.lit(1)).alias("problems"), F.count_if(any_).alias("with_any"), F.avg("n").alias("candidates_per_problem"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("total_pairs"),
              pct(F.col("x"), every).alias("a_pct"), pct(F.col("y"), every).alias("b_pct"), pct(F.col("x"), any_).alias("a_given_any_pct"), pct(F.col("y"), any_).alias("b_given_any_pct"))
    m = m.withColumn("with_any_pct", 100.0 * st.rate(F.col("with_any"), F.col("problems"))).withColumn("b_minus_a_pct", F.col("b_pct") - F.col("a_pct")).withColumn("b_minus_a_given_any_pct", F.col("b_given_any_pct") - F.col("a_given_any_pct"))
    if timing is None:
        return m.withColumn("a_seconds", F.lit(None).cast("double")).withColumn("b_seconds", F.lit(None).cast("double"))
    # one row of a small table
    of = lambda name: F.max(F.when(F.col("name") == f"select_{name}_seconds", F.col("value")))
    return m.join(F.broadcast(timing.agg(of(names[0]).alias("a_seconds"), of(names[1]).alias("b_seconds"))))


def bucketed(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, problems, correct, accuracy, any, accuracy_given_any): the first bound not below the value, else the last; null values are skipped."""
    bucket = F.lit(float(bounds[-1]))
    for x in reversed(bounds):
        bucket = F.when(F.col(value) <= x, F.lit(float(x))).otherwise(bucket)
    g = df.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("problems"), F.sum("chosen_correct").alias("correct"), F.sum("any_correct").alias("with_any"))
    return g.withColumn("accuracy", st.rate(F.col("correct"), F.col("problems"))).withColumn("accuracy_given_any", st.rate(F.col("correct"), F.col("with_any")))


def tertile_bounds(df: DataFrame, value: str) -> DataFrame:
    """(lo, hi): the values at places n//3 and 2n//3 of ascending order, null below three values."""
    from quorate.operators.windows import global_prefix

    g = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c")).withColumn("__neg", -F.col(value))
    p = global_prefix(g, "__neg", "__neg", {"upto": "c"})
    total = p.agg(F.sum("c").alias("total"))
    pick = lambda m: F.min(F.when(F.col("upto") > F.floor(F.col("total") * m / 3), F.col(value)))
    return p.crossJoin(F.broadcast(total)).groupBy("total").agg(pick(1).alias("lo"), pick(2).alias("hi")).select(F.when(F.col("total") >= 3, F.col("lo")).alias("lo"), F.when(F.col("total") >= 3, F.col("hi")).alias("hi"))


def upper_median(g: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the value at place n//2 of each group."""
    w = Window.partitionBy(by).orderBy(value)
    n = Window.partitionBy(by)
    r = g.withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(n))
    return r.filter(F.col("r") == F.floor(F.col("n") / 2)).select(by, F.col(value).alias("median"))


def classification(df: DataFrame, pred: Column, truth: Column) -> DataFrame:
    c = df.agg(F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn"), F.count_if(~pred & ~truth).alias("tn"))
    col = F.col
    p, r = st.rate(col("tp"), col("tp") + col("fp")), st.rate(col("tp"), col("tp") + col("fn"))
    return c.select("*", p.alias("precision"), r.alias("recall"), st.rate(2 * p * r, p + r).alias("f1"), st.rate(col("tp") + col("tn"), col("tp") + col("fp") + col("fn") + col("tn")).alias("accuracy"))
