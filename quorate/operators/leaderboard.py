"""Comparing methods over the same problems: decisions are (method, problem_id, correct 0/1, accepted boolean, any_correct 0/1)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.operators.evaluation import label_at, labels_of
from quorate.operators.grid import CONFIG, selection_grid, top_selections  # noqa: F401


def method_decisions(cands: DataFrame, selections: DataFrame, methods: list[str], missing: str = "abstain") -> DataFrame:
    """One row per method and problem; a missing choice is an abstention or an error, and an abstention is not correct."""
    names = cands.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    # a bounded number of methods beside every problem
    grid = labels_of(cands).select("problem_id", "any_correct").crossJoin(F.broadcast(names))
    sel = label_at(selections, cands).select("method", "problem_id", "chosen_index", "chosen_correct", *[c for c in ("accepted",) if c in selections.columns])
    if "accepted" not in sel.columns:
        sel = sel.withColumn("accepted", F.lit(True))
    j = grid.join(sel, ["method", "problem_id"], "left")
    if missing == "error":
        j = j.withColumn("accepted", F.when(F.col("chosen_index").isNull(), F.raise_error(F.lit("a method lacks a problem")).cast("boolean")).otherwise(F.col("accepted")))
    acc = F.coalesce("accepted", F.lit(False)) & F.col("chosen_correct").isNotNull()
    return j.select("method", "problem_id", F.when(acc, F.col("chosen_correct")).otherwise(0).alias("correct"), acc.alias("accepted"), "any_correct")


def summary(dec: DataFrame) -> DataFrame:
    """Per method: counts, rates, Wilson bounds and place (more correct, then more accurate when accepted, then name)."""
    g = dec.groupBy("method").agg(F.count(F.lit(1)).alias("problems"), F.count_if("accepted").alias("n_accepted"), F.sum("correct").cast("long").alias("n_correct"), F.count_if(F.col("any_correct") == 1).alias("n_any"),
                                  F.count_if((F.col("any_correct") == 1) & (F.col("correct") == 0)).alias("missed"))
    low, high = st.wilson(F.col("n_correct"), F.col("problems"))
    g = g.select("*", st.rate(F.col("n_accepted"), F.col("problems")).alias("coverage"), st.rate(F.col("n_correct"), F.col("problems")).alias("accuracy"), low.alias("low"), high.alias("high"), st.rate(F.col("n_correct"), F.col("n_accepted")).alias("accepted_accuracy"))
    # one row per method
    w = Window.orderBy(F.desc("n_correct"), F.desc(F.round("accepted_accuracy", 12)), "method")
    return g.withColumn("place", F.row_number().over(w))


def frontier(summ: DataFrame) -> DataFrame:
    """Methods with accepted rows that no other beats in coverage and accepted accuracy at once."""
    s = summ.filter("n_accepted > 0").select("method", F.round("coverage", 12).alias("c"), F.round("accepted_accuracy", 12).alias("a"))
    o = s.select(F.col("method").alias("m2"), F.col("c").alias("c2"), F.col("a").alias("a2"))
    beaten = (F.col("c2") >= F.col("c")) & (F.col("a2") >= F.col("a")) & ((F.col("c2") > F.col("c")) | (F.col("a2") > F.col("a")))
    return s.join(F.broadcast(o), beaten, "left_anti").select("method", F.col("c").alias("coverage"), F.col("a").alias("accepted_accuracy"))


def paired_matrix(dec: DataFrame) -> DataFrame:
    """Per ordered pair of methods: both, a_only, b_only, neither and the sign test."""
    a = dec.select("problem_id", F.col("method").alias("a"), F.col("correct").alias("x"))
    b = dec.select("problem_id", F.col("method").alias("b"), F.col("correct").alias("y"))
    x, y = F.col("x") == 1, F.col("y") == 1
    g = a.join(b, "problem_id").filter("a <> b").groupBy("a", "b").agg(F.count_if(x & y).alias("both_correct"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))
    return g.withColumn("p_value", st.sign_test(F.col("a_only"), F.col("b_only")))


def disagreements(dec: DataFrame, best: str, limit: int = 10) -> DataFrame:
    """A report: for each other method the first problems on which only one of the two is correct."""
    b = dec.filter(F.col("method") == best).select("problem_id", F.col("correct").alias("best_correct"))
    d = dec.filter(F.col("method") != best).join(b, "problem_id").filter("correct <> best_correct")
    w = Window.partitionBy("method").orderBy("problem_id")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("method", "place", "problem_id", "best_correct", F.col("correct").alias("other_correct"))


def pairwise_wins(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("problem_id", F.col("correct").alias("x")).join(b.select("problem_id", F.col("correct").alias("y")), "problem_id")
    return j.agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))


def grid(scored: DataFrame, configs: DataFrame) -> DataFrame:
    """Accuracy of each weighting (config, wa, wb) of two scores: the scores are made once and weighed by every configuration."""
    # the configurations are a short list: one aggregate of the problems with a column for each, so that rows are read and shuffled once
    listed = [tuple(r) for r in configs.select("config", "wa", "wb").collect()]
    best = [F.max_by("label", F.struct(F.lit(wa) * F.col("score_a") + F.lit(wb) * F.col("score_b"), -F.col("candidate_index"))).alias(f"c{i}") for i, (_, wa, wb) in enumerate(listed)]
    one = scored.groupBy("problem_id").agg(F.max("label").alias("any_correct"), *best)
    pick = one.select("any_correct", F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(f"c{i}").alias("correct")) for i, (c, _, _) in enumerate(listed)])).alias("x")).select("x.*", "any_correct")
    g = pick.groupBy("config").agg(F.count(F.lit(1)).alias("problems"), F.sum("correct").cast("long").alias("n_correct"), F.sum("any_correct").cast("long").alias("n_any"))
    return g.withColumn("accuracy", st.rate(F.col("n_correct"), F.col("problems"))).withColumn("accuracy_given_any", st.rate(F.col("n_correct"), F.col("n_any")))


def top_configs(g: DataFrame, n: int) -> DataFrame:
    """A report: the n best configurations."""
    return g.orderBy(F.desc(F.round("accuracy", 12)), F.desc("n_correct"), "config").limit(n)


def oracle_pool(hits: DataFrame) -> DataFrame:
    """(problem_id, hit boolean, selected boolean) rows -> problems, with any hit, selected hits, gap."""
    p = hits.groupBy("problem_id").agg(F.bool_or("hit").alias("any_hit"), F.bool_or(F.col("hit") & F.col("selected")).alias("sel_hit"), F.bool_or("selected").alias("in_pool"))
    return p.agg(F.count(F.lit(1)).alias("problems"), F.count_if("any_hit").alias("oracle"), F.count_if("sel_hit").alias("selected"), (F.count_if("any_hit") - F.count_if("sel_hit")).alias("gap"), F.count_if(~F.col("in_pool")).alias("missing_from_pool"))


def cross_tab(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
