"""Choosing one candidate of a problem, with deterministic ties."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.functions import text as tx
from quorate.operators import graph
from quorate.operators.pairs import both_ways, centrality
from quorate.operators.windows import cut


def first_candidate(cands: DataFrame) -> DataFrame:
    return cands.groupBy("problem_id").agg(F.min("candidate_index").alias("chosen_index"))


def statement_length(text_col: str = "candidate") -> Column:
    """Length of a text's normal form, 0 of a null."""
    return F.length(tx.normalize(F.coalesce(F.col(text_col), F.lit(""))))


def _shortest(length: Column) -> Column:
    return F.min_by("candidate_index", F.struct(length, "candidate_index"))


def shortest(cands: DataFrame, text_col: str = "candidate") -> DataFrame:
    return cands.groupBy("problem_id").agg(_shortest(statement_length(text_col)).alias("chosen_index"))


def first_and_shortest(cands: DataFrame, length_col: str) -> DataFrame:
    """(problem_id, first_index, shortest_index) of candidates that come with their statement_length(), in one pass."""
    return cands.groupBy("problem_id").agg(F.min("candidate_index").alias("first_index"), _shortest(F.col(length_col)).alias("shortest_index"))


def random_choice(cands: DataFrame, seed: int) -> DataFrame:
    """A hash of seed and problem picks the index."""
    return cands.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).select("problem_id", st.stable_index(F.lit(seed), F.col("problem_id"), F.col("n")).alias("chosen_index"))


def medoid(cents: DataFrame, length_col: str, *, simple_k: int = 0, max_drop: float = -1.0, penalty_col: str | None = None) -> DataFrame:
    """(problem_id, chosen_index, centrality, gap): the most central candidate, of equals the shorter, then the earlier.

    With simple_k, the simplest (penalty_col) of the simple_k most central that lose at most max_drop (if not negative); the gap is
    always that between the two most central ones.
    """
    c = cents.withColumn("__c", F.round("centrality", 12))
    w = Window.partitionBy("problem_id").orderBy(F.desc("__c"), length_col, "candidate_index")
    ranked = c.withColumn("__r", F.row_number().over(w)).withColumn("__best", F.first("__c").over(w)).withColumn("__next", F.lead("__c").over(w))
    gap = ranked.filter("__r = 1").select("problem_id", (F.col("__c") - F.col("__next")).alias("gap"))
    pool = ranked.filter(F.col("__r") <= max(1, simple_k))
    if simple_k > 0:
        if max_drop >= 0:
            pool = pool.filter(F.col("__best") - F.col("__c") <= max_drop)
        key = F.struct(F.col(penalty_col).alias("p"), (-F.col("__c")).alias("c"), F.col(length_col).alias("l"), F.col("candidate_index").alias("i"))
    else:
        key = F.struct(F.col("__r"))
    best = pool.groupBy("problem_id").agg(F.min_by(F.struct("candidate_index", "__c"), key).alias("b"))
    return best.join(gap, "problem_id").select("problem_id", F.col("b.candidate_index").alias("chosen_index"), F.col("b.__c").alias("centrality"), "gap")


def representatives(comps: DataFrame, nodes: DataFrame, pairs: DataFrame, tie_break: str = "medoid") -> DataFrame:
    """(problem_id, chosen_index, centrality, gap) within each problem's rank-1 component. nodes carry ``length``."""
    top = comps.filter("rank = 1").select("problem_id", F.explode("indices").alias("candidate_index"))
    inside = nodes.join(top, ["problem_id", "candidate_index"])
    if tie_break == "shortest":
        pick = inside.groupBy("problem_id").agg(F.min_by("candidate_index", F.struct("length", "candidate_index")).alias("chosen_index"))
    elif tie_break == "first":
        pick = inside.groupBy("problem_id").agg(F.min("candidate_index").alias("chosen_index"))
    elif tie_break == "medoid":
        a = top.select("problem_id", F.col("candidate_index").alias("i"))
        b = top.select("problem_id", F.col("candidate_index").alias("j"))
        own = pairs.join(a, ["problem_id", "i"], "left_semi").join(b, ["problem_id", "j"], "left_semi")
        return medoid(centrality(inside, own), "length")
    else:
        raise ValueError(f"unknown tie break {tie_break!r}")
    return pick.withColumn("centrality", F.lit(None).cast("double")).withColumn("gap", F.lit(None).cast("double"))


def with_fallback(primary: DataFrame, fallback: DataFrame, *, min_size: int = 0, min_cohesion: float = 0.0, name: str = "bleu_medoid") -> DataFrame:
    """Use the fallback's choice where the primary's component is too small or too loose; the primary choice is kept beside it."""
    need = (F.col("size") < min_size) | (F.col("cohesion") < min_cohesion)
    f = fallback.select("problem_id", F.col("chosen_index").alias("__f"))
    return primary.join(f, "problem_id", "left").withColumn("primary_index", F.col("chosen_index")).withColumn("fallback_used", F.when(need, F.lit(name))).withColumn("chosen_index", F.when(need, F.coalesce("__f", "chosen_index")).otherwise(F.col("chosen_index"))).drop("__f")


def global_medoid_mode(nodes: DataFrame, pairs: DataFrame, *, objective: str = "mean", simple_k: int = 0, max_drop: float = -1.0, pair_mode: str = "all", digits: int = 12) -> DataFrame:
    """(problem_id, chosen_index, centrality, gap, size, cohesion) over each problem's whole pool: its most central candidate, or the simplest of
    the simple_k most central that lose at most max_drop. nodes carry ``length`` and, for simple_k, ``penalty``. Pairs must be all pairs."""
    if pair_mode != "all":
        raise ValueError("the global medoid needs the scores of all pairs, not of nearest neighbours alone")
    cents = centrality(nodes, pairs, mode="geometric" if objective == "gmean" else "mean").withColumn("centrality", F.round("centrality", digits))
    picked = medoid(cents, "length", simple_k=simple_k, max_drop=max_drop, penalty_col="penalty" if simple_k else None)
    pool = nodes.groupBy("problem_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    coh = pairs.groupBy("problem_id").agg(F.avg("score").alias("cohesion"))
    return picked.join(pool, "problem_id").join(coh, "problem_id", "left").withColumn("cohesion", F.coalesce("cohesion", F.lit(1.0)))


FALLBACKS = ("bleu_medoid", "critic_medoid", "critic_knn_medoid")


def fallback_choice(name: str, nodes: DataFrame, critic: DataFrame, bleu: DataFrame, k: int = 3, digits: int = 12) -> DataFrame:
    """(problem_id, chosen_index, centrality) of a fallback: the medoid by BLEU, by the critic, or by the critic's k nearest."""
    if name not in FALLBACKS:
        raise ValueError(f"unknown fallback {name!r}")
    cents = centrality(nodes, bleu if name == "bleu_medoid" else critic, mode="knn" if name == "critic_knn_medoid" else "mean", k=k)
    return medoid(cents.withColumn("centrality", F.round("centrality", digits)), "length")


def top_k_list(chosen: DataFrame, ranked: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """(problem_id, chosen_indices): the choice, then ranked others (problem_id, candidate_index, place), then the rest by index; distinct, k at most."""
    rows = (chosen.select("problem_id", F.col("chosen_index").alias("candidate_index"), F.lit(0).alias("tier"), F.lit(0).alias("place"))
            .unionByName(ranked.select("problem_id", "candidate_index", F.lit(1).alias("tier"), F.col("place").cast("int").alias("place")))
            .unionByName(cands.select("problem_id", "candidate_index", F.lit(2).alias("tier"), F.col("candidate_index").alias("place"))))
    first = rows.groupBy("problem_id", "candidate_index").agg(F.min(F.struct("tier", "place")).alias("o"))
    w = Window.partitionBy("problem_id").orderBy("o", "candidate_index")
    top = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("r", "candidate_index"))).alias("x")).select("problem_id", F.col("x.candidate_index").alias("chosen_indices"))


def vote(results: DataFrame, lengths: DataFrame, how: str = "weighted") -> DataFrame:
    """results: (problem_id, member, chosen_index, size, cohesion, centrality) -> the index with the most weight, then votes, then shorter, then earlier."""
    if how not in ("weighted", "majority"):
        raise ValueError(f"unknown vote {how!r}")
    w = F.greatest(F.lit(1), F.col("size")) * F.coalesce("cohesion", F.lit(1.0)) * F.coalesce("centrality", F.lit(1.0)) if how == "weighted" else F.lit(1.0)
    tally = results.withColumn("w", w.cast("double")).groupBy("problem_id", "chosen_index").agg(F.round(F.sum("w"), 9).alias("weight"), F.count(F.lit(1)).alias("votes"))
    named = tally.join(lengths.select("problem_id", F.col("candidate_index").alias("chosen_index"), "length"), ["problem_id", "chosen_index"])
    return named.groupBy("problem_id").agg(F.max_by(F.struct("chosen_index", "weight", "votes"), F.struct("weight", "votes", -F.col("length"), -F.col("chosen_index"))).alias("b")).select("problem_id", "b.*")


def arg_max(scored: DataFrame, score: str = "score", minimize: bool = False) -> DataFrame:
    """(problem_id, chosen_index, score): the best score; of equals the first index."""
    o = st.oriented(F.col(score), minimize)
    return scored.groupBy("problem_id").agg(F.max_by(F.struct("candidate_index", F.col(score).alias("s")), F.struct(o, -F.col("candidate_index"))).alias("b")).select("problem_id", F.col("b.candidate_index").alias("chosen_index"), F.col("b.s").alias("score"))


def mean_scores(scored: DataFrame) -> DataFrame:
    """Mean over models: (problem_id, candidate_index, model, score) -> (problem_id, candidate_index, score)."""
    return scored.groupBy("problem_id", "candidate_index").agg(F.avg("score").alias("score"))


def confidence(scored: DataFrame, chosen: DataFrame, *, temperature: float = 1.0, minimize: bool = False, mask: str | None = None) -> DataFrame:
    """Per problem: chosen and runner-up score and probability, margins (null without a runner-up) and the number of eligible candidates."""
    rows = scored.withColumn("o", st.oriented(F.col("score"), minimize))
    pick = chosen.select("problem_id", "chosen_index")
    j = rows.join(pick, "problem_id")
    eligible = F.col(mask) if mask else F.lit(True)
    is_chosen = F.col("candidate_index") == F.col("chosen_index")
    rival = eligible & ~is_chosen
    agg = j.groupBy("problem_id", "chosen_index").agg(
        F.max(F.when(is_chosen, F.col("score"))).alias("chosen_score"), F.max(F.when(is_chosen, F.col("o"))).alias("co"),
        F.max_by(F.when(rival, F.struct("candidate_index", "score", "o")), F.when(rival, F.struct("o", -F.col("candidate_index")))).alias("r"),
        F.count_if(eligible).alias("eligible_count"), F.count(F.lit(1)).alias("n_candidates"))
    p, q = st.sigmoid(F.col("co") / temperature), st.sigmoid(F.col("r.o") / temperature)
    return agg.select("problem_id", "chosen_index", "chosen_score", p.alias("chosen_probability"), F.col("r.candidate_index").alias("runner_up_index"), F.col("r.score").alias("runner_up_score"), q.alias("runner_up_probability"),
                      (F.col("co") - F.col("r.o")).alias("score_margin"), (p - q).alias("probability_margin"), "eligible_count", "n_candidates")


def cluster_score(members: DataFrame, mode: str = "max", k: int = 3, temp: float = 1.0) -> DataFrame:
    """(problem_id, component, cluster_score, size, best_rank) of clusters of scored members (problem_id, component, score, rank)."""
    s = F.reverse(F.array_sort(F.collect_list("score")))
    mean_of = lambda n: F.aggregate(F.slice(F.col("s"), 1, n), F.lit(0.0), lambda a, x: a + x) / F.least(F.size("s"), F.lit(n))
    how = {
        "max": F.element_at("s", 1), "mean_top2": mean_of(2), "mean_topk": mean_of(max(1, k)),
        "logsumexp": F.element_at("s", 1) + temp * F.log(F.greatest(F.lit(1e-12), F.aggregate(F.col("s"), F.lit(0.0), lambda a, x: a + F.exp((x - F.element_at("s", 1)) / temp)))),
    }
    if mode not in how:
        raise ValueError(f"unknown cluster score {mode!r}")
    return members.groupBy("problem_id", "component").agg(s.alias("s"), F.count(F.lit(1)).alias("size"), F.min("rank").alias("best_rank")).select("problem_id", "component", how[mode].alias("cluster_score"), "size", "best_rank")


def verifier_choice(scored: DataFrame, pairs: DataFrame, threshold: float, *, top_m: int = 20, cluster: str = "mean_top2", cluster_k: int = 3, temp: float = 1.0, rep: str = "best", delta: float = 0.1, mutual_k: int = 0, margin: float = 0.0, mode: str = "components", support: float = 0.7) -> DataFrame:
    """(problem_id, chosen_index, score, cluster_score, size, cohesion) of scored candidates (problem_id, candidate_index, candidate, score, and typechecks if there are any).

    The top_m best (0: all) of those that typecheck (of all where none does) are clustered; the best cluster is the one with the highest
    cluster score, of equals the larger, then the earlier; it is represented by its best score or by the simplest within delta of that.
    """
    if rep not in ("best", "simple"):
        raise ValueError(f"unknown representative {rep!r}")
    valid = scored
    if "typechecks" in scored.columns:
        any_ok = F.max(F.coalesce("typechecks", F.lit(False))).over(Window.partitionBy("problem_id"))
        valid = scored.withColumn("__any", any_ok).filter(F.coalesce("typechecks", F.lit(False)) | ~F.col("__any"))
    w = Window.partitionBy("problem_id").orderBy(F.desc("score"), "candidate_index")
    norm = tx.normalize(F.coalesce(F.col("candidate"), F.lit("")))
    ranked = valid.withColumn("rank", F.row_number().over(w)).select("problem_id", F.col("candidate_index").alias("index"), "score", "rank", (F.col("rank") - 1).alias("candidate_index"), F.length(norm).alias("length"), F.round(tx.penalty(norm, w_binders=0.5, w_prop=0.25), 9).alias("penalty"))
    top = cut(ranked.filter(F.col("rank") <= top_m) if top_m > 0 else ranked)
    # clusters are of places by score, so that what goes by index there goes by rank
    at = lambda index, place: top.select("problem_id", F.col("index").alias(index), F.col("candidate_index").alias(place))
    placed = pairs.join(at("i", "a"), ["problem_id", "i"]).join(at("j", "b"), ["problem_id", "j"]).select("problem_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "score")
    comps, _stats = graph.ranked_components(top.select("problem_id", "candidate_index"), cut(placed), threshold, rank="size", mutual_k=mutual_k, margin=margin, mode=mode, support=support)
    comps = cut(comps.select("problem_id", F.col("rank").alias("component"), "indices", "cohesion"))
    members = comps.select("problem_id", "component", F.explode("indices").alias("candidate_index")).join(top, ["problem_id", "candidate_index"])
    clusters = cluster_score(members, cluster, cluster_k, temp)
    best = clusters.groupBy("problem_id").agg(F.max_by(F.struct("component", "cluster_score", "size"), F.struct("cluster_score", "size", -F.col("component"))).alias("c")).select("problem_id", "c.*")
    inside = members.join(best, ["problem_id", "component"]).withColumn("__top", F.max("score").over(Window.partitionBy("problem_id")))
    if rep == "simple":
        inside, key = inside.filter(F.col("score") >= F.col("__top") - delta), F.struct("penalty", -F.col("score"), "length", "index")
    else:
        key = F.struct("rank")
    pick = inside.groupBy("problem_id", "component", "cluster_score", "size").agg(F.min_by(F.struct("index", "score"), key).alias("b"))
    return pick.join(comps.select("problem_id", "component", "cohesion"), ["problem_id", "component"]).select("problem_id", F.col("b.index").alias("chosen_index"), F.col("b.score").alias("score"), "cluster_score", "size", "cohesion")


def audit(cands: DataFrame, comps: DataFrame, pairs: DataFrame, top_components: int = 3, top_edges: int = 5, snippet: int = 60) -> DataFrame:
    """Per problem: its best components with their numbers of correct candidates, its strongest pairs and candidate snippets."""
    lab = cands.select("problem_id", "candidate_index", "label")
    m = comps.filter(F.col("rank") <= top_components).select("problem_id", "rank", "indices", "size", "cohesion", F.explode("indices").alias("candidate_index")).join(lab, ["problem_id", "candidate_index"])
    c = m.groupBy("problem_id", "rank", "indices", "size", "cohesion").agg(F.sum("label").alias("n_labeled_correct"))
    c = c.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("rank", "indices", "size", "cohesion", "n_labeled_correct"))).alias("components"))
    w = Window.partitionBy("problem_id").orderBy(F.desc("score"), "i", "j")
    e = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_edges).groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("r", "i", "j", "score"))).alias("top_edges"))
    t = cands.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("candidate_index", "label", tx.shorten(F.col("candidate"), snippet).alias("snippet")))).alias("candidates"))
    return c.join(e, "problem_id", "left").join(t, "problem_id")


def knn_directed(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("problem_id", "node").orderBy(F.desc("score"), "other")
    return both_ways(pairs).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
