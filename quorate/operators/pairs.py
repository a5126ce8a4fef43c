"""Pairs of candidates inside a problem: (problem_id, i, j, score) with i < j; the diagonal is never stored."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import text as tx
from quorate.operators import tiles
from quorate.operators.tiles import cosine_pairs, nearest, pair_frame  # noqa: F401

MAX_N = 4
FLOOR = 1e-12


def gram_counts(cands: DataFrame, toks: str, max_n: int = MAX_N) -> DataFrame:
    """(problem_id, candidate_index, order, gram, c)."""
    orders = F.array(*[F.struct(F.lit(n).alias("order"), tx.ngrams(F.col(toks), n).alias("grams")) for n in range(1, max_n + 1)])
    long = cands.select("problem_id", "candidate_index", F.explode(orders).alias("o")).select("problem_id", "candidate_index", "o.order", F.explode("o.grams").alias("gram"))
    return long.groupBy("problem_id", "candidate_index", "order", "gram").agg(F.count(F.lit(1)).alias("c"))


def _one_way(overlaps: np.ndarray, hyp: np.ndarray, ref: np.ndarray, smooth: float) -> np.ndarray:
    logs = np.zeros(len(hyp))
    for n, o in enumerate(overlaps, 1):
        total = np.maximum(hyp - (n - 1), 0)
        logs += np.log(np.maximum(FLOOR, np.where(total > 0, (o + smooth) / np.where(total > 0, total + smooth, 1.0), 0.0))) / len(overlaps)
    brevity = np.where((hyp < ref) & (hyp > 0), np.exp(np.minimum(0.0, 1.0 - ref / np.maximum(hyp, 1))), 1.0)
    return np.where(hyp == 0, np.where(ref == 0, 1.0, 0.0), brevity * np.exp(logs))


def _gram_hashes(toks: str, max_n: int) -> Column:
    """All n-grams of orders 1 to max_n as 64-bit hashes, order by order."""
    def grams(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda k: F.xxhash64(F.lit(n), F.slice(toks, k, F.lit(n))))
        return F.when(F.size(toks) >= n, some).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[grams(n) for n in range(1, max_n + 1)])


def _both_bleus(cands: DataFrame, text_col: str, max_n: int, smooth: float, normalize: bool, block: int = tiles.BLOCK) -> DataFrame:
    """(problem_id, i, j, of_i, of_j): smoothed BLEU of i against j as reference, and of j against i, of all pairs i < j."""
    def kernel(t: tiles.Tiles):
        grams, n = t.lists("grams", np.int64)
        row, length = np.repeat(np.arange(len(n)), n), t.column("len").to_numpy().astype(np.int64)
        # a row's grams stand order by order, of each order as many as its length has
        per = np.maximum(length[:, None] - np.arange(max_n), 0)
        overlaps = tiles.common_features(t, row, grams, np.repeat(np.tile(np.arange(max_n), len(n)), per.ravel()), max_n)
        x, y, at = t.pairs()
        for a in range(0, len(x), 500_000):
            p, q, o = x[a:a + 500_000], y[a:a + 500_000], overlaps[:, at[a:a + 500_000]].astype(float)
            yield [t.ids(p), pa.array(t.index[p]), pa.array(t.index[q]), pa.array(_one_way(o, length[p], length[q], smooth)), pa.array(_one_way(o, length[q], length[p], smooth))]

    text = F.coalesce(F.col(text_col), F.lit(""))
    toks = cands.select("problem_id", "candidate_index", tx.tokens(tx.normalize(text) if normalize else text).alias("toks"))
    kind = dict(cands.dtypes)["candidate_index"]
    return tiles.Tiled(toks, [F.size("toks").alias("len"), _gram_hashes("toks", max_n).alias("grams")], block).apply(kernel, f"i {kind}, j {kind}, of_i double, of_j double")


def bleu_pairs(cands: DataFrame, text_col: str = "candidate", max_n: int = MAX_N, smooth: float = 1.0, normalize: bool = True) -> DataFrame:
    """Symmetric smoothed BLEU of all pairs: the mean of both directions."""
    return _both_bleus(cands, text_col, max_n, smooth, normalize).select("problem_id", "i", "j", (0.5 * (F.col("of_i") + F.col("of_j"))).alias("score"))


def bleu_directed(cands: DataFrame, text_col: str = "candidate", max_n: int = MAX_N, smooth: float = 1.0, normalize: bool = True) -> DataFrame:
    """(problem_id, hyp, ref, score): smoothed BLEU of each candidate against each other one as its reference."""
    ways = F.explode(F.array(F.struct(F.col("i").alias("hyp"), F.col("j").alias("ref"), F.col("of_i").alias("score")), F.struct(F.col("j").alias("hyp"), F.col("i").alias("ref"), F.col("of_j").alias("score"))))
    return _both_bleus(cands, text_col, max_n, smooth, normalize).select("problem_id", ways.alias("w")).select("problem_id", "w.*")


def jaccard_pairs(cands: DataFrame, text_col: str = "candidate", block: int = tiles.BLOCK) -> DataFrame:
    """Jaccard similarity of distinct tokens; 1 where both have none."""
    def kernel(t: tiles.Tiles):
        hashes, n = t.lists("t", np.int64)
        row = np.repeat(np.arange(len(n)), n)
        both = tiles.common_features(t, row, hashes, np.zeros(len(row), np.int64), 1)[0]
        x, y, at = t.pairs()
        o = both[at].astype(float)
        union = n[x] + n[y] - o
        yield [t.ids(x), pa.array(t.index[x]), pa.array(t.index[y]), pa.array(np.where(union > 0, o / np.maximum(union, 1), 1.0))]

    toks = F.transform(F.array_distinct(tx.tokens(F.coalesce(F.col(text_col), F.lit("")))), lambda w: F.xxhash64(w))
    kind = dict(cands.dtypes)["candidate_index"]
    return tiles.Tiled(cands, [toks.alias("t")], block).apply(kernel, f"i {kind}, j {kind}, score double")


def hybrid_pairs(critic: DataFrame, bleu: DataFrame, alpha: float) -> DataFrame:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    b = bleu.withColumnRenamed("score", "b")
    return critic.join(b, ["problem_id", "i", "j"]).select("problem_id", "i", "j", (alpha * F.col("score") + (1 - alpha) * F.col("b")).alias("score"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(problem_id, node, other, score) in both directions."""
    return pairs.select("problem_id", F.col("i").alias("node"), F.col("j").alias("other"), "score").unionByName(
        pairs.select("problem_id", F.col("j").alias("node"), F.col("i").alias("other"), "score"))


def knn_edges(pairs: DataFrame, k: int, mutual: bool) -> DataFrame:
    """Pairs of which each (mutual), or one, is among the other's k most similar; ties go to the smaller index."""
    w = Window.partitionBy("problem_id", "node").orderBy(F.desc("score"), "other")
    return near_edges(both_ways(pairs).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k), mutual)


def near_edges(near: DataFrame, mutual: bool) -> DataFrame:
    """knn_edges() of what nearest() found."""
    votes = near.groupBy("problem_id", F.least("node", "other").alias("i"), F.greatest("node", "other").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    return votes.filter(F.col("n") >= (2 if mutual else 1)).select("problem_id", "i", "j", "score")


def knn_scored(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """All pairs; those that were not chosen score 0."""
    c = chosen.select("problem_id", "i", "j", F.lit(True).alias("hit"))
    return pairs.join(c, ["problem_id", "i", "j"], "left").select("problem_id", "i", "j", F.when(F.col("hit"), F.col("score")).otherwise(0.0).alias("score"))


def symmetrized(pairs_ij: DataFrame, pairs_ji: DataFrame) -> DataFrame:
    """Mean of an order-dependent scorer's two directions."""
    r = pairs_ji.withColumnRenamed("score", "back")
    return pairs_ij.join(r, ["problem_id", "i", "j"]).select("problem_id", "i", "j", ((F.col("score") + F.col("back")) / 2).alias("score"))


class ScorerRegistry:
    """Named pair scorers: DataFrame of candidates -> pairs."""

    def __init__(self):
        self._known: dict[str, Callable[..., DataFrame]] = {"bleu": bleu_pairs, "jaccard": jaccard_pairs, "cosine": cosine_pairs}

    def register(self, name: str, scorer: Callable[..., DataFrame]) -> None:
        self._known[name] = scorer

    def register_function(self, name: str, fn: Callable, *cols: str) -> None:
        """fn(*pandas series of a, *of b) -> series of scores: a model behind a pandas UDF."""
        scorer = F.pandas_udf(fn, "double")

        def run(cands: DataFrame, **_):
            p = pair_frame(cands, *cols)
            return p.select("problem_id", "i", "j", scorer(*[F.col(f"{c}_i") for c in cols], *[F.col(f"{c}_j") for c in cols]).alias("score"))

        self._known[name] = run

    def score(self, name: str, cands: DataFrame, **options) -> DataFrame:
        if name not in self._known:
            raise ValueError(f"unknown scorer {name!r}; known: {sorted(self._known)}")
        return self._known[name](cands, **options)


SCORERS = ScorerRegistry()


def centrality(nodes: DataFrame, pairs: DataFrame, mode: str = "mean", k: int = 3, eps: float = FLOOR) -> DataFrame:
    """(problem_id, candidate_index, centrality): mean, geometric mean, or mean of the k largest similarities to the others; 1 for a single candidate."""
    d = both_ways(pairs)
    if mode == "geometric":
        agg = F.exp(F.avg(F.log(F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1.0)))))
    else:
        agg = F.avg("score")
    if mode == "knn":
        w = Window.partitionBy("problem_id", "node").orderBy(F.desc("score"), "other")
        d = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    c = d.groupBy("problem_id", F.col("node").alias("candidate_index")).agg(agg.alias("centrality"))
    return nodes.join(c, ["problem_id", "candidate_index"], "left").withColumn("centrality", F.coalesce("centrality", F.lit(1.0)))
