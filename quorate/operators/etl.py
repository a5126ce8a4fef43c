"""Training-data building: pairs, lists, splits and samples. Random picks are orders of a hash of seed and keys, so they repeat."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.operators.windows import first_in_order


def order_hash(seed: int, *keys: str) -> Column:
    return st.stable_hash(F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])


def capped(df: DataFrame, by: list[str], order: list, cap: int) -> DataFrame:
    """The first cap rows of each group; 0 keeps all, -1 none."""
    if cap == 0:
        return df
    if cap < 0:
        return df.limit(0)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")


def reference_pairs(cands: DataFrame) -> DataFrame:
    """(problem_id, candidate_index, a, b, label, task): candidate against reference."""
    return cands.select("problem_id", "candidate_index", F.col("candidate").alias("a"), F.col("reference").alias("b"), "label", F.lit("pred_vs_ref").alias("task"))


def labelled_pairs(cands: DataFrame) -> DataFrame:
    """(problem_id, i, j, label): correct-correct pairs are 1, correct-incorrect 0; pairs of incorrect ones say nothing."""
    a = cands.select("problem_id", F.col("candidate_index").alias("i"), F.col("label").alias("li"))
    b = cands.select("problem_id", F.col("candidate_index").alias("j"), F.col("label").alias("lj"))
    return a.join(b, "problem_id").filter("i < j and li + lj > 0").select("problem_id", "i", "j", (F.col("li") * F.col("lj")).alias("label"))


def hard_pairs(pairs: DataFrame, cap: int, seed: int) -> DataFrame:
    """Of labelled, scored pairs: the least similar positives and the most similar negatives of each problem, cap of each class."""
    hard = F.when(F.col("label") == 1, F.round("score", 9)).otherwise(-F.round("score", 9))
    return capped(pairs.withColumn("__h", order_hash(seed, "problem_id", "i", "j")), ["problem_id", "label"], [hard, "__h", "i", "j"], cap).drop("__h")


def random_pairs(pairs: DataFrame, cap: int, seed: int) -> DataFrame:
    return capped(pairs.withColumn("__h", order_hash(seed, "problem_id", "i", "j")), ["problem_id", "label"], ["__h", "i", "j"], cap).drop("__h")


def symmetrize(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.unionByName(pairs.withColumnRenamed(a, "__t").withColumnRenamed(b, a).withColumnRenamed("__t", b))


def pairwise_examples(cands: DataFrame) -> DataFrame:
    """(problem_id, pos, neg): every correct with every incorrect candidate."""
    p = cands.filter("label = 1").select("problem_id", F.col("candidate_index").alias("pos"))
    n = cands.filter("label = 0").select("problem_id", F.col("candidate_index").alias("neg"))
    return p.join(n, "problem_id")


def listwise_examples(cands: DataFrame, negatives: int, seed: int) -> DataFrame:
    """(problem_id, candidates, labels): one positive, picked by hash, and up to ``negatives`` negatives; problems lacking a class are skipped."""
    h = cands.withColumn("h", order_hash(seed, "problem_id", "candidate_index"))
    pos = capped(h.filter("label = 1"), ["problem_id"], ["h", "candidate_index"], 1)
    neg = capped(h.filter("label = 0"), ["problem_id"], ["h", "candidate_index"], negatives)
    rows = pos.unionByName(neg).groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("label")).alias("o"), "h", "candidate_index", "label"))).alias("x"))
    return rows.filter(F.exists("x", lambda r: r["label"] == 1) & F.exists("x", lambda r: r["label"] == 0)).select("problem_id", F.col("x.candidate_index").alias("sampled_indices"), F.col("x.label").alias("labels"))


def mined_negatives(scored: DataFrame, hard_k: int, easy_k: int, total: int, seed: int) -> DataFrame:
    """(problem_id, candidate_index, tier, place): the hard_k best-scored negatives, easy_k others by hash, then refills by score up to total."""
    neg = scored.filter("label = 0").withColumn("h", order_hash(seed, "problem_id", "candidate_index"))
    by_score = Window.partitionBy("problem_id").orderBy(F.desc("score"), "candidate_index")
    r = neg.withColumn("s", F.row_number().over(by_score)).withColumn("tier", F.when(F.col("s") <= hard_k, 0).otherwise(1))
    e = Window.partitionBy("problem_id", "tier").orderBy("h", "candidate_index")
    r = r.withColumn("e", F.row_number().over(e)).withColumn("tier", F.when(F.col("tier") == 0, 0).when(F.col("e") <= easy_k, 1).otherwise(2))
    w = Window.partitionBy("problem_id").orderBy("tier", F.when(F.col("tier") == 1, F.col("e")).otherwise(F.col("s")))
    return r.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= total).select("problem_id", "candidate_index", "tier", "place")


def split_by_id(ids: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """(problem_id, split): distinct ids in hash order, cut at int(n * share); the last split takes the rest. Three ids are needed for three splits.

    Places come from counts of the hash's leading bits; only the ids around a cut are put in order.
    """
    d = ids.select("problem_id").distinct().withColumn("__h", order_hash(seed, "problem_id"))
    names = list(shares)
    if len(names) == 1:
        return d.select("problem_id", F.lit(names[0]).alias("split"))
    upto, places = F.lit(0), []
    for name in names[:-1]:
        upto = upto + F.floor(F.col("n") * shares[name])
        places.append(upto)
    return first_in_order(d, "__h", "problem_id", places).select("problem_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("part") + 1).alias("split"))


def train_eval(ids: DataFrame, eval_share: float, seed: int) -> DataFrame:
    """(problem_id, split): clamp(int(n * share), 1, n - 1) ids for evaluation."""
    d = ids.select("problem_id").distinct().withColumn("__h", order_hash(seed, "problem_id"))
    k = F.least(F.greatest(F.floor(F.col("n") * eval_share), F.lit(1)), F.col("n") - 1)
    return first_in_order(d, "__h", "problem_id", [k]).select("problem_id", F.when(F.col("part") == 0, "eval").otherwise("train").alias("split"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("problem_id").intersect(b.select("problem_id"))


def build_stats(cands: DataFrame) -> DataFrame:
    """problems, without a correct one, without an incorrect one, usable, skip rate."""
    p = cands.groupBy("problem_id").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    usable = F.count_if((F.col("p") > 0) & (F.col("p") < F.col("n")))
    return p.agg(F.count(F.lit(1)).alias("problems"), F.count_if(F.col("p") == 0).alias("no_positive"), F.count_if(F.col("p") == F.col("n")).alias("no_negative"), usable.alias("usable"), (1 - usable / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("skip_rate"))


def guard_skips(stats: DataFrame, max_rate: float) -> DataFrame:
    r = stats.first()
    if r["problems"] and r["skip_rate"] > max_rate:
        raise ValueError(f"{r['skip_rate']:.3f} of problems are unusable; at most {max_rate} may be")
    return stats


def sweep(spark, **axes: list) -> DataFrame:
    """The product of parameter lists, with a running index; a bounded table of the driver's."""
    from itertools import product

    rows = [(i, *map(float, p)) for i, p in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "idx int, " + ", ".join(f"{k} double" for k in axes))


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return plan.join(done.select(key).distinct(), key, "left_anti")


def pairwise_loss(scored: DataFrame) -> DataFrame:
    """Mean logistic loss of correct over incorrect scores: -ln sigmoid(s_pos - s_neg)."""
    p = scored.filter("label = 1").select("problem_id", F.col("score").alias("sp"))
    n = scored.filter("label = 0").select("problem_id", F.col("score").alias("sn"))
    d = F.col("sp") - F.col("sn")
    loss = F.when(d >= 0, F.log1p(F.exp(-d))).otherwise(-d + F.log1p(F.exp(d)))
    return p.join(n, "problem_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg(loss).alias("loss"), F.avg(d).alias("mean_margin"), F.avg(F.when(d > 0, 1.0).otherwise(0.0)).alias("rank_acc"))


def listwise_loss(scored: DataFrame) -> DataFrame:
    """Mean over problems of -ln of the softmax mass on correct candidates."""
    w = Window.partitionBy("problem_id")
    e = F.exp(F.col("score") - F.max("score").over(w))
    g = scored.withColumn("e", e).groupBy("problem_id").agg(F.sum("e").alias("z"), F.sum(F.when(F.col("label") == 1, F.col("e"))).alias("p"))
    return g.filter("p is not null").agg(F.count(F.lit(1)).alias("problems"), F.avg(-F.log(F.col("p") / F.col("z"))).alias("loss"))
