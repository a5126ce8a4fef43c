"""Interfaces of external models: what is outside plugs in as a function over pandas batches; nothing here trains or loads a network."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.operators.windows import cut


def equivalence_probability(pairs: DataFrame, a: str, b: str, logits: Callable, temperature: float = 1.0) -> DataFrame:
    """Adds score = softmax(logits / T)[1]; logits(series a, series b) -> frame with columns 0 and 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        z = logits(x, y)
        return 1 / (1 + np.exp(-(z[1] - z[0]) / temperature))

    return pairs.withColumn("score", run(a, b))


def statement_score(rows: DataFrame, nl: str, statement: str, model: Callable) -> DataFrame:
    """Adds the raw score of (statement in words, formal statement)."""
    return rows.withColumn("score", F.pandas_udf(model, "double")(nl, statement))


def embed(rows: DataFrame, text_col: str, model: Callable) -> DataFrame:
    """Adds ``embedding``, scaled to unit length; model(series) -> series of lists."""
    raw = rows.withColumn("__e", F.pandas_udf(model, "array<double>")(text_col))
    norm = F.sqrt(F.aggregate("__e", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("__n", norm).withColumn("embedding", F.transform("__e", lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(x))).drop("__e", "__n")


def checked(cands: DataFrame, checker: Callable, cache: DataFrame | None = None) -> DataFrame:
    """Adds ``typechecks``: from the cache by key where known, else from checker(series of keys' texts) -> series of booleans."""
    keyed = cands.withColumn("__key", st.memo_key(F.coalesce(F.col("header"), F.lit("")) if "header" in cands.columns else F.lit(""), F.col("candidate")))
    run = F.pandas_udf(checker, "boolean")
    if cache is None:
        return keyed.withColumn("typechecks", run("candidate")).drop("__key")
    known = keyed.join(cache.select(F.col("key").alias("__key"), F.col("ok").alias("typechecks")), "__key")
    fresh = keyed.join(cache.select(F.col("key").alias("__key")), "__key", "left_anti").withColumn("typechecks", run("candidate"))
    return known.unionByName(fresh, allowMissingColumns=True).drop("__key")


def checked_once(cands: DataFrame, checker: Callable, store) -> DataFrame:
    """checked() with a stored cache (sources.jsonl.memo_store): candidates that it lacks are checked, each distinct text once, and stored;
    a second run checks none."""
    key = st.memo_key(F.coalesce(F.col("header"), F.lit("")) if "header" in cands.columns else F.lit(""), F.col("candidate"))
    rows = cut(cands.withColumn("key", key))
    misses = rows.join(store.lookup(rows).select("key"), "key", "left_anti").groupBy("key").agg(F.first("candidate").alias("candidate"))
    # the checker's answers are written before they are used, so that none is asked for twice
    fresh = cut(misses.select("key", F.pandas_udf(checker, "boolean")("candidate").alias("ok")))
    store.append_new(fresh)
    return rows.join(store.lookup(rows).withColumnRenamed("ok", "typechecks"), "key", "left").drop("key")


def typecheck_filter(cands: DataFrame, checker: Callable, cache: DataFrame | None = None, drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(survivors, failures): candidates that pass the checker, and the others; without drop_empty a problem without survivors keeps all."""
    rows = checked(cands, checker, cache)
    if drop_empty:
        return rows.filter("typechecks"), rows.filter("not typechecks")
    any_ok = rows.groupBy("problem_id").agg(F.bool_or("typechecks").alias("__any"))
    j = rows.join(any_ok, "problem_id")
    return j.filter("typechecks or not __any").drop("__any"), j.filter("not typechecks and __any").drop("__any")


def proof_outcomes(pairs: DataFrame, prover: Callable) -> DataFrame:
    """Adds ok: prover(a, b) and prover(b, a) both hold; prover(series, series) -> series of booleans."""
    run = F.pandas_udf(prover, "boolean")
    return pairs.withColumn("__ab", run("a", "b")).withColumn("__ba", run("b", "a")).withColumn("ok", F.col("__ab") & F.col("__ba")).drop("__ab", "__ba")


class _Samples:
    """A table function's handler: one prompt, as many rows as the model gives for it, at most n, without repeated texts."""

    def __init__(self, model: Callable):
        self.model = model

    def rows(self, problem_id, prompt: str, n: int, seed: int):
        seen = set()
        for i in range(n or 0):
            text = self.model(prompt, seed + i)
            if text is not None and text not in seen:
                seen.add(text)
                yield problem_id, i, text


def register_sampler(spark, name: str, model: Callable, id_type: str = "bigint"):
    """A table function name(problem_id, prompt, n, seed) -> (problem_id, candidate_index, candidate), for lateral joins from DataFrames and from SQL:

        SELECT s.* FROM problems p, LATERAL name(p.problem_id, p.prompt, 3, 7) s

    model(prompt, seed) -> text, or None for no sample; a text that repeats gives no row of its own.  Returns the function itself.
    """
    samples = _Samples(model)

    class Sampler:
        def eval(self, problem_id, prompt: str, n: int, seed: int):
            yield from samples.rows(problem_id, prompt, n, seed)

    fn = F.udtf(Sampler, returnType=f"problem_id {id_type}, candidate_index int, candidate string")
    spark.udtf.register(name, fn)
    return fn


def sample_candidates(problems: DataFrame, prompt: str, n: int, model: Callable, seed: int | Callable = 0) -> DataFrame:
    """(problem_id, candidate_index, candidate): n samples per prompt; model(series of prompts, series of seeds) -> series of texts.

    seed: a number that the problem's own seed is made from, or a function of the sample's index (Column -> Column)."""
    index = F.col("candidate_index")
    rows = problems.select("problem_id", F.col(prompt).alias("prompt"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("candidate_index")).withColumn("seed", seed(index) if callable(seed) else st.crc_seed(seed, F.col("problem_id")) + index)
    return rows.withColumn("candidate", F.pandas_udf(model, "string")("prompt", "seed")).select("problem_id", "candidate_index", "candidate")
