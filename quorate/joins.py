"""Joins and aggregations that do not let one key's rows meet in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot, so that there are fewer hot keys than this, whatever the data: they can be broadcast.
HOT_KEYS = 10_000
#: Rows of a hot key that meet in one place, about.
PART = 64
#: Rows of a slim table that one task aggregates, about.
ROWS_A_TASK = 200_000


def in_few_tasks(df: DataFrame, n_rows: int) -> DataFrame:
    """The rows in as many tasks as they are worth, without a shuffle. A key that is in every task gives the aggregation one partial row for
    each, so that a table of many small files would send more rows of a hot key than of all others."""
    return df.coalesce(max(1, -(-n_rows // ROWS_A_TASK)))


def hot_limit(n_rows: int) -> int:
    """A key with more rows than this is hot."""
    return max(PART, n_rows // HOT_KEYS)


def parts_of(count: str, n_rows: int) -> Column:
    """Parts that the rows of a key are dealt into, by their counted number: 1 unless the key is hot."""
    return F.when(F.col(count) > hot_limit(n_rows), F.ceil(F.col(count) / PART)).otherwise(F.lit(1)).cast("int")


def hot_keys(counted: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """The hot keys of a table's n_rows rows, with their number of parts in __q_of; ``counted`` has a row for each key, or for each that may be
    hot, with the counted number of its rows in column ``count``."""
    return counted.select(*keys, parts_of(count, n_rows).alias("__q_of")).filter("__q_of > 1")


def dealt_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with ``one``, which has a row for each key that is looked for; ``hot``, made by hot_keys(), has all hot keys of rows, whether
    ``one`` has them or not.

    The rows of a hot key are dealt into its parts, and its row of ``one`` is copied to each, so that no key's rows meet in one task.
    There are fewer than HOT_KEYS hot keys, so that they can be broadcast.  ``rows`` should be a table that was written, as rows are dealt by
    their place in it.
    """
    named = F.broadcast(hot.select(*[F.col(k).alias(f"__q_hot{i}") for i, k in enumerate(keys)], "__q_of"))
    parts = lambda df: df.join(named, [F.col(k) == F.col(f"__q_hot{i}") for i, k in enumerate(keys)], "left").withColumn("__q_of", F.coalesce("__q_of", F.lit(1))).drop(*[f"__q_hot{i}" for i in range(len(keys))])
    dealt = parts(rows).withColumn("__q_part", F.pmod(F.monotonically_increasing_id(), F.col("__q_of")).cast("int")).drop("__q_of")
    copies = parts(one).withColumn("__q_part", F.explode(F.sequence(F.lit(0), F.col("__q_of") - 1))).drop("__q_of")
    return dealt.join(copies, [*keys, "__q_part"], how).drop("__q_part")


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], count: str, n_rows: int, how: str = "inner") -> DataFrame:
    """Join rows with ``one``, which has a row for each key that is looked for, and for each hot key, with the counted number of the key's rows in
    column ``count`` (dropped).  Where rows may have hot keys that ``one`` lacks, use dealt_join().

    The rows of a hot key are dealt into parts by its count, and its row of ``one`` is copied to each part, so that no key's rows meet in
    one task.  The table of hot keys that tells rows of their number of parts has fewer than HOT_KEYS rows.  ``rows`` should be a table
    that was written, as rows are dealt by their place in it.
    """
    parts = one.withColumn("__q_k", parts_of(count, n_rows))
    hot = parts.filter("__q_k > 1").select(*[F.col(k).alias(f"__q_hot{i}") for i, k in enumerate(keys)], F.col("__q_k").alias("__q_of"))
    same = [F.col(k) == F.col(f"__q_hot{i}") for i, k in enumerate(keys)]
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn("__q_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__q_of", F.lit(1))).cast("int"))
    dealt = dealt.drop("__q_of", *[f"__q_hot{i}" for i in range(len(keys))])
    copies = parts.withColumn("__q_part", F.explode(F.sequence(F.lit(0), F.col("__q_k") - 1))).drop("__q_k", count)
    return dealt.join(copies, [*keys, "__q_part"], how).drop("__q_part")
