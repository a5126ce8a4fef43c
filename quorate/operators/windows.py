"""Windows: per problem, and ordered prefixes over a whole table without a single-partition window."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate import scratch

#: Rows of a range of a globally ordered table, about; a table with no more is one range.
RANGE_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the folder that the cluster names."""
    return scratch.table(df, "cut")


def per_problem(*order: Column | str):
    return Window.partitionBy("problem_id").orderBy(*order)


def global_prefix(df: DataFrame, key: str, tie: str, sums: dict[str, str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``k`` (1-based place by key descending, nulls last, tie ascending), ``n`` (rows) and the running sum of each column of ``sums`` {name: column}.

    The table is written once; its size decides the number of ranges.  Ranges are of (key, tie), so that rows of one key are spread as well
    if their ties differ; a range's rows are numbered by a window of its own, and offsets come from one row per range.
    """
    df = cut(df)
    n = df.count()
    order = [F.col(key).desc_nulls_last(), F.col(tie).asc()]
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    places = lambda d: d.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order))).withColumns({f"__{name}": F.sum(col).over(own) for name, col in sums.items()})
    if n <= range_rows:
        out = places(df.withColumn("__range", F.lit(0)))
        return out.select(*df.columns, F.col("__k").cast("long").alias("k"), F.lit(n).cast("long").alias("n"), *[F.col(f"__{name}").alias(name) for name in sums])
    # written, as a row's range is its task's number
    ranged = cut(df.repartitionByRange(-(-n // range_rows), *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__c"), *[F.sum(c).alias(f"__t_{name}") for name, c in sums.items()])
    # one row for each range
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"), *[F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__t0_{name}") for name in sums])
    out = places(ranged).join(F.broadcast(totals), "__range")
    return out.select(*df.columns, (F.col("__k") + F.col("__c0")).cast("long").alias("k"), F.lit(n).cast("long").alias("n"), *[(F.col(f"__{name}") + F.col(f"__t0_{name}")).alias(name) for name in sums])


def first_in_order(df: DataFrame, key: str, tie: str, upto: list[Column], bits: int = 16) -> DataFrame:
    """Adds ``part``: how many of the places ``upto`` (Columns of n, ascending) a row lies behind, by key ascending, then tie.

    key is a long of 60 random bits.  Rows are counted by the key's leading bits, at most 2^bits counts; only rows of the buckets in which a place lies
    are put in order.
    """
    slot = F.shiftright(key, 60 - bits)
    # the counts are bounded by 2^bits
    counts = df.groupBy(slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy(F.lit(0)).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__c0", F.coalesce(F.sum("__c").over(run), F.lit(0))).withColumn("n", F.sum("__c").over(Window.partitionBy(F.lit(0))))
    inside = F.lit(False)
    for u in upto:
        inside = inside | ((F.col("__c0") < u) & (u < F.col("__c0") + F.col("__c")))
    counts = counts.withColumn("__cutting", inside)
    rows = df.withColumn("__slot", slot).join(F.broadcast(counts), "__slot")
    place = F.col("__c0") + F.row_number().over(Window.partitionBy("__slot").orderBy(key, tie))
    behind = lambda at: sum(((at > u).cast("int") for u in upto[1:]), (at > upto[0]).cast("int"))
    whole = rows.filter(~F.col("__cutting")).withColumn("part", behind(F.col("__c0") + 1))
    part = rows.filter("__cutting").withColumn("__place", place).withColumn("part", behind(F.col("__place"))).drop("__place")
    return whole.unionByName(part).drop("__slot", "__c", "__c0", "__cutting")
