"""Connected components of an undirected graph as tables: alternating large-star and small-star steps.

Each step turns links towards smaller ids; it ends when every node hangs on the smallest id of its component.  Links stay tables
throughout: nothing but counts reaches the driver, and each round is written to the shared folder.  Of a node with many links the links
are dealt into parts by their counted number wherever they meet the node's row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_few_tasks, materialize, spread_join


def connected_components(links: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """(node, root) for every node that is not the smallest of its component."""
    edges = materialize(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct(), label)
    while True:
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        n_up = F.count_if(F.col("root") < F.col("node"))
        least = materialize(in_few_tasks(both, 2 * n).groupBy("node").agg(F.least("node", F.min("root")).alias("__q_m"), F.count(F.lit(1)).alias("__q_n"), n_up.alias("__q_up")), label)
        # done if no node has two parents and no parent has a parent
        if least.filter("__q_up > 1 or (__q_up = 1 and __q_n > 1)").isEmpty():
            discard(least)
            return edges
        met = spread_join(both, least.drop("__q_up"), ["node"], "__q_n", 2 * n)
        large = materialize(met.filter("root > node").select(F.col("root").alias("node"), F.col("__q_m").alias("root")).distinct(), label)
        n = large.count()
        down = in_few_tasks(large, n).groupBy("node").agg(F.min("root").alias("__q_m"), F.count(F.lit(1)).alias("__q_n"))
        turned = spread_join(large, down, ["node"], "__q_n", n).filter("root <> __q_m")
        small = turned.select(F.greatest("root", "__q_m").alias("node"), F.least("root", "__q_m").alias("root")).unionByName(down.select("node", F.col("__q_m").alias("root"))).distinct()
        after = materialize(small, label)
        discard(edges, large, least)
        edges = after
