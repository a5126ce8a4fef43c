"""The strategy grid: cluster selection by every configuration, over pairs that stay one row each.

A configuration's graph is a bit: a pair carries the set of graphs in which it is an edge, a node its label in each, and a node the set of
(graph, rank) slots whose best component has it.  Pairs are ranked, joined into triangles and met with labels once for all graphs; only what
belongs to components, problems and configurations has a row for each of them.  Reports by buckets are grouping sets of one aggregate.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.operators import graph
from quorate.operators import selection as se
from quorate.operators.pairs import both_ways
from quorate.operators.windows import cut
from quorate.scratch import discard

CONFIG = ["threshold", "tie_break", "cluster_rank", "mutual_k", "margin", "support"]
#: Graphs, or slots, that one pass holds as bits of a number.
BITS = 60
KEY = ["problem_id", "i", "j"]


def _cut(df: DataFrame) -> DataFrame:
    """As cut(), for joins by sorting. Spark judges a table by its files, in which labels and masks that repeat take a small part of what their rows
    do in memory, and would send rows of every node through the driver."""
    out = cut(df)
    sorted_by_keys = out.hint("merge")
    sorted_by_keys._quorate_path = out._quorate_path
    return sorted_by_keys


def _has(mask: str, bit: int) -> Column:
    return F.expr(f"({mask} & {1 << bit}L) <> 0")


def _mask(conditions: dict[int, Column]) -> Column:
    """The bits whose condition holds."""
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, c in conditions.items()], F.lit(0).cast("long"))


def graph_masks(pairs: DataFrame, graphs: list[tuple]) -> DataFrame:
    """(problem_id, i, j, score, mask): the pairs that are an edge of any graph (threshold, mutual_k, margin, support), after thinning of triangles and
    the rescue of isolated nodes where a graph has a margin."""
    ranked = pairs.select(*KEY, "score", F.lit(0).alias("worst"))
    if any(k > 0 for _, k, _, _ in graphs):
        w = Window.partitionBy("problem_id", "node").orderBy(F.desc("score"), "other")
        places = both_ways(pairs).withColumn("r", F.row_number().over(w))
        # a pair is mutual among k if it is among the k best of both its ends
        ranked = places.groupBy("problem_id", F.least("node", "other").alias("i"), F.greatest("node", "other").alias("j")).agg(F.max("score").alias("score"), F.max("r").alias("worst"))
    linked = {b: (F.col("score") >= t) & (F.lit(True) if k <= 0 else F.col("worst") <= k) for b, (t, k, _, _) in enumerate(graphs)}
    edges = _cut(ranked.select(*KEY, "score", _mask(linked).alias("mask")).filter("mask <> 0"))
    pruned = {b: g for b, g in enumerate(graphs) if g[2] > 0}
    if not pruned:
        return edges
    some = sum(1 << b for b in pruned)
    # a hint holds up to the next union
    ends = _both_masks(edges, some).hint("merge")
    a = ends.select("problem_id", F.col("node").alias("centre"), F.col("other").alias("i"), F.col("score").alias("s_i"), F.col("mask").alias("m_i"))
    b = ends.select("problem_id", F.col("node").alias("centre"), F.col("other").alias("k"), F.col("score").alias("s_k"), F.col("mask").alias("m_k"))
    met = a.join(b, ["problem_id", "centre"]).filter("i < k").withColumn("m", F.expr("m_i & m_k")).filter("m <> 0")
    far = pairs.select("problem_id", "i", F.col("j").alias("k"), F.col("score").alias("s_ik"))
    apart = _mask({bit: (F.col("s_ik") < t) & (F.least("s_i", "s_k") - F.col("s_ik") >= margin) for bit, (t, _, margin, _) in pruned.items()})
    weak = F.when(F.col("s_i") <= F.col("s_k"), F.col("i")).otherwise(F.col("k"))
    bad = met.join(far, ["problem_id", "i", "k"]).withColumn("gone", F.col("m").bitwiseAND(apart)).filter("gone <> 0")
    gone = bad.select("problem_id", F.least(weak, "centre").alias("a"), F.greatest(weak, "centre").alias("b"), "gone").groupBy("problem_id", F.col("a").alias("i"), F.col("b").alias("j")).agg(F.bit_or("gone").alias("gone"))
    thinned = _cut(edges.join(gone, KEY, "left").select(*KEY, "score", F.col("mask").alias("first"), F.expr("mask & ~coalesce(gone, 0L)").alias("mask")))
    bits = list(pruned)

    def rescue(pdf):
        """graph.rescue_isolates of each graph of a problem."""
        import pandas as pd

        i, j, s = (pdf[c].to_numpy() for c in ("i", "j", "score"))
        added = np.zeros(len(pdf), np.int64)
        for bit in bits:
            own, first = (pdf["mask"].to_numpy() >> bit) & 1 == 1, np.flatnonzero((pdf["first"].to_numpy() >> bit) & 1)
            touched = set(i[own]) | set(j[own])
            me, other, at = np.concatenate([i[first], j[first]]), np.concatenate([j[first], i[first]]), np.concatenate([first, first])
            order = np.lexsort((other, -s[at], me))
            best = order[np.unique(me[order], return_index=True)[1]] if len(order) else order
            for e in best:  # by node
                if me[e] not in touched:
                    touched |= {me[e], other[e]}
                    added[at[e]] |= 1 << bit
        return pd.DataFrame({"problem_id": pdf["problem_id"], "i": i, "j": j, "score": s, "mask": pdf["mask"].to_numpy() | added})

    kind, index = dict(edges.dtypes)["problem_id"], dict(edges.dtypes)["i"]
    return _cut(thinned.groupBy("problem_id").applyInPandas(rescue, f"problem_id {kind}, i {index}, j {index}, score double, mask long").filter("mask <> 0"))


def _both_masks(edges: DataFrame, some: int = -1) -> DataFrame:
    """(problem_id, node, other, score, mask) of edges in both directions, with the bits of ``some``."""
    e = edges.select(*KEY, "score", F.expr(f"mask & {some}L").alias("mask")).filter("mask <> 0")
    return e.select("problem_id", F.col("i").alias("node"), F.col("j").alias("other"), "score", "mask").unionByName(e.select("problem_id", F.col("j").alias("node"), F.col("i").alias("other"), "score", "mask"))


def labels(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(problem_id, candidate_index, labels): the smallest index of a node's component in each of n graphs. Each round takes the least label of a
    node's neighbours, graph by graph, and then the label of that label."""
    node = ["problem_id", "candidate_index"]
    both = _cut(_both_masks(edges).select("problem_id", F.col("node").alias("candidate_index"), "other", "mask"))
    state = _cut(nodes.select(*node, F.array_repeat("candidate_index", n).alias("labels")))
    while True:
        of = state.select("problem_id", F.col("candidate_index").alias("other"), F.col("labels").alias("near"))
        least = both.join(of, ["problem_id", "other"]).groupBy(*node).agg(*[F.min(F.when(_has("mask", g), F.get("near", F.lit(g)))).alias(f"g{g}") for g in range(n)])
        low = state.join(least, node, "left").select(*node, "labels", F.array(*[F.least(F.get("labels", F.lit(g)), F.coalesce(f"g{g}", F.get("labels", F.lit(g)))) for g in range(n)]).alias("low"))
        low = _cut(low)
        each = low.select(*node, F.posexplode("low").alias("g", "next"))
        far = low.select("problem_id", F.col("candidate_index").alias("next"), F.posexplode("low").alias("g", "far"))
        jumped = each.join(far, ["problem_id", "next", "g"]).groupBy(*node).agg(F.array_sort(F.collect_list(F.struct("g", F.least("next", "far").alias("x")))).alias("s")).select(*node, F.col("s.x").alias("after"))
        after = _cut(low.join(jumped, node).select(*node, F.col("after").alias("labels"), (F.col("after") != F.col("labels")).alias("moved")))
        discard(state, low)
        done = after.filter("moved").isEmpty()
        state = after.drop("moved")
        state._quorate_path = after._quorate_path
        if done:
            discard(both)
            return state


def mask_components(nodes: DataFrame, pairs: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(problem_id, graph, indices, size, cohesion) of the components of n graphs; a pair has a row for each graph only where both its ends share a
    component, behind the join and before the sum."""
    of = labels(nodes, edges, n)
    members = of.select("problem_id", "candidate_index", F.posexplode("labels").alias("graph", "component")).groupBy("problem_id", "graph", "component").agg(F.array_sort(F.collect_list("candidate_index")).alias("indices"))
    a = of.select("problem_id", F.col("candidate_index").alias("i"), F.col("labels").alias("la"))
    b = of.select("problem_id", F.col("candidate_index").alias("j"), F.col("labels").alias("lb"))
    same = F.filter(F.transform("la", lambda x, g: F.when(x == F.get("lb", g), F.struct(g.alias("graph"), x.alias("component")))), lambda x: x.isNotNull())
    inner = pairs.select(*KEY, F.col("score").cast("decimal(18,12)").alias("s")).join(a, ["problem_id", "i"]).join(b, ["problem_id", "j"]).select("problem_id", "s", F.explode(same).alias("x"))
    mean = inner.groupBy("problem_id", "x.graph", "x.component").agg(F.round(F.sum("s").cast("double") / F.count(F.lit(1)), 12).alias("cohesion"))
    return members.join(mean, ["problem_id", "graph", "component"], "left").select("problem_id", "graph", "indices", F.size("indices").alias("size"), F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"))


def mask_support_clusters(nodes: DataFrame, pairs: DataFrame, edges: DataFrame, shares: list[float]) -> DataFrame:
    """(problem_id, graph, indices, size, cohesion) of the support clusters of each graph, all graphs of a problem in one task."""
    import pandas as pd

    listed = (nodes.select("problem_id", F.col("candidate_index").alias("i"), F.lit(-1).alias("j"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("mask"))
              .unionByName(pairs.join(edges.select(*KEY, "mask"), KEY, "left").select(*KEY, "score", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf.j < 0, "i"].unique())
        p = pdf[pdf.j >= 0]
        a, b = np.searchsorted(ids, p["i"].to_numpy()), np.searchsorted(ids, p["j"].to_numpy())
        s = np.zeros((len(ids), len(ids)))
        s[a, b] = s[b, a] = p["score"].to_numpy(float)
        rows = []
        for g, share in enumerate(shares):
            link = np.eye(len(ids), dtype=bool)
            link[a, b] = link[b, a] = (p["mask"].to_numpy() >> g) & 1 == 1
            for inside in graph._grown_sets(s, link, share):
                m = int(inside.sum())
                rows.append((pdf.problem_id.iloc[0], g, [int(v) for v in ids[inside]], m, round(float(s[np.ix_(inside, inside)][np.triu_indices(m, 1)].mean()), 12) if m > 1 else 1.0))
        return pd.DataFrame(rows, columns=["problem_id", "graph", "indices", "size", "cohesion"])

    kind = dict(nodes.dtypes)["problem_id"]
    return listed.groupBy("problem_id").applyInPandas(run, f"problem_id {kind}, graph int, indices array<int>, size int, cohesion double")


def _chunks(items: list) -> Iterator[tuple[int, list]]:
    for a in range(0, len(items), BITS):
        yield a, items[a:a + BITS]


def clusters(nodes: DataFrame, pairs: DataFrame, graphs: list[tuple], mode: str) -> DataFrame:
    """(problem_id, graph, indices, size, cohesion) of every graph, numbered by its place in ``graphs``."""
    if mode not in ("components", "support"):
        raise ValueError(f"unknown cluster mode {mode!r}")
    parts = []
    for first, some in _chunks(graphs):
        edges = graph_masks(pairs, some)
        own = mask_components(nodes, pairs, edges, len(some)) if mode == "components" else mask_support_clusters(nodes, pairs, edges, [g[3] for g in some])
        parts.append(own.withColumn("graph", F.col("graph") + first))
    return reduce(DataFrame.unionByName, parts)


def _slot_rows(top: DataFrame, nodes: DataFrame, pairs: DataFrame, digits: int) -> DataFrame:
    """(problem_id, slot, candidate_index, length, penalty, centrality) of the members of each slot's component. top: (problem_id, slot, indices)."""
    slots = sorted(r[0] for r in top.select("slot").distinct().collect())  # as many as there are graphs times ranks
    parts = []
    for _, some in _chunks(slots):
        at = {slot: bit for bit, slot in enumerate(some)}
        bit = reduce(lambda c, s: c.when(F.col("slot") == s, F.lit(1 << at[s]).cast("long")), some, F.when(F.lit(False), F.lit(0).cast("long")))
        member = _cut(top.filter(F.col("slot").isin(some)).select("problem_id", F.explode("indices").alias("candidate_index"), bit.alias("b")).groupBy("problem_id", "candidate_index").agg(F.bit_or("b").alias("mask")))
        a = member.select("problem_id", F.col("candidate_index").alias("i"), F.col("mask").alias("ma"))
        b = member.select("problem_id", F.col("candidate_index").alias("j"), F.col("mask").alias("mb"))
        shared = pairs.join(a, ["problem_id", "i"]).join(b, ["problem_id", "j"]).select(*KEY, "score", F.expr("ma & mb").alias("mask")).filter("mask <> 0")
        sums = _both_masks(shared).withColumn("s", F.col("score").cast("decimal(18,12)")).groupBy("problem_id", F.col("node").alias("candidate_index"))
        sums = sums.agg(*[F.round(F.sum(F.when(_has("mask", k), F.col("s"))).cast("double") / F.count_if(_has("mask", k)), 12).alias(f"c{k}") for k in range(len(some))])
        each = F.filter(F.array(*[F.when(_has("mask", k), F.struct(F.lit(s).alias("slot"), F.round(F.coalesce(f"c{k}", F.lit(1.0)), digits).alias("centrality"))) for s, k in at.items()]), lambda x: x.isNotNull())
        parts.append(member.join(sums, ["problem_id", "candidate_index"], "left").select("problem_id", "candidate_index", F.explode(each).alias("x")).select("problem_id", "candidate_index", "x.*"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.join(nodes.select("problem_id", "candidate_index", "length", *[c for c in ("penalty",) if c in nodes.columns]), ["problem_id", "candidate_index"])


def choices(nodes: DataFrame, pairs: DataFrame, configs: list[tuple], baselines: dict[str, DataFrame], *, mode: str = "components", ensemble: str | None = None, vote: str = "weighted", simple_k: int = 0, max_drop: float = -1.0, digits: int = 12) -> DataFrame:
    """(problem_id, strategy, config, chosen_index, size, cohesion, centrality): what every configuration (the columns of CONFIG), baseline and the
    ensemble choose.

    nodes: (problem_id, candidate_index, length, label, and penalty for simple_k).  With simple_k, a medoid is the simplest of the simple_k most central
    that lose at most max_drop.  ensemble: the vote of all configurations with that tie break.
    """
    nodes, pairs = _cut(nodes), _cut(pairs)
    picks = None
    if configs:
        graphs = list(dict.fromkeys((c[0], c[3], c[4], c[5] if mode == "support" else None) for c in configs))
        graph_of = lambda c: graphs.index((c[0], c[3], c[4], c[5] if mode == "support" else None))
        found = _cut(clusters(nodes, pairs, graphs, mode).withColumn("cohesion", F.round("cohesion", digits)))
        ranks = list(dict.fromkeys(c[2] for c in configs))
        slot_of = lambda c: graph_of(c) * len(ranks) + ranks.index(c[2])
        by_graph = found.withColumn("problem_id", F.struct("graph", F.col("problem_id").alias("id")))
        top = reduce(DataFrame.unionByName, [graph.rank_components(by_graph, r).filter("rank = 1").select(F.col("problem_id.id").alias("problem_id"), (F.col("graph") * len(ranks) + n).alias("slot"), "indices", "size", "cohesion") for n, r in enumerate(ranks)])
        top = _cut(top)
        rows = _cut(_slot_rows(top, nodes, pairs, digits))
        own = rows.withColumn("problem_id", F.struct("slot", F.col("problem_id").alias("id")))
        index = F.col("candidate_index")
        by_tie = {
            "first": lambda: own.groupBy("problem_id").agg(F.min(index).alias("chosen_index")).withColumn("centrality", F.lit(None).cast("double")),
            "shortest": lambda: own.groupBy("problem_id").agg(F.min_by(index, F.struct("length", index)).alias("chosen_index")).withColumn("centrality", F.lit(None).cast("double")),
            "medoid": lambda: se.medoid(own, "length", simple_k=simple_k, max_drop=max_drop, penalty_col="penalty" if simple_k else None).drop("gap"),
        }
        for tie in dict.fromkeys(c[1] for c in configs):
            if tie not in by_tie:
                raise ValueError(f"unknown tie break {tie!r}")
            # the configurations are a short list
            numbers = nodes.sparkSession.createDataFrame([(slot_of(c), n) for n, c in enumerate(configs) if c[1] == tie], "slot int, config int")
            mine = by_tie[tie]().select(F.col("problem_id.id").alias("problem_id"), F.col("problem_id.slot").alias("slot"), "chosen_index", "centrality").join(F.broadcast(numbers), "slot")
            picks = mine if picks is None else picks.unionByName(mine)
        picks = _cut(picks.join(top.select("problem_id", "slot", "size", "cohesion"), ["problem_id", "slot"]).select("problem_id", F.lit("selection").alias("strategy"), "config", "chosen_index", "size", "cohesion", "centrality"))
    others = dict(baselines)
    if ensemble is not None:
        own = picks.filter(F.col("config").isin([n for n, c in enumerate(configs) if c[1] == ensemble])).withColumn("member", F.col("config"))
        voted = se.vote(own, nodes, vote).select("problem_id", "chosen_index")
        # the vote carries the numbers of its strongest member that agrees
        strength = F.struct(F.round(F.greatest(F.lit(1), F.col("size")) * F.coalesce("cohesion", F.lit(1.0)) * F.coalesce("centrality", F.lit(1.0)), digits), -F.col("config"))
        others["ensemble"] = own.join(voted, ["problem_id", "chosen_index"]).groupBy("problem_id", "chosen_index").agg(F.max_by(F.struct("size", "cohesion", "centrality"), strength).alias("b")).select("problem_id", "chosen_index", "b.*")
    rest = {"size": "1", "cohesion": "cast(null as double)", "centrality": "cast(null as double)"}
    rows = [d.select("problem_id", F.lit(name).alias("strategy"), F.lit(None).cast("int").alias("config"), "chosen_index", *[F.col(c) if c in d.columns else F.expr(e).alias(c) for c, e in rest.items()]) for name, d in others.items()]
    return reduce(DataFrame.unionByName, ([picks] if picks is not None else []) + rows)


def bucket(value: Column, bounds: list[float]) -> Column:
    """The number of the first bound that is not below the value, or of bounds; null for a null value."""
    out = F.lit(len(bounds))
    for n, x in reversed(list(enumerate(bounds))):
        out = F.when(value <= x, n).otherwise(out)
    return F.when(value.isNotNull(), out)


#: What totals() gives: the columns that a set leaves out are null.
REPORTS = ("length", "candidates", "component")


def totals(chosen: DataFrame, nodes: DataFrame, problems: DataFrame | None = None, bounds: dict[str, list[float]] | None = None) -> DataFrame:
    """(report, bucket, strategy, config, problems, n_correct, n_any, accuracy, accuracy_given_any, avg_size, avg_cohesion, avg_centrality) of
    choices: over all problems (report "all", bucket null) and by buckets of each report that has bounds, by one aggregate over grouping sets.

    Reports: length, of problems' (problem_id, length), null lengths left out; candidates, their number; component, the chosen one's size."""
    bounds, nodes = bounds or {}, nodes.hint("merge")
    if set(bounds) - set(REPORTS):
        raise ValueError(f"unknown reports {sorted(set(bounds) - set(REPORTS))}")
    per = nodes.groupBy("problem_id").agg(F.max("label").alias("any_correct"), F.count(F.lit(1)).alias("candidates"))
    if problems is not None:
        per = per.join(problems.select("problem_id", "length"), "problem_id", "left")
    j = chosen.join(nodes.select("problem_id", F.col("candidate_index").alias("chosen_index"), "label"), ["problem_id", "chosen_index"]).join(per, "problem_id")
    values = {"length": "length", "candidates": "candidates", "component": "size"}
    named = [r for r in REPORTS if r in bounds]
    j = j.select("strategy", "config", "label", "any_correct", "size", "cohesion", "centrality", *[bucket(F.col(values[r]), bounds[r]).alias(r) for r in named])
    # sums of decimals do not hang on the order of rows
    mean = lambda c: F.round(F.sum(c.cast("decimal(18,12)")).cast("double") / F.count(c), 12)
    sums = [F.count(F.lit(1)).alias("problems"), F.sum("label").cast("long").alias("n_correct"), F.sum("any_correct").cast("long").alias("n_any"), F.avg("size").alias("avg_size"), mean(F.col("cohesion")).alias("avg_cohesion"), mean(F.coalesce("centrality", F.lit(0.0))).alias("avg_centrality")]
    own = ["strategy", "config"]
    g = j.groupingSets([own, *[[*own, r] for r in named]], *own, *named).agg(F.grouping_id().alias("__id"), *sums)
    # of the bits behind strategy and config the one that is 0 names the report
    report = reduce(lambda c, x: c.when(F.expr(f"(__id & {1 << (len(named) - 1 - x[0])}) = 0"), x[1]), enumerate(named), F.when(F.lit(False), ""))
    which = report.otherwise("all") if named else F.lit("all")
    out = g.withColumn("report", which).withColumn("bucket", F.coalesce(*[F.col(r) for r in named]) if named else F.lit(None).cast("int"))
    if named:
        out = out.filter("report = 'all' or bucket is not null")
    return out.select("report", "bucket", *own, "problems", "n_correct", "n_any", st.rate(F.col("n_correct"), F.col("problems")).alias("accuracy"), st.rate(F.col("n_correct"), F.col("n_any")).alias("accuracy_given_any"), "avg_size", "avg_cohesion", "avg_centrality")


def selection_grid(nodes: DataFrame, pairs: DataFrame, configs: list[tuple], baselines: dict[str, DataFrame], **options) -> DataFrame:
    """The strategy grid, one row for each configuration, baseline and the ensemble; options are those of choices()."""
    nodes = _cut(nodes)
    g = totals(choices(nodes, pairs, configs, baselines, **options), nodes).drop("report", "bucket")
    named = nodes.sparkSession.createDataFrame([(n, float(c[0]), c[1], c[2], int(c[3]), float(c[4]), float(c[5])) for n, c in enumerate(configs)], "config int, threshold double, tie_break string, cluster_rank string, mutual_k int, margin double, support double")
    return g.join(F.broadcast(named), "config", "left").select("strategy", "config", *CONFIG, *[c for c in g.columns if c not in ("strategy", "config")])


def top_selections(g: DataFrame, n: int, by: str = "accuracy_given_any") -> DataFrame:
    """A report: the n best configurations of a selection grid, by key, accuracy, then the configuration itself."""
    return g.filter("strategy = 'selection'").orderBy(F.desc(F.round(by, 12)), F.desc(F.round("accuracy", 12)), *CONFIG).limit(n)
