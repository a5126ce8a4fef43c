"""Similarity graphs inside problems. Edges are (problem_id, i, j, score) with i < j, nodes (problem_id, candidate_index)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.operators.pairs import both_ways, knn_edges
from quorate.operators.windows import cut as _cut
from quorate.scratch import discard

KEY = ["problem_id", "i", "j"]


def threshold_edges(pairs: DataFrame, threshold: float, mutual_k: int = 0) -> DataFrame:
    """Pairs at or above the threshold; with mutual_k, only those that are among each other's mutual_k best of all pairs."""
    edges = pairs.filter(F.col("score") >= threshold)
    return edges if mutual_k <= 0 else edges.join(knn_edges(pairs, mutual_k, mutual=True).select(*KEY), KEY, "left_semi")


def triangles(edges: DataFrame) -> DataFrame:
    """(problem_id, centre, i, k, s_i, s_k) with i < k: pairs of edges that meet."""
    d = both_ways(edges)
    a = d.select("problem_id", F.col("node").alias("centre"), F.col("other").alias("i"), F.col("score").alias("s_i"))
    b = d.select("problem_id", F.col("node").alias("centre"), F.col("other").alias("k"), F.col("score").alias("s_k"))
    return a.join(b, ["problem_id", "centre"]).filter("i < k")


def prune_triangles(edges: DataFrame, pairs: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Where two edges meet and their far ends are dissimilar by margin, drop the weaker edge (of equals, the one to the smaller neighbour)."""
    if margin <= 0:
        return edges
    far = pairs.select("problem_id", "i", F.col("j").alias("k"), F.col("score").alias("s_ik"))
    bad = triangles(edges).join(far, ["problem_id", "i", "k"]).filter((F.col("s_ik") < threshold) & (F.least("s_i", "s_k") - F.col("s_ik") >= margin))
    weak = F.when(F.col("s_i") <= F.col("s_k"), F.col("i")).otherwise(F.col("k"))
    drop = bad.select("problem_id", F.least(weak, "centre").alias("i"), F.greatest(weak, "centre").alias("j")).distinct()
    return edges.join(drop, KEY, "left_anti")


def rescue_isolates(nodes: DataFrame, edges: DataFrame, eligible: DataFrame) -> DataFrame:
    """(problem_id, i, j, score) to add back: in index order, a node without edges takes its best eligible pair, which counts for later nodes."""
    listed = (nodes.select("problem_id", F.col("candidate_index").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("score"), F.lit("node").alias("kind"))
              .unionByName(edges.select(*KEY, "score").withColumn("kind", F.lit("edge"))).unionByName(eligible.select(*KEY, "score").withColumn("kind", F.lit("pair"))))

    def run(pdf):
        touched = set(pdf.loc[pdf.kind == "edge", "i"]) | set(pdf.loc[pdf.kind == "edge", "j"])
        p = pdf[pdf.kind == "pair"]
        a, b, score = p["i"].to_numpy(np.int64), p["j"].to_numpy(np.float64).astype(np.int64), p["score"].to_numpy(float)
        me, other, score = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])
        order = np.lexsort((other, -score, me))
        first = order[np.unique(me[order], return_index=True)[1]] if len(order) else order
        best = {int(me[k]): (-float(score[k]), int(other[k])) for k in first}
        rows = []
        for node in sorted(pdf.loc[pdf.kind == "node", "i"]):
            if node not in touched and node in best:
                s, other = best[node]
                touched |= {node, other}
                rows.append((pdf.problem_id.iloc[0], min(node, other), max(node, other), -s))
        import pandas as pd

        return pd.DataFrame(rows, columns=[*KEY, "score"])

    kind = dict(listed.dtypes)["problem_id"]
    return listed.groupBy("problem_id").applyInPandas(run, f"problem_id {kind}, i int, j int, score double")


#: Rows (nodes and edges) of a problem up to which its components are found inside one task.
LOCAL_ROWS = 200_000


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and edges (a, b) the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def components(nodes: DataFrame, edges: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(problem_id, candidate_index, component): component is its smallest index.

    Rows are counted by problem: problems of up to local_rows are solved in one task each, of which there may be many; larger ones by rounds of
    joins, in which labels spread along edges and through labels of labels.  Edges of nodes that are not listed do not count.
    """
    import pandas as pd

    kinds = dict(nodes.dtypes)
    rows = _cut(nodes.select("problem_id", F.col("candidate_index").alias("i"), F.col("candidate_index").alias("j")).distinct().unionByName(edges.select(*KEY)))
    large = _cut(rows.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > local_rows).select("problem_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64)
        ids = np.sort(i[i == j])
        i, j = i[i != j], j[i != j]
        known = np.isin(i, ids) & np.isin(j, ids)
        found = ids[_least_labels(len(ids), np.searchsorted(ids, i[known]), np.searchsorted(ids, j[known]))]
        return pd.DataFrame({"problem_id": pdf["problem_id"].iloc[:1].repeat(len(ids)).to_numpy(), "candidate_index": ids, "component": found})

    schema = f"problem_id {kinds['problem_id']}, candidate_index {kinds['candidate_index']}, component {kinds['candidate_index']}"
    if large.isEmpty():
        out = _cut(rows.groupBy("problem_id").applyInPandas(run, schema))
    else:
        small = rows.join(large, "problem_id", "left_anti").groupBy("problem_id").applyInPandas(run, schema)
        rest = rows.join(large, "problem_id", "left_semi")
        spread = _spread_labels(rest.filter("i = j").select("problem_id", F.col("i").alias("candidate_index")), rest.filter("i <> j"))
        out = _cut(small.unionByName(spread))
        discard(spread)
    discard(rows, large)
    return out


def _spread_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """components() by rounds of joins, each of which is a table."""
    node = ["problem_id", "candidate_index"]
    both = _cut(edges.select("problem_id", F.col("i").alias("candidate_index"), F.col("j").alias("other")).unionByName(edges.select("problem_id", F.col("j").alias("candidate_index"), F.col("i").alias("other"))).distinct())
    labels = _cut(nodes.select(*node, F.col("candidate_index").alias("component")))
    while True:
        of = labels.select("problem_id", F.col("candidate_index").alias("other"), F.col("component").alias("near"))
        low = both.join(of, ["problem_id", "other"]).groupBy(*node).agg(F.min("near").alias("near"))
        step = labels.join(low, node, "left").select(*node, "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        up = step.select("problem_id", F.col("candidate_index").alias("next"), F.col("next").alias("far"))
        after = _cut(step.join(up, ["problem_id", "next"]).select(*node, F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("moved")))
        discard(labels)
        labels = after.drop("moved")
        labels._quorate_path = after._quorate_path
        if after.filter("moved").isEmpty():
            discard(both)
            return labels


def cohesion(comps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(problem_id, component, indices, size, cohesion): mean score over all pairs inside, to twelve digits, as those beyond hang on the order of sums; 1 for a single node."""
    a = comps.select("problem_id", F.col("candidate_index").alias("i"), "component")
    b = comps.select("problem_id", F.col("candidate_index").alias("j"), F.col("component").alias("component_j"))
    inner = pairs.join(a, ["problem_id", "i"]).join(b, ["problem_id", "j"]).filter("component = component_j")
    mean = inner.groupBy("problem_id", "component").agg(F.round(F.avg("score"), 12).alias("cohesion"))
    members = comps.groupBy("problem_id", "component").agg(F.array_sort(F.collect_list("candidate_index")).alias("indices"))
    return members.join(mean, ["problem_id", "component"], "left").withColumn("size", F.size("indices")).withColumn("cohesion", F.coalesce("cohesion", F.lit(1.0)))


def rank_components(stats: DataFrame, by: str = "size_then_cohesion") -> DataFrame:
    """Adds rank, 1 for the best; the last key is the smallest member."""
    keys = {
        "size": [F.desc("size")],
        "cohesion": [F.desc(F.round("cohesion", 12)), F.desc("size")],
        "size_times_cohesion": [F.desc(F.round(F.col("size") * F.col("cohesion"), 12)), F.desc("size")],
        "size_then_cohesion": [F.desc("size"), F.desc(F.round("cohesion", 12))],
    }
    if by not in keys:
        raise ValueError(f"unknown component rank {by!r}")
    w = Window.partitionBy("problem_id").orderBy(*keys[by], F.element_at("indices", 1), F.col("indices").cast("string"))
    return stats.withColumn("rank", F.row_number().over(w))


def _needed(share: float, n: int) -> int:
    """The members, itself included, that a member must be adjacent to: share of n, rounded up but for rounding errors."""
    return int(share * n + 0.999999)


def _thin(inside: np.ndarray, link: np.ndarray, share: float) -> np.ndarray:
    """Drop the member with the least support (of equals the smallest index) while one has too little; supports are kept up as members go."""
    inside = inside.copy()
    size, support = int(inside.sum()), link[:, inside].sum(1)
    while share > 0 and size >= 2:
        least = np.where(inside, support, np.iinfo(np.int64).max)
        weakest = int(least.argmin())
        if least[weakest] >= _needed(share, size):
            break
        inside[weakest] = False
        size -= 1
        support = support - link[weakest]
    return inside


def _grown_sets(scores: np.ndarray, link: np.ndarray, share: float) -> list[np.ndarray]:
    """The distinct clusters, as masks, that grow from each node.

    Sums and supports of all nodes are kept up by one row for each member that joins.  Scores are summed as whole numbers of twelve digits (fewer if
    they are large), so that a sum does not hang on the order in which members joined: what a set grows to depends on the set alone,
    and a seed whose set was met before stops there.  Sets are known by 128 random bits of each member, combined.
    """
    n = len(scores)
    top = max(1.0, float(np.abs(scores).max(initial=0.0)) * n)
    whole = np.rint(scores * 10.0 ** min(12, 18 - int(np.ceil(np.log10(top))))).astype(np.int64)
    np.fill_diagonal(whole, 0)
    rng = np.random.default_rng(0)
    bits = [int.from_bytes(rng.bytes(16), "little") for _ in range(n)]
    met: set[int] = set()
    found: dict[bytes, np.ndarray] = {}
    for seed in range(n):
        inside, out = np.zeros(n, bool), np.ones(n, bool)
        inside[seed], out[seed] = True, False
        sums, support, size, name = whole[seed].copy(), link[seed].astype(np.int64), 1, bits[seed]
        while name not in met:
            met.add(name)
            able = out & (support >= _needed(share, size))
            if not able.any():
                cluster = _thin(inside, link, share)
                found.setdefault(np.packbits(cluster).tobytes(), cluster)
                break
            best = np.flatnonzero(able)
            best = best[sums[best] == sums[best].max()]
            k = int(best[support[best].argmax()])
            inside[k], out[k] = True, False
            sums += whole[k]
            support += link[k]
            size, name = size + 1, name ^ bits[k]
    return list(found.values())


def densify(clusters: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """(problem_id, indices): clusters thinned until each member is adjacent to enough of the others."""
    import pandas as pd

    inner = edges.select(*KEY).groupBy("problem_id").agg(F.collect_list(F.struct("i", "j")).alias("edges"))
    rows = clusters.select("problem_id", "indices").join(inner, "problem_id", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                at = {v: k for k, v in enumerate(sorted(r.indices))}
                link = np.eye(len(at), dtype=bool)
                ends = np.array([(at.get(e["i"], -1), at.get(e["j"], -1)) for e in r.edges], np.int64).reshape(-1, 2) if r.edges is not None else np.zeros((0, 2), np.int64)
                ends = ends[(ends >= 0).all(1)]
                link[ends[:, 0], ends[:, 1]] = link[ends[:, 1], ends[:, 0]] = True
                keep = _thin(np.ones(len(at), bool), link, share)
                out.append([int(v) for v, k in at.items() if keep[k]])
            yield pd.DataFrame({"problem_id": pdf["problem_id"], "indices": out})

    kind = dict(clusters.dtypes)["problem_id"]
    return rows.mapInPandas(run, f"problem_id {kind}, indices array<int>")


def support_clusters(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, share: float = 0.7) -> DataFrame:
    """(problem_id, indices, size, cohesion): clusters grown from each node by mean score while enough members are adjacent; they may overlap."""
    import pandas as pd

    listed = (nodes.select("problem_id", F.col("candidate_index").alias("i"), F.lit(-1).alias("j"), F.lit(0.0).alias("score"), F.lit(False).alias("linked"))
              .unionByName(pairs.join(edges.select(*KEY, F.lit(True).alias("linked")), KEY, "left").select(*KEY, "score", F.coalesce("linked", F.lit(False)).alias("linked"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf.j < 0, "i"].unique())
        n = len(ids)
        s, link = np.zeros((n, n)), np.eye(n, dtype=bool)
        p = pdf[pdf.j >= 0]
        a, b = np.searchsorted(ids, p["i"].to_numpy()), np.searchsorted(ids, p["j"].to_numpy())
        s[a, b] = s[b, a] = p["score"].to_numpy(float)
        link[a, b] = link[b, a] = p["linked"].to_numpy(bool)
        found: dict[tuple, float] = {}
        for inside in _grown_sets(s, link, share):
            block, m = s[np.ix_(inside, inside)], int(inside.sum())
            found[tuple(int(v) for v in ids[inside])] = float(block[np.triu_indices(m, 1)].mean()) if m > 1 else 1.0
        return pd.DataFrame({"problem_id": [pdf.problem_id.iloc[0]] * len(found), "indices": [list(k) for k in found], "size": [len(k) for k in found], "cohesion": list(found.values())})

    kind = dict(nodes.dtypes)["problem_id"]
    return listed.groupBy("problem_id").applyInPandas(run, f"problem_id {kind}, indices array<int>, size int, cohesion double")


def graph_counts(nodes: DataFrame, edges: DataFrame, comps: DataFrame, suffix: str) -> DataFrame:
    """(problem_id, edges_<s>, components_<s>, isolated_<s>)."""
    e = edges.groupBy("problem_id").agg(F.count(F.lit(1)).alias(f"edges_{suffix}"))
    c = comps.groupBy("problem_id").agg(F.countDistinct("component").alias(f"components_{suffix}"))
    touched = both_ways(edges).select("problem_id", F.col("node").alias("candidate_index")).distinct().withColumn("t", F.lit(1))
    i = nodes.join(touched, ["problem_id", "candidate_index"], "left").groupBy("problem_id").agg(F.count_if(F.col("t").isNull()).alias(f"isolated_{suffix}"))
    return c.join(i, "problem_id").join(e, "problem_id", "left").fillna(0, [f"edges_{suffix}"])


def ranked_components(nodes: DataFrame, pairs: DataFrame, threshold: float, *, rank: str = "size_then_cohesion", mutual_k: int = 0, margin: float = 0.0, keep_best: bool = True, mode: str = "components", support: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Ranked components (or support clusters) and graph statistics of each problem."""
    if mode not in ("components", "support"):
        raise ValueError(f"unknown cluster mode {mode!r}")
    first = threshold_edges(pairs, threshold, mutual_k)
    edges, added = prune_triangles(first, pairs, threshold, margin), None
    before = components(nodes, first)
    stats = graph_counts(nodes, first, before, "before")
    if margin > 0 and keep_best:
        added = _cut(rescue_isolates(nodes, edges, first))
        edges = edges.unionByName(added)
    after = components(nodes, edges) if margin > 0 else before
    stats = stats.join(graph_counts(nodes, edges, after, "after"), "problem_id")
    n_added = added.groupBy("problem_id").agg(F.count(F.lit(1)).alias("edges_readded")) if added is not None else nodes.select("problem_id").limit(0).withColumn("edges_readded", F.lit(0).cast("long"))
    stats = stats.join(n_added, "problem_id", "left").fillna(0, ["edges_readded"])
    found = cohesion(after, pairs).drop("component") if mode == "components" else support_clusters(nodes, edges, pairs, support)
    return rank_components(found, rank), stats
