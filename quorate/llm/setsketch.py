"""Near-duplicates by SetSketch registers (operator 8).

Each document's set of word shingles gets SetSketch registers: of each of m hash functions the smallest exponential value, kept as a
truncated power of a base near 1.  Registers of a union are the larger of the parts' registers, and equal registers tell of similar
sets.  Documents of equal sets are collapsed; those that share all registers of a band become candidates; the register
comparison's joint likelihood, given both set sizes, drops pairs that are far below the threshold; what is left is decided on full
sets.  In a group of candidates each is first compared with the group's root; those that are similar are settled.  Only the others are
compared with the whole group, in tasks of a block of them and a block of the group; a task gives back a spanning forest of links, never
all pairs.

With rows r in a band, pairs at the threshold t are missed with probability (1 - t^r)^bands: 1e-7 at 0.85 (34 bands of 6) and 1.3e-7 at
0.8 (40 bands of 5); the likelihood cut lies five standard deviations below the threshold.

Defined cases: texts without words, null or empty, have an empty set and are linked with nothing; a row with a null doc_id takes no part and
has a null component_id and kept true; rows of one doc_id, of equal texts or not, are one node (each row is returned); ties and equal sets go to the
smallest doc_id; an empty table gives an empty result; texts of any length are read
whole; other columns, whatever their names, take no part.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART, chunks, hot_limit, in_few_tasks, map_texts, materialize, spread_join
from .components import connected_components

BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    similar_pct: int = 85  # linked when 100 * intersection >= similar_pct * union
    bands: int = 34
    rows: int = 6
    #: Nodes, and shingles, of a group that one block holds, about.
    block_nodes: int = 1000
    block_shingles: int = 1_500_000

    @property
    def m(self) -> int:
        return self.bands * self.rows

    @property
    def cut(self) -> float:
        t = self.similar_pct / 100
        return t - 5 * (t * (1 - t) / self.m) ** 0.5


#: For five-word shingles and a similarity of 0.8.
FIVE_WORDS = Params(5, 80, 40, 5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, one text after another, and where each begins."""
    known = _WordHashes()
    words = [(t.encode("utf-8", "surrogatepass").lower().split() if t else []) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(first[-1]))
    n = len(h)
    whole = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k if len(whole) else 0):
        whole += h[i:n - k + 1 + i] * _K[i]
    whole = _mix(whole)
    parts = []
    for d, size in enumerate(sizes):
        a = first[d]
        if size >= k:
            s = np.sort(whole[a:a + size - k + 1])
            parts.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif size:
            parts.append(_mix((h[a:a + size] * _K[:size]).sum(keepdims=True) + np.uint64(size)))
        else:
            parts.append(np.zeros(0, np.uint64))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def registers(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """One row of m registers for each set; 0 where it is empty."""
    odd = _mix(np.arange(1, m + 1, dtype=np.uint64) * _K[0]) | np.uint64(1)
    own = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, m), np.uint16)
    if len(own):
        begins = first[own]
        low = np.empty((len(own), m))
        h = np.empty_like(values)
        for i in range(m):
            np.multiply(values, odd[i], out=h)
            low[:, i] = np.minimum.reduceat(h, begins)
        x = -np.log1p(-(low + 0.5) / 2.0**64) / RATE
        out[own] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 1, LIMIT)
    return out


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _slope(greater, less, equal, u, v, j):
    """Derivative by the similarity of the registers' joint log-likelihood; u and v are the sets' shares of the summed sizes."""
    dp = lambda x: (BASE - 1) / BASE / (1 - x * (BASE - 1) / BASE) / np.log(BASE)
    x, y = np.clip(u - v * j, 1e-12, 1), np.clip(v - u * j, 1e-12, 1)
    px, py = _p(x), _p(y)
    return -greater * v * dp(x) / px - less * u * dp(y) / py + equal * (v * dp(x) + u * dp(y)) / np.maximum(1 - px - py, 1e-12)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity that maximises the joint likelihood, for rows of registers and exact set sizes."""
    greater, less = (a > b).sum(-1), (a < b).sum(-1)
    equal = a.shape[-1] - greater - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        mid = (lo + hi) / 2
        up = _slope(greater, less, equal, u, v, mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def likely(a: np.ndarray, b: np.ndarray, n_a, n_b, cut: float) -> np.ndarray:
    """Whether estimate() is at least cut, without finding it: the likelihood is concave."""
    greater, less = (a > b).sum(-1), (a < b).sum(-1)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    able = np.minimum(u / v, v / u) >= cut
    return able & (_slope(greater, less, a.shape[-1] - greater - less, u, v, np.minimum(cut, np.minimum(u / v, v / u))) >= 0)


class Forest:
    """Union-find over 0..n-1; a root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        up = self.up
        for j in others:
            a, b = self.find(i), self.find(int(j))
            if a != b:
                up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above


def _settled_first(n: int, settled: np.ndarray) -> Forest:
    """A forest in which the settled rows, which are known to be linked, are one tree."""
    f = Forest(n)
    done = np.flatnonzero(settled)
    if len(done):
        f.up[done] = done[0]
    return f


def link_likely(regs: np.ndarray, sizes: np.ndarray, cut: float, settled: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Roots after comparing each asking row with the rows that are not yet in its tree, by estimated similarity."""
    f = _settled_first(len(regs), settled)
    for i in np.flatnonzero(ask):
        roots = f.roots()
        rest = np.flatnonzero(roots != roots[i])
        if len(rest):
            f.join(i, rest[likely(regs[i], regs[rest], sizes[i], sizes[rest], cut)])
    return f.roots()


def link_exact(values: np.ndarray, first: np.ndarray, similar_pct: int, settled: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Roots after comparing each asking row's full set with all others.

    An asking row that is already linked with the settled tree is passed over: any row that it might link is in that tree too, or asks
    somewhere itself and finds it there.
    """
    n = len(first) - 1
    f, sizes = _settled_first(n, settled), np.diff(first)
    if n < 2 or not ask.any():
        return f.roots()
    _, local = np.unique(values, return_inverse=True)
    flag = np.zeros(local.max() + 1 if len(local) else 1, np.int64)
    main = int(np.flatnonzero(settled)[0]) if settled.any() else -1
    for i in np.flatnonzero(ask):
        if main >= 0 and f.find(i) == f.find(main):
            continue
        own = local[first[i]:first[i + 1]]
        flag[own] = 1
        both = np.add.reduceat(flag[local], first[:-1])
        flag[own] = 0
        f.join(i, np.flatnonzero(100 * both >= similar_pct * (sizes + sizes[i] - both)))
    return f.roots()


def _sketches(docs: DataFrame, p: Params) -> DataFrame:
    def run(texts):
        values, first = shingle_sets(texts, p.shingle)
        regs = registers(values, first, p.m)
        sums = lambda x: (c := np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]))[first[1:]] - c[first[:-1]]
        with np.errstate(over="ignore"):
            f1, f2 = sums(_mix(values + _K[1])), sums(_mix(values ^ _K[2]))
        return {"n_shingles": np.diff(first), "__q_f1": f1.view(np.int64), "__q_f2": f2.view(np.int64), "__q_regs": [r.astype("<u2").tobytes() for r in regs]}

    return map_texts(docs, run, "n_shingles long, __q_f1 long, __q_f2 long, __q_regs binary")


def _starred(nodes: DataFrame, payload: str, alike, label: str) -> DataFrame:
    """Adds ``settled``: whether a node's payload is alike that of its group's root, which links it to the root. One row and one copy of
    the root's payload for each node; a large group's rows are dealt into parts, each with a copy of the root's payload."""
    heads = nodes.filter("node = root").groupBy("root").agg(F.min(F.struct(F.col(payload).alias("p"), F.col("n").alias("n"))).alias("h"), F.max("parts").alias("parts"))
    heads = heads.select("root", "h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = nodes.join(heads, ["root", "part"]).select("node", "root", "parts", "part", "n", payload, F.col("h.p").alias("__q_p"), F.col("h.n").alias("__q_n"))
    kind = dict(nodes.dtypes)[payload]

    def run(batches):
        for pdf in batches:
            own = (pdf["node"] == pdf["root"]).to_numpy()
            ok = own | alike(pdf[payload].tolist(), pdf["n"].to_numpy(), pdf["__q_p"].tolist(), pdf["__q_n"].to_numpy())
            yield pdf[["node", "root", "parts", "part", "n", payload]].assign(settled=ok)

    return materialize(joined.mapInPandas(run, f"node long, root long, parts int, part int, n long, {payload} {kind}, settled boolean"), label)


def _tasks(nodes: DataFrame, p: Params) -> DataFrame:
    """Deal starred nodes into tasks __q_task.

    A group without loose nodes needs none.  Small groups share tasks.  A group that is larger than a block is cut: its loose nodes into blocks, all its nodes into blocks, and each
    pair of a loose block and a block is a task.  Settled nodes are one tree already, so pairs among them need no task.
    """
    sizes = in_few_tasks(nodes.select("root", "n", "settled", "parts"), nodes.count()).groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.count_if(~F.col("settled")).alias("lc"), F.coalesce(F.sum(F.when(~F.col("settled"), F.col("n"))), F.lit(0)).alias("ls"), F.max("parts").alias("__q_k"))
    n_blocks = lambda c, s: F.greatest(F.ceil(F.col(c) / p.block_nodes), F.ceil(F.col(s) / p.block_shingles)).cast("int")
    need = sizes.filter("lc > 0").select("root", n_blocks("c", "s").alias("__q_b"), n_blocks("lc", "ls").alias("__q_l"), "c", "s", "__q_k")
    total = need.filter("__q_b <= 1").agg(F.sum("c"), F.sum("s")).first()
    shared = max(1, -(-(total[0] or 0) // 600), -(-(total[1] or 0) // 600_000))
    # a large group's nodes meet a copy of its row in each of their parts
    copies = need.select("root", "__q_b", "__q_l", F.explode(F.sequence(F.lit(0), F.col("__q_k") - 1)).alias("part"))
    cut = nodes.join(copies, ["root", "part"])
    small, big = F.col("__q_b") <= 1, F.col("__q_b") > 1
    task = lambda i, j: F.concat_ws(":", "root", i, j)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.pmod(F.xxhash64("node"), F.col("__q_b")).cast("int")
    loose = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.col("__q_l"), F.lit(1))).cast("int")
    # as one of all nodes beside each loose block; as a loose node beside each block
    beside = F.transform(upto(F.col("__q_l")), lambda i: F.struct(task(i, own).alias("task"), F.lit(False).alias("ask")))
    asking = F.when(F.col("settled"), F.array().cast("array<struct<task:string,ask:boolean>>")).otherwise(F.transform(upto(F.col("__q_b")), lambda j: F.struct(task(loose, j).alias("task"), F.lit(True).alias("ask"))))
    one = F.array(F.struct(F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(shared)).cast("string")).alias("task"), (~F.col("settled")).alias("ask")))
    cut = cut.withColumn("__q_t", F.explode(F.when(small, one).when(big, F.concat(beside, asking))))
    return cut.select(*[c for c in nodes.columns if c not in ("parts", "part")], F.col("__q_t.task").alias("__q_task"), F.col("__q_t.ask").alias("__q_ask"))


def _groups(pdf, link):
    """(a, b) links of a task: link(rows, settled, ask) -> roots, for each group in it. A loose row that is there and asks counts once."""
    import pandas as pd

    out = []
    twice = ~pdf["__q_ask"] & ~pdf["settled"] & pdf["node"].isin(pdf.loc[pdf["__q_ask"], "node"])
    pdf = pdf[~twice].sort_values(["root", "node"], kind="stable").reset_index(drop=True)
    root = pdf["root"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
    for a, b in zip(first, [*first[1:], len(pdf)]):
        part = pdf.iloc[a:b]
        ids = part["node"].to_numpy()
        out.append(pd.DataFrame({"a": ids, "b": ids[link(part, part["settled"].to_numpy(bool), part["__q_ask"].to_numpy(bool))]}))
    found = pd.concat(out)
    return found[found["a"] != found["b"]]


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Operator 8: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    sketched = materialize(_sketches(docs, p), "sketches")
    sets = ["n_shingles", "__q_f1", "__q_f2"]
    able = sketched.filter("n_shingles > 0 and doc_id is not null")
    # only sets that occur more than once need the join
    reps = materialize(able.groupBy(*sets).agg(F.min("doc_id").alias("__q_rep"), F.count(F.lit(1)).alias("__q_c")).filter("__q_c > 1"), "equal-sets")
    rep = F.coalesce("__q_rep", "doc_id")
    mapped = materialize(spread_join(able, reps, sets, "__q_c", able.count(), "left").select("doc_id", "n_shingles", rep.alias("rep"), F.when(F.col("doc_id") == rep, F.col("__q_regs")).alias("regs")), "sets")
    heads = mapped.filter("regs is not null").select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "regs")

    width = 2 * p.rows
    banded = heads.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))).alias("band", "key")).select("node", "key")
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("__q_top"), F.count(F.lit(1)).alias("__q_c")).filter("hub < __q_top")
    hubs = materialize(hubs.select("key", "hub", "__q_c"), "bands")
    candidates = connected_components(spread_join(banded, hubs, ["key"], "__q_c", hubs.agg(F.coalesce(F.sum("__q_c"), F.lit(0))).first()[0]), "node", "hub", "candidates")

    def members(edges: DataFrame) -> DataFrame:
        """(node, root, parts, part): all nodes of all groups, roots included; a hot group's nodes are dealt into parts by its size."""
        n = edges.count()
        # the scan's few large parts and the roots' many small ones become parts of a size
        every = in_few_tasks(edges.select("node", "root").unionByName(edges.select(F.col("root").alias("node"), "root").distinct()), 2 * n)
        # fewer than HOT_KEYS rows, by hot_limit()
        hot = in_few_tasks(edges, n).groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot_limit(n)).select(F.col("root").alias("__q_r"), F.ceil(F.col("c") / PART).cast("int").alias("__q_k"))
        parts = F.coalesce("__q_k", F.lit(1))
        return every.join(F.broadcast(hot), F.col("root") == F.col("__q_r"), "left").select("node", "root", parts.alias("parts"), F.pmod(F.xxhash64("node", F.lit(2)), parts).cast("int").alias("part"))

    rows_of = lambda blobs: np.frombuffer(b"".join(blobs), "<u2").reshape(len(blobs), p.m)

    def close_registers(own, n, heads_, m):
        return likely(rows_of(own), rows_of(heads_), n.astype(float), m.astype(float), p.cut) if len(own) else np.zeros(0, bool)

    def close_texts(own, n, heads_, m):
        out = np.zeros(len(own), bool)
        for a, b in chunks([(x or "") + (y or "") for x, y in zip(own, heads_)], 2_000_000):
            values, first = shingle_sets(own[a:b] + heads_[a:b], p.shingle)
            sets_ = [values[x:y] for x, y in zip(first, first[1:])]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets_[:b - a], sets_[b - a:])], np.int64)
            size = np.diff(first)
            out[a:b] = 100 * both >= p.similar_pct * (size[:b - a] + size[b - a:] - both)
        return out

    def stage(pool: DataFrame, payload: str, alike, link, label: str) -> DataFrame:
        """Links to roots by the stars, and those that the tasks find, as components."""
        starred = _starred(pool, payload, alike, f"{label}-stars")
        stars = starred.filter("settled and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = _tasks(starred, p).groupBy("__q_task").applyInPandas(lambda pdf: _groups(pdf, link), "a long, b long")
        return connected_components(stars.unionByName(found), "a", "b", label)

    def link_registers(part, settled, ask):
        return link_likely(rows_of(part["regs"].tolist()), part["n"].to_numpy().astype(float), p.cut, settled, ask)

    def link_texts(part, settled, ask):
        values, first = shingle_sets(part["text"].tolist(), p.shingle)
        return link_exact(values, first, p.similar_pct, settled, ask)

    pool = members(candidates).join(heads, "node").dropDuplicates(["node", "n", "regs"])
    refined = stage(pool, "regs", close_registers, link_registers, "likely")
    sized = members(refined).join(heads.select("node", "n"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    final = stage(texts.join(sized, "node").dropDuplicates(["node", "text"]), "text", close_texts, link_texts, "links")

    slim = mapped.select("doc_id", "n_shingles", "rep")
    counted = materialize(slim.groupBy("rep").agg(F.count(F.lit(1)).alias("__q_c")).join(final.select(F.col("node").alias("rep"), F.col("root").alias("__q_root")), "rep", "left").filter("__q_c > 1 or __q_root is not null"), "roots")
    joined = spread_join(slim, counted, ["rep"], "__q_c", slim.count(), "left")
    linked = joined.select("doc_id", "n_shingles", F.coalesce("__q_root", "rep").alias("component_id"))
    alone = sketched.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Documents that share a shingle, counted; DuckDB on the small tables only.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""
