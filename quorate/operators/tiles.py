"""Pairs inside problems as tiles, so that a large problem is no task of its own.

Candidates of a problem are dealt by a hash of their index into blocks of about BLOCK; a tile is a pair of blocks, and each candidate is copied to the
tiles of its block.  Tiles are dealt into tasks by the number of pairs, which is known from the counted sizes, and scored there as
matrices.  Problems of one block, the usual case, are tiles of their own, and a task scores many of them at once.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.joins import spread_join
from quorate.operators.windows import cut

#: Candidates in a block, and pairs or candidates that a task takes, about.
BLOCK, PAIRS_A_TASK, ROWS_A_TASK = 512, 1_500_000, 2_000
#: A feature that more rows of a tile share is counted by a matrix product, in slices of so many features.
SHARED, SLICE = 24, 2048


class Tiled:
    """Candidates in blocks: ``rows`` has __block and __blocks beside the columns asked for; ``tasks`` is what their pairs are worth."""

    def __init__(self, cands: DataFrame, cols: list[Column | str], block: int = BLOCK):
        rows = cands.select("problem_id", "candidate_index", *cols)
        sizes = rows.groupBy("problem_id").agg(F.count(F.lit(1)).alias("__n"))
        n = F.col("__n").cast("double")
        total, most, pairs = sizes.agg(F.sum("__n"), F.max("__n"), F.sum(n * (n - 1) / 2)).first()
        self.block, self.single = block, (most or 0) <= block
        least = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.tasks = max(1, -(-int(pairs or 0) // PAIRS_A_TASK), min(least, -(-(total or 0) // ROWS_A_TASK)))
        if self.single:
            self.rows = rows.withColumns({"__block": F.lit(0), "__blocks": F.lit(1)})
        else:
            sized = spread_join(cut(rows), sizes.withColumn("__own", F.col("__n")), ["problem_id"], "__n", total)
            blocks = F.ceil(F.col("__own") / block).cast("int")
            self.rows = sized.withColumn("__blocks", blocks).withColumn("__block", F.pmod(F.xxhash64("candidate_index"), F.col("__blocks")).cast("int")).drop("__own")

    def sides(self) -> tuple[DataFrame, DataFrame]:
        """Candidates as the first and as the second block of each of their tiles (__a, __b), dealt alike."""
        other = lambda low, high: F.explode(F.sequence(low, high))
        b, last = F.col("__block"), F.col("__blocks") - 1
        first = self.rows.withColumn("__b", other(b, last)).withColumnRenamed("__block", "__a").drop("__blocks")
        second = self.rows.withColumn("__a", other(F.lit(0), b)).withColumnRenamed("__block", "__b").drop("__blocks")
        deal = lambda df: df.repartition(self.tasks, "problem_id", "__a", "__b")
        return deal(first), deal(second)

    def apply(self, kernel: Callable[["Tiles"], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
        """kernel's rows, (problem_id, *fields), over tiles that tasks hold together."""
        schema = T.StructType([self.rows.schema["problem_id"], *T._parse_datatype_string(fields).fields])
        b, last = F.col("__block"), F.col("__blocks") - 1
        copies = self.rows.withColumn("__x", F.explode(F.sequence(F.lit(0), last)))
        tiles = copies.select("*", F.least(b, "__x").alias("__a"), F.greatest(b, "__x").alias("__b"), (b > F.col("__x")).alias("__second")).drop("__x", "__block", "__blocks")
        dealt = tiles.withColumn("__task", F.pmod(F.xxhash64("problem_id", "__a", "__b"), F.lit(8 * self.tasks)).cast("int")).repartition(self.tasks, "__task")
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def run(table):
            parts = [p for p in kernel(Tiles(table))]
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(p, kinds)], schema=kinds) for p in parts], schema=kinds)

        return dealt.groupBy("__task").applyInArrow(run, schema)


class Tiles:
    """The tiles that a task holds, sorted: rows of one tile stand together, its first block's before its second's, by index."""

    def __init__(self, table: pa.Table):
        named = table.combine_chunks().select(["problem_id", "__a", "__b"]).to_pandas()
        code = named.groupby(["problem_id", "__a", "__b"], sort=False, dropna=False).ngroup().to_numpy()
        index, second = table["candidate_index"].to_numpy(), table["__second"].to_numpy()
        order = np.lexsort((index, second, code))
        self.table = table.combine_chunks().take(pa.array(order))
        self.index, self.tile = index[order].astype(np.int64), code[order]
        second = second[order]
        self.n_tiles = int(self.tile.max(initial=-1)) + 1
        rows = np.bincount(self.tile, minlength=self.n_tiles)
        n_second = np.bincount(self.tile, second, minlength=self.n_tiles).astype(np.int64)
        self.start = np.cumsum(rows) - rows
        a, b = named["__a"].to_numpy()[order], named["__b"].to_numpy()[order]
        self.same = (a == b)[self.start] if self.n_tiles else np.zeros(0, bool)
        self.n_first = rows - n_second
        self.n_other = np.where(self.same, rows, n_second)
        self.other = np.where(self.same, self.start, self.start + self.n_first)

    def column(self, name: str) -> pa.Array:
        c = self.table[name]
        return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)

    def lists(self, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
        """A column of lists as one array, with each row's number of items."""
        c = self.column(name)
        n = np.where(c.is_null().to_numpy(zero_copy_only=False), 0, np.diff(c.offsets.to_numpy()))
        return c.flatten().to_numpy(zero_copy_only=False).astype(kind), n

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, at) of all pairs of all tiles: rows with index x < index y, and their place in the tiles' matrices laid end to end."""
        begin = self.begin()
        xs, ys, ats = [], [], []
        for t in range(self.n_tiles):
            n, m = int(self.n_first[t]), int(self.n_other[t])
            i, j = np.triu_indices(n, 1) if self.same[t] else (k.ravel() for k in np.indices((n, m)))
            ats.append(begin[t] + i * m + j)
            xs.append(self.start[t] + i)
            ys.append(self.other[t] + j)
        x, y, at = (np.concatenate([*k, np.zeros(0, np.int64)]).astype(np.int64) for k in (xs, ys, ats))
        turn = self.index[x] > self.index[y]
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        some = self.index[x] != self.index[y]
        return x[some], y[some], at[some]

    def begin(self) -> np.ndarray:
        size = self.n_first * self.n_other
        return np.cumsum(size) - size

    def ids(self, rows: np.ndarray) -> pa.Array:
        return self.column("problem_id").take(pa.array(rows))


def pair_frame(cands: DataFrame, *cols: str, block: int = BLOCK) -> DataFrame:
    """All pairs i < j of each problem; each of cols as <col>_i and <col>_j."""
    t = Tiled(cands, list(cols), block)
    if t.single:
        a = t.rows.select("problem_id", F.col("candidate_index").alias("i"), *[F.col(c).alias(f"{c}_i") for c in cols])
        b = t.rows.select("problem_id", F.col("candidate_index").alias("j"), *[F.col(c).alias(f"{c}_j") for c in cols])
        return a.join(b, "problem_id").filter("i < j")
    first, second = t.sides()
    pack = lambda df, name: df.select("problem_id", "__a", "__b", F.struct("candidate_index", *cols).alias(name))
    met = pack(first, "x").join(pack(second, "y").hint("shuffle_hash"), ["problem_id", "__a", "__b"])
    up = F.col("x.candidate_index") < F.col("y.candidate_index")
    # in the tile of a block with itself each pair is met both ways, in others once, whichever index is smaller
    met = met.filter(up | ((F.col("__a") < F.col("__b")) & (F.col("x.candidate_index") > F.col("y.candidate_index"))))
    ends = met.select("problem_id", F.when(up, F.col("x")).otherwise(F.col("y")).alias("lo"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("hi"))
    return ends.select("problem_id", F.col("lo.candidate_index").alias("i"), *[F.col(f"lo.{c}").alias(f"{c}_i") for c in cols], F.col("hi.candidate_index").alias("j"), *[F.col(f"hi.{c}").alias(f"{c}_j") for c in cols])


def _unit_vectors(tiles: Tiles) -> np.ndarray:
    """Rows of length one; vectors that are null, hold nulls or are zero become zero, so that they score 0."""
    flat, n = tiles.lists("v", float)
    width = int(n.max(initial=0))
    out = np.zeros((len(n), width))
    if not ((n == width) | (n == 0)).all():
        raise ValueError("vectors of one problem must have the same length")
    out[n == width] = flat.reshape(-1, width) if width else 0.0
    norm = np.sqrt((out * out).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return np.where(ok[:, None], out, 0.0) / np.where(ok, norm, 1.0)[:, None]


def _similarities(tiles: Tiles) -> Iterator[tuple[int, np.ndarray]]:
    v = _unit_vectors(tiles)
    for t in range(tiles.n_tiles):
        yield t, v[tiles.start[t]:tiles.start[t] + tiles.n_first[t]] @ v[tiles.other[t]:tiles.other[t] + tiles.n_other[t]].T


def _cosines(tiles: Tiles):
    x, y, at = tiles.pairs()
    flat = np.concatenate([*(s.ravel() for _, s in _similarities(tiles)), np.zeros(0)])
    yield [tiles.ids(x), pa.array(tiles.index[x]), pa.array(tiles.index[y]), pa.array(flat[at])]


def cosine_pairs(cands: DataFrame, vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(problem_id, i, j, score): cosine of all pairs, a matrix product for each tile."""
    kind = dict(cands.dtypes)["candidate_index"]
    return Tiled(cands, [F.col(vec_col).alias("v")], block).apply(_cosines, f"i {kind}, j {kind}, score double")


def nearest(cands: DataFrame, k: int, vec_col: str = "embedding", digits: int = 9, block: int = BLOCK) -> DataFrame:
    """(problem_id, node, other, score, r): of each candidate the k most similar others, ties to the smaller index; scores are rounded to ``digits``
    first, as sums in another order differ beyond them.

    A tile keeps k for each of its rows, and what tiles keep is merged by a limit that works before the shuffle and behind it, so that what
    is written grows with candidates times k, not with pairs.
    """
    def kernel(tiles: Tiles):
        for t, s in _similarities(tiles):
            s = np.round(s, digits)
            a, b = np.arange(tiles.start[t], tiles.start[t] + tiles.n_first[t]), np.arange(tiles.other[t], tiles.other[t] + tiles.n_other[t])
            for rows, others, m in ((a, b, s),) if tiles.same[t] else ((a, b, s), (b, a, s.T)):
                # others stand by index, so that a stable order breaks ties by it
                m = np.where(tiles.index[rows][:, None] == tiles.index[others][None, :], -np.inf, m)
                best = np.argsort(-m, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(m, best, 1)
                i, j = np.nonzero(score > -np.inf)
                yield [tiles.ids(rows[i]), pa.array(tiles.index[rows[i]]), pa.array(tiles.index[others[best[i, j]]]), pa.array(score[i, j])]

    from pyspark.sql import Window

    kind = dict(cands.dtypes)["candidate_index"]
    kept = Tiled(cands, [F.col(vec_col).alias("v")], block).apply(kernel, f"node {kind}, other {kind}, score double")
    place = F.row_number().over(Window.partitionBy("problem_id", "node").orderBy(F.desc("score"), "other"))
    return kept.withColumn("r", place).filter(F.col("r") <= k)


def _occurrences(row: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """How many equal features a row has before each."""
    order = np.lexsort((feature, row))
    r, f = row[order], feature[order]
    new = np.concatenate([np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (f[1:] != f[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    out = np.empty(len(r), np.int64)
    out[order] = np.arange(len(r)) - first
    return out


def common_features(tiles: Tiles, row: np.ndarray, feature: np.ndarray, order: np.ndarray, n_orders: int) -> np.ndarray:
    """(n_orders, cells): of each cell of the tiles' matrices how many features of each order both rows have, with multiplicity.

    The k-th occurrence of a feature in a row is a feature of its own, so that multiplicity is membership.  Of features that few rows of a
    tile have, the pairs of those rows are listed, all features of one count together; others go through matrix products.
    """
    begin, cells = tiles.begin(), int((tiles.n_first * tiles.n_other).sum())
    out = np.zeros((n_orders, cells), np.float32)
    key = [_occurrences(row, feature), feature, order, tiles.tile[row]]
    by = np.lexsort(key)
    row, order = row[by], order[by]
    new = np.ones(min(1, len(by)), bool)
    if len(by):
        new = np.concatenate([new, np.any([k[by][1:] != k[by][:-1] for k in key], axis=0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(by)))
    local = row - tiles.start[tiles.tile[row]]  # place in the tile

    def add(x, y, n):
        """Rows x and y of a tile, x before y, share a feature of order n."""
        t = tiles.tile[x]
        meets = tiles.same[t] | ((local_of[x] < tiles.n_first[t]) & (local_of[y] >= tiles.n_first[t]))
        x, y, n, t = x[meets], y[meets], n[meets], t[meets]
        at = begin[t] + local_of[x] * tiles.n_other[t] + local_of[y] - np.where(tiles.same[t], 0, tiles.n_first[t])
        for k in range(n_orders):
            some = at[n == k]
            if len(some):
                np.add.at(out[k], some, 1) if len(some) < cells // 16 else np.add(out[k], np.bincount(some, minlength=cells), out=out[k], casting="unsafe")

    local_of = np.arange(len(tiles.index)) - tiles.start[tiles.tile]
    for m in range(2, SHARED + 1):
        at = first[size == m]
        if len(at):
            members = np.sort(row[at[:, None] + np.arange(m)], axis=1)
            i, j = np.triu_indices(m, 1)
            step = max(1, 2_000_000 // len(i))
            for a in range(0, len(at), step):
                some = members[a:a + step]
                add(some[:, i].ravel(), some[:, j].ravel(), np.repeat(order[at[a:a + step]], len(i)))
    many = size > SHARED
    group, inside = np.repeat(np.cumsum(many) - 1, size), np.repeat(many, size)
    tile = tiles.tile[row]  # sorted, and within a tile by order
    for t in np.unique(tile[first[many]]) if many.any() else ():
        n, m = int(tiles.n_first[t]), int(tiles.n_other[t])
        whole = slice(*np.searchsorted(tile, [t, t + 1]))
        for k in range(n_orders):
            at = np.searchsorted(order[whole], [k, k + 1]) + whole.start
            mine = inside[at[0]:at[1]]
            names, f = np.unique(group[at[0]:at[1]][mine], return_inverse=True)
            r = local[at[0]:at[1]][mine]
            for a in range(0, len(names), SLICE):
                here = (f >= a) & (f < a + SLICE)
                x = np.zeros((n + (0 if tiles.same[t] else m), min(SLICE, len(names) - a)), np.float32)
                x[r[here], f[here] - a] = 1
                out[k, begin[t]:begin[t] + n * m] += (x[:n] @ (x if tiles.same[t] else x[n:]).T).ravel()
    return out
