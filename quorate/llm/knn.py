"""Exact top-k by inner product: a Voronoi join (operator 9).

Pivots, about as many as the square root of the data's size, are chosen on a bounded sample and split queries and data into cells.  Summaries
per partition - the best lower bounds that data give each query cell - yield a score that a cell's k-th best surely reaches.  A vector is
sent for a query cell only if its upper bound reaches that score.  Bounds: for a query q of a cell with pivot p and radius u, and a vector x of
a cell with pivot c, q.x lies within u |x| of p.x, and is at most p.c + u |c| + (|p| + u) |x - c|; the second rules out whole cells of data.
Neighbouring query cells share a block of queries, and a vector goes to a block once if any of its cells asks for it: where vectors have no
structure that bounds can use, each is copied once for each block of up to QUERY_BLOCK queries.  Within a block each cell's queries meet only
what the cell asked for.  A block's vectors are dealt into slices by their counted number, (block, slice) is solved by itself, and the
slices' best are merged.

Every vector is a candidate and every comparison that could matter is made, so recall is 1.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as padded with zeros; a null id
takes no part; ties go to the smaller id; fewer than k candidates give fewer rows; of rows that repeat an id each is a candidate of its own,
except for queries of that id, and each is a query of its own; a score beyond 64 bits is an error; an empty table gives an empty result; vectors may have any
number of components; other columns take no part.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Pivots: the square root of the number of vectors, within these bounds.
MIN_PIVOTS, MAX_PIVOTS = 8, 2048
#: Vectors that pivots are chosen from: this many for each pivot.
SAMPLE_PER_PIVOT = 8
#: Bytes of sample vectors that come to the driver, as arrays, at most; a vector for each pivot comes in any case.
SAMPLE_BYTES = 64 << 20
QUERY_BLOCK = 2048
DATA_SLICE = 20_000
#: Vectors that meet all cells at a time.
STEP = 1024
#: Relative slack of bounds, far above the error of sums of doubles.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id, x: floor(scale * component) as doubles, of the vectors that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("x"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Points of the sample, each as far as can be from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked = [int(np.argmax((sample**2).sum(1)))]
    gap = ((sample - sample[picked[0]]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)) and gap.max() > 0:
        picked.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of doubles as binaries."""
    data = np.ascontiguousarray(x, "<f8")
    width = data.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while every sum stays below 2^53, Python integers beyond."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    return whole(a) @ whole(b).T


def order_cells(centres: np.ndarray) -> np.ndarray:
    """The cells in a chain in which each is followed by the nearest that is left."""
    left = np.arange(len(centres))
    out = [0]
    left = left[1:]
    while len(left):
        nearest = int(((centres[left] - centres[out[-1]]) ** 2).sum(1).argmin())
        out.append(int(left[nearest]))
        left = np.delete(left, nearest)
    return np.array(out)


def _best_distinct(ids: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best values of different ids (all, if fewer ids)."""
    take = 4 * n
    while True:
        some = np.argpartition(-low, take)[:take] if take < len(low) else np.arange(len(low))
        some = some[np.argsort(-low[some], kind="stable")]
        first = some[np.sort(np.unique(ids[some], return_index=True)[1])]
        if len(first) >= n or take >= len(low):
            return first[:n]
        take *= 8


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, scale: int = 1024, pivots: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Operator 9: query_id, rank, vec_id, score. A vector is no candidate for the query of its own id."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = materialize(integer_vectors(vectors, scale, id_col, vec_col), "vectors")
    asked = materialize(integer_vectors(queries, scale, id_col, vec_col), "queries")
    dim, n_data = data.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.count(F.lit(1))).first()
    dim = max(dim, asked.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0], 1)
    pivots = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, int(np.ceil(n_data**0.5))))
    # ids alone are sorted; one row of each id comes back, so that the sample's size is bounded
    n_sample = max(pivots, min(SAMPLE_PER_PIVOT * pivots, SAMPLE_BYTES // (8 * dim)))
    some = data.select(F.xxhash64("id").alias("h"), "id").distinct().orderBy("h", "id").limit(n_sample).select("id")
    rows = data.join(F.broadcast(some), "id", "left_semi").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").select("x").toArrow()
    sample = np.concatenate([np.zeros((0, dim)), *(_matrix(c, dim) for c in rows.column(0).chunks)])
    centres = choose_pivots(sample, pivots)
    centres = centres[order_cells(centres)]
    held = spark.sparkContext.broadcast(centres)

    def place(batches):
        p = held.value
        square = (p**2).sum(1)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                x = _matrix(part.column(1), dim)
                cell = (square[None, :] - 2 * x @ p.T).argmin(1)
                far = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x**2).sum(1))), part.column(1)], ["id", "cell", "far", "norm", "x"])

    placed_schema = "id long, cell int, far double, norm double, x array<double>"
    data_cells = materialize(data.mapInArrow(place, placed_schema), "data-cells")
    # a key of its own for each row, as ids may repeat; it is written, so that it stays what it is
    query_cells = materialize(asked.mapInArrow(place, placed_schema).withColumn("row", F.monotonically_increasing_id()), "query-cells")
    # one row for each of a bounded number of cells
    radius = np.full(len(centres), -1.0)
    n_asked = np.zeros(len(centres), np.int64)
    for r in query_cells.groupBy("cell").agg(F.max("far"), F.count(F.lit(1))).collect():
        radius[r[0]], n_asked[r[0]] = r[1] * (1 + SLACK), r[2]
    used = np.flatnonzero(n_asked)
    if not len(used) or not n_data:
        return empty
    reach = radius[used]
    lengths = np.sqrt((centres**2).sum(1))

    def summarise(batches):
        p = held.value[used]
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in used]
        for batch in batches:
            ids, norm, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2), dim)
            lows = p @ x.T - reach[:, None] * norm[None, :]
            lows -= SLACK * np.abs(lows)
            for n, low in enumerate(lows):
                if len(best[n][0]) > k:  # what is not above the worst held cannot count
                    able = low > best[n][1][-1]
                    among, low = np.concatenate([best[n][0], ids[able]]), np.concatenate([best[n][1], low[able]])
                else:
                    among, low = np.concatenate([best[n][0], ids]), np.concatenate([best[n][1], low])
                top = _best_distinct(among, low, k + 1)
                best[n] = among[top], low[top]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(used)), [len(b[0]) for b in best]).astype(np.int32)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], ["cell", "id", "low"])

    # k + 1 ids, each by its best row, as a query's own id may be among them with any number of rows
    lows = data_cells.select("id", "norm", "x").mapInArrow(summarise, "cell int, id long, low double").groupBy("cell", "id").agg(F.max("low").alias("low"))
    ranked = lows.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))).filter(F.col("r") <= k + 1)
    surely = np.full(len(used), -np.inf)
    for c, low, n in ranked.groupBy("cell").agg(F.min("low"), F.count(F.lit(1))).collect():
        surely[c] = low if n == k + 1 else -np.inf
    # whole cells of data that a query cell's score rules out: at most pivots x pivots values
    of_cell = {r[0]: (r[1], r[2]) for r in data_cells.groupBy("cell").agg(F.max("far"), F.max("norm")).collect()}
    far, norm = (np.array([of_cell.get(c, (0.0, 0.0))[i] for c in range(len(centres))]) for i in (0, 1))
    between = centres[used] @ centres.T
    high = np.minimum(between + reach[:, None] * lengths[None, :] + (lengths[used] + reach)[:, None] * far[None, :], between + lengths[used][:, None] * far[None, :] + reach[:, None] * norm[None, :])
    alive = high + SLACK * (np.abs(high) + lengths[used][:, None] * norm[None, :]) >= surely[:, None]

    # consecutive cells, which are neighbours, share a block; a cell with more queries has blocks of its own
    block_of, n_blocks, filled = np.zeros(len(centres), np.int64), 0, QUERY_BLOCK
    own_blocks = np.ones(len(centres), np.int64)
    for c in used:
        if filled + n_asked[c] > QUERY_BLOCK:
            block_of[c], filled = n_blocks, int(n_asked[c])
            own_blocks[c] = -(-filled // QUERY_BLOCK)
            n_blocks += int(own_blocks[c])
        else:
            block_of[c] = n_blocks - 1
            filled += int(n_asked[c])
    blocks = np.unique(block_of[used])
    starts = np.searchsorted(block_of[used], blocks)
    table = spark.sparkContext.broadcast((surely, alive))

    def wanted(ids, cell, norm, x) -> np.ndarray:
        """vectors x used cells: whether the cell asks for the vector"""
        least, able = table.value
        high = x @ held.value[used].T + norm[:, None] * reach[None, :]
        return able.T[cell] & (high + SLACK * (np.abs(high) + norm[:, None] * lengths[used][None, :]) >= least[None, :])

    def parts(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                ids, cell, norm = (np.asarray(part.column(i)) for i in (0, 1, 2))
                x = _matrix(part.column(3), dim)
                yield ids, norm, x, np.logical_or.reduceat(wanted(ids, cell, norm, x), starts, axis=1)

    def count(batches):
        total = np.zeros(len(blocks), np.int64)
        for _, _, _, asks in parts(batches):
            total += asks.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(total)], ["block", "n"])

    inputs = data_cells.select("id", "cell", "norm", "x")
    n_sent = np.zeros(n_blocks, np.int64)
    for r in inputs.mapInArrow(count, "block int, n long").groupBy("block").agg(F.sum("n")).collect():
        n_sent[r[0]] = r[1]
    slices = np.maximum(1, -(-n_sent // DATA_SLICE))
    copies = np.ones(n_blocks, np.int64)
    copies[block_of[used]] = own_blocks[used]

    def send(batches):
        for ids, norm, x, asks in parts(batches):
            for n, b in enumerate(blocks):
                at = np.flatnonzero(asks[:, n])
                for c in range(copies[b] if len(at) else 0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b + c, np.int32)), pa.array(ids[at]), pa.array(norm[at]), _packed(x[at])], ["block", "id", "norm", "x"])

    for b in blocks:  # blocks of one cell have the same slices
        slices[b:b + copies[b]] = slices[b]
    # per block one value: fewer than the queries by QUERY_BLOCK, and at most one for each cell besides
    n_slices = F.element_at(F.array(*[F.lit(int(n)) for n in slices]), F.col("block") + 1)
    sent = inputs.mapInArrow(send, "block int, id long, norm double, x binary").withColumn("slice", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), n_slices).cast("int"))
    per_cell = F.array(*[F.struct(F.lit(int(b)).alias("b"), F.lit(int(n)).alias("n")) for b, n in zip(block_of, own_blocks)])
    of = F.element_at(per_cell, F.col("cell") + 1)
    waiting = query_cells.select("cell", (of["b"] + F.pmod(F.xxhash64("row"), of["n"])).cast("int").alias("block"), "row", "id", "x").withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1)))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        keys, asks, found, scores = ([np.zeros(0, np.int64)] for _ in range(4))
        if len(q) and len(d):
            d = d.sort_values("id", kind="stable")
            ids, norms, dx = d["id"].to_numpy(), d["norm"].to_numpy(), np.frombuffer(b"".join(d["x"]), "<f8").reshape(len(d), dim)
            for cell, part in q.groupby("cell"):
                n = int(np.searchsorted(used, cell))
                qx = np.zeros((len(part), dim))
                for i, v in enumerate(part["x"]):
                    qx[i, :len(v)] = v
                high = dx @ centres[cell] + norms * reach[n]
                own = np.flatnonzero(high + SLACK * (np.abs(high) + norms * lengths[cell]) >= surely[n])
                for a in range(0, len(part), 256):
                    s = _products(qx[a:a + 256], dx[own])
                    for row, query, key in zip(s, part["id"].to_numpy()[a:a + 256], part["row"].to_numpy()[a:a + 256]):
                        able = np.flatnonzero(ids[own] != query)
                        r = row[able]
                        if len(r) > k:
                            kth = np.sort(r)[-k] if r.dtype == object else -np.partition(-r, k - 1)[k - 1]
                            able = able[r >= kth]
                        # ids ascend, so that a stable order by score leaves ties to smaller ids
                        best = able[np.argsort(-row[able], kind="stable")[:k]]
                        keys.append(np.full(len(best), key))
                        asks.append(np.full(len(best), query))
                        found.append(ids[own[best]])
                        scores.append(row[best].astype(np.int64))
        return pd.DataFrame({"row": np.concatenate(keys), "query_id": np.concatenate(asks), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    key = ["block", "slice"]
    partial = waiting.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(solve, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    out = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out._quorate_sent = {"sent": int((n_sent[blocks] * copies[blocks]).sum()), "cells": len(used), "blocks": int(n_blocks), "vectors": int(n_data)}
    return out


#: All pairs of a query and another vector; DuckDB on the small tables only.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.x, d.x)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
