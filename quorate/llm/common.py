"""Shared helpers: tables, scratch space that all executors see, and batched text maps."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate import scratch
from quorate.joins import HOT_KEYS, PART, dealt_join, hot_keys, hot_limit, in_few_tasks, parts_of, spread_join  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    return scratch.path(spark, label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back. Survives the loss of any executor."""
    return scratch.table(df, label)


read_back, discard = scratch.read, scratch.discard


def path_of(df: DataFrame) -> str:
    return df._quorate_path


def text_slices(column: pa.Array, max_chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """(place, texts) of a column in consecutive lists of whole texts of about max_chars bytes each; one list at a time is in Python."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    a = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and size + n > max_chars:
            yield a, column.slice(a, i - a).to_pylist()
            a, size = i, 0
        size += n
    if a < len(column):
        yield a, column.slice(a).to_pylist()


def chunks(texts: list[str | None], max_chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of whole texts holding about max_chars characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > max_chars:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def map_texts(df: DataFrame, fn: Callable[[list[str | None]], dict[str, np.ndarray]], fields: str, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), max_chars: int = 2_000_000) -> DataFrame:
    """Apply fn to bounded lists of whole texts; one output row for each input row: id, extra columns, then fn's columns."""
    data = df.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c) for c in extra], F.col(text_col).cast("string").alias("__q_text"))
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*data.schema.fields[:-1], *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    n_keep = len(extra) + 1

    def run(batches):
        for batch in batches:
            for a, texts in text_slices(batch.column(n_keep), max_chars):
                cols = fn(texts)
                kept = [batch.column(i).slice(a, len(texts)).cast(kinds.field(i).type) for i in range(n_keep)]
                made = [cols[f.name].cast(kinds.field(f.name).type) if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], kinds.field(f.name).type) for f in added.fields]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=kinds)

    return data.mapInArrow(run, schema)


def _labelled(labels: DataFrame, label_col: str, allowed) -> DataFrame:
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("__q_y"))
            .filter(F.col("__q_y").isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max("__q_y").alias("__q_y")))


def class_weights(labels: DataFrame, label_col: str, allowed, max_docs: int) -> np.ndarray:
    """How many labelled rows a row of training_sample() stands for, by class: 1 unless the cap on the class cuts rows off."""
    counts = dict(tuple(r) for r in _labelled(labels, label_col, allowed).groupBy("__q_y").agg(F.count(F.lit(1))).collect())
    return np.array([max(1.0, counts.get(y, 0) / max(1, max_docs // 2)) for y in (0, 1)])


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed, max_docs: int, extra: tuple[str, ...] = ()) -> list:
    """At most max_docs labelled rows, as (doc_id, label, text, *extra), chosen by a hash of the id; half of each class where there are enough.

    ``allowed`` is a condition on doc_id: only those rows' labels are read.  Labels other than 0 and 1 are skipped; of several labels
    for one id the largest counts; of several rows of documents with one id, the one whose text's hash is smallest.
    """
    rows = _labelled(labels, label_col, allowed)
    picked = None
    for y in (0, 1):
        part = rows.filter(F.col("__q_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__q_text"), *[F.col(c).cast("string").alias(f"__q_{c}") for c in extra])
    # max_docs bounds this broadcast and, with one row for each id, what comes to the driver
    row = F.struct("__q_text", *[f"__q_{c}" for c in extra])
    got = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "__q_y").agg(F.min_by(row, F.struct(F.xxhash64("__q_text").alias("h"), *[f"__q_{c}" for c in extra])).alias("r")).select("doc_id", "__q_y", "r.*")
    return sorted((tuple(r) for r in got.collect()), key=lambda r: tuple(("" if x is None else x) for x in r))


def filter_texts(df: DataFrame, fn: Callable[[list[str | None]], np.ndarray], *, text_col: str = "text", max_chars: int = 2_000_000) -> DataFrame:
    """The rows for which fn, given bounded lists of whole texts, says True; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, texts in text_slices(batch.column(at), max_chars):
                yield batch.slice(a, len(texts)).filter(pa.array(fn(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)
