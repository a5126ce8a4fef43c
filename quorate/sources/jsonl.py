"""JSON-lines, text and split sources and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate import scratch
from quorate.functions import stats as st
from quorate.functions import text as tx
from quorate.sources.cache import open_fs, read_cached
from quorate.sources.store import KeyedStore

BOM = "﻿"
#: The names under which a split may be stored, and where a missing training split is taken from.
SPLIT_NAMES = {"train": ["train"], "valid": ["valid", "validation", "dev"], "test": ["test"]}
TRAIN_FALLBACK = ["valid", "test"]


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Every line that is not white space alone as a row, duplicates kept, with file and place in it (__file, __start, __place)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__place"))
    return lines.filter(tx.squeeze(F.col("value")) != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "__file", "__start", "__place").select("r.*", "__file", "__start", "__place")


def numbered_lines(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """(file, line, value): every line of the files with its number in its file, from 1, the byte-order mark removed.

    as_one: the files are parts of one, in the order of their names, and numbers run on from each to the next.
    Blocks of a file are counted first, so that only a block's own lines are numbered in one place.
    """
    at = ["__file", "__start"]
    lines = scratch.table(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__place")), "lines")
    # one row for each block
    blocks = lines.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(F.lit(0)).orderBy(*at) if as_one else Window.partitionBy("__file").orderBy("__start")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("__place"))
    out = lines.withColumn("__own", inside).join(blocks.select(*at, before.alias("__before")), at)
    return out.select(F.col("__file").alias("file"), (F.col("__before") + F.col("__own")).alias("line"), F.regexp_replace("value", f"^{BOM}", "").alias("value"))


def faulty_lines(spark: SparkSession, path: str, key: str = "problem_id", as_one: bool = False) -> DataFrame:
    """(file, line, fault) of lines that are not blank and have no key, or are no JSON object; as_one: the files are parts of one."""
    rows = numbered_lines(spark, path, as_one).filter(tx.squeeze(F.col("value")) != "")
    value = F.get_json_object("value", f"$.{key}")
    fault = F.when(~F.trim("value").startswith("{") | F.json_object_keys("value").isNull(), "not an object").when(value.isNull(), f"{key} is missing")
    return rows.select("file", "line", fault.alias("fault")).filter("fault is not null")


def require_keys(spark: SparkSession, path: str, key: str = "problem_id") -> None:
    """An error that names file and line of the first faulty line."""
    for r in faulty_lines(spark, path, key).orderBy("file", "line").limit(1).collect():
        raise ValueError(f"{r['fault']} at {r['file']}:{r['line']}")


def read_keyed(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "problem_id", first: bool = False) -> DataFrame:
    """One row per key, the last line of each (or the first); a line without key is an error."""
    rows = read_rows(spark, path, schema)
    ok = rows.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit(f"{key} is missing in "), F.col("__file"))).cast(dict(rows.dtypes)[key])).otherwise(F.col(key)))
    return one_per_key(ok, key, ["__file", "__start", "__place"], first).drop("__file", "__start", "__place")


def one_per_key(rows: DataFrame, key: str, order: list[str], first: bool = False) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.asc(o) if first else F.desc(o) for o in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("problem_id")).filter("problem_id <> ''")


def parse_settings(lines: DataFrame) -> DataFrame:
    """(name, value) of key=value lines: comments and unreadable numbers are skipped, the last of a name wins. Needs columns value, place."""
    kv = lines.filter(~F.col("value").startswith("#") & F.contains("value", F.lit("="))).select(F.trim(F.substring_index("value", "=", 1)).alias("name"), F.trim(F.expr("substr(value, instr(value, '=') + 1)")).try_cast("double").alias("v"), "place")
    return kv.filter("v is not null").groupBy("name").agg(F.max_by("v", "place").alias("value"))


def temperature(js: F.Column, default: float = 1.0):
    """The first of temperature.fitted, temperature.input, temperature, fitted_temperature that is a positive finite number."""
    paths = ("$.temperature.fitted", "$.temperature.input", "$.temperature", "$.fitted_temperature")
    values = [F.get_json_object(js, p).try_cast("double") for p in paths]
    return F.coalesce(*[F.when((v > 0) & (v < float("inf")), v) for v in values], F.lit(default))


def resolve_split(spark: SparkSession, path: str, split: str, formats: tuple[str, ...] = ("parquet", "jsonl", "json", "arrow"), names: dict[str, str] | None = None, base: str | None = None, cache: str | None = None) -> DataFrame:
    """A split of a folder by its file names; a missing training split falls back to valid, then test. A single file is a split itself.

    What ``path`` names is looked for in this order: the path itself; the path below ``base``; the folder that ``names`` gives for it, a published
    name; the cache at ``cache``, by the id in its info files.  Arrow files, by split or one folder of them per split, are read as caches.
    """
    jvm = spark._jvm

    def there(p: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    tried_first = [path, *([f"{base.rstrip('/')}/{path}"] if base and ":" not in path and not path.startswith("/") else []), *([mapped] if (mapped := local_name(path, names or {})) != path else [])]
    found_at = next((p for p in tried_first if there(p)), None)
    if found_at is None and cache is not None:
        return read_cached(spark, cache, path, split)
    path = found_at or path
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(root).isFile():
        return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    found = [s.getPath().getName() for s in fs.listStatus(root)]
    tried = [split] + (TRAIN_FALLBACK if split == "train" else [])
    for want in tried:
        for fmt in formats:
            mine = [n for n in found if any(n.startswith(p) for p in SPLIT_NAMES.get(want, [want]))]
            hits = [f"{path.rstrip('/')}/{n}" for n in sorted(mine) if n.endswith(f".{fmt}")]
            if fmt == "arrow":
                for n in sorted(mine):  # a cached split is a folder of Arrow files
                    inner = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{n}")
                    if fs.getFileStatus(inner).isDirectory():
                        hits += sorted(f"{path.rstrip('/')}/{n}/{s.getPath().getName()}" for s in fs.listStatus(inner) if s.getPath().getName().endswith(".arrow"))
                if hits:
                    return read_arrow(spark, hits)
            elif hits:
                return spark.read.parquet(*hits) if fmt == "parquet" else spark.read.json(hits)
    raise FileNotFoundError(f"no split {split!r} in {path}")


def local_name(name: str, known: dict[str, str]) -> str:
    """The folder that stands for a published data set's name, or the name itself."""
    return known.get(name.strip().rstrip("/"), name)


def _arrow_batches(path: str):
    """Record batches of an Arrow file or stream, one at a time."""
    import pyarrow as pa

    where, name = open_fs(path)
    with where.open_input_file(name) as f:
        try:
            r = pa.ipc.open_file(f)
            yield r.schema
            for i in range(r.num_record_batches):
                yield r.get_batch(i)
        except pa.ArrowInvalid:
            f.seek(0)
            r = pa.ipc.open_stream(f)
            yield r.schema
            yield from r


def read_arrow(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Arrow files or streams as a table: the schema comes from the first, and executors read the files, a record batch at a time."""
    from pyspark.sql.pandas.types import from_arrow_schema

    paths = [paths] if isinstance(paths, str) else paths
    schema = from_arrow_schema(next(_arrow_batches(paths[0])))

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                content = _arrow_batches(p)
                next(content)
                yield from content

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    return files.mapInArrow(run, schema)


def write_arrow_splits(splits: dict[str, DataFrame], path: str) -> None:
    """A cached data set: a folder for each split with an Arrow file for each of its parts, written by the executors."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    for name, df in splits.items():
        where, folder = open_fs(f"{path}/{name}")
        where.create_dir(folder, recursive=True)
        kinds = to_arrow_schema(df.schema)

        def run(batches, uri=f"{path}/{name}", kinds=kinds):
            import uuid

            fs_, target = open_fs(uri)
            part = f"{target}/{uuid.uuid4().hex}"
            n = 0
            with fs_.open_output_stream(f"{part}.part", compression=None) as f, pa.ipc.new_file(f, kinds) as w:
                for b in batches:
                    w.write_batch(pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(b.columns, kinds)], schema=kinds))
                    n += b.num_rows
            yield pa.RecordBatch.from_pydict({"part": [part if n else None]})

        # a repeated task leaves a part that nobody names
        for r in df.mapInArrow(run, "part string").filter("part is not null").collect():
            where.move(f"{r['part']}.part", f"{r['part']}.arrow")


#: Where a row of a table of Parquet files stands. Files are dealt to tasks by size, so that the tasks' order is not that of the files.
FILE_ORDER = ("_metadata.file_path", "_metadata.row_index")


def inspect(df: DataFrame, n: int = 3, width: int = 160, order: tuple[str, ...] = ()) -> DataFrame:
    """(row, column, type, value): the first rows' values, cut to width; first by the columns of ``order``, or else as the tasks have them."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.substring(F.col(c).cast("string"), 1, width).alias("value")) for c, t in df.dtypes])
    rows = df.select(F.struct(*[F.col(c).alias(f"p{k}") for k, c in enumerate(order)], F.monotonically_increasing_id().alias("id")).alias("__place"), items.alias("__items"))
    # n rows
    first = rows.orderBy("__place").limit(n).select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__place")) - 1).cast("long").alias("row"), "__items")
    return first.select("row", F.explode("__items").alias("x")).select("row", "x.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(df: DataFrame, path: str) -> str:
    """A one-row table as sorted, indented JSON, through the cluster's file system."""
    import json

    text = json.dumps(json.loads(df.toJSON().first()), sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    return write_text(df.sparkSession, path, text)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return text


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str = "problem_id") -> int:
    """Append the rows whose key the sink lacks, one of each key; returns how many keys it had. Running it again, or twice at once, adds nothing twice."""
    store = KeyedStore(spark, path, df.schema, key)
    had = store.count()
    store.append_new(df)
    return had


def read_sink(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "problem_id") -> DataFrame:
    """The rows of a sink that append_new() writes."""
    return KeyedStore(spark, path, schema, key).read()


#: A stored cache of checks: the key of a header and a candidate, and what the checker said.
MEMO = "key string, ok boolean"


def memo_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, MEMO, "key")


def cache_misses(rows: DataFrame, cache: DataFrame | KeyedStore) -> DataFrame:
    """Rows with their memo key that the cache, a table or a store, lacks; of a store only the buckets of the rows' keys are read."""
    keyed = rows.withColumn("key", st.memo_key(F.col("header"), F.col("candidate")))
    return keyed.join((cache.lookup(keyed) if isinstance(cache, KeyedStore) else cache).select("key"), "key", "left_anti")


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split_col).json(path)


def write_id_lists(df: DataFrame, path: str, split_col: str = "split", key: str = "problem_id") -> None:
    """<split>_ids beside the splits: each split's distinct ids as text, sorted, in ranges of files."""
    ids = scratch.table(df.select(F.col(split_col).alias("split"), F.col(key).cast("string").alias("id")).distinct(), "ids")
    # a bounded number of split names
    for r in ids.select("split").distinct().collect():
        ids.filter(F.col("split") == r["split"]).select("id").orderBy("id").write.mode("overwrite").text(f"{path}/{r['split']}_ids")


def first_ids(rows: DataFrame, order: str, max_rows: int = 0, max_problems: int = 0) -> DataFrame:
    """At most max_rows rows in order; then only rows of the first max_problems distinct ids."""
    from quorate.operators.candidates import first_problems

    out = rows.orderBy(order).limit(max_rows) if max_rows else rows
    return first_problems(out, order, max_problems) if max_problems else out


def probe(spark: SparkSession) -> dict[str, str]:
    import platform

    return {"spark": spark.version, "python": platform.python_version(), "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism)}
