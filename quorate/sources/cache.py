"""Cached data sets as a data source: folders of Arrow files with an info file that says what they were made from.

    spark.dataSource.register(cache.ArrowCache)
    spark.read.format("arrow_cache").option("dataset", "owner/name").option("split", "test").load(root)
"""
from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The name of a cache's info file, where it lists its sources, how a source begins, and the endings of a split's file.
INFO_FILE, SOURCES, PREFIX = "dataset_info.json", "download_checksums", "hf://datasets/"
ENDINGS = ("-", "_", ".")
#: Where a training split that a cache lacks is taken from.
TRAIN_FALLBACK = ("valid", "validation", "test")


def open_fs(uri: str):
    """(file system, path in it) of a path that may lack a scheme or its slashes."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon:
        uri = f"file://{uri}"
    elif not rest.startswith("//"):
        uri = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(uri)


def find_split(root: str, dataset: str, split: str, revision: str = "") -> list[str]:
    """The Arrow files of a cached data set's split; a missing training split is taken from TRAIN_FALLBACK.

    Folders are tried in order of their names: those of the owner if the id has one, else those that begin with the id.  One counts if
    its info file names the id (and the revision) as a source and its splits have the one asked for.
    """
    from pyarrow import fs

    where, base = open_fs(root)
    owner, slash, _ = dataset.partition("/")
    begins = f"{owner}___" if slash else dataset
    if where.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no cache at {root}")
    # a cache has a few folders for each data set
    names = sorted(f.path for f in where.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory and f.base_name.startswith(begins))
    infos = sorted(f.path for n in names for f in where.get_file_info(fs.FileSelector(n, recursive=True)) if f.base_name == INFO_FILE)
    lacking = None
    for want in (split, *(TRAIN_FALLBACK if split == "train" else ())):
        for path in infos:
            try:
                with where.open_input_file(path) as f:
                    info = json.loads(f.read())
            except ValueError:
                continue
            if not any(k.startswith(f"{PREFIX}{dataset}@{revision}") for k in info.get(SOURCES) or {}):
                continue
            there = sorted(info.get("splits") or {})
            if there and want not in there:
                lacking = lacking or ValueError(f"split {split!r} is not in the cache of {dataset!r}; there are {there}")
                continue
            folder = path.rsplit("/", 1)[0]
            files = sorted(f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.extension == "arrow")
            mine = [p for p in files if (stem := p.rsplit("/", 1)[1].removesuffix(".arrow")) == want or any(stem.endswith(e + want) for e in ENDINGS)]
            if mine:
                scheme = root.partition(":")[0] if ":" in root else "file"
                return [f"{scheme}://{p}" for p in mine[:1]]
            lacking = lacking or FileNotFoundError(f"the cache of {dataset!r} has no file of split {split!r} in {folder}")
    raise lacking or FileNotFoundError(f"no cache of {dataset!r} in {root}")


def batches_of(uri: str) -> list[int]:
    """What can be read of an Arrow file or stream by itself: numbers of batches of a file, places of messages of a stream; [-1], all at
    once, where batches share a dictionary."""
    import pyarrow as pa

    where, name = open_fs(uri)
    with where.open_input_file(name) as f:
        try:
            return list(range(pa.ipc.open_file(f).num_record_batches))
        except pa.ArrowInvalid:
            f.seek(0)
        out = []
        pa.ipc.read_message(f)
        while True:
            at = f.tell()
            try:
                m = pa.ipc.read_message(f)
            except EOFError:
                return out
            if m.type == "dictionary":
                return [-1]
            out.append(at)


def read_batch(uri: str, at: int) -> Iterator:
    import pyarrow as pa

    where, name = open_fs(uri)
    with where.open_input_file(name) as f:
        try:
            r = pa.ipc.open_file(f)
            yield r.get_batch(at)
            return
        except pa.ArrowInvalid:
            f.seek(0)
        if at < 0:
            yield from pa.ipc.open_stream(f)
            return
        schema = pa.ipc.read_schema(pa.ipc.read_message(f))
        f.seek(at)
        yield pa.ipc.read_record_batch(pa.ipc.read_message(f), schema)


class Batch(InputPartition):
    def __init__(self, uri: str, at: int):
        self.uri, self.at = uri, at


class ArrowCacheReader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType):
        self.files, self.schema = files, schema

    def partitions(self) -> list[Batch]:
        return [Batch(f, at) for f in self.files for at in batches_of(f)]

    def read(self, partition: Batch) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        for b in read_batch(partition.uri, partition.at):
            yield pa.RecordBatch.from_arrays([b.column(k.name).cast(k.type) for k in kinds], schema=kinds)


class ArrowCache(DataSource):
    """Options: path (the cache's root), dataset, split ("train" if none), revision (any if none). A partition for each record batch."""

    @classmethod
    def name(cls) -> str:
        return "arrow_cache"

    def _files(self) -> list[str]:
        o = self.options
        return find_split(o["path"], o["dataset"], o.get("split", "train"), o.get("revision", ""))

    def schema(self) -> T.StructType:
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        where, name = open_fs(self._files()[0])
        with where.open_input_file(name) as f:
            try:
                return from_arrow_schema(pa.ipc.open_file(f).schema)
            except pa.ArrowInvalid:
                f.seek(0)
                return from_arrow_schema(pa.ipc.open_stream(f).schema)

    def reader(self, schema: T.StructType) -> ArrowCacheReader:
        return ArrowCacheReader(self._files(), schema)


def read_cached(spark: SparkSession, root: str, dataset: str, split: str, revision: str = "") -> DataFrame:
    spark.dataSource.register(ArrowCache)
    return spark.read.format("arrow_cache").option("dataset", dataset).option("split", split).option("revision", revision).load(root)


def write_cached(df: DataFrame, root: str, dataset: str, revision: str, split: str, splits: list[str], rows_a_batch: int = 10_000) -> str:
    """A split of a cache: its Arrow file, in batches of so many rows, and the info file, for tests and examples: the rows go through one task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    folder = f"{root}/{dataset.replace('/', '___')}/default/{revision}"
    kinds = to_arrow_schema(df.schema)
    name = f"{folder}/{dataset.rsplit('/', 1)[-1]}-{split}.arrow"

    def run(batches):
        where, target = open_fs(name)
        where.create_dir(target.rsplit("/", 1)[0], recursive=True)
        n = 0
        with where.open_output_stream(target) as f, pa.ipc.new_stream(f, kinds) as w:
            for b in batches:
                t = pa.Table.from_arrays([c.cast(k.type) for c, k in zip(b.columns, kinds)], schema=kinds)
                for part in t.to_batches(max_chunksize=rows_a_batch):
                    w.write_batch(part)
                n += t.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n]})

    df.coalesce(1).mapInArrow(run, "n long").collect()
    where, base = open_fs(folder)
    with where.open_output_stream(f"{base}/{INFO_FILE}") as f:
        f.write(json.dumps({SOURCES: {f"{PREFIX}{dataset}@{revision}/{split}.parquet": {}}, "splits": {s: {} for s in splits}}).encode())
    return folder
