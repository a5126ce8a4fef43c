"""Intermediate tables in the folder that all executors see."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of a row group, about. A task that writes a table holds one, a task that reads it holds one and a batch of rows that does not reach
#: beyond it; with Parquet's 128 MB that is most of a small heap for eight tasks of whole texts.
ROW_GROUP = 2 << 20
#: Folders that this process made, of each application.
_made: dict[str, list[str]] = {}
_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or SparkContext.setCheckpointDir names; where neither is set, one of this process, which is an error
    on a cluster, as executors would not share it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not (found := sc._jsc.sc().getCheckpointDir()).isEmpty():
        named = found.get()
    if named:
        return qualified(spark, named).rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="quorate-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[sc.applicationId] = f"file://{folder}"
    return _own[sc.applicationId]


def qualified(spark: SparkSession, where: str) -> str:
    """A path with the scheme that Spark takes it by, so that other libraries open the same file system."""
    if ":" in where:
        return where
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; clear() deletes what was written there."""
    p = f"{root(spark)}/quorate-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(p)
    return p


def read(spark: SparkSession, where: str, schema: T.StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(where)
    out._quorate_path = where
    return out


def table(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    where = path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(where)
    return read(spark, where, df.schema)


def delete(spark: SparkSession, where: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by table() that nothing reads any more."""
    for df in frames:
        if where := getattr(df, "_quorate_path", None):
            delete(df.sparkSession, where)


def clear(spark: SparkSession) -> int:
    """Delete all intermediate tables that this process made; call it when results that read them are written. Returns their number."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for where in made:
        delete(spark, where)
    return len(made)
