"""A keyed table that several writers may append to at once, each key once.

Rows lie in buckets of their key's hash, a folder for each batch and bucket.  A batch counts from the moment that the next numbered list of
batches, which names it, is there; a list is made whole under another name and linked to its own, which fails if another writer was first.
Who loses that race drops the keys that the winner brought, by reading the winner's batch alone, and tries again.  Folders that no list names,
as a run that was cut leaves them, are never read.  Readers follow the last list; a lookup reads the buckets of its own keys alone.
"""
from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Lists of batches are merged when they are longer.
MAX_BATCHES = 200


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str = "problem_id", buckets: int = BUCKETS):
        """The number of buckets holds for the life of the store."""
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    # --- the list of batches -------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the last list; -1 if there is none."""
        fs, p = self._fs(f"{self.path}/_log")
        if not fs.exists(p):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=-1)

    def batches(self, version: int | None = None) -> list[dict]:
        n = self.version() if version is None else version
        if n < 0:
            return []
        fs, p = self._fs(f"{self.path}/_log/{n:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, batches: list[dict]) -> bool:
        """Whether this writer's list became the one of that number."""
        fs, tmp = self._fs(f"{self.path}/_log/tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        _, last = self._fs(f"{self.path}/_log/{version:012d}.json")
        try:
            if fs.getUri().getScheme() == "file":
                os.link(tmp.toUri().getPath(), last.toUri().getPath())
                return True
            return self._rename(tmp, last)
        except FileExistsError:
            return False
        finally:
            fs.delete(tmp, False)

    def _rename(self, source, target) -> bool:
        """Rename unless the target is there, in one step on file systems that know it."""
        from py4j.protocol import Py4JJavaError

        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, how)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.toString():
                return False
            raise

    # --- rows ----------------------------------------------------------------------------------------------------------------------

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _rows(self, batches: list[dict], buckets: list[int] | None = None) -> DataFrame:
        some = [b for b in batches if b["buckets"] and (buckets is None or set(b["buckets"]) & set(buckets))]
        if not some:
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*self.schema.fields, T.StructField("__batch", T.StringType()), T.StructField("__bucket", T.IntegerType())])
        rows = self.spark.read.schema(full).option("basePath", self.path).parquet(*[f"{self.path}/{b['name']}" for b in some])
        return (rows if buckets is None else rows.filter(F.col("__bucket").isin(buckets))).drop("__batch", "__bucket")

    def count(self, version: int | None = None) -> int:
        """Rows, by the list alone."""
        return sum(b["rows"] for b in self.batches(version))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.batches(version))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose key is among keys (a column named as the store's key); only the buckets of those keys are read."""
        asked = keys.select(F.col(self.key)).distinct()
        # at most one row for each bucket
        buckets = sorted(r[0] for r in asked.select(self._bucket(F.col(self.key))).distinct().collect())
        return self._rows(self.batches(version), buckets).join(asked, self.key, "left_semi")

    def _write(self, rows: DataFrame) -> dict:
        name = f"__batch={uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn("__bucket", self._bucket(F.col(self.key))).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        fs, p = self._fs(f"{self.path}/{name}")
        buckets = sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith("__bucket="))
        return {"name": name, "buckets": buckets, "rows": self._rows([{"name": name, "buckets": buckets}]).count()}

    def _delete(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def append_new(self, df: DataFrame) -> int:
        """Append the rows whose key the store lacks, one of each key; rows without a key are left out. Returns the version that holds them."""
        once = df.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        at = self.version()
        mine = self._write(once.join(self.lookup(once, at).select(self.key), self.key, "left_anti"))
        while True:
            if not mine["buckets"]:
                self._delete(mine["name"])
                return at
            if self._commit(at + 1, [*self.batches(at), mine]):
                if len(self.batches(at + 1)) > MAX_BATCHES:
                    self.compact()
                return at + 1
            # another writer was first: what its batches have is left out, and they alone are read
            known = {b["name"] for b in self.batches(at)}
            at = self.version()
            fresh = [b for b in self.batches(at) if b["name"] not in known]
            rest = self._rows([mine]).join(self._rows(fresh, mine["buckets"]).select(self.key), self.key, "left_anti")
            before, mine = mine, self._write(rest)
            self._delete(before["name"])

    def compact(self) -> int:
        """Write all batches as one; a writer that was first meanwhile wins, and nothing changes. Batches of older versions stay for their readers."""
        at = self.version()
        old = self.batches(at)
        if len(old) < 2:
            return at
        mine = self._write(self._rows(old))
        if self._commit(at + 1, [mine]):
            return at + 1
        self._delete(mine["name"])
        return self.version()

    def vacuum(self) -> int:
        """Delete folders that the last list does not name; for times without writers and readers. Returns their number."""
        named = {b["name"] for b in self.batches()}
        fs, p = self._fs(self.path)
        gone = [n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("__batch=") and n not in named]
        for n in gone:
            self._delete(n)
        return len(gone)
