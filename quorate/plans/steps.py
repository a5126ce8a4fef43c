"""A run of named steps with the wall time of each."""
from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Each step gets the results so far and returns a DataFrame, which is written to the run's folder and read back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.results: dict[str, DataFrame] = {}
        self.timing: list[tuple[str, float, int]] = []

    def run(self, name: str, step: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
        began = time.monotonic()
        path = f"{self.folder}/{name}"
        step(self.results).write.mode("overwrite").parquet(path)
        out = self.results[name] = self.spark.read.parquet(path)
        self.timing.append((name, time.monotonic() - began, out.count()))
        return out

    def timings(self) -> DataFrame:
        return self.spark.createDataFrame(self.timing, "step string, seconds double, rows long")

    def settings_text(self) -> str:
        return "".join(f"{n}={s:.3f}\n" for n, s, _ in self.timing)
