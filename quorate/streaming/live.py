"""Structured Streaming: choices and outcomes as they arrive."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def windowed_accuracy(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours", by: str = "method") -> DataFrame:
    """Counts and accuracy of outcomes (ts, by, correct) in tumbling windows; rows later than the watermark are dropped, closed windows are emitted once."""
    g = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("accuracy"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", by: str = "problem_id") -> DataFrame:
    """Session windows of activity on a problem."""
    g = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _best(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    index, score = state.get if state.exists else (None, None)
    before = index
    for pdf in batches:
        if not len(pdf):
            continue
        top = float(pdf["score"].max())
        first = int(pdf.loc[pdf["score"] == top, "candidate_index"].min())
        if score is None or top > score or (top == score and first < index):
            index, score = first, top
    state.update((index, score))
    if index != before:
        yield pd.DataFrame({"problem_id": [key[0]], "chosen_index": [index], "score": [score]})


def running_choice(scored: DataFrame) -> DataFrame:
    """The best candidate so far of each problem, emitted whenever it changes (problem_id, candidate_index, score); ties go to the smaller index."""
    kind = dict(scored.dtypes)["problem_id"]
    return scored.groupBy("problem_id").applyInPandasWithState(_best, f"problem_id {kind}, chosen_index int, score double", "chosen_index int, score double", "update", "NoTimeout")


class _Closing(StatefulProcessor):
    """The best candidate of each problem, kept until no row of it came for ``keep`` milliseconds of event time; then it is given out and forgotten."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "chosen_index int, score double, n long, closes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        index, score, n, closes = self.best.get() if self.best.exists() else (None, None, 0, 0)
        watermark, before = timerValues.getCurrentWatermarkInMs(), closes
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64") // 1000
            # rows older than the watermark are late: what they belong to may be given out already
            pdf, at = pdf[at >= watermark], at[at >= watermark]
            if len(pdf):
                top = float(pdf["score"].max())
                first = int(pdf.loc[pdf["score"] == top, "candidate_index"].min())
                if score is None or top > score or (top == score and first < index):
                    index, score = first, top
                n, closes = n + len(pdf), max(closes, int(at.max()) + self.keep)
        if n and closes != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(closes)
            self.best.update((index, score, n, closes))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index, score, n, _ = self.best.get()
        self.best.clear()
        yield pd.DataFrame({"problem_id": [key[0]], "chosen_index": [index], "score": [score], "n": [n]})

    def close(self) -> None:
        pass


def closing_choice(scored: DataFrame, keep_minutes: int, lateness: str = "2 hours") -> DataFrame:
    """(problem_id, chosen_index, score, n): the best candidate of each problem, given out once, when no row of it came for keep_minutes of event time;
    its state goes then. Rows (problem_id, candidate_index, score, ts) later than the watermark are dropped. Needs the RocksDB state store."""
    kind = dict(scored.dtypes)["problem_id"]
    rows = scored.select("problem_id", "candidate_index", "score", "ts").withWatermark("ts", lateness)
    return rows.groupBy("problem_id").transformWithStateInPandas(_Closing(keep_minutes * 60_000), f"problem_id {kind}, chosen_index int, score double, n long", "Append", "EventTime")


#: What transformWithState needs of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def keep_once(stream: DataFrame, key: str, lateness: str | None = None) -> DataFrame:
    """The first row of each key; with lateness, keys are forgotten after it."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key]) if lateness else stream.dropDuplicates([key])


def resume_into(stream: DataFrame, path: str, checkpoint: str, key: str = "problem_id"):
    """Write rows whose key the sink lacks, batch by batch; running again after a stop, or beside another run, adds nothing twice. A batch reads
    the buckets of its own keys alone."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from quorate.sources.jsonl import append_new

        append_new(batch.sparkSession, batch.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
