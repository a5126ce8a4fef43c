"""Hot keys, repeated ids and bounded collects: what must hold however the rows are dealt."""
import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import common, line_dedup, packing, quality, registry, setsketch, toxicity, warc

from .cases import empty_docs, prose

#: Rows that a task may read whatever its stage's median: a block of a group, by design, and what hashing deals unevenly.
BLOCK_ROWS = 1500


@contextmanager
def no_broadcasts(spark, partitions=24):
    want = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def last_stage(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(None)
    ids = [jobs.apply(i).stageIds() for i in range(jobs.size())]
    return max((x.apply(j) for x in ids for j in range(x.size())), default=-1)


def uneven(spark, after):
    """(stage, largest, median) of the stages behind ``after`` in which a task read more than 5 times the median's rows and BLOCK_ROWS."""
    store = spark.sparkContext._jsc.sc().statusStore()
    out = []
    for stage in range(after + 1, last_stage(spark) + 1):
        tasks = store.taskList(stage, 0, 1000)
        rows = []
        for i in range(tasks.size()):
            m = tasks.apply(i).taskMetrics()
            if m.isDefined() and (n := m.get().shuffleReadMetrics().recordsRead()):
                rows.append(n)
        if len(rows) > 2 and max(rows) > 5 * np.median(rows) and max(rows) > BLOCK_ROWS:
            out.append((stage, max(rows), float(np.median(rows)), len(rows)))
    return out


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 exact copies of one text, 4,000 near copies of another, and other texts; one line is in all of them."""
    rng = random.Random(9)
    shared = "one line that is in every document of all"
    copy, base = prose(rng, 30), prose(rng, 60).split()
    rows = [f"{copy}\n{shared}"] * 20_000
    for _ in range(4_000):
        w = list(base)
        w[rng.randrange(60)] = prose(rng, 1)
        rows.append(" ".join(w) + f"\n{shared}")
    rows += [f"{prose(rng, 20)}\n{shared}" for _ in range(6_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", f"s{i % 9}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(24)
    return common.materialize(df, "hot"), rows


def test_near_duplicates_have_no_hot_task(spark, hot):
    docs, rows = hot
    with no_broadcasts(spark):
        after = last_stage(spark)
        got = common.materialize(setsketch.near_duplicates(docs), "t")
        assert not uneven(spark, after)
    sizes = {r["component_id"]: r["count"] for r in got.groupBy("component_id").count().collect()}
    assert sorted(sizes.values())[-2:] == [4_000, 20_000] and len(sizes) == 6_002
    assert got.filter("kept").count() == 6_002


def test_line_dedup_has_no_hot_task(spark, hot):
    docs, rows = hot
    with no_broadcasts(spark):
        after = last_stage(spark)
        got = common.materialize(line_dedup.dedup_lines(docs), "t")
        assert not uneven(spark, after)
    # the shared line stays once, as does the copied text, and the near copies' own lines
    assert got.filter(F.col("text").contains("one line that is in every document")).count() == 1
    assert got.agg(F.sum("n_removed")).first()[0] == 29_999 + 19_999


def test_archives_have_no_hot_task(spark):
    pages = common.materialize(spark.range(30_000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("the same page")).otherwise(F.concat(F.lit("page "), F.col("id"))).alias("html")).repartition(24), "t")
    with no_broadcasts(spark):
        after = last_stage(spark)
        got = common.materialize(warc.warc_round_trip(pages), "t")
        assert not uneven(spark, after)
    assert got.count() == 30_000 and got.filter("refers_to = 1 and payload_bytes = 13").count() == 19_999


def test_samples_hold_one_row_of_each_id(spark):
    rng = random.Random(3)
    rows = [(1, prose(rng, 5), "en") for _ in range(10_000)] + [(i, prose(rng, 5), "en") for i in range(2, 30)] + [(None, "x y", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 30)] + [(1, 1, 0), (None, 1, 1), (5, 7, None), (None, None, None)], "doc_id long, quality int, toxic int")
    sample = common.training_sample(docs, labels, "quality", F.lit(True), 10, extra=("lang",))
    assert len(sample) <= 10 and len({r[0] for r in sample}) == len(sample)
    assert sample == common.training_sample(docs.repartition(7), labels, "quality", F.lit(True), 10, extra=("lang",))
    for neighbours in (False, True):
        quality.fit(docs, labels, F.lit(True), neighbours)
    toxicity.fit(docs, labels, F.lit(True))


def test_fit_on_empty_and_odd_tables(spark):
    docs, none = empty_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 5, -1), (None, None, None), (2, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a b", "en"), (2, None, None), (2, "two", "de"), (3, "", None), (None, "n", "en")], "doc_id long, text string, lang string")
    for d in (docs, some):
        for labels in (none, odd):
            for neighbours in (False, True):
                m = quality.fit(d, labels, F.lit(True), neighbours)
                assert quality.classify_quality(some, m).filter("score between 0 and 1").count() == 5
                assert quality.quality_rules(some, m).count() == 5
            t = toxicity.fit(d, labels, quality.crc_fold(5) != 0)
            assert toxicity.score_toxicity(some, t).filter("score between 0 and 1").count() == 5


def test_packing_deals_repeated_rows_evenly(spark):
    docs = spark.createDataFrame([(None, "")] * 8_000 + [(7, "same text")] * 8_000, "doc_id long, text string").repartition(8)
    pieces = common.materialize(packing.tokenize_pieces(docs, registry.TOKENIZER, 64), "t")
    packed = common.materialize(packing.pack_pieces(pieces, 64, group=1_000), "t")
    groups = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()]
    assert packed.count() == 16_000 and max(groups) < 1_300 and len(groups) == 16


@pytest.mark.parametrize("params, low", [(setsketch.Params(), 0.85), (setsketch.FIVE_WORDS, 0.8)])
def test_bands_find_pairs_at_the_threshold(params, low):
    """Pairs of random sets at and just above the threshold: all share a band and pass the likelihood cut."""
    rng = np.random.default_rng(12)
    lost = total = 0
    for size in (20, 60, 200, 1000):
        for _ in range(6):
            n, width = 250, size
            # k common values of two sets of a size give k / (2 size - k)
            k = np.ceil(2 * width * rng.uniform(low, low + 0.02, n) / (1 + rng.uniform(low, low + 0.02, n))).astype(int)
            k = np.maximum(k, int(np.ceil(2 * width * low / (1 + low))))
            values, first = [], [0]
            for m in np.minimum(k, width):
                base = rng.integers(0, 2**63, 2 * width - m, dtype=np.uint64)
                values += [np.sort(base[:width]), np.sort(np.concatenate([base[:m], base[width:]]))]
                first += [first[-1] + width, first[-1] + 2 * width]
            regs = setsketch.registers(np.concatenate(values), np.array(first), params.m)
            a, b = regs[::2], regs[1::2]
            banded = (a == b).reshape(n, params.bands, params.rows).all(2).any(1)
            sizes = np.full(n, float(width))
            lost += int((~(banded & setsketch.likely(a, b, sizes, sizes, params.cut))).sum())
            total += n
    assert total == 6_000 and lost <= 3, lost


def test_top_k_with_ten_thousand_rows_of_one_id(spark):
    """The sample holds one row of each id, and the id's rows are candidates each of their own."""
    from quorate.llm import knn

    rng = np.random.default_rng(4)
    x = rng.normal(size=(10_300, 4)).astype(np.float32)
    ids = np.concatenate([np.full(10_000, 7), np.arange(100, 400)])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in knn.top_k(df, df.filter("vec_id >= 100 and vec_id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(x.astype(float) * 1024)
    assert len(got) == 15
    for q, rows in got.items():
        other = ids != q
        score = whole[other] @ whole[np.flatnonzero(ids == q)[0]]
        order = np.lexsort((ids[other], -score))[:10]
        assert [(i, s) for _, i, s in sorted(rows)] == [(int(ids[other][k]), int(score[k])) for k in order]


def test_lines_of_a_long_text_are_not_met_by_each_other(spark):
    """Texts of 200,000 boilerplate lines: the time grows with the lines."""
    import time

    seconds = []
    for n in (20_000, 200_000):
        text = "\n".join(f"menu line {k}" for k in range(n))
        docs = common.materialize(spark.createDataFrame([(i, text, f"s{i}") for i in range(6)], "doc_id long, text string, source string"), "long")
        began = time.perf_counter()
        got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").alias("k")).collect()
        seconds.append(time.perf_counter() - began)
        assert sorted(map(tuple, got)) == [(0, n, 0, len(text))] + [(i, n, n, 0) for i in range(1, 6)]
    assert seconds[1] < 6 * seconds[0] + 10


def test_rows_of_one_id_and_text_spread_when_lines_go(spark):
    rows = [(1, "kept\nshared", "a")] * 20_000 + [(None, "kept\nshared", "b")] * 5_000 + [(i, "shared\nother", f"s{i}") for i in range(2, 2_000)] + [(0, "shared", "z")]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(24), "same")
    with no_broadcasts(spark):
        after = last_stage(spark)
        got = common.materialize(line_dedup.dedup_lines(docs), "t")
        assert not uneven(spark, after)
    assert {(r["doc_id"] is None, r["text"]): r["count"] for r in got.groupBy(F.col("doc_id").isNull().alias("x"), "doc_id", "text").count().filter("doc_id is null or doc_id < 2").collect()} == {(True, "kept"): 5_000, (False, "kept"): 20_000, (False, "shared"): 1}


def test_row_groups_of_scratch_tables_are_bounded(spark):
    """A task holds a row group that it writes, one that it reads, and a batch of rows within it: of whole texts these took up a heap of 1 GB."""
    from pathlib import Path

    import pyarrow.parquet as pq

    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 24), i -> sha2(concat_ws(' ', id, i), 512)), ' ') AS text")
    kept = common.materialize(docs, "row-groups")
    assert kept.count() == 6000 and kept.exceptAll(docs).isEmpty()
    groups = [g for f in Path(common.path_of(kept).removeprefix("file:")).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in [m.row_group(i).total_byte_size for i in range(m.num_row_groups)]]
    assert sum(groups) > 15e6 and max(groups) < 4e6
    common.discard(kept)
