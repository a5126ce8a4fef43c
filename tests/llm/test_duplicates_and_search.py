"""Line de-duplication, near-duplicates, top-k search and the pipeline against brute force."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import components, knn, line_dedup, quality, registry, setsketch
from quorate.llm.lines import line_arrays

from .cases import edge_docs, edge_rows, empty_docs, prose

# --- lines -----------------------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_sites):
    """rows: (doc_id, text, source) -> [(doc_id, n_lines, n_removed, text)]"""
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for line in (t.split("\n") if t is not None else []):
            if line.strip(" \t\n\x0b\x0c\r"):
                if s is not None:
                    sites[line].add(s)
                first[line] = min((x for x in (first.get(line), d) if x is not None), default=None)
    out = Counter()
    for d, t, s in rows:
        if t is None:
            out[d, 0, 0, None] += 1
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (x.strip(" \t\n\x0b\x0c\r") and len(sites[x]) >= min_sites and first[x] != d)]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def got_lines(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in df.collect())


def test_lines_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got_lines(registry.op7_line_dedup(spark, sf)) == brute_lines([(r["doc_id"], r["text"], r["source"]) for r in docs], line_dedup.MIN_SITES)


def test_lines_edge_cases(spark):
    rows = edge_rows()
    want = brute_lines([(r[0], r[1], r[3]) for r in rows], 5)
    out = line_dedup.dedup_lines(edge_docs(spark), keep=("doc_id", "text", "lang", "score", "h1"))
    assert got_lines(out) == want and {"lang", "score", "h1"} <= set(out.columns)
    assert sum(n for (d, _, removed, _), n in want.items() if removed) >= 13
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(k * 1000 + i, f"a long line that is number {k}\nown {k} {i} text of the document", "en", f"s{i}", 1) for k in range(4) for i in range(197 + k * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got_lines(line_dedup.dedup_lines(df, min_sites=200)) == brute_lines([(r[0], r[1], r[3]) for r in rows], 200)


# --- near-duplicates -------------------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows, k, pct):
    """rows: (doc_id, text) -> Counter of (doc_id, n_shingles, component_id, kept)"""
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(live):
        for b, y in live[:i]:
            small, large = sorted((len(x), len(y)))
            if 100 * small >= pct * large:
                both = len(x & y)
                if 100 * both >= pct * (len(x) + len(y) - both):
                    ra, rb = find(a), find(b)
                    up[max(ra, rb)] = min(ra, rb)
    out = Counter()
    for d, s in sets:
        c = d if d is None or not s else find(d)
        out[d, len(s), c, True if d is None else d == c] += 1
    return out


def got_near(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_near_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_near([(r["doc_id"], r["text"]) for r in docs], 3, 85)
    assert got_near(registry.op8_setsketch(spark, sf)) == want
    assert sum(not k[3] for k in want) > 5


def test_near_edge_cases(spark):
    got = got_near(setsketch.near_duplicates(edge_docs(spark)))
    rows = [(r[0], r[1]) for r in edge_rows()]
    # rows of one doc_id are one node: doc 15 has two texts, unlinked with others
    assert got == brute_near(rows, 3, 85)
    assert setsketch.near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("params", [setsketch.Params(), setsketch.Params(block_nodes=12), setsketch.Params(shingle=5, similar_pct=80, bands=40, rows=5, block_nodes=30, block_shingles=4000)])
def test_near_groups_of_edited_copies(spark, params):
    """Groups in which pairs lie on both sides of the threshold, exact copies, and unrelated texts that share a passage."""
    rng = random.Random(3)
    rows, passage = [], prose(rng, 25)
    for group in range(3):
        base = prose(rng, 90).split()
        for _ in range(70):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append(" ".join(w))
        rows += [" ".join(base)] * 15
    rows += [f"{prose(rng, 40)} {passage}" for _ in range(40)] + [prose(rng, 3) for _ in range(20)]
    rng.shuffle(rows)
    data = list(enumerate(rows))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert got_near(setsketch.near_duplicates(df, params)) == brute_near(data, params.shingle, params.similar_pct)


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    m = 204
    for sim in (0.3, 0.85):
        errors = []
        for _ in range(30):
            n, base = 300, rng.integers(0, 2**63, 900, dtype=np.uint64)
            k = round(2 * n * sim / (1 + sim))
            v, f = np.concatenate([base[:n], base[:k], base[n:2 * n - k]]), np.array([0, n, 2 * n])
            r = setsketch.registers(v, f, m)
            errors.append(setsketch.estimate(r[:1], r[1:], np.array([300.0]), np.array([300.0]))[0] - k / (2 * n - k))
            union = np.unique(v)
            assert (setsketch.registers(union, np.array([0, len(union)]), m)[0] == r.max(0)).all()
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    a, b = rng.integers(1, 99, (2, 50, m)).astype(np.uint16)
    n1, n2 = rng.integers(50, 60, (2, 50)).astype(float)
    assert (setsketch.likely(a, b, n1, n2, 0.4) == (setsketch.estimate(a, b, n1, n2) >= 0.4)).all()


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(400, 450), rng.randrange(400, 450)) for _ in range(40)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# --- top k -----------------------------------------------------------------------------------------------------------------------


def brute_top(rows, queries, k, scale=1024):
    import math

    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = lambda v: [math.floor(float(np.float32(x)) * scale) for x in v]
    data = [(i, ints(v)) for i, v in rows if i is not None and ok(v)]
    out = Counter()
    for q, v in queries:
        if q is None or not ok(v):
            continue
        x = ints(v)
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in data if i != q)[:k]
        for n, (s, i) in enumerate(best, 1):
            out[q, n, i, -s] += 1
    return out


def got_top(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_top_k_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_top(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert got_top(registry.op9_voronoi_knn(spark, sf)) == want and len(want) >= 50


def test_top_k_edge_cases(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) + (i % 3) * 5]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf")] * 4), (None, [1.0] * 4), (204, []), (205, [2.0]), (0, [9.0, 9.0, 9.0, 9.0]), (300, [3e9, 1e9, 0.0, 1.0]), (301, [0.0] * 4)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400, 440)]
    df = spark.createDataFrame([(i, v, "clash", "c") for i, v in rows], "vec_id long, embedding array<float>, score string, cell string")
    q = [r for r in rows if r[0] is not None and r[0] % 10 == 0 and r[0] != 0] + [(200, None), (None, [1.0] * 4)]
    qdf = spark.createDataFrame(q, "vec_id long, embedding array<float>")
    big = {300}
    want = brute_top(rows, q, 5)
    for slices, block in ((20_000, 2048), (30, 2048), (30, 3)):
        monkeypatch.setattr(knn, "DATA_SLICE", slices)
        monkeypatch.setattr(knn, "QUERY_BLOCK", block)
        got = got_top(knn.top_k(df, qdf, 5))
        assert got == want, (want - got, got - want, big)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert got_top(knn.top_k(few, few, 10)) == brute_top(rows[:3], rows[:3], 10)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(none, none).count() == 0 and knn.top_k(few, none).count() == 0 and knn.top_k(none, few).count() == 0


def test_top_k_bounds_prune_far_cells(spark, monkeypatch):
    """Clustered vectors: most data need not be copied to a query's cell, and the result is still exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 32)) * 20
    x = (centres[np.arange(12_000) % 100] + rng.normal(size=(12_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = np.floor(x.astype(float) * 1024)
    want = Counter()
    for q in range(0, 12_000, 61):
        score = whole @ whole[q]
        score[q] = -np.inf
        for n, i in enumerate(np.lexsort((np.arange(12_000), -score))[:10], 1):
            want[q, n, int(i), int(score[i])] += 1
    for block in (2048, 2):  # one block of all queries; blocks of a cell or two
        monkeypatch.setattr(knn, "QUERY_BLOCK", block)
        out = knn.top_k(df, df.filter("vec_id % 61 = 0"), 10)
        assert got_top(out) == want
        sent = out._quorate_sent
        assert sent["cells"] > 90 and sent["sent"] <= 0.05 * sent["cells"] * sent["vectors"], sent
    assert sent["blocks"] > 50


@pytest.mark.parametrize("copies", [1, 30])
def test_top_k_repeated_ids(spark, copies):
    """Each row of a repeated query id is a query of its own, and its id's own rows, however many, do not raise the bound."""
    rng = np.random.default_rng(6)
    centres = np.eye(8)[:4] * 40
    rows = [(i, [float(x) for x in centres[i % 4] * (1 + i % 3) + rng.normal(size=8)]) for i in range(400)]
    rows += [(40, [float(x) for x in centres[n % 4] * 5]) for n in range(copies)] + [rows[60]] * copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got_top(knn.top_k(df, df.filter("vec_id % 20 = 0"), 10)) == brute_top(rows, [r for r in rows if r[0] % 20 == 0], 10)


# --- pipeline --------------------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    from .test_archives_and_tokens import check_packing

    rows = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels, F.lit(True), False)
    rows = [r for r in rows if quality.rule_columns([r[1]], rules, 50, 50, 50)["kept"][0]]
    model = quality.fit(docs, labels, quality.crc_fold(4) != 2, True)
    rows = [r for r in rows if model.scores(line_arrays([r[1]]))[0] >= 0.7]
    cleaned = brute_lines([(r[0], r[1], r[3]) for r in rows], line_dedup.MIN_SITES)
    texts = {k[0]: k[3] for k in cleaned}
    gone = {k[0] for k in brute_near(list(texts.items()), 5, 80) if not k[3]}
    assert gone and len(rows) < docs.count()
    check_packing(corpus_pipeline.run(spark, sf).collect(), [(d, t) for d, t in texts.items() if d not in gone])


def test_pipeline_stages_handle_edge_cases(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "line dedup", "near dedup", "packing"]
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            n = out.count()
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            if name == "line dedup":
                assert n == docs.count()
                assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
            if name == "near dedup" and docs.count():
                ids = Counter(r["doc_id"] for r in out.collect())
                assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[None] == 1  # the null id's copy of document 1 leaves, its null text stays
