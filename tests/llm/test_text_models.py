"""Quality rules and classifier, toxicity and licences: counts against brute force, models by held-out accuracy, edge cases."""
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import crf, licences, quality, registry, toxicity
from quorate.llm.lines import line_arrays, line_features

from .cases import edge_docs, edge_rows, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if tri[tuple(w[i:i + 3])] > 1:
            mark[i] = mark[i + 1] = mark[i + 2] = True
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(mark)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check_rules(rows, texts):
    assert len(rows) == len(texts)
    want = Counter((d, *brute_counts(t)) for d, t in texts)
    assert Counter((r["doc_id"], *[r[c] for c in COUNTS]) for r in rows) == want
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and 100 * r["content_words"] >= 50 * r["n_words"])


def test_rules_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_rules(registry.op4_quality_rules(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rules_edge_cases(spark, sf):
    model = quality.fit_rows(["good text here. " * 20, "### $$$ *** " * 20] * 5, np.array([1, 0] * 5), False)
    check_rules(quality.quality_rules(edge_docs(spark), model).collect(), [(r[0], r[1]) for r in edge_rows()])
    assert quality.quality_rules(empty_docs(spark), model).count() == 0


def brute_chain(chain, x):
    """Marginals and the best path by summing over all label sequences."""
    from itertools import product

    e = chain.emit(x)
    paths = {y: sum(e[i, a] for i, a in enumerate(y)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=len(x))}
    z = np.logaddexp.reduce(list(paths.values()))
    p = [np.exp(np.logaddexp.reduce([s for y, s in paths.items() if y[i]]) - z) for i in range(len(x))]
    return np.array(p), max(paths, key=paths.get), z


def test_chain_against_all_paths():
    rng = np.random.default_rng(0)
    chain = crf.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    first = np.array([0, 1, 6, 9])
    x = rng.normal(size=(9, 3))
    p, pairs, z = chain.marginals(x, first)
    y = chain.viterbi(x, first)
    total = 0
    for a, b in zip(first, first[1:]):
        bp, by, bz = brute_chain(chain, x[a:b])
        assert np.allclose(p[a:b], bp) and tuple(y[a:b]) == by
        total += bz
    assert np.isclose(z, total) and np.isclose(pairs.sum(), 6)


def test_chain_gradient_raises_likelihood():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((60, 1)), rng.normal(size=(60, 2))], 1)
    first = np.arange(0, 61, 6)
    y = (np.arange(60) // 3) % 2
    ll = lambda c: sum(c.emit(x)[i, y[i]] for i in range(60)) + sum(c.moves[y[i - 1], y[i]] for i in range(60) if i % 6) - c.marginals(x, first)[2]
    start = crf.Chain(np.zeros(3), np.zeros((2, 2)))
    assert ll(crf.fit_chain(x, y, first, np.zeros(3))) > ll(start) + 1


def test_line_features_shape():
    x = line_arrays(["a b\n\nc", None, ""])
    assert list(x.first_line) == [0, 3, 4, 5]
    assert line_features(x, True).shape[0] == 5 and np.isfinite(line_features(x, True)).all()


@pytest.fixture(scope="module")
def tenth(spark):
    return "/root/testdata/sf0.1"


def held_out(spark, sf, rows, col, threshold):
    y = {r["doc_id"]: r[col] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(r["score"] >= threshold, y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    return np.mean([a == b for a, b in out]), len(out)


def test_quality_held_out(spark, tenth):
    rows = registry.op6_quality_classifier(spark, tenth).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    acc, n = held_out(spark, tenth, rows, "quality", 0.7)
    assert n > 500 and acc > 0.98


def test_toxicity_held_out(spark, tenth):
    rows = registry.op2_toxicity(spark, tenth).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    acc, n = held_out(spark, tenth, rows, "toxic", 0.5)
    assert n > 500 and acc >= 0.98


def test_scores_ignore_labels_language_and_source(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    texts = ["kind words only " * 9, "you moron and loser " * 9] * 30
    tox = toxicity.fit_rows(texts, np.array([0, 1] * 30), ["en"] * 60)
    a = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, tox).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), tox).collect()}
    assert a == b


def test_toxicity_edge_cases(spark):
    m = toxicity.fit_rows(["good day", "you idiot", ""] * 20, np.array([0, 1, 0] * 20), ["en", "en", None] * 20)
    rows = toxicity.score_toxicity(edge_docs(spark), m).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    empties = {r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}
    assert len(empties) == 1
    assert toxicity.score_toxicity(empty_docs(spark), m).count() == 0
    one = toxicity.fit_rows(["a", "b"], np.array([0, 0]), [None, None])
    assert len(set(one.scores(["a", None, "zzz"]).tolist())) == 1
    assert toxicity.fit_rows([], np.zeros(0, np.int64), []).scores(["x"])[0] == 0.5


def test_toxicity_maxima_by_hand():
    rng = np.random.default_rng(3)
    m = toxicity.ToxicityModel(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), {w: rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}, rng.normal(size=24).astype(np.float32), np.ones(25, np.float32))
    texts = ["a b c d e", "", "one", "x y", None]
    got, where = m.maxima(toxicity.Batch(texts), track=True)
    for d, t in enumerate(texts):
        v = np.array([m.table[list(toxicity.features(w))].sum(0) for w in toxicity.tokens(t)]).reshape(-1, toxicity.DIM)
        for k, w in enumerate(toxicity.WIDTHS):
            conv = [sum(v[i + j] @ m.filters[w][j] for j in range(w)) + m.bias[k * 8:k * 8 + 8] for i in range(len(v) - w + 1)]
            want = np.maximum(np.max(conv, axis=0), 0) if conv else np.zeros(8)
            assert np.allclose(got[d, k * 8:k * 8 + 8], want, atol=1e-4)


def test_quality_edge_cases(spark):
    m = quality.fit_rows(["plain words in a row make text. " * 9, "### *** &&& " * 30] * 10, np.array([1, 0] * 10), True)
    rows = quality.classify_quality(edge_docs(spark), m).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify_quality(empty_docs(spark), m).count() == 0
    one = quality.fit_rows(["a b", "c d"], np.array([1, 1]), True)
    assert np.allclose(one.scores(line_arrays(["anything", None])), 0.75)
    assert np.allclose(quality.fit_rows([], np.zeros(0, np.int64), True).scores(line_arrays(["x"])), 0.5)


def test_licences_whole_table(spark, sf):
    rows = {r["doc_id"]: r for r in registry.op10_licences(spark, sf).collect()}
    marks = {"GPL": "GNU General Public License, version 3", "CC-BY-NC": "CC BY-NC 4.0", "MIT": "Released under the MIT License", "Apache-2.0": "Apache License, Version 2.0", "Proprietary": "All rights reserved."}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d["doc_id"]]["families"] == sorted(k for k, v in marks.items() if v in d["text"])
        for n in rows[d["doc_id"]]["notices"]:
            assert 0 <= n["begin"] < n["end"] <= len(d["text"]) and n["cover"] >= licences.MIN_COVER


def test_licence_templates_and_prose():
    m = licences.fit_rows(["ordinary prose about the sea and the license of a driver.\nAll the rights of the many."] * 3)
    for family, notices in licences.TEMPLATES.items():
        for t in notices:
            out = licences.scan([f"Some first line.\n{t}\nSome last line."], m)["families"].to_pylist()[0]
            assert out == [family], (family, t, out)
    for t in ("The licence of this driver was checked under the law.", "Permission to enter was granted, free of charge.", "All rights and wrongs were reserved for later."):
        assert licences.scan([t], m)["families"].to_pylist() == [[]]
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction."
    assert licences.scan([wrapped], m)["families"].to_pylist() == [["MIT"]]


def test_licence_edge_cases(spark):
    m = licences.fit_rows([None, ""])
    rows = licences.scan_licences(edge_docs(spark), m).collect()
    assert len(rows) == len(edge_rows()) and all(not r["families"] for r in rows)
    assert licences.scan_licences(empty_docs(spark), m).count() == 0
    assert licences.scan([licences.TEMPLATES["MIT"][0]], licences.fit(empty_docs(spark)))["families"].to_pylist() == [["MIT"]]


def test_capped_classes_keep_their_share(spark):
    """Where the cap evens the classes out, weights bring their share back: mean scores stay what the labels say."""
    rng = np.random.default_rng(8)
    odd = lambda p, a, b: " ".join(a if rng.random() < p else b for _ in range(12))
    bad = [rng.random() < 0.1 for _ in range(2000)]
    texts = [odd(0.6 if x else 0.4, "idiot", "day") + ".\n" + odd(0.6 if x else 0.4, "### $$$", "plain words") for x in bad]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(not x), int(x)) for i, x in enumerate(bad)], "doc_id long, quality int, toxic int")
    for neighbours in (False, True):
        scores = quality.fit(docs, labels, F.lit(True), neighbours, max_docs=300).scores(line_arrays(texts))
        assert abs(scores.mean() - 0.9) < 0.06
    assert abs(toxicity.fit(docs, labels, F.lit(True), max_docs=300).scores(texts).mean() - 0.1) < 0.06
