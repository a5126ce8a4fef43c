"""Scores of fitted models against plain-Python forward passes over a whole table, and what training adds to simpler models."""
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import crf, licences, quality, registry, toxicity
from quorate.llm.licence_texts import NAMES
from quorate.llm.lines import line_arrays, line_features

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_features(text, neighbours):
    """A text's lines as (words, features), by plain loops over characters."""
    lines = (text or "").split("\n")
    words = [WORD.findall(x) for x in lines]
    flat = [w for ws in words for w in ws]
    tri = Counter(zip(flat, flat[1:], flat[2:]))
    again = [False] * len(flat)
    for i in range(len(flat) - 2):
        if tri[tuple(flat[i:i + 3])] > 1:
            again[i] = again[i + 1] = again[i + 2] = True
    rows, seen, at = [], set(), 0
    for line, ws in zip(lines, words):
        data = line.encode()
        n, size, w = len(ws), max(len(data), 1), max(len(ws), 1)
        of = lambda f: sum(map(f, data))
        upper, lower, wide = of(lambda c: 65 <= c <= 90), of(lambda c: 97 <= c <= 122), of(lambda c: c >= 192)
        letters = max(upper + lower + wide, 1)
        runs = sum(1 for i in range(at, at + n) if i and flat[i] == flat[i - 1])
        rows.append([math.log1p(n) / 4, n == 0, n < 4, upper / letters, min(of(lambda c: c in b"#*$%&|<>") / w, 2), min(of(lambda c: c in b"!?") / w, 2), min(of(lambda c: c == 124) / w, 2),
                     of(lambda c: 48 <= c <= 57) / size, min(of(lambda c: c in b".,;:") / w, 1), min(letters / w / 10, 2), sum(again[at:at + n]) / w, runs / w, n > 0 and line in seen])
        if n:
            seen.add(line)
        at += n
    rows = [[float(x) for x in r] for r in rows]
    out = []
    for i, r in enumerate(rows):
        beside = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows)]
        mean = [sum(x) / len(beside) for x in zip(*beside)] if beside else [0.0] * 13
        out.append([1.0, *r, *mean, float(i == 0), float(i == len(rows) - 1)] if neighbours else [1.0, *r])
    return [len(w) for w in words], out


def brute_quality(model, text):
    """(score, content words) by sums over the chain, one line after another."""
    n, rows = brute_features(text, model.neighbours)
    e = [(0.0, float(np.dot(r, model.chain.weights))) for r in rows]
    m = model.chain.moves.tolist()
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    a, best, back = [e[0]], [e[0]], []
    for x in e[1:]:
        a.append(tuple(x[j] + add([a[-1][i] + m[i][j] for i in (0, 1)]) for j in (0, 1)))
        ways = [[best[-1][i] + m[i][j] for i in (0, 1)] for j in (0, 1)]
        back.append([int(w[1] > w[0]) for w in ways])
        best.append(tuple(x[j] + max(ways[j]) for j in (0, 1)))
    b = [(0.0, 0.0)]
    for x in e[:0:-1]:
        b.insert(0, tuple(add([m[i][j] + x[j] + b[0][j] for j in (0, 1)]) for i in (0, 1)))
    good = [1 / (1 + math.exp(min(700, y[1] + z[1] - y[0] - z[0]))) for y, z in zip(a, b)]
    label = [int(best[-1][1] > best[-1][0])]
    for way in back[::-1]:
        label.insert(0, way[label[0]])
    total = sum(n)
    share = min(max(sum(g * k for g, k in zip(good, n)) / total if total else 0.5, 1e-3), 1 - 1e-3)
    z = float(np.dot([1, math.log(share / (1 - share)), math.log1p(total) / 4, total < 10], model.dense))
    return 1 / (1 + math.exp(-z)), sum(k for k, y in zip(n, label) if y == 0)


def test_quality_scores_by_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    classifier, rules = quality.fit(docs, labels, quality.crc_fold(4) != 2, True), quality.fit(docs, labels, F.lit(True), False)
    got = registry.op6_quality_classifier(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r["score"], brute_quality(classifier, texts[r["doc_id"]])[0], abs_tol=1e-6)
    got = registry.op4_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        content = brute_quality(rules, texts[r["doc_id"]])[1]
        assert r["content_words"] == content and r["kept"] == (not r["base_failed"] and 100 * content >= 50 * r["n_words"])


def brute_toxicity(model, text):
    vectors = [model.table[list(toxicity.features(w))].astype(float).sum(0) for w in toxicity.tokens(text)]
    z = float(model.out[0])
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            c = k * toxicity.FILTERS + f
            sums = [sum(float(vectors[i + j] @ model.filters[width][j][:, f]) for j in range(width)) + float(model.bias[c]) for i in range(len(vectors) - width + 1)]
            z += float(model.out[1 + c]) * max([0.0, *sums])
    return 1 / (1 + math.exp(-max(-30, min(30, model.scale[0] + model.scale[1] * z))))


def test_toxicity_scores_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), quality.crc_fold(5) != 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in registry.op2_toxicity(spark, sf).collect():
        assert math.isclose(r["score"], brute_toxicity(model, texts[r["doc_id"]]), abs_tol=1e-3)


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "text", "lang", "quality", "toxic").collect()
    return sorted({tuple(r) for r in rows}, key=lambda r: crc32(str(r[0]).encode()))


def test_training_lifts_the_convolution(labelled):
    train = [r for r in labelled if crc32(str(r[0]).encode()) % 5]
    test = [r for r in labelled if crc32(str(r[0]).encode()) % 5 == 0]
    y = np.array([r[4] for r in test])

    def accuracy(**how):
        m = toxicity.fit_rows([r[1] for r in train], np.array([r[4] for r in train]), [r[2] for r in train], **how)
        return ((m.scores([r[1] for r in test]) >= 0.5) == y).mean()

    trained, untrained = accuracy(), accuracy(rounds=0)
    assert trained >= 0.98 and trained > untrained + 0.05


@pytest.mark.parametrize("neighbours", [False, True])
def test_chain_is_as_good_as_its_line_model(labelled, neighbours):
    """Held-out rows of four folds: the chain decides documents as well as the line model that it starts from, and fits their labels better or as well."""
    fold = np.array([crc32(str(r[0]).encode()) % 4 for r in labelled])
    good = np.array([r[3] for r in labelled])
    wrong, loss = Counter(), Counter()
    for f in range(4):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        x, first, words, _ = quality._sample_lines([labelled[i][1] for i in train], neighbours)
        one = np.ones(len(train))
        chains = {"chain": crf.fit_lines(x, first, words, 1 - good[train], one), "line": crf.Chain(crf.line_model(x, first, words, 1 - good[train], one)[0], np.zeros((2, 2)))}
        assert (np.diag(chains["chain"].moves) > 0.05).all()
        for name, chain in chains.items():
            share, n = quality._share(chain, x, first, words)
            model = quality.QualityModel(chain, neighbours, crf.fit_logistic(quality._doc_inputs(share, n), good[train].astype(float), one, l2=1e-4))
            texts, y = [labelled[i][1] for i in test], good[test]
            if neighbours:
                s = model.scores(line_arrays(texts))
                wrong[name] += int(((s >= 0.7) != y).sum())
                loss[name] -= float(np.log(np.where(y == 1, s, 1 - s)).sum())
            else:
                got = quality.rule_columns(texts, model, 50, 50, 50)
                wrong[name] += int(((got["kept"] != (y == 1)) & ~got["base_failed"]).sum())
    # one document in 4,000 is within what the fit's last digits decide
    assert wrong["chain"] <= wrong["line"] + (1 if neighbours else 0), wrong
    assert wrong["chain"] < 0.005 * len(labelled)


OFFERS = ["Our code is offered to everyone under the {n}.", "Everything in this folder is provided under the {n}, see COPYING.", "The library and its tools come under the {n}.", "This module is free to use under the {n}."]
TALK = ["Nobody had read the {n} before the meeting.", "They compared the {n} with older texts in class.", "This library is no longer licensed under the {n}.", "I wonder who wrote the {n} and when."]


def test_licence_classifier_decides_where_cover_alone_errs(spark):
    """Sentences that training has not: grants in other words and mentions that grant nothing. No threshold on template cover does as well."""
    from quorate.llm import licence_texts

    assert not set(OFFERS + TALK) & set(licence_texts.GRANTS + licence_texts.MENTIONS)
    m = licences.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rows = [(c if s in OFFERS else 0, licences.words(s.format(n=n))) for s in OFFERS + TALK for c, f in enumerate(licences.FAMILIES, 1) for n in NAMES.get(f, [])]
    want, batch = np.array([c for c, _ in rows]), [ws for _, ws in rows]
    label, _, _ = m.classify(batch)
    right = (label == want).mean()
    assert (label == want)[want > 0].mean() > 0.97 and (label == want)[want == 0].mean() > 0.85
    covers = m.covers(*m.codes(batch), len(batch))
    top, best = covers.max(1), m.classes[covers.argmax(1)]
    alone = max((np.where(top >= t, best, 0) == want).mean() for t in np.arange(0.1, 1.0, 0.02))
    assert right > alone + 0.1, (right, alone)
    # what cover alone misses at a strict threshold, and what it takes at that of the operator
    missed, taken = (want > 0) & (top < 0.9), (want == 0) & (top >= licences.MIN_COVER)
    assert missed.sum() > 50 and (label == want)[missed].mean() > 0.95
    assert taken.sum() > 150 and (label[taken] == 0).mean() > 0.85


def test_licence_classifier_needs_confirmation():
    m = licences.fit_rows(["ordinary prose about the sea"] * 3)
    ws = licences.words("granted license distributed copies redistribute warranty released")
    label, _, cover = m.classify([ws])
    assert label[0] == 0 and cover[0] < licences.MIN_COVER


def test_licence_screen_changes_nothing(labelled):
    """Scoring only paragraphs that hold enough of some template gives what scoring all of them would."""
    texts = [r[1] for r in labelled[:1500]]
    m = licences.fit_rows(texts[:300])
    batch = [licences.words(t[a:b]) for t in texts for a, b in licences.paragraphs(t)]
    label, _, _ = m.classify(batch)
    every, _ = m.predict(batch)
    covers = np.concatenate([m.covers(*m.codes(batch[a:a + 2000]), len(batch[a:a + 2000])) for a in range(0, len(batch), 2000)])
    own = np.where(m.classes[None, :] == every[:, None], covers, 0).max(1)
    assert (label == np.where(own >= licences.MIN_COVER, every, 0)).all() and (label > 0).sum() > 20


def test_line_features_by_brute_force(labelled):
    for r in labelled[:60]:
        for neighbours in (False, True):
            assert np.allclose(line_features(line_arrays([r[1]]), neighbours), brute_features(r[1], neighbours)[1])


def plain_licence(model, text):
    """(n_paragraphs, [(family, begin, end, probability, cover)]) of a text by loops over the fitted model's numbers."""
    n, rows = len(model.ids), []
    pairs = {int(c): n + k for k, c in enumerate(model.pairs)}
    mass: dict[int, dict[int, float]] = {}
    for sentence, feature, share in zip(model.owner.tolist(), model.feat.tolist(), model.share.tolist()):
        mass.setdefault(feature, {})[sentence] = share
    spans, at, open_ = [], 0, False
    for line in (text or "").split("\n"):
        if line.strip():
            if open_:
                spans[-1][1] = at + len(line)
            else:
                spans.append([at, at + len(line)])
            open_ = len(line) <= 100 and line.strip()[-1] not in ".!?:;"
        else:
            open_ = False
        at += len(line) + 1
    for a, b in spans:
        ws = licences.words(text[a:b])
        ids = [model.ids.get(w, -1) for w in ws]
        found = {i for i in ids if i >= 0} | {pairs[x * n + y] for x, y in zip(ids, ids[1:]) if x >= 0 and y >= 0 and x * n + y in pairs}
        cover: dict[int, float] = {}
        for f in sorted(found):
            for sentence, share in mass.get(f, {}).items():
                cover[sentence] = cover.get(sentence, 0.0) + share
        if max(cover.values(), default=0.0) < licences.MIN_COVER:
            continue
        size = math.sqrt(min(max(len(ws), 1), 40))
        z = [sum(float(model.weights[f, c]) for f in found) / size + float(model.bias[c]) for c in range(model.weights.shape[1])]
        best = max(range(1, len(z)), key=lambda c: (z[c], -c))
        p = 1 / (1 + math.exp(-(model.scale[0] + model.scale[1] * (z[best] - z[0]))))
        own = max((v for s, v in cover.items() if model.classes[s] == best), default=0.0)
        if p >= 0.5 and own >= licences.MIN_COVER:
            rows.append((licences.FAMILIES[best - 1], a, b, p, own))
    return len(spans), rows


def test_licences_by_plain_loops_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = licences.fit(docs)
    got = {r["doc_id"]: r for r in licences.scan_licences(docs, model).collect()}
    notices = 0
    for d in docs.select("doc_id", "text").collect():
        n, rows = plain_licence(model, d["text"])
        r = got[d["doc_id"]]
        assert r["n_paragraphs"] == n and r["families"] == sorted({x[0] for x in rows})
        assert [(x["family"], x["begin"], x["end"]) for x in r["notices"]] == [x[:3] for x in rows]
        assert all(abs(x["probability"] - y[3]) < 1e-4 and abs(x["cover"] - y[4]) < 1e-9 for x, y in zip(r["notices"], rows))
        notices += len(rows)
    assert notices > 3
    for t in ["Licensed under the MIT License.", *[x for f in licences.FAMILIES for x in licences.TEMPLATES[f]], "The MIT License is short.", ""]:
        assert [x["family"] for x in licences.scan([t], model)["notices"].to_pylist()[0]] == [x[0] for x in plain_licence(model, t)[1]]
