"""Licence scan (operator 10): a trained paragraph classifier with template comparison.

Each paragraph is scored by softmax regression over sparse word one- and two-grams.  It is trained on licence texts, pieces of them, and
sentences that grant a named licence, varied at random (words dropped, replaced, surrounded by corpus text); the unknown class is learned from
paragraphs of the corpus, notices' words strewn over prose, prose with such words, and sentences that name a licence without granting it.
The score against the unknown class is calibrated on variants and paragraphs that training did not see (Platt's sigmoid at a stated prior).
A predicted family counts only if the paragraph also holds enough of one of the family's template sentences, weighed by the rarity of its words:
the comparison confirms, the classifier decides.  A paragraph that holds enough of no template sentence cannot be confirmed, whatever its
class, and is not scored.

A paragraph is a line, joined with the next while it is short and does not end a sentence (hard-wrapped text); blank lines end it.

Defined cases: null and empty texts have no paragraphs and no licences; null ids and repeated rows are carried through; of equal scores the
family earlier in the list wins; an empty table gives an empty result; texts and paragraphs of any
length are read whole; other columns, whatever their names, take no part.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .crf import fit_logistic
from .licence_texts import GRANTS, MENTIONS, NAMES, PROSE, TEMPLATES

FAMILIES = sorted(TEMPLATES)
#: Corpus paragraphs that train and calibrate the unknown class come from this number of documents, at most.
MAX_SAMPLE_DOCS = 400
#: Variants of each text that are trained on.
VARIANTS = 24
#: Share of a template sentence, weighed by rarity, that a paragraph must hold to confirm a prediction.
MIN_COVER = 0.35
#: Share of paragraphs taken to be notices, to which the calibration is set.
PRIOR = 0.05
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.:;])\s+")
_SPELLED = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
_ENDS = (".", "!", "?", ":", ";")


def paragraphs(text: str | None) -> list[tuple[int, int]]:
    """Spans of a text's paragraphs."""
    out: list[list[int]] = []
    at, open_ = 0, False
    for line in (text or "").split("\n"):
        end, shown = at + len(line), line.strip()
        if shown:
            if open_:
                out[-1][1] = end
            else:
                out.append([at, end])
            open_ = len(line) <= 100 and not shown.endswith(_ENDS)
        else:
            open_ = False
        at = end + 1
    return [(a, b) for a, b in out]


def words(text: str) -> list[str]:
    return [_SPELLED.get(w, w) for w in _WORD.findall(text.lower())]


def template_sentences() -> list[tuple[int, list[str]]]:
    """(class, words) of the sentences of the licence texts, and of plain grants by each of a family's names."""
    out = []
    for c, f in enumerate(FAMILIES, 1):
        seen = set()
        for t in [*TEMPLATES[f], *[f"Licensed under the {n}." for n in NAMES.get(f, [])]]:
            for part in _SENTENCE.split(t):
                ws = tuple(words(part))
                if ws not in seen and (len(ws) >= 4 or part == t):
                    seen.add(ws)
                    out.append((c, list(ws)))
    return out


@dataclass
class LicenceModel:
    ids: dict[str, int]  # words of the training rows
    pairs: np.ndarray  # sorted codes of their two-grams
    weights: np.ndarray  # (words + pairs) x (1 + families); class 0 is unknown
    bias: np.ndarray
    owner: np.ndarray  # of the template sentences' features: the sentence
    feat: np.ndarray  # ... the feature, ascending
    share: np.ndarray  # ... the feature's share of the sentence
    classes: np.ndarray  # of each template sentence
    scale: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # of the margin over the unknown class

    def codes(self, batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Paragraph and feature of each distinct known one- or two-gram."""
        get = self.ids.get
        ids = np.array([get(w, -1) for ws in batch for w in ws], np.int64)
        owner = np.repeat(np.arange(len(batch)), [len(ws) for ws in batch])
        single = np.flatnonzero(ids >= 0)
        two = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (owner[:-1] == owner[1:])) if len(ids) > 1 else np.zeros(0, np.int64)
        code = ids[two] * len(self.ids) + ids[two + 1]
        place = np.searchsorted(self.pairs, code)
        known = self.pairs[np.minimum(place, len(self.pairs) - 1)] == code if len(self.pairs) else np.zeros(len(code), bool)
        n = len(self.ids) + len(self.pairs)
        feats = np.unique(np.concatenate([owner[single] * n + ids[single], owner[two][known] * n + len(self.ids) + place[known]]))
        return feats // n, feats % n

    def logits(self, owner: np.ndarray, feat: np.ndarray, batch: list[list[str]]) -> np.ndarray:
        return _sums(self.weights, owner, feat, len(batch)) / _size(batch)[:, None] + self.bias

    def covers(self, owner: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
        """For each paragraph and template sentence the share of the sentence that the paragraph holds."""
        lo, hi = np.searchsorted(self.feat, feat), np.searchsorted(self.feat, feat, side="right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        place = np.repeat(owner, size) * len(self.classes) + self.owner[at]
        return np.bincount(place, self.share[at], n * len(self.classes)).reshape(n, len(self.classes))

    def predict(self, batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The classifier alone: class (0: unknown) and the probability that it is a notice, of each paragraph."""
        z = self.logits(*self.codes(batch), batch)
        best = z[:, 1:].argmax(1) + 1
        p = 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * (z.max(1, where=np.arange(z.shape[1]) > 0, initial=-np.inf) - z[:, 0]), -30, 30)))
        return np.where(p >= 0.5, best, 0), p

    def classify(self, batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class (0: none), probability and template cover of each paragraph."""
        label, p, cover = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
        for a in range(0, len(batch), 4096):
            part = batch[a:a + 4096]
            covers = self.covers(*self.codes(part), len(part))
            some = np.flatnonzero(covers.max(1) >= MIN_COVER)
            if not len(some):
                continue
            best, prob = self.predict([part[i] for i in some])
            own = np.where(self.classes[None, :] == best[:, None], covers[some], 0).max(1)
            label[a + some], p[a + some], cover[a + some] = np.where(own >= MIN_COVER, best, 0), prob, own
        return label, p, cover


def _size(batch: list[list[str]]) -> np.ndarray:
    return np.sqrt(np.minimum([max(len(ws), 1) for ws in batch], 40))


def _sums(weights: np.ndarray, owner: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
    """Sum of the features' weights of each paragraph; owner ascends."""
    out = np.zeros((n, weights.shape[1]), weights.dtype)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.add.reduceat(weights[feat], first, axis=0)
    return out


def _variants(rng, ws: list[str], filler: list[str], n: int) -> list[list[str]]:
    """The words as they are, pieces of them, and with words dropped, replaced, and put into other text."""
    out = [list(ws)]
    for v in range(n - 1):
        part = list(ws)
        if len(ws) > 16 and v % 2:
            k = int(rng.integers(10, len(ws)))
            a = int(rng.integers(0, len(ws) - k + 1))
            part = part[a:a + k]
        if v % 3:
            part = [w if rng.random() > 0.05 else filler[rng.integers(len(filler))] for w in part if rng.random() > 0.06]
        if v % (4 if len(ws) > 16 else 2) == 1:
            before, after = rng.integers(0, 12, 2)
            part = [filler[k] for k in rng.integers(len(filler), size=before)] + part + [filler[k] for k in rng.integers(len(filler), size=after)]
        out.append(part or list(ws))
    return out


def _positives() -> list[tuple[int, list[str]]]:
    out = [(c, words(t)) for c, f in enumerate(FAMILIES, 1) for t in TEMPLATES[f]]
    out += [(c, ws) for c, ws in template_sentences() if len(ws) >= 8]
    return out + [(c, words(g.format(n=n))) for c, f in enumerate(FAMILIES, 1) for n in NAMES.get(f, []) for g in GRANTS]


def fit_rows(texts: list[str | None], seed: int = 11, epochs: int = 14, rate: float = 0.5) -> LicenceModel:
    rng = np.random.default_rng(seed)
    templates = template_sentences()
    corpus = [words(t[a:b]) for t in texts if t for a, b in paragraphs(t)]
    corpus = [corpus[i] for i in rng.permutation(len(corpus))]
    plain = [w for ws in corpus[:400] for w in ws[:50]] or words(" ".join(PROSE))
    strewn = [w for _, ws in templates for w in ws]
    scattered = [[plain[rng.integers(len(plain))] if rng.random() < 0.7 else strewn[rng.integers(len(strewn))] for _ in range(rng.integers(3, 40))] for _ in range(800)]
    unlike = [words(m.format(n=n)) for f in FAMILIES for n in NAMES.get(f, []) for m in MENTIONS] + [words(p) for p in PROSE for _ in range(4)]
    negatives = scattered + [v for ws in unlike for v in _variants(rng, ws, plain, 5)]
    positives = [(c, v) for c, ws in _positives() for v in _variants(rng, ws, plain, VARIANTS if len(ws) > 12 else VARIANTS // 2)]
    rows = [*[v for _, v in positives], *negatives, *corpus]
    kinds = np.array([c for c, _ in positives] + [0] * (len(negatives) + len(corpus)))

    # words and two-grams that at least two rows hold
    vocab = _seen_twice(rows, lambda ws: set(ws))
    pair_set = _seen_twice(rows, lambda ws: {(a, b) for a, b in zip(ws, ws[1:]) if a in vocab and b in vocab})
    for _, ws in templates:
        for w in ws:
            vocab.setdefault(w, len(vocab))
    pair_set = {**pair_set, **{p: 0 for _, ws in templates for p in zip(ws, ws[1:])}}
    pairs = np.unique(np.array([vocab[a] * len(vocab) + vocab[b] for a, b in pair_set], np.int64))
    model = LicenceModel(vocab, pairs, np.zeros((len(vocab) + len(pairs), len(FAMILIES) + 1), np.float32), np.zeros(len(FAMILIES) + 1, np.float32),
                         np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.array([c for c, _ in templates]))
    # a feature's share of a template sentence is its rarity among paragraphs that are no notices
    owner, feat = model.codes([*negatives, *corpus])
    rarity = np.log(1 + (len(negatives) + len(corpus)) / (1 + np.bincount(feat, minlength=len(model.weights))))
    t_owner, t_feat = model.codes([ws for _, ws in templates])
    mass = np.bincount(t_owner, rarity[t_feat], len(templates))
    order = np.argsort(t_feat, kind="stable")
    model.owner, model.feat, model.share = t_owner[order], t_feat[order], (rarity[t_feat] / mass[t_owner])[order]

    # a corpus paragraph that holds most of a template sentence is no example of the unknown class
    n_own = len(rows) - len(corpus)
    keep = np.ones(len(rows), bool)
    for a in range(0, len(corpus), 4096):
        part = corpus[a:a + 4096]
        keep[n_own + a:n_own + a + len(part)] = model.covers(*model.codes(part), len(part)).max(1) < 0.6
    order = rng.permutation(np.flatnonzero(keep))
    check, train = order[::4], np.setdiff1d(order, order[::4])
    owner, feat = model.codes(rows)
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    scale = 1 / _size(rows)
    weight = np.sqrt(len(train) / np.maximum(np.bincount(kinds[train], minlength=len(FAMILIES) + 1), 1))[kinds]
    target = np.eye(len(FAMILIES) + 1, dtype=np.float32)[kinds]
    state_w, state_b = np.full_like(model.weights, 1e-8), np.full_like(model.bias, 1e-8)
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for a in range(0, len(mixed), 256):
            some = mixed[a:a + 256]
            size = first[some + 1] - first[some]
            at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            own, f = np.repeat(np.arange(len(some)), size), feat[at]
            z = _sums(model.weights, own, f, len(some)) * scale[some][:, None] + model.bias
            e = np.exp(z - z.max(1, keepdims=True))
            g = ((e / e.sum(1, keepdims=True) - target[some]) * weight[some][:, None] / len(some)).astype(np.float32)
            sort = np.argsort(f, kind="stable")
            used, starts = np.unique(f[sort], return_index=True)
            if len(used):
                gw = np.add.reduceat((g * scale[some][:, None].astype(np.float32))[own[sort]], starts, axis=0) + 1e-6 * model.weights[used]
                state_w[used] += gw * gw
                model.weights[used] -= rate * gw / np.sqrt(state_w[used])
            gb = g.sum(0)
            state_b += gb * gb
            model.bias -= 0.1 * gb / np.sqrt(state_b)
    # the calibration sees rows that training did not, the unknown ones weighed to the stated prior
    held = [rows[i] for i in check]
    z = model.logits(*model.codes(held), held)
    gap = z[:, 1:].max(1) - z[:, 0]
    notice = (kinds[check] > 0).astype(float)
    if 0 < notice.sum() < len(notice):
        shares = np.where(notice > 0, PRIOR / notice.mean(), (1 - PRIOR) / (1 - notice.mean()))
        model.scale = fit_logistic(np.stack([np.ones_like(gap), gap], 1).astype(float), notice, shares, l2=1e-4)
    return model


def _seen_twice(rows: list[list[str]], grams) -> dict:
    once, twice = set(), {}
    for ws in rows:
        for g in grams(ws):
            if g in once:
                twice.setdefault(g, len(twice))
            else:
                once.add(g)
    return twice


def fit(docs: DataFrame, max_docs: int = MAX_SAMPLE_DOCS) -> LicenceModel:
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # hashes alone are sorted; max_docs bounds the broadcast, and one text per hash comes back
    some = texts.select("h").distinct().orderBy("h").limit(max_docs)
    rows = texts.join(F.broadcast(some), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")).collect()
    return fit_rows([r["text"] for r in sorted(rows, key=lambda r: r["h"])])


def scan(texts: list[str | None], model: LicenceModel) -> dict[str, pa.Array]:
    spans = [paragraphs(t) for t in texts]
    batch = [words(t[a:b]) for t, ps in zip(texts, spans) for a, b in ps]
    label, p, cover = model.classify(batch) if batch else (np.zeros(0, int),) * 3
    at, n_par, found, families = 0, [], [], []
    for ps in spans:
        rows = []
        for k, (a, b) in enumerate(ps):
            if label[at + k]:
                rows.append({"family": FAMILIES[label[at + k] - 1], "begin": a, "end": b, "probability": float(p[at + k]), "cover": float(cover[at + k])})
        at += len(ps)
        n_par.append(len(ps))
        found.append(rows)
        families.append(sorted({r["family"] for r in rows}))
    kind = pa.list_(pa.struct([("family", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("cover", pa.float64())]))
    return {"n_paragraphs": pa.array(n_par, pa.int64()), "families": pa.array(families, pa.list_(pa.string())), "notices": pa.array(found, kind)}


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Operator 10: doc_id, n_paragraphs, families, notices (family, span, probability, template cover) of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: scan(texts, held.value), "n_paragraphs long, families array<string>, notices array<struct<family string, begin long, end long, probability double, cover double>>")
