"""Toxicity (operator 2): a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word, two prefixes and a suffix.  Filters of several widths slide over the
whole text; each filter's maximum feeds a logistic output that is then calibrated, and for each language a threshold of its own is
chosen on rows kept out of training.  Language never enters the score: it only picks the threshold behind ``flagged``.

Defined cases: a null or empty text has no words and gets the score of all-zero maxima; null ids and repeated rows are carried through;
languages without enough calibration rows, and null languages, use 0.5; a sample with one class only gives a constant score; texts of any length
are read whole, a list of bounded size at a time or one long text by itself; equal texts get equal scores; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_weights, map_texts, training_sample
from .crf import fit_logistic

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
MAX_TRAINING_DOCS = 6000
MIN_LANGUAGE_ROWS = 40
_MARKS = b".,;:!?\"()[]{}<>|#*$%&=+/\\_~`^@"
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split() if text else []


def features(word: bytes) -> tuple[int, int, int, int]:
    """Buckets of the word, its first 5 and 7 bytes and its last 4."""
    return (crc32(word) % BUCKETS, crc32(b"<5" + word[:5]) % BUCKETS, crc32(b"<7" + word[:7]) % BUCKETS, crc32(b">4" + word[-4:]) % BUCKETS)


class Batch:
    """Texts as indexes into the distinct words of the batch; offsets in ``first``."""

    def __init__(self, texts: list[str | None]):
        vocab: dict[bytes, int] = {}
        ids, sizes = [], []
        for t in texts:
            ws = tokens(t)
            sizes.append(len(ws))
            ids.extend([vocab.setdefault(w, len(vocab)) for w in ws])
        self.ids = np.array(ids, np.int32)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rows = np.array([features(w) for w in vocab], np.int32).reshape(-1, 4)
        self._windows: dict[int, tuple] = {}

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts that have a window of this width, where each one's windows begin in the list of windows, and the windows' positions."""
        if width not in self._windows:
            n = np.maximum(np.diff(self.first) - width + 1, 0)
            own = np.flatnonzero(n)
            begins = np.concatenate([[0], np.cumsum(n[own])])[:-1] if len(own) else np.zeros(0, np.int64)
            at = np.repeat(self.first[own] - begins, n[own]) + np.arange(n.sum())
            self._windows[width] = own, begins, at
        return self._windows[width]


@dataclass
class ToxicityModel:
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width -> width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    thresholds: dict[str, float] = field(default_factory=dict)

    def maxima(self, b: Batch, track: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each text and filter the maximum (0 at least) and, if asked for, its first position (-1: none above 0)."""
        n = len(b.first) - 1
        best, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1, np.int64)
        if not len(b.ids):
            return best, where
        vec = self.table[b.rows].sum(1)
        for k, width in enumerate(WIDTHS):
            own, begins, at = b.windows(width)
            if not len(own):
                continue
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            conv = (vec @ self.filters[width][0])[b.ids[at]]
            for j in range(1, width):
                conv += (vec @ self.filters[width][j])[b.ids[at + j]]
            top = np.maximum.reduceat(conv, begins, axis=0)
            best[own, cols] = np.maximum(top + self.bias[cols], 0)
            if track:
                sizes = np.diff(np.concatenate([begins, [len(at)]]))
                pos, f = np.nonzero(conv == np.repeat(top, sizes, 0))
                doc = np.searchsorted(begins, pos, side="right") - 1
                firsts = np.unique(doc * FILTERS + f, return_index=True)[1]
                where[own[doc[firsts]], k * FILTERS + f[firsts]] = at[pos[firsts]]
        where[best <= 0] = -1
        return best, where

    def logits(self, b: Batch) -> np.ndarray:
        return self.maxima(b)[0] @ self.out[1:] + self.out[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.scale[0] + self.scale[1] * self.logits(Batch(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_rows(texts: list[str], toxic: np.ndarray, langs: list[str | None], rounds: int = 12, rate: float = 0.02, seed: int = 7, weight: np.ndarray | None = None) -> ToxicityModel:
    """weight: how many documents each stands for; scores and thresholds are calibrated with it."""
    weight = np.ones(len(toxic)) if weight is None else weight
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    model = ToxicityModel(table, filters, np.full(len(WIDTHS) * FILTERS, -0.2, np.float32), np.zeros(1 + len(WIDTHS) * FILTERS, np.float32))
    if len(set(toxic.tolist())) < 2:
        p = (toxic.sum() + 1) / (len(toxic) + 2)
        model.scale = np.array([np.log(p / (1 - p)), 0.0])
        return model
    # every fifth row calibrates
    held = np.arange(len(toxic)) % 5 == 4
    if len(set(toxic[held].tolist())) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    # embeddings and filters start at random; what they come to look for is learned
    model.out[1:] = 0.3
    model.out[0] = -1.5
    state: dict[str, np.ndarray] = {}

    def step(name: str, theta: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        s = state.setdefault(name, np.full(theta.shape, 1e-6, np.float32))
        s[at] += g * g
        theta[at] -= rate * g / np.sqrt(s[at])

    mixed, n_parts = rng.permutation(train), max(1, len(train) // 256)
    parts = [mixed[a::n_parts] for a in range(n_parts)]
    parts = [(Batch([texts[i] for i in rows]), toxic[rows]) for rows in parts]
    for _ in range(rounds):
        for at_part in rng.permutation(len(parts)):
            b, y = parts[at_part]
            best, where = model.maxima(b, track=True)
            p = 1 / (1 + np.exp(-np.clip(best @ model.out[1:] + model.out[0], -30, 30)))
            g = ((p - y) / len(y)).astype(np.float32)
            back = g[:, None] * model.out[1:]
            step("out", model.out, np.concatenate([[g.sum()], best.T @ g]) + 1e-4 * model.out)
            if not len(b.ids):
                continue
            vec = model.table[b.rows].sum(1)
            words, slopes = [], []
            gb = np.zeros_like(model.bias)
            for k, width in enumerate(WIDTHS):
                gw = np.zeros_like(model.filters[width])
                for f in range(FILTERS):
                    c = k * FILTERS + f
                    docs = np.flatnonzero(where[:, c] >= 0)
                    gb[c] = back[docs, c].sum()
                    for j in range(width):
                        at = b.ids[where[docs, c] + j]
                        gw[j, :, f] = back[docs, c] @ vec[at]
                        words.append(at)
                        slopes.append(back[docs, c, None] * model.filters[width][j, :, f])
                step(f"w{width}", model.filters[width], gw)
            step("bias", model.bias, gb)
            some, place = np.unique(b.rows[np.concatenate(words)].ravel(), return_inverse=True)
            if len(some):
                spread = np.zeros((len(some), DIM), np.float32)
                np.add.at(spread, place, np.repeat(np.concatenate(slopes), 4, 0))
                step("table", model.table, spread, some)
    check = np.flatnonzero(held) if held.any() else train
    z = model.logits(Batch([texts[i] for i in check]))
    model.scale = fit_logistic(np.stack([np.ones_like(z), z], 1).astype(float), toxic[check].astype(float), weight[check], l2=1e-3)
    if model.scale[1] <= 0:
        model.scale = np.array([np.log(weight[toxic == 1][0] / weight[toxic == 0][0]), 1.0])
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] + model.scale[1] * z, -30, 30)))
    for lang in sorted({x for x in langs if x}):
        own = np.array([langs[i] == lang for i in check])
        if own.sum() >= MIN_LANGUAGE_ROWS and 0 < toxic[check][own].sum() < own.sum():
            model.thresholds[lang] = _best_threshold(p[own], toxic[check][own], weight[check][own])
    return model


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the best F1."""
    cuts = np.unique(np.concatenate([p, [0.0, 1.0]]))
    mids = (cuts[1:] + cuts[:-1]) / 2
    f1 = [2 * (weight * y)[p >= t].sum() / max(weight[p >= t].sum() + (weight * y).sum(), 1) for t in mids]
    top = np.flatnonzero(np.isclose(f1, max(f1)))
    return float(mids[top[np.argmax(np.diff(cuts)[top])]])


def fit(docs: DataFrame, labels: DataFrame, allowed, max_docs: int = MAX_TRAINING_DOCS) -> ToxicityModel:
    rows = training_sample(docs, labels, "toxic", allowed, max_docs, extra=("lang",))
    rows.sort(key=lambda r: crc32(str(r[0]).encode()))
    toxic = np.array([r[1] for r in rows], np.int64)
    return fit_rows([r[2] or "" for r in rows], toxic, [r[3] for r in rows], weight=class_weights(labels, "toxic", allowed, max_docs)[toxic])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (score >= threshold), threshold of the row's language, flagged (score >= that threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        s = held.value.scores(texts)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    scored = map_texts(docs, run, "score double, predicted int", extra=("lang",))
    per_lang = F.lit(threshold)
    for lang, t in sorted(model.thresholds.items()):
        per_lang = F.when(F.col("lang") == lang, F.lit(t)).otherwise(per_lang)
    return scored.withColumn("lang_threshold", per_lang).withColumn("flagged", F.col("score") >= F.col("lang_threshold")).drop("lang")
