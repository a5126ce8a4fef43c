"""Quality rules (operator 4) and the quality classifier (operator 6): conditional random fields over a text's lines.

Both label each line of a whole text good (content) or bad (boilerplate) with a linear chain trained on ``labels.quality``:
operator 4 decodes the best label sequence (Viterbi) and keeps a document by its share of content words; operator 6 takes
forward-backward marginals, weighted by line length, and calibrates them into a score.

Defined cases: a null text is an empty text; an empty text has no words, fails the base rules, and gets a score like any other; a null
doc_id is carried through; repeated rows are scored each; an empty table gives an empty result; texts of any
length are read whole, a long one as a chain of all its lines; other columns, whatever their names, take no part.  If the
sample lacks one of the two classes, a neutral model is used: operator 4 keeps what passes the base rules, operator 6 gives every text
the observed class's smoothed share.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, class_weights, filter_texts, map_texts, training_sample
from .crf import Chain, fit_lines, fit_logistic
from .lines import Lines, line_arrays, line_features

#: Labelled rows that a model is fitted on, at most.
MAX_TRAINING_DOCS = 4000


def _neutral(x: np.ndarray) -> Chain:
    w = np.zeros(x.shape[1])
    w[0] = -2.0
    return Chain(w, np.zeros((2, 2)))


def _sample_lines(texts: list[str], neighbours: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, Lines]:
    parts = [line_arrays(texts[a:b]) for a, b in chunks(texts, 2_000_000)] or [line_arrays([""])]
    x = np.concatenate([line_features(p, neighbours) for p in parts])
    sizes = np.concatenate([np.diff(p.first_line) for p in parts])
    words = np.concatenate([p.words for p in parts])
    return x, np.concatenate([[0], np.cumsum(sizes)]), words, parts


def _doc_inputs(share: np.ndarray, words: np.ndarray) -> np.ndarray:
    s = np.clip(share, 1e-3, 1 - 1e-3)
    return np.stack([np.ones_like(s), np.log(s / (1 - s)), np.log1p(words) / 4, words < 10], axis=1)


@dataclass
class QualityModel:
    chain: Chain
    neighbours: bool
    dense: np.ndarray  # of _doc_inputs

    def line_labels(self, x: Lines) -> np.ndarray:
        return self.chain.viterbi(line_features(x, self.neighbours), x.first_line)

    def scores(self, x: Lines) -> np.ndarray:
        share, words = _share(self.chain, line_features(x, self.neighbours), x.first_line, x.words)
        return 1 / (1 + np.exp(-np.clip(_doc_inputs(share, words) @ self.dense, -30, 30)))


def _share(chain: Chain, x: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean of the lines' P(good); 0.5 where a text has no words."""
    good = 1 - chain.marginals(x, first)[0]
    total = np.concatenate([[0.0], np.cumsum(good * words)])
    n = np.concatenate([[0], np.cumsum(words)])
    num, den = total[first[1:]] - total[first[:-1]], (n[first[1:]] - n[first[:-1]]).astype(float)
    return np.where(den > 0, num / np.maximum(den, 1), 0.5), den


def fit(docs: DataFrame, labels: DataFrame, allowed, neighbours: bool, max_docs: int = MAX_TRAINING_DOCS) -> QualityModel:
    rows = training_sample(docs, labels, "quality", allowed, max_docs)
    quality = np.array([r[1] for r in rows], np.int64)
    return fit_rows([r[2] or "" for r in rows], quality, neighbours, class_weights(labels, "quality", allowed, max_docs)[quality])


def fit_rows(texts: list[str], quality: np.ndarray, neighbours: bool, weight: np.ndarray | None = None) -> QualityModel:
    """weight: how many documents each stands for."""
    x, first, words, _ = _sample_lines(texts, neighbours)
    if len(set(quality.tolist())) < 2:
        p = (quality.sum() + 1) / (len(quality) + 2)
        return QualityModel(_neutral(x), neighbours, np.array([np.log(p / (1 - p)), 0, 0, 0]))
    weight = np.ones(len(quality)) if weight is None else weight
    chain = fit_lines(x, first, words, 1 - quality, weight)
    share, n = _share(chain, x, first, words)
    return QualityModel(chain, neighbours, fit_logistic(_doc_inputs(share, n), quality.astype(float), weight, l2=1e-4))


def rule_columns(texts: list[str | None], model: QualityModel, min_words: int, max_repeat_pct: int, min_content_pct: int) -> dict[str, np.ndarray]:
    x = line_arrays(texts)
    c = {k: x.by_doc(v) for k, v in x.counts.items()}
    n_words = x.by_doc(x.words)
    n_repeat = x.by_doc(x.repeated)
    n_chars = np.array([len(t) if t else 0 for t in texts], np.int64)
    # every line counts its own line end as a space; a text has one line end fewer than lines
    word_chars = n_chars - (c["space"] - 1)
    failed = (n_words < min_words) | (100 * n_repeat > max_repeat_pct * n_words)
    content = x.by_doc(x.words * (model.line_labels(x) == 0))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": c["symbol"], "n_dup_lines": x.by_doc(x.duplicate), "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & (100 * content >= min_content_pct * n_words), "content_words": content,
    }


MIN_WORDS, MAX_REPEAT_PCT, MIN_CONTENT_PCT, THRESHOLD = 50, 50, 50, 0.7


def quality_rules(docs: DataFrame, model: QualityModel, *, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, min_content_pct: int = MIN_CONTENT_PCT) -> DataFrame:
    """Operator 4: base counts and rules, then the share of words in lines that Viterbi decoding labels content decides."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: rule_columns(texts, held.value, min_words, max_repeat_pct, min_content_pct),
                     "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long")


def filter_rules(docs: DataFrame, model: QualityModel, *, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, min_content_pct: int = MIN_CONTENT_PCT) -> DataFrame:
    """The rows that operator 4 keeps."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: rule_columns(texts, held.value, min_words, max_repeat_pct, min_content_pct)["kept"])


def filter_quality(docs: DataFrame, model: QualityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that operator 6 predicts to be good."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: held.value.scores(line_arrays(texts)) >= threshold)


def classify_quality(docs: DataFrame, model: QualityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """Operator 6: doc_id, score (P(quality = 1)) and predicted (score >= threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        s = held.value.scores(line_arrays(texts))
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_texts(docs, run, "score double, predicted int")


def crc_fold(mod: int, col: str = "doc_id"):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(col).cast("long").cast("string").cast("binary")) % mod
