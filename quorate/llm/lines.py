"""Line and word statistics of many texts at once, in numpy.

A text is cut at every newline; words are runs of bytes other than space and 0x09-0x0D.  A null text is an empty text: one line
without words.  All arrays are flat; ``first_line[d]`` is where document d's lines begin.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def _lut(chars) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_SPACE = _lut(SPACES)
_CLASSES = {
    "upper": _lut(range(65, 91)),
    "lower": _lut(range(97, 123)),
    "digit": _lut(range(48, 58)),
    "symbol": _lut(SYMBOLS),
    "bang": _lut(b"!?"),
    "pipe": _lut(b"|"),
    "stop": _lut(b".,;:"),
    "wide": _lut(range(192, 256)),
    "tail": _lut(range(128, 192)),
}


@dataclass
class Lines:
    first_line: np.ndarray
    first_word: np.ndarray
    words: np.ndarray
    size: np.ndarray
    duplicate: np.ndarray
    repeated: np.ndarray
    runs: np.ndarray
    counts: dict[str, np.ndarray]

    def by_doc(self, per_line: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_line, dtype=np.int64)])
        return total[self.first_line[1:]] - total[self.first_line[:-1]]


def line_arrays(texts: list[str | None]) -> Lines:
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    blob = b"\n".join([*data, b""])
    arr = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(arr == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    first_line = np.concatenate([[0], np.cumsum([d.count(b"\n") + 1 for d in data], dtype=np.int64)])
    space = _SPACE[arr]
    begins = np.ones(len(arr), np.uint8)
    begins[1:] = space[:-1]
    begins &= 1 - space
    per_line = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    n_words = per_line(begins)
    counts = {k: per_line(v[arr]) for k, v in _CLASSES.items()}
    counts["space"] = per_line(space)

    words = blob.split()
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    word_end = np.cumsum(n_words)
    word_start = word_end - n_words
    doc_words = np.concatenate([[0], np.cumsum(n_words)])[first_line]
    doc = np.repeat(np.arange(len(data), dtype=np.uint64), np.diff(doc_words))
    again = np.zeros(len(h), bool)
    if len(h) > 2:
        with np.errstate(over="ignore"):
            key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc[2:] * np.uint64(0x94D049BB133111EB)
        own = np.flatnonzero(doc[:-2] == doc[2:])
        order = own[np.argsort(key[own])]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        for k in range(3):
            again[at + k] = True
    run = np.zeros(len(h), bool)
    run[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    sums = lambda flags: (t := np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))[word_end] - t[word_start]

    duplicate = np.zeros(len(starts), np.int64)
    texts_of = blob.split(b"\n")
    for d in np.flatnonzero(np.diff(first_line) > 1):
        seen: set[bytes] = set()
        for i in range(first_line[d], first_line[d + 1]):
            if n_words[i]:
                if texts_of[i] in seen:
                    duplicate[i] = 1
                seen.add(texts_of[i])
    return Lines(first_line, doc_words, n_words, ends - starts, duplicate, sums(again), sums(run), counts)


def line_features(x: Lines, neighbours: bool) -> np.ndarray:
    """One row of features for each line; with ``neighbours``, the mean of the two adjacent lines' features of the same text beside its own."""
    c, w = x.counts, np.maximum(x.words, 1)
    letters = np.maximum(c["upper"] + c["lower"] + c["wide"], 1)
    size = np.maximum(x.size, 1)
    own = np.stack([
        np.log1p(x.words) / 4,
        x.words == 0,
        x.words < 4,
        c["upper"] / letters,
        np.minimum(c["symbol"] / w, 2),
        np.minimum(c["bang"] / w, 2),
        np.minimum(c["pipe"] / w, 2),
        c["digit"] / size,
        np.minimum(c["stop"] / w, 1),
        np.minimum(letters / w / 10, 2),
        x.repeated / w,
        x.runs / w,
        x.duplicate,
    ], axis=1).astype(np.float64)
    if not neighbours:
        return np.concatenate([np.ones((len(own), 1)), own], axis=1)
    n = len(own)
    line = np.arange(n)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    opens[x.first_line[:-1]] = closes[x.first_line[1:] - 1] = True
    before = np.where(opens[:, None], 0, own[np.maximum(line - 1, 0)])
    after = np.where(closes[:, None], 0, own[np.minimum(line + 1, n - 1)])
    beside = (before + after) / np.maximum(2 - opens.astype(int) - closes.astype(int), 1)[:, None]
    return np.concatenate([np.ones((n, 1)), own, beside, opens[:, None], closes[:, None]], axis=1)
