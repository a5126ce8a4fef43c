"""BPE with word ends by a segment tree over adjacent pair ranks (operator 11).

A piece of text starts as one symbol for each byte, the last marked as the word's end.  Leaf i of a segment tree holds the rank of the pair
that begins at symbol i, with i itself below it, so that the root, the least leaf, is the leftmost pair of the lowest rank.  Merging it
changes three leaves: that of the pair, that of its right half, which goes, and that of the pair to the left; each takes a logarithmic number
of steps, so that a piece of n symbols takes n log n however long it is.  It ends when the root holds no pair.

Texts are cut and normalised as the vocabulary's file says: special tokens are found in the raw text; what lies between them is composed
(NFC), lower-cased code point by code point, and cut into contractions, letters, single digits and other signs, without white space.  Text
below U+0250, where composing changes nothing, is cut by one pattern; other text goes through the file's own normaliser and pre-tokeniser.

Defined cases: a null text is an empty text, with no ids and the digests of no bytes; an empty table gives an empty result; texts may be of any
length, as may a piece without a space; null ids and repeated rows are carried through, each row by itself; other columns, whatever
their names, are not read.
"""
from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Pieces that a worker remembers at most; beyond it the cache starts anew. Longer pieces than REMEMBERED_CHARS are not remembered.
MAX_CACHED = 800_000
REMEMBERED_CHARS = 64
#: Above every leaf: no pair.
NONE = 1 << 62
#: Bits of a leaf that hold its place.
PLACE_BITS = 32
#: From this code point on the vocabulary's own normaliser and pre-tokeniser cut a text.
PLAIN_BELOW = "ɐ"
#: Signs that str.split() takes for white space and the vocabulary's pattern does not.
NO_SPACE = "\x1c\x1d\x1e\x1f"
#: The pieces of lower-cased text below PLAIN_BELOW; its white space is that of Unicode, which lacks U+001C to U+001F.
PLAIN_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


class PairTree:
    """Ranks of adjacent pairs; the root is the least (rank, place)."""

    __slots__ = ("size", "tree")

    def __init__(self, leaves: list[int]):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.tree = tree = [NONE] * self.size + leaves + [NONE] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

    def put(self, place: int, leaf: int) -> None:
        tree, k = self.tree, self.size + place
        tree[k] = leaf
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            least = leaf if leaf < other else other
            if tree[k] == least:
                break
            tree[k] = leaf = least

    def root(self) -> int:
        return self.tree[1]


def byte_signs() -> list[str]:
    """The sign that stands for each byte: printable ones for themselves, the others in order from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Words(dict):
    """What stands between two spaces -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: "WordBpe"):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.encode_pieces(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = ids
        return ids


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        # a pair of ids as one number -> its rank, above its place in the tree; and rank -> the id that the pair becomes
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.wide = max(vocab.values()) + 1
        self.ranks = {vocab[a] * self.wide + vocab[b]: rank << PLACE_BITS for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        signs = byte_signs()
        self.inner, self.last = [vocab.get(s) for s in signs], [vocab.get(s + self.suffix) for s in signs]
        self._full = Tokenizer.from_file(path)
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._byte_of = {s: b for b, s in enumerate(signs)}
        self._known: dict[str, bytes] = {}
        self.words = _Words(self)

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        return _load(path)

    def merge(self, ids: list[int]) -> list[int]:
        """Join the leftmost pair of the lowest rank until none is left."""
        n = len(ids)
        if n < 2:
            return ids
        ids, wide, ranks, made = list(ids), self.wide, self.ranks.get, self.made
        pairs = PairTree([(r | i) if (r := ranks(ids[i] * wide + ids[i + 1])) is not None else NONE for i in range(n - 1)])
        tree, put, places = pairs.tree, pairs.put, (1 << PLACE_BITS) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) < NONE:
            i = top & places
            j = after[i]
            x = ids[i] = made[top >> PLACE_BITS]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                put(j, NONE)
                r = ranks(x * wide + ids[k])
                put(i, NONE if r is None else r | i)
            else:
                put(i, NONE)
            if (h := before[i]) >= 0:
                r = ranks(ids[h] * wide + x)
                put(h, NONE if r is None else r | h)
        return [x for x in ids if x >= 0]

    def encode_bytes_of(self, data: bytes) -> list[int]:
        """The ids of a piece, given as bytes."""
        if not data:
            return []
        return self.merge([x for x in (*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]) if x is not None])

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.encode_bytes_of(piece.encode()), "<u4").tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self._known) >= MAX_CACHED:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if text.isascii() or max(text) < PLAIN_BELOW:
            return PLAIN_PIECES.findall(text.lower())
        signs = (p for p, _ in self._full.pre_tokenizer.pre_tokenize_str(self._full.normalizer.normalize_str(text)))
        return [bytes(map(self._byte_of.__getitem__, p)).decode() for p in signs]

    def encode_pieces(self, text: str) -> bytes:
        known = self._known.get
        return b"".join([known(p) or self._piece(p) for p in self.pieces(text)])

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self._specials.split(text) if self._specials and "<" in text else [text]):
            if k % 2:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
            elif (part.isascii() or max(part) < PLAIN_BELOW) and not any(c in part for c in NO_SPACE):
                # no piece spans white space, so that what stands between two spaces can be remembered whole
                out += map(self.words.__getitem__, part.split())
            elif part:
                out.append(self.encode_pieces(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens with a space between each two, as the vocabulary names no decoder; ids that it lacks are left out."""
        n, tokens = len(self.tokens), self.tokens
        try:
            return " ".join(map(tokens.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join(t for i in ids if i < n and (t := tokens[i]) is not None)


@lru_cache(maxsize=4)
def _load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str, **columns) -> DataFrame:
    """doc_id, ids (array<int>) and decoded of each whole text; map_texts' options name other columns."""

    def run(texts):
        bpe = WordBpe.load(path)
        packed = [np.frombuffer(bpe.encode_packed(t or ""), "<u4") for t in texts]
        ends = np.cumsum([0, *map(len, packed)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*packed, np.zeros(0, "<u4")]).astype(np.int32)))
        return {"ids": ids, "decoded": [bpe.decode(p.tolist()) for p in packed]}

    return map_texts(docs, run, "ids array<int>, decoded string", **columns)


def word_bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Operator 11: encode each whole text, decode the ids again; doc_id, n_tokens and the digests of both."""

    def run(texts):
        bpe = WordBpe.load(path)
        n, ids_sha, back_sha = [], [], []
        for t in texts:
            ids = bpe.encode_packed(t or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            back_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": back_sha}

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
