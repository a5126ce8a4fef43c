"""Byte-level BPE by prefix dynamic programming (operator 5).

For each prefix of a piece of text exactly one token can end its encoding.  Keeping that last token for every prefix gives the encoding
by walking back, lets bytes be appended without touching what is there, and confines an edit's work to the bytes from the edit to
where the old and new cuts meet again.  A token sequence is the encoding of its bytes exactly if each token and each adjacent pair
encodes to itself, so a prefix of length i ends in token t if t's bytes end there and the pair (last token of the shorter prefix, t) is
one; pairs are decided by merging their few bytes and are remembered.

Defined cases: a null text is an empty text: no ids, the digests of no bytes; null ids and repeated rows are carried through; texts of any length
are read whole, a piece of any length takes time and memory in proportion to it; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""
from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: What a worker remembers at most, of pieces and of pairs; beyond it a cache starts anew.
MAX_CACHED = 800_000
#: Characters behind its end that decide where a piece of the pattern ends: it may change if one of them does.
LOOKAHEAD = 2


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: "PrefixBpe"):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = pack_ids(self.bpe.encode_piece(_bytes(piece)))
        if len(piece) <= 64:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[piece] = ids
        return ids


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        # every beginning of a token, with the token's id if it is one itself, else -1
        self._begins = {token[:i]: -1 for token in ranks for i in range(1, len(token))} | ranks
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> "PrefixBpe":
        return _load(path, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: always join the pair whose union has the lowest rank, the leftmost of equals."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            options = [(self.ranks[u], i) for i in range(len(parts) - 1) if (u := parts[i] + parts[i + 1]) in self.ranks]
            if not options:
                break
            i = min(options)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _is_whole(self, token: int) -> bool:
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b, in this order, are the encoding of their bytes."""
        if len(self._pairs) >= MAX_CACHED:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = self._is_whole(b) and self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """last[i] is the token that ends the encoding of data[:i + 1]; adds the entries that are missing.

        From each place, tokens that begin there are followed byte by byte; the one that may follow the place's own last token claims its end.
        """
        old, size = len(last), len(data)
        last.extend([-1] * (size - old))
        begins, pairs = self._begins.get, self._pairs
        for begin in range(max(0, old - self.longest + 1), size):
            if begin and last[begin - 1] < 0:
                raise ValueError("the vocabulary lacks a byte")
            before = last[begin - 1] << 32 if begin else 0
            for end in range(max(begin, old) + 1, min(begin + self.longest, size) + 1):
                token = begins(data[begin:end])
                if token is None:
                    break
                if token < 0 or last[end - 1] >= 0:
                    continue
                if begin:
                    ok = pairs.get(before | token)
                    if ok is None:
                        ok = self._fits(last[begin - 1], token)
                else:
                    ok = self._is_whole(token)
                if ok:
                    last[end - 1] = token
        return last

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(data, self.extend(data, []))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def _load(path: str, pattern: str) -> PrefixBpe:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return PrefixBpe(ranks, pattern)


class EditableText:
    """A text whose encoding is kept up to date through appends and edits.

    Prefix entries are redone near an edit alone; the text itself and the list of its pieces are rebuilt by each edit, in time that grows with the
    text, though far less than encoding it again would take.
    """

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.spans: list[tuple[int, int]] = []
        self.tables: list[list[int]] = []
        self.fresh = 0  # prefix entries computed so far
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, begin: int, end: int, text: str) -> None:
        """Put text in place of self.text[begin:end]; only pieces that read into the edit, and those up to where cuts meet again, are redone.

        A piece's cut depends on the characters up to LOOKAHEAD past its end: a run of white space gives its last character back if a word
        follows, and a quote asks whether the two characters behind it make a contraction.  Behind the edit the text is the same from any
        common cut on, as the pattern never looks back.
        """
        new, shift = self.text[:begin] + text + self.text[end:], len(text) - (end - begin)
        k = bisect_left(self.spans, begin - LOOKAHEAD + 1, key=lambda s: s[1])
        at = self.spans[k][0] if k < len(self.spans) else (self.spans[-1][1] if self.spans else 0)
        spans, tables, rest = [], [], len(self.spans)
        for m in self.bpe.pattern.finditer(new, at):
            if m.start() >= begin + len(text):
                same = bisect_left(self.spans, m.start() - shift, lo=k, key=lambda s: s[0])
                if same < len(self.spans) and self.spans[same][0] == m.start() - shift >= end:
                    rest = same
                    break
            data, table = _bytes(m.group()), []
            j = k + len(spans)
            if j < len(self.spans) and self.spans[j][0] == m.start():  # the bytes before the edit keep their entries
                before = _bytes(self.text[slice(*self.spans[j])])
                same = next((i for i, (x, y) in enumerate(zip(before, data)) if x != y), min(len(before), len(data)))
                table = self.tables[j][:same]
            self.fresh += len(data) - len(table)
            tables.append(self.bpe.extend(data, table))
            spans.append(m.span())
        self.spans = self.spans[:k] + spans + [(a + shift, b + shift) for a, b in self.spans[rest:]]
        self.tables = self.tables[:k] + tables + self.tables[rest:]
        self.text = new

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.bpe.walk(_bytes(self.text[a:b]), t) for (a, b), t in zip(self.spans, self.tables)))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Operator 5: encode each whole text, decode the ids again; doc_id, n_tokens and the digests of both."""

    def run(texts):
        bpe = PrefixBpe.load(path, pattern)
        n, ids_sha, back_sha = [], [], []
        for t in texts:
            ids = bpe.encode_bytes(t or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            back_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": back_sha}

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
