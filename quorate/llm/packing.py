"""Best-two-fit packing of token sequences (operator 3).

Documents are tokenised, get an end id, and only those longer than a sequence are cut into full pieces (the first piece takes the
remainder).  Pieces are dealt by a hash of their place into groups of bounded size; a group is packed by itself, which costs at most a part-filled
sequence or so a group.  A sequence is filled greedily, largest piece first, with the largest that still fits; if a gap remains, its
smallest piece is replaced by the two unpacked pieces that fill the widened gap most tightly.

Defined cases: a null text is an empty text and yields its end id alone; null ids and repeated rows are packed like others; a text of any
length is cut into as many pieces as it needs; pieces of equal length are packed in order of document and place; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""
from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_slices

#: Pieces that are packed together, about.
GROUP = 16_384
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def tokenizer(json_path: str, rank_path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids as the tokenizers library gives them.  The rank file holds the same vocabulary and is several times faster to apply; texts that
    may hold the vocabulary's special token go through tokenizers itself."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(json_path)
    special = tuple(t.content for t in full.get_added_tokens_decoder().values())

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def tokenize_pieces(docs: DataFrame, paths: tuple[str, str, str], capacity: int, keep_ids: bool = False) -> DataFrame:
    """One row for each piece; with keep_ids its ids too."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(PIECES + (", ids array<int>" if keep_ids else ""))
    kinds = to_arrow_schema(schema)

    def run(batches):
        encode = tokenizer(*paths)
        for batch in batches:
            for a, texts in text_slices(batch.column(1), 2_000_000):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(a, len(texts)).to_pylist(), texts):
                    tokens = np.array([*encode(text or ""), END_ID], "<u4")
                    for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                        part = tokens[s:s + n]
                        rows.append((doc, k, s, n, crc32(part.tobytes()), *([part.astype(np.int32).tolist()] if keep_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__q_text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; every length is from 1 to capacity."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    there = sum(1 << n for n, s in enumerate(stacks) if s)  # bit n: pieces of length n are left
    upto = [(1 << n + 1) - 1 for n in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int, at: int) -> int:
        nonlocal there
        i = stacks[n].pop()
        bins[i], offsets[i] = n_bins, at
        if not stacks[n]:
            there ^= 1 << n
        return i

    n_bins = 0
    while there:
        used = items = small = last = 0
        while (n := (there & upto[capacity - used]).bit_length() - 1) > 0:
            last, small = take(n, used), n
            used += n
            items += 1
        gap = capacity - used
        if gap and items > 1 and there:
            # what is left exceeds the gap, so two pieces that fit in its place are each shorter than the smallest
            room, best, pair = gap + small, small, None
            a = (there & upto[small - 1]).bit_length() - 1
            while 2 * a > best and best < room:
                b = (there & upto[min(a, room - a)]).bit_length() - 1
                if b == a and len(stacks[a]) < 2:
                    b = (there & upto[a - 1]).bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = (there & upto[a - 1]).bit_length() - 1
            if pair:
                used -= small
                stacks[small].append(last)
                there |= 1 << small
                for n in pair:
                    take(n, used)
                    used += n
        n_bins += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (it is read twice: once to count).

    Pieces are dealt by their place in the table, so that rows that repeat an id, with or without the same text, spread like others."""
    n_groups = -(-pieces.count() // group) or 1
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key, pdf):
        pdf = pdf.drop(columns="__q_group").sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = bins + (int(key[0]) << 32)
        pdf["offset"] = offsets
        return pdf

    dealt = pieces.withColumn("__q_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    return dealt.groupBy("__q_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, paths: tuple[str, str, str], capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Operator 3: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack_pieces(materialize(tokenize_pieces(docs, paths, capacity, keep_ids), "pieces"), capacity)
