"""Spelling variants by rolling hashes of deletions (operator 13).

Two words differ by one replaced sign exactly if they have the same length and are equal without the sign at one place; they differ by an
inserted sign exactly if the longer one without some sign is the other.  So each word has a key for each place that may go, of what is left,
with the place and the length (kind R) or without the place (kind D, once for each run of equal signs, as it does not matter which of them
goes), and one of itself (kind F).  Prefix and suffix sums of a polynomial give all these hashes as array operations over the letters of many
words at once, with no string cut: what is left of a word without place i is its prefix to i plus its suffix behind i, a power lower.

Keys are dealt by their leading bits into buckets of bounded size, and each bucket is sorted as one array of integers; keys that meet no other
are dropped there.  What is left joins the words again, and words that share a key are told apart by the strings themselves, so that a
hash that lies costs time and no link.  A group holds at most one word for each letter that may stand at the place, so that groups need no
bound; a word learns how many are in its groups and the most frequent of them, and no pairs are formed.

Roots follow forms by doubling: a form is five times as frequent as its word, so chains are short whatever the data.

Defined cases: null texts have no words; a null doc_id counts as the empty string where occurrences are altered; texts of any length are read in slices
between runs, a run of any length is a word; repeated rows count again; of equally frequent near words the first in code-point order is the
form; words without near words have n_near 0, no form, and are their own root; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""
from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join, text_slices
from .divergence import words_of

#: Words have at least so many code points and occurrences; a form is so many times as frequent as its word; one of so many occurrences is altered.
MIN_LENGTH, MIN_COUNT, TIMES, ALTER = 6, 5, 5, 199
#: Words that a task counts before it passes its counts on; letters whose keys are made at once; keys in a bucket, about.
HELD, LETTERS, BUCKET = 800_000, 1 << 20, 1 << 16
#: Latin-1 letters, A-Z to a-z; U+00C0 to U+00FF are letters here, all others separate runs.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
#: Two primes below 2^31, so that products fit 64 bits, and a base for each.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)
KINDS = {"R": 0, "D": 1, "F": 2}


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, alter: int = ALTER) -> DataFrame:
    """(word, n): the runs of letters, lower-cased, of which one occurrence in ``alter``, chosen by a checksum, lacks a letter."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("t")).filter("t is not null")
    kinds = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def passed_on(held):
        words = list(held)
        for a in range(0, len(words), 50_000):
            some = words[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some], pa.string()), pa.array([held[w] for w in some], pa.int64())], schema=kinds)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for a, texts in text_slices(batch.column(1), 4_000_000):
                for doc, text in zip(batch.column(0).slice(a, len(texts)).to_pylist(), texts):
                    begin = crc32(f"{doc}:".encode())
                    # signs beyond Latin-1 become question marks, which separate runs as they do
                    for words in words_of(text.encode("latin-1", "replace"), FOLD):
                        for w, n in Counter(words).items():
                            if len(w) >= min_length:
                                h = crc32(w if w.isascii() else w.decode("latin-1").encode(), begin)
                                if h % alter == 0:
                                    w = w[:(i := h % len(w))] + w[i + 1:]
                                held[w] += n
                if len(held) > HELD:
                    yield from passed_on(held)
                    held = Counter()
        yield from passed_on(held)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        done += more
        step = step * step % prime
    return out[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit, so that leading bits deal evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def deletion_keys(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, place, word) of all keys of words given as one array of letters and their lengths."""
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(letters)) - starts[word]
    ends = starts + lengths
    left, whole = [], []
    for base, prime in zip(BASES, PRIMES):
        p = np.uint64(prime)
        power = _powers(base, prime, int(lengths.max(initial=0)))
        # sums stay below 2^31 times the number of letters
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[place] % p)])
        total = sums[ends] - sums[starts]
        prefix = sums[:-1] - sums[starts][word]
        suffix = (sums[ends][word] - sums[1:]) % p * np.uint64(pow(base, -1, prime)) % p
        left.append((prefix + suffix) % p)
        whole.append(total % p)
    of_left, of_whole = (np.uint64(1 << 31) * h[0] + h[1] for h in (left, whole))
    n, at = lengths.astype(np.uint64), place.astype(np.uint64)
    replaced = _mixed(of_left ^ _mixed(n[word] * np.uint64(0x9E3779B97F4A7C15) + at + np.uint64(1)))
    # of equal neighbours only the first goes
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(letters)), bool), (letters[1:] != letters[:-1]) | (place[1:] == 0)]))
    text = lambda h, size: _mixed(h ^ _mixed(size * np.uint64(0xD6E8FEB86659FD93)))
    key = np.concatenate([replaced, text(of_left[first], n[word[first]] - np.uint64(1)), text(of_whole, n)]).view(np.int64)
    kind = np.repeat(np.array([KINDS["R"], KINDS["D"], KINDS["F"]], np.int8), [len(letters), len(first), len(lengths)])
    places = np.concatenate([place, place[first], np.full(len(lengths), -1)]).astype(np.int32)
    return key, kind, places, np.concatenate([word, word[first], np.arange(len(lengths))])


def word_keys(words: DataFrame) -> DataFrame:
    """(key, kind, place, wid) of words, (wid, word)."""
    kinds = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("place", pa.int32()), ("wid", pa.int64())])

    def run(batches):
        for batch in batches:
            for a, some in text_slices(batch.column(1), LETTERS):
                wid = batch.column(0).slice(a, len(some)).to_numpy()
                letters = [w.encode("latin-1") for w in some]
                key, kind, place, word = deletion_keys(np.frombuffer(b"".join(letters), np.uint8), np.array([len(w) for w in letters], np.int64))
                for b in range(0, len(key), LETTERS):
                    part = slice(b, b + LETTERS)
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(kind[part]), pa.array(place[part]), pa.array(wid[word[part]])], schema=kinds)

    return words.select("wid", "word").mapInArrow(run, "key long, kind byte, place int, wid long")


def shared_keys(keys: DataFrame, n_keys: int, bucket: int = BUCKET) -> DataFrame:
    """The keys that may link: of kind R those of two words or more, of kinds D and F those that a word and another word's rest have."""
    bits = max(0, int(-(-n_keys // bucket) - 1).bit_length())

    def run(table):
        table = table.combine_chunks()
        key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, kind = key[order], kind[order]
        new = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        have = [np.bincount(group, kind == k) for k in range(3)]
        links = np.where(kind == KINDS["R"], (have[0] > 1)[group], ((have[1] > 0) & (have[2] > 0))[group])
        return table.take(pa.array(order[links])).select(["kind", "place", "wid"])

    dealt = keys.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    return dealt.groupBy("bucket").applyInArrow(run, "kind byte, place int, wid long")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(wid, n_near, form, form_n): of words, (wid, word, n), made by materialize(), those with near words; form is the most frequent of them."""
    letters = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    keys = materialize(shared_keys(word_keys(words), letters, bucket), "shared-keys")
    # a word has at most two keys for each of its letters, and one more
    met = keys.join(words, "wid")
    rest = F.when(F.col("kind") == KINDS["F"], F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    at = F.when(F.col("kind") == KINDS["R"], F.col("place")).otherwise(-1)
    named = met.select("wid", "word", "n", (F.col("kind") == KINDS["F"]).alias("whole"), at.alias("at"), rest.alias("rest"))
    # the words of a group differ in one sign, so there are at most as many as there are letters, or one and those that have one sign more
    group = Window.partitionBy("at", "rest")
    order = group.orderBy(F.desc("n"), "word")
    me = F.struct((-F.col("n")).alias("less"), "word")
    whole, rests = F.when(F.col("whole"), me), F.when(~F.col("whole"), me)
    seen = named.select("wid", "at", "whole", F.count(F.lit(1)).over(group).alias("size"), F.row_number().over(order).alias("r"), F.first(me).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("one"),
                        F.nth_value(me, 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("two"), F.min(whole).over(group).alias("it"), F.min(rests).over(group).alias("first_rest"), F.count(rests).over(group).alias("n_rests"))
    replaced = F.col("at") >= 0
    n = F.when(replaced, F.col("size") - 1).when(F.col("whole"), F.col("n_rests")).otherwise(F.col("it").isNotNull().cast("long"))
    best = F.when(replaced, F.when(F.col("r") == 1, F.col("two")).otherwise(F.col("one"))).when(F.col("whole"), F.col("first_rest")).otherwise(F.col("it"))
    found = seen.select("wid", n.alias("n_near"), best.alias("best")).filter("n_near > 0")
    return found.groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select("wid", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), one for each word and without rings: each round a word's root becomes its root's root, twice as far.

    A root that many words hang on is dealt into parts by its counted number."""
    state = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        many = state.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
        on = many.join(state.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = materialize(spread_join(state, on, ["root"], "c", state.count(), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(state)
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        state = after


def spelling_variants(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, alter: int = ALTER, bucket: int = BUCKET) -> DataFrame:
    """Operator 13: word, form, root, n, n_near, form_n."""
    counted = word_counts(docs, min_length, alter).filter((F.col("n") >= min_count) & (F.length("word") >= min_length))
    words = materialize(counted.withColumn("wid", F.monotonically_increasing_id()), "words")
    near = near_words(words, bucket)
    takes = F.col("form_n") >= times * F.col("n")
    told = words.join(near, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).cast("long").alias("form_n"))
    told = materialize(told, "forms")
    return told.join(roots(told.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
