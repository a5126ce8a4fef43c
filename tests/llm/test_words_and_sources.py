"""Operators 11 to 13: word BPE against the tokenizers library, the divergence audit against SQL and plain Python, spelling variants against brute force."""
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quorate.llm import divergence, registry, spelling, word_bpe

from .cases import edge_docs, edge_rows, empty_docs

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- word BPE ----------------------------------------------------------------------------------------------------------------------


def by_library(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    out = []
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def digests(df):
    return Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect())


def test_word_bpe_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, by_library([r["text"] for r in rows])))
    assert digests(registry.op11_word_bpe(spark, sf)) == want


def test_word_bpe_edge_cases(spark):
    rows = edge_rows()
    assert digests(word_bpe.word_bpe_round_trip(edge_docs(spark), VOCABULARY)) == Counter((r[0], *x) for r, x in zip(rows, by_library([r[1] for r in rows])))
    assert word_bpe.word_bpe_round_trip(empty_docs(spark), VOCABULARY).count() == 0


def test_word_bpe_gives_ids_and_text(spark):
    b, t = word_bpe.WordBpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    got = {r["doc_id"]: r for r in word_bpe.encode_texts(edge_docs(spark).filter("doc_id in (4, 7, 13, 14)"), VOCABULARY).collect()}
    for doc, text, *_ in edge_rows():
        if doc in got:
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert got[doc]["ids"] == ids and got[doc]["decoded"] == t.decode(ids, skip_special_tokens=False) == b.decode(ids)
    assert b.decode([320, 10**6, 321]) == t.decode([320, 10**6, 321], skip_special_tokens=False)


def test_word_bpe_random_strings():
    b, t, rng = word_bpe.WordBpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(2)
    signs = [lambda: chr(rng.randrange(0x250)), lambda: rng.choice("ab 's'T re.,<|>12\x1c\x85  "), lambda: chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0x300, 0x370), rng.randrange(0x1F300, 0x1F900)])), lambda: rng.choice(["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "ΑΣ ", "İ", "é"])]
    for _ in range(4000):
        kind = rng.choice([[0, 1], [1], [0, 1, 2, 3], [1, 3]])
        text = "".join(signs[rng.choice(kind)]() for _ in range(rng.randrange(40)))
        assert b.encode(text) == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_plain_sign_is_cut_as_the_library_does():
    b, t = word_bpe.WordBpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for c in range(0x250):
        text = f"a{chr(c)}b{chr(c)}{chr(c)}1"
        assert b.encode(text) == t.encode(text, add_special_tokens=False).ids, hex(c)


def test_pair_tree_root_is_the_leftmost_least():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 8, 33):
        leaves = [rng.randrange(5) << word_bpe.PLACE_BITS | i for i in range(n)]
        tree = word_bpe.PairTree(list(leaves))
        for _ in range(200):
            assert tree.root() == min(leaves)
            i = rng.randrange(n)
            leaves[i] = word_bpe.NONE if rng.random() < 0.4 else rng.randrange(5) << word_bpe.PLACE_BITS | i
            tree.put(i, leaves[i])


def test_long_pieces_are_not_quadratic():
    import time

    b, rng = word_bpe.WordBpe.load(VOCABULARY), random.Random(4)
    seconds = []
    for n in (50_000, 200_000):
        piece = "".join(rng.choice("abcdefgh") for _ in range(n)).encode()
        began = time.process_time()
        b.encode_bytes_of(piece)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * max(seconds[0], 0.1)


# --- source divergence ---------------------------------------------------------------------------------------------------------------


def audit(rows, min_docs, top=50):
    """(lang, source, part, item, value, rank) by plain loops."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept, sources = sorted(t for t, n in df[lang].items() if n >= min_docs), sorted(s for g, s in groups if g == lang)
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(sorted(found), 1) if part == "pair" or k <= top}
    return out


def audited(df):
    rows = df.collect()
    out = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_divergence_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    assert audited(registry.op12_source_divergence(spark, sf)) == audit(rows, 30)


@pytest.mark.parametrize("block, part", [(256, 4096), (3, 5)])
def test_divergence_edge_cases(spark, block, part):
    rng = random.Random(6)
    rows = [(t[1], t[2], t[3]) for t in edge_rows()]
    rows += [("same Same sáme 日本 x-y " * rng.randint(0, 4), rng.choice(["en", "de", None]), rng.choice([None, "", "ß", "a", "b", "z9", "Z9", "日"])) for _ in range(60)]
    rows += [("", "nothing", "a"), (None, "nothing", "b"), ("123", "nothing", "c")]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "text string, lang string, source string, term string, c string, sid int, m int")
    assert audited(divergence.source_divergence(df, min_docs=3, top=4, block=block, part=part)) == audit(rows, 3, 4)
    assert divergence.source_divergence(empty_docs(spark)).count() == 0


def test_terms_are_whole_wherever_a_long_text_is_cut():
    rng = random.Random(7)
    data = "".join(rng.choice(["a", "B", " ", "é", "7", "long" * 30, "日"]) for _ in range(3000)).encode()
    want = data.translate(divergence.FOLD).split()
    for size in (1, 7, 50, 1000, 10**6):
        assert [w for words in divergence.words_of(data, size=size) for w in words] == want


def test_equal_columns_are_met_once(spark):
    """Terms that always come together share a vector."""
    rows = [("en", f"s{i % 5}", " ".join(f"w{chr(97 + k)}" for k in range(20)) * (i % 5 + 1)) for i in range(200)]
    own, groups = divergence.kept_counts(spark.createDataFrame(rows, "lang string, source string, text string"), 30)
    vectors = divergence.distinct_vectors(own, groups, 256).collect()
    terms = own.select("term").distinct().count()
    assert sum(r["m"] for r in vectors) == terms and len(vectors) < terms


# --- spelling variants ----------------------------------------------------------------------------------------------------------------


def variants(rows, min_length=6, min_count=5, times=5, alter=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % alter == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    letters = sorted({c for w in words for c in w})

    def near(w):
        some = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return [x for x in some if x in words and x != w]

    found, form = {w: near(w) for w in words}, {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(found[w]), words[form[w]] if form[w] is not None else None))
    return out


def spelled(df):
    rows = df.collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert spelled(registry.op13_spelling_variants(spark, sf)) == variants(rows)


@pytest.mark.parametrize("alter, bucket", [(199, 1 << 16), (2, 16)])
def test_variants_edge_cases(spark, alter, bucket):
    rng = random.Random(8)
    words = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaa", "abaaaa", "aabaaa", "Straße", "strasse", "straßen", "ÉCOLES", "écoles", "Écoles", "naïve×y", "letter", "lettre", "etters", "letters", "lettersx"]
    rows = [(rng.choice([None, *range(9)]), rng.choice([" ", "日", "-", "\n", "1"]).join(rng.choice(words[:rng.randint(1, len(words))]) for _ in range(30))) for _ in range(150)]
    chain = [("prefix" + "x" * k, 5 * 5 ** (4 - k)) for k in range(5)]  # forms of forms of forms
    rows += [(7, " ".join([w] * n)) for w, n in chain] + [(t[0], t[1]) for t in edge_rows()]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], "doc_id long, text string, word string, n int, form string, wid string")
    got = spelled(spelling.spelling_variants(df, alter=alter, bucket=bucket))
    assert got == variants(rows, alter=alter)
    if alter == 199:
        assert {r[2] for r in got if r[0].startswith("prefix")} == {"prefix"}
    assert spelling.spelling_variants(empty_docs(spark)).count() == 0


def test_long_words_cost_what_they_hold(spark):
    """Two words of 300,000 letters that differ in one, and one with a letter more."""
    base = "".join(random.Random(9).choice("abc") for _ in range(300_000))
    texts = [base, base[:1000] + "z" + base[1001:], base + "q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for t in texts for _ in range(5))], "doc_id long, text string")
    got = {r["word"]: (r["n"], r["n_near"]) for r in spelling.spelling_variants(df, alter=1 << 40).collect()}
    assert got == {texts[0]: (5, 2), texts[1]: (5, 1), texts[2]: (5, 1)}


def test_hashes_that_lie_link_nothing(spark, monkeypatch):
    """With keys of four values, which words that are not near share, the strings still decide."""
    some = ["letters", "lettres", "letter", "lexters", "another", "anothex"]
    words = spark.createDataFrame([(w, 8, i) for i, w in enumerate(some)], "word string, n long, wid long")
    key, kind, place, word = spelling.deletion_keys(np.frombuffer("".join(some).encode(), np.uint8), np.array([len(w) for w in some]))
    lies = spark.createDataFrame([tuple(map(int, r)) for r in zip(key & 3, kind, place, word)], "key long, kind byte, place int, wid long")
    monkeypatch.setattr(spelling, "word_keys", lambda _: lies)
    assert {r["wid"]: r["n_near"] for r in spelling.near_words(words).collect()} == {0: 2, 2: 1, 3: 1, 4: 1, 5: 1}


def test_keys_agree_exactly_where_strings_do():
    rng = random.Random(10)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    key, kind, place, word = spelling.deletion_keys(np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words]))
    means = defaultdict(set)
    for k, t, p, w in zip(key.tolist(), kind.tolist(), place.tolist(), word.tolist()):
        rest = words[w] if t == 2 else words[w][:p] + words[w][p + 1:]
        means[k].add((rest, p if t == 0 else None))
    assert all(len(m) == 1 for m in means.values()) and len(means) == len(set.union(*means.values()))
