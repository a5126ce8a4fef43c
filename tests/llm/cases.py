"""Small documents with the cases that every operator must define: nulls, empty and very long texts, ties, repeats, clashing columns."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, node string, root string, component_id string, rank string, line string, h1 string, sequence_id string, piece string"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    ws = base.split()
    near = " ".join(ws[:60] + ["changed"] + ws[61:])
    texts = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", "c"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t \n", "de", "d"), (7, "one", "en", "a"), (8, "one", "en", "b"),
        (9, "two words", "fr", "c"), (10, prose(rng, 60_000), "en", "a"), (11, "x" * 200_000, "en", "a"), (12, "line again here we go\n" * 40, "en", "e"), (13, "Ünï çødé 日本語 🙂 <|endoftext|> done", "xx", "f"),
        (14, "### &&& *** %%% " * 30, "en", "a"), (None, base, "en", "a"), (None, None, None, None), (15, prose(rng, 200), "en", "a"), (15, prose(rng, 200), "en", "a"), (16, "same row", "en", "a"), (16, "same row", "en", "a"),
        (17, "A\r\nB\x0bC\x0cD\x00E F G", "en", "a"),
    ]
    shared = "this line of boilerplate is on very many sites"
    texts += [(100 + i, f"{prose(rng, 55)}\n{shared}\n{prose(rng, 10)}", "en", f"site{i % 7}") for i in range(14)]
    return [(*t, None if t[1] is None else len(t[1]), "clash", "x", "y", "z", None, "1", "l", "h", "s", "p") for t in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
