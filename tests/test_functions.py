"""Text, statistics and label functions against values worked out by hand or published."""
import math

import pytest
from pyspark.sql import functions as F

from quorate.functions import stats as st
from quorate.functions import text as tx


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, want", [
    ("theorem t1 : 1 = 1 := rfl", ": 1 = 1"), ("lemma foo.bar' (x : Nat) -- c\n : x = x := by simp", "(x : Nat) : x = x"), ("example (a b : ℤ) : a = b where", "(a b : ℤ) : a = b"), ("theorem t (n : Nat := 0) : n = n", "(n : Nat"),
    ("P nowhere Q", "P no"), ("/- doc -/ theorem z : True", ": True"), ("", ""), ("-- c", ""), ("a   b\n c\t", "a b c"), ("  THEOREM  x : y", ": y"), ("theorem", "theorem"),
])
def test_normalize(spark, text, want):
    assert one(spark, text, tx.normalize) == want


def test_features(spark):
    for text, want in (("(x y : Nat) (h : Prop) (hp : p x) : x = y → ∀ z, z ∧ w", (54, 3, 1, 1, 0, 1, 0, 1, 2)), ("(f : ℝ → ℝ) (hf : Continuous.on f) : ∃ c, f c = 0 ∨ c -> c", (58, 2, 2, 0, 1, 0, 1, 1, 0))):
        df = spark.createDataFrame([(text,)], "v string")
        assert tuple(df.select(*[c.alias(k) for k, c in tx.features(F.col("v")).items()]).first()) == want
        assert df.select(tx.feature_prefix(F.col("v"))).first()[0] == "[FEATS chars=%d binders=%d arrows=%d forall=%d exists=%d and=%d or=%d eq=%d propAsm=%d]" % want


def test_fences_idents_and_declarations(spark):
    assert one(spark, "x\n```lean\n a b \n```\ny ```c```", tx.unwrap_fence) == "a b"
    assert one(spark, "none", tx.unwrap_fence) == "none"
    assert [one(spark, v, tx.sanitize_ident) for v in ("a-b..c", "__", "é", "ok_1")] == ["a_b_c", "x", "x", "ok_1"]
    decl = lambda c: tx.sorry_decl(tx.signature(c), F.lit("n"))
    assert one(spark, "theorem t (x : Nat) : x = x := rfl", decl) == "theorem n (x : Nat) : x = x := by\n  sorry"
    assert one(spark, "1 = 1", decl) == "theorem n : 1 = 1 := by\n  sorry" and one(spark, None, decl) == ""


def test_shorten_and_tags(spark):
    assert one(spark, "abcdefgh", lambda c: tx.shorten(c, 6)) == "abc..." and one(spark, "abcdef", lambda c: tx.shorten(c, 6)) == "abcdef" and one(spark, "abcdefgh", lambda c: tx.shorten(c, 0)) == "abcdefgh"
    assert one(spark, "-0.5", tx.float_tag) == "m0p5"


def test_tokens_and_ngrams(spark):
    assert one(spark, "f.x' + 12 →y_1", tx.tokens) == ["f.x'", "+", "12", "→", "y_1"]
    assert one(spark, "a b c", lambda c: tx.ngrams(tx.tokens(c), 2)) == ["a b", "b c"] and one(spark, "a", lambda c: tx.ngrams(tx.tokens(c), 2)) == [] and one(spark, "", lambda c: tx.ngrams(tx.tokens(c), 1)) == []


@pytest.mark.parametrize("k, n, want", [(5, 10, (0.2366, 0.7634)), (24, 36, (0.503339979, 0.797853812)), (27, 55, (0.363767778, 0.619237402)), (0, 10, (0, 0.2775328)), (10, 10, (0.7224672, 1.0)), (0, 0, (0, 0))])
def test_wilson(spark, k, n, want):
    low, high = st.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(k, n)], "k int, n int").select(low.alias("l"), high.alias("h")).first()
    assert r["l"] == pytest.approx(want[0], abs=1e-4) and r["h"] == pytest.approx(want[1], abs=1e-4)


@pytest.mark.parametrize("a, b, want", [(8, 2, 0.109375), (0, 0, 1.0), (3, 0, 0.25), (9, 0, 0.00390625), (10, 0, 0.001953125), (14, 0, 0.0001220703125), (21, 0, 9.5367431640625e-07), (30, 1, 2.9802322387695312e-08), (5, 5, 1.0)])
def test_sign_test(spark, a, b, want):
    r = spark.createDataFrame([(a, b)], "a int, b int").select(st.sign_test(F.col("a"), F.col("b"))).first()[0]
    assert r == pytest.approx(want, rel=1e-9)


def test_ln_factorial_beyond_the_sum(spark):
    for n in (0, 1, 20, 64, 65, 200, 5000):
        assert one(spark, n, st.ln_factorial, "int") == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-12)


def test_sigmoid_is_stable(spark):
    assert one(spark, 1.0, st.sigmoid, "double") == pytest.approx(0.7310585786300049)
    assert one(spark, -800.0, st.sigmoid, "double") == 0.0 and one(spark, 800.0, st.sigmoid, "double") == 1.0


def test_labels(spark):
    want = {"1": 1, "true": 1, " Yes ": 1, "CORRECT": 1, "1.0": 1, "0": 0, "wrong": 0, "2": None, "maybe": None, None: None}
    assert {k: one(spark, k, st.lax_label) for k in want} == want
    assert one(spark, 1, st.strict_label, "int") == 1
    with pytest.raises(Exception):
        one(spark, 2, st.strict_label, "int")
    assert one(spark, "Y", st.lax_bool) is True and one(spark, "f", st.lax_bool) is False and one(spark, "?", st.lax_bool) is None
