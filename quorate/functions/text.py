"""Statement text: Column -> Column, built-in expressions only."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, declaration keywords and the token pattern that results depend on.
SPACES = r"\s\u00a0\u001c-\u001f\u0085\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DECL = rf"^[{SPACES}]*(?i:theorem|lemma|example|def|axiom|structure|instance)[{SPACES}]+"
NAME = rf"(?:[A-Za-z_][A-Za-z0-9_'.]*[{SPACES}]*)?"
TOKEN = rf"[A-Za-z_][A-Za-z0-9_'.]*|[0-9]+|[^{SPACES}]"
BINDER = r"\([^)]*:[^)]*\)"
FENCE = r"(?is)```(?:lean)?\s*(.*?)```"


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?md)--.*?$", ""), r"(?s)/-.*?-/", "")


def strip_proof(c: Column) -> Column:
    """Up to the first ``:=``; only without one, up to the first ``where``."""
    return F.when(F.contains(c, F.lit(":=")), F.substring_index(c, ":=", 1)).otherwise(F.substring_index(c, "where", 1))


def strip_header(c: Column) -> Column:
    """Without a leading declaration keyword and the name after it."""
    return F.regexp_replace(c, DECL + NAME, "")


def squeeze(c: Column) -> Column:
    """White space, NBSP included, becomes single spaces; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{SPACES}]+", " "))


def normalize(c: Column) -> Column:
    return squeeze(strip_header(strip_proof(strip_comments(c))))


def occurrences(c: Column, mark: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def features(c: Column) -> dict[str, Column]:
    binders = F.regexp_extract_all(c, F.lit(BINDER), F.lit(0))
    prop = F.filter(binders, lambda b: F.contains(b, F.lit(": Prop")) | (b.rlike(r"(?U):\s*[a-z]\w*\s*\)?") & ~F.contains(b, F.lit("."))))
    return {
        "n_chars": F.length(c),
        "n_binders": F.size(binders),
        "n_arrows": occurrences(c, "→") + occurrences(c, "->"),
        "n_forall": occurrences(c, "∀"),
        "n_exists": occurrences(c, "∃"),
        "n_and": occurrences(c, "∧"),
        "n_or": occurrences(c, "∨"),
        "n_eq": occurrences(c, "="),
        "n_prop": F.size(prop),
    }


def feature_prefix(c: Column) -> Column:
    names = ("chars", "binders", "arrows", "forall", "exists", "and", "or", "eq", "propAsm")
    parts = [F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in zip(names, features(c).values())]
    return F.concat(F.lit("[FEATS "), F.concat_ws(" ", *parts), F.lit("]"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def ngrams(toks: Column, n: int) -> Column:
    """The n-grams of a token array as strings; tokens hold no white space."""
    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))


def shorten(c: Column, limit: int) -> Column:
    """At most limit characters, the last three of them dots if cut; 0 keeps all."""
    if limit <= 0:
        return c
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, max(0, limit - 3)), F.lit("...")))


def unwrap_fence(c: Column) -> Column:
    return F.when(c.rlike(FENCE), F.trim(F.regexp_replace(F.regexp_extract(c, FENCE, 1), r"^\s+|\s+$", ""))).otherwise(c)


def sanitize_ident(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_"), r"_+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit("x")).otherwise(s)


def signature(c: Column) -> Column:
    return normalize(unwrap_fence(F.coalesce(c, F.lit(""))))


def sorry_decl(sig: Column, name: Column, kind: str = "theorem") -> Column:
    head = F.when(F.substring(sig, 1, 1).isin("(", "{", "[", ":"), sig).otherwise(F.concat(F.lit(": "), sig))
    return F.when(sig == "", F.lit("")).otherwise(F.concat(F.lit(f"{kind} "), name, F.lit(" "), head, F.lit(" := by\n  sorry")))


def penalty(c: Column, w_chars: float = 1.0, w_binders: float = 1.0, w_prop: float = 1.0, chars_scale: float = 100.0) -> Column:
    if chars_scale <= 0:
        raise ValueError("chars_scale must be positive")
    f = features(c)
    return w_chars * (f["n_chars"] / F.lit(float(chars_scale))) + w_binders * f["n_binders"] + w_prop * f["n_prop"]


def float_tag(c: Column) -> Column:
    return F.replace(F.replace(c.cast("string"), F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))
