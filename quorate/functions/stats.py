"""Statistics as Column expressions: proportions, exact tests, logistic, labels, hashes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: two-sided 95 percent point of the normal distribution.
Z95 = 1.959963984540054


def rate(k: Column, n: Column) -> Column:
    """k / n, 0 where n is 0."""
    return F.when(n > 0, k / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval of k out of n; (0, 0) where n is 0."""
    total = F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / total, z * z
    den = 1 + zz / total
    mid = (p + zz / (2 * total)) / den
    half = z * F.sqrt(p * (1 - p) / total + zz / (4 * total * total)) / den
    low = F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(F.lit(0.0))
    return low, high


def ln_factorial(n: Column) -> Column:
    """ln n! by summation for small n and Stirling's series beyond, where the series is exact to double precision."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    direct = F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), F.least(n, F.lit(64)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(n <= 64, direct).otherwise(series)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed for small n, by its asymptotic series beyond."""
    x = n.cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * x * x * x * x * x * x)
    direct = F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), F.least(n, F.lit(64)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1.0 / i.cast("double"))
    return F.when(n <= 64, direct).otherwise(series)


def sign_test(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided sign test over the discordant pairs; 1 where there are none.

    The tail is summed from its largest term down, each from the one before by a ratio; what lies ten standard deviations further counts
    for nothing in a double and is left out, so that the number of terms grows with the square root of the pairs.
    """
    n, k = (a_only + b_only).cast("long"), F.least(a_only, b_only).cast("long")
    largest = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) - n * F.log(F.lit(2.0)))
    steps = F.least(k, F.ceil(5 * F.sqrt(n.cast("double"))) + 64).cast("int")
    step = lambda a, d: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * (k - d) / (n - k + d + 1)).alias("t"))
    tail = F.aggregate(F.sequence(F.lit(0), steps), F.struct(F.lit(0.0).alias("s"), largest.alias("t")), step, lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def oriented(score: Column, minimize: bool = False) -> Column:
    return -score if minimize else score


def lax_label(c: Column) -> Column:
    """0 or 1 of the many spellings; null where it is none of them."""
    s = F.lower(F.trim(c.cast("string")))
    number = s.try_cast("double")
    return F.when(s.isin("1", "true", "yes", "correct", "ok"), 1).when(s.isin("0", "false", "no", "incorrect", "wrong"), 0).when(number.isin(0.0, 1.0), number.cast("int"))


def strict_label(c: Column) -> Column:
    return F.when(c.cast("string").isin("1", "true"), 1).when(c.cast("string").isin("0", "false"), 0).otherwise(F.raise_error(F.concat(F.lit("label must be 0 or 1: "), F.coalesce(c.cast("string"), F.lit("null")))))


def lax_bool(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("1", "true", "t", "yes", "y"), True).when(s.isin("0", "false", "f", "no", "n"), False)


def stable_hash(*parts: Column) -> Column:
    """The first 60 bits of a SHA-256 over the parts, as a long: the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def stable_index(seed: Column, pid: Column, n: Column) -> Column:
    return F.pmod(stable_hash(seed.cast("string"), pid.cast("string")), n).cast("int")


def crc_seed(seed: int, pid: Column) -> Column:
    return F.crc32(pid.cast("string").cast("binary")).bitwiseXOR(F.lit(seed).cast("long"))


def memo_key(header: Column, candidate: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(header, F.lit("")), F.lit("\n\n"), F.coalesce(candidate, F.lit(""))), 256)
