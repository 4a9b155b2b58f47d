"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    # one fold carries the product and both squares
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("ab", "aa", "bb")])

    def step(s, z):
        x, y = z["x"], z["y"]
        return F.struct((s["ab"] + x * y).alias("ab"), (s["aa"] + x * x).alias("aa"), (s["bb"] + y * y).alias("bb"))

    def finish(s):
        flat = (s["aa"] <= TINY * TINY) | (s["bb"] <= TINY * TINY)
        return F.when(flat, 0.0).otherwise(s["ab"] / F.sqrt(s["aa"] * s["bb"]))

    both = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.aggregate(both, start, step, finish)


def l2_normalise(a: Column) -> Column:
    """Null if the vector has no length."""
    # arrays of one bind the vector and its norm, which are otherwise worked out again for each component
    scaled = lambda v: F.transform(F.array(norm(v)), lambda n: F.when(n > TINY, F.transform(v, lambda x: x / n)))[0]
    return F.transform(F.array(a), scaled)[0]


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; null unless both are that."""
    valid = lambda c: F.lower(c).rlike("^[0-9a-f]{16}$")
    bits = lambda c: F.conv(F.lower(c), 16, -10).cast("long")
    return F.when(valid(a) & valid(b), F.bit_count(bits(a).bitwiseXOR(bits(b))))
