"""A deterministic stand-in for a text encoder: digest bytes as numbers, normalised."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.functions.vectors import norm


def mock_embedding(text: Column, dim: int) -> Column:
    """Four-byte big-endian numbers of the SHA-512 digest, repeated, as -1..1, of length one."""
    hexed = F.sha2(F.encode(text, "UTF-8"), 512)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(hexed, F.pmod(i, F.lit(16)) * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967295.0 * 2 - 1)
    return F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / norm(v)))[0]
