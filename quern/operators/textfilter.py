"""Token filter over paths: one whole token, or a prefix with a final star."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: A filter that would keep more than this share of all rows is dropped.
GUARD = 0.5
# fixed values: characters that a pattern must not hold
FORBIDDEN = "\"':()+-"


@dataclass(frozen=True)
class Pattern:
    body: str
    prefix: bool

    @classmethod
    def parse(cls, raw: str | None) -> Pattern | None:
        """None for a blank pattern; ValueError for one that is no single token."""
        text = (raw or "").strip()
        if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
            text = text[1:-1].strip()
        if not text:
            return None
        body, prefix = (text[:-1], True) if text.endswith("*") else (text, False)
        if not body or "*" in body:
            raise ValueError("a star may only end a pattern")
        if any(c.isspace() or c in FORBIDDEN for c in body):
            raise ValueError("a pattern is a single token")
        if not all(c.isalnum() or c == "_" for c in body):
            raise ValueError("a pattern holds letters and digits only")
        return cls(fold(body), prefix)


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def _accents() -> tuple[str, str]:
    """Letters of the scripts with accents that Unicode takes apart into one letter and marks, and those letters."""
    pairs = {}
    for block in (range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000)):
        for c in map(chr, block):
            plain = fold(c)
            if c.lower() == c and len(plain) == 1 and plain != c:
                pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


def tokens(path: Column) -> Column:
    """Lower-cased runs of letters and digits, without accents."""
    folded = F.translate(F.regexp_replace(F.lower(path), r"\p{M}+", ""), *_accents())
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def matches(path: Column, pattern: Pattern) -> Column:
    t = tokens(path)
    parts = [p for p in pattern.body.split("_") if p]
    if not parts:
        return F.lit(False)
    if len(parts) == 1:
        return F.exists(t, lambda x: x.startswith(parts[0])) if pattern.prefix else F.array_contains(t, parts[0])
    n = len(parts)
    fits = lambda i: F.forall(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts)]),
        lambda z: F.when((z.k == n - 1) & F.lit(pattern.prefix), F.get(t, i + z.k).startswith(z.p)).otherwise(F.get(t, i + z.k) == z.p),
    )
    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))), fits)


def guarded(rows: DataFrame, pattern: Pattern | None, guard: float = GUARD) -> DataFrame:
    """Matching rows; all rows if the pattern is absent or matches more than ``guard`` of them.

    One aggregate decides; its single row meets the rows in a broadcast.
    """
    if pattern is None:
        return rows
    m = matches(F.col("path"), pattern)
    share = rows.agg(F.avg(F.when(m, 1.0).otherwise(0.0)).alias("_share"))
    return rows.crossJoin(F.broadcast(share)).where(m | (F.col("_share") > guard)).drop("_share")
