"""Arithmetic on whole Arrow batches of vectors: what would be interpreted loops per element in SQL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

TINY = 1e-12
#: Numbers that are converted to double precision in one go.
CHUNK = 4_000_000


def matrices(part: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, whether each row is a vector of ``dim`` numbers, matrix with zeros for other rows) of runs of rows."""
    step = max(1, CHUNK // max(1, dim))
    for a in range(0, len(part), step):
        run = part.slice(a, step)
        lengths = run.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        flat = run.flatten()
        if flat.null_count:
            # a null component makes its vector one that cannot be compared
            owner = np.repeat(np.arange(len(run)), np.maximum(lengths, 0))
            hurt = owner[flat.is_null().to_numpy(zero_copy_only=False)]
            flat = flat.fill_null(0)
        else:
            hurt = []
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        fits = lengths == dim
        if fits.all():
            m = values.reshape(-1, dim)
        else:
            m = np.zeros((len(run), dim))
            m[fits] = values[np.repeat(fits, np.maximum(lengths, 0))].reshape(-1, dim)
        if len(hurt):
            fits = fits.copy()
            fits[hurt] = False
        yield a, fits, m


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without length become zeros."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > TINY, m / np.maximum(n, TINY), 0.0)


def cosine_to(query: Sequence[float]):
    """A function of a vector column: cosine with the query, 0 where either has no length, null for other dimensions.

    Row by row the same sum in the same order, so equal vectors score equally wherever they stand.
    """
    q = np.asarray(query, float)
    length = float(np.linalg.norm(q))
    q = q / length if length > TINY else np.zeros_like(q)

    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out, ok = np.zeros(len(part)), np.zeros(len(part), bool)
            for a, fits, m in matrices(part, len(q)):
                dot, square = np.einsum("ij,j->i", m, q), np.einsum("ij,ij->i", m, m)
                norm = np.sqrt(square)
                out[a : a + len(m)] = np.where(norm > TINY, dot / np.maximum(norm, TINY), 0.0)
                ok[a : a + len(m)] = fits
            yield pa.array(out, mask=~ok)

    return F.arrow_udf(score, "double")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that links (a, b) reach from it."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
