"""Named query vectors: static ones, those worked out from a person's state, and how a request picks among them."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from quern.operators.search import blend, mean_vectors


@dataclass(frozen=True)
class Centroid:
    vector: list[float]
    n: int
    #: The points it was made of, as a table with ``id``: they are no results of a search by it.
    seeds: DataFrame = field(compare=False)


def centroid_of(points: DataFrame) -> Centroid | None:
    """The mean of the points' vectors; None where there is none."""
    row = mean_vectors(points).limit(1).collect()
    return Centroid(list(row[0].centroid), row[0].n, points.select("id")) if row else None


class Registry:
    """Dynamic centroids by name, worked out on first use and again after ``invalidate``.

    A computation that fails counts as having nothing until the next ``invalidate``.
    """

    def __init__(self):
        self._sources: dict[str, Callable[[], DataFrame]] = {}
        self._held: dict[str, Centroid | None] = {}

    def register(self, name: str, points: Callable[[], DataFrame]) -> None:
        self._sources[name] = points
        self._held.pop(name, None)

    def invalidate(self, name: str) -> None:
        self._held.pop(name, None)

    def unregister(self, name: str) -> None:
        self._sources.pop(name, None)
        self._held.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._sources)

    def count(self, name: str) -> int | None:
        """Vectors in the centroid, if it is at hand."""
        held = self._held.get(name)
        return held.n if held else None

    def is_empty(self, name: str) -> bool:
        """Whether it has been worked out and there was nothing."""
        return name in self._held and self._held[name] is None

    def get(self, name: str) -> Centroid | None:
        if name not in self._sources:
            return None
        if name not in self._held:
            try:
                self._held[name] = centroid_of(self._sources[name]())
            except Exception:  # noqa: BLE001 - whatever is wrong with the source, it has no centroid now
                self._held[name] = None
        return self._held[name]


def static_vectors(centroids: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    """Vectors of the named static centroids; a name that differs in case alone will do if none is exact."""
    wanted = [n.lower() for n in names]
    rows = centroids.where(F.lower("name").isin(wanted)).select("name", "centroid").collect() if wanted else []
    exact = {r.name: list(r.centroid) for r in rows}
    folded = {r.name.lower(): list(r.centroid) for r in sorted(rows, key=lambda r: r.name, reverse=True)}
    return {n: exact.get(n) or folded[n.lower()] for n in names if n in exact or n.lower() in folded}


def resolve(names: Sequence[str], static: Mapping[str, Sequence[float]], dynamic: Registry, weights: Sequence[float] | None = None, dim: int | None = None) -> list[float]:
    """The blend of all the named centroids, static ones first; LookupError names the first that is missing."""
    vectors = []
    for name in names:
        found = static.get(name)
        if found is None:
            held = dynamic.get(name)
            found = held.vector if held else None
        if found is None:
            raise LookupError(f"there is no centroid {name!r}")
        if dim is not None and len(found) != dim:
            raise ValueError(f"centroid {name!r} has {len(found)} dimensions and not {dim}")
        vectors.append(found)
    return blend(vectors, weights)


def query_vector(names: Sequence[str], positive: Sequence[str], negative: Sequence[str], centroid: Callable[[Sequence[str]], list[float]], text: Callable[[Sequence[str], Sequence[str]], list[float]], dim: int, pattern: str = "") -> list[float]:
    """The vector of a request: by centroids or by prompts, never both; zeros for a bare file name pattern."""
    if names:
        if positive or negative:
            raise ValueError("a search is by centroids or by prompts")
        return centroid(names)
    if positive:
        return text(positive, negative)
    if pattern.strip() and not negative:
        return [0.0] * dim
    raise ValueError("at least one positive prompt is needed")


def source_names(folders: Sequence[str], names: Sequence[str] = ()) -> list[str]:
    """A name for each source folder: its own, one given for all, or one given for each."""
    if not names:
        return [f.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1] for f in folders]
    if len(names) == 1:
        return list(names) * len(folders)
    if len(names) != len(folders):
        raise ValueError("as many source names as folders are needed, or one")
    return list(names)


def drift(store: int | None, cache: int) -> int | str:
    """By how much the store is ahead of the cache; ``unknown`` while the store cannot be counted."""
    return "unknown" if store is None or store < 0 or not math.isfinite(store) else store - cache
