"""An inverted-file index of vectors as tables: exact searches that read few cells.

Points lie in one partition folder per cell, a cell being the points nearest to one of some
centroids by angle, sorted within a file by their angle to it.  A small table has each
cell's centroid, the largest angle in it (its radius) and how many points of each collection it has.

By the triangle inequality of angles no point of a cell can be closer to a query than the
query's angle to the centroid less the radius.  A search opens cells in the order of that
bound until the k-th best score beats the bound of all others, so it gives what a full scan
gives.  Within the cells that are opened the same inequality, with the point's own angle, keeps
points from being scored at all.  How well cells are chosen decides the cost, never the result.

Appends assign new points to the cells that there are.  They widen the radii first and add the
points then, so that a search in between misses no point that it sees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quern.functions.kernels import matrices, unit_rows
from quern.functions.vectors import TINY
from quern.operators import search as S
from quern.scratch import Scratch
from quern.sources.tables import replace

#: Vectors and numbers that centroids are fitted on at most, in the driver, and points of the sample for each centroid at least.
SAMPLE_ROWS, SAMPLE_NUMBERS, PER_CELL = 20_000, 8_000_000, 8
MOST_CELLS, ROUNDS = 8192, 10
#: The cells that are opened first hold so many times the rows that are asked for.
PROBE = 4
#: Slack of bounds against rounding, in radians.
SLACK = 1e-7
#: The cell of points whose vector has no direction or another dimension.
OTHER = -1


def fit_centroids(unit: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; cells that lose all their points are given up."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(unit, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(ROUNDS):
        near = (unit @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, unit)
        centroids = unit_rows(sums)
        centroids = centroids[np.linalg.norm(centroids, axis=1) > 0.5]
    return centroids


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Points with their cell and their angle to its centroid."""
    at = points.columns.index("vector")
    schema = StructType([f for f in points.schema.fields if f.name not in ("cell", "angle")] + [StructField("cell", IntegerType()), StructField("angle", DoubleType())])

    def run(batches):
        dim = centroids.shape[1]
        for batch in batches:
            cell, angle = np.full(batch.num_rows, OTHER, np.int32), np.zeros(batch.num_rows)
            for a, fits, m in matrices(batch.column(at), dim):
                good = np.flatnonzero(fits & (np.linalg.norm(m, axis=1) > TINY) & np.isfinite(m).all(1))
                for b in range(0, len(good), 4096):
                    rows = good[b : b + 4096]
                    cosine = unit_rows(m[rows]) @ centroids.T
                    cell[a + rows] = near = cosine.argmax(1)
                    angle[a + rows] = np.arccos(np.clip(cosine[np.arange(len(rows)), near], -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    return points.mapInArrow(run, schema)


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell", "collection").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))


@dataclass
class Searched:
    """The rows of a page, and how many of the index's cells and points had to be opened for it."""

    rows: DataFrame
    opened: int
    cells: int
    points_opened: int
    points: int


class VectorIndex:
    """An index below ``path``, which all executors must reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._known = spark, path.rstrip("/"), None

    @classmethod
    def build(cls, points: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Index points (id, vector, collection and whatever else is to be found with them).

        Centroids are fitted on a sample of at most SAMPLE_ROWS points in the order of a hash
        of their ids; by default there are about as many cells as a cell has points.
        Points without a vector are left out, as a search leaves them out; those whose vector
        has no direction, another dimension or parts that are no numbers have a cell of their own,
        which is opened where a score of 0 counts.  A cell that holds very many points is
        written by several tasks.  An empty table gives an index without points.
        """
        self = cls(points.sparkSession, path)
        points = points.where("vector is not null")
        first = points.select(F.size("vector").alias("dim")).groupBy("dim").agg(F.count("*").alias("n"))
        sizes = [tuple(r) for r in first.orderBy(F.desc("n"), "dim").limit(2).collect()]
        dim, n = sizes[0] if sizes else (1, 0)
        most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(dim, 1)))
        sample = points.where(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(most).select(F.col("vector").cast("array<double>").alias("vector")).toArrow()["vector"].combine_chunks()
        unit = np.concatenate([m[fits & np.isfinite(m).all(1) & (np.linalg.norm(m, axis=1) > TINY)] for _, fits, m in matrices(sample, dim)] or [np.zeros((0, dim))])
        wanted = cells or min(math.isqrt(n) + 1, MOST_CELLS)
        centroids = fit_centroids(unit_rows(unit), max(1, min(wanted, len(unit) // (1 if cells else PER_CELL)))) if len(unit) else np.eye(1, dim)
        where = [(i, c.tolist()) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(where, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        points.limit(0).drop("cell", "angle").write.parquet(f"{self.path}/shape")
        self._add(points, centroids, None)
        return self

    def append(self, points: DataFrame) -> None:
        """Add points to the cells that there are; ids that the index has already are not looked for."""
        _, centroids, _ = self._cells()
        self._add(points.where("vector is not null"), centroids, self._read_stats())
        self._known = None

    def _add(self, points: DataFrame, centroids: np.ndarray, stats: DataFrame | None) -> None:
        scratch = Scratch(self.spark)
        rows = scratch.keep(_assigned(points, centroids), "index-rows")
        new = _stats(rows)
        if stats is not None:
            new = new.unionByName(stats).groupBy("cell", "collection").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        replace(new.coalesce(1), f"{self.path}/cells")
        # a cell that holds very many points is dealt to several tasks, small ones share a task
        dealt = self.spark.sql("SELECT /*+ REBALANCE(cell) */ * FROM {rows}", rows=rows)
        dealt.sortWithinPartitions("cell", "angle").write.partitionBy("cell").mode("append").parquet(f"{self.path}/points")
        scratch.drop(rows)

    def _read_stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def _cells(self):
        """Of each cell its number, centroid, and counts and radii by collection; bounded by the number of cells and collections."""
        if self._known is None:
            c = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
            self._known = [r.cell for r in c], np.array([r.centroid for r in c]), [tuple(r) for r in self._read_stats().select("cell", "collection", "n", "radius").collect()]
        return self._known

    def facet(self) -> DataFrame:
        """(collection, n): points of each collection, from the table of cells alone."""
        named = self._read_stats().where(F.coalesce(F.col("collection"), F.lit("")) != "")
        return named.groupBy("collection").agg(F.sum("n").alias("n"))

    def _scan(self, cells: list[int], windows: dict[int, tuple[float, float]] | None = None) -> DataFrame:
        shape = self.spark.read.parquet(f"{self.path}/shape").schema.add("angle", DoubleType()).add("cell", IntegerType())
        rows = self.spark.read.schema(shape).parquet(f"{self.path}/points").where(F.col("cell").isin(cells))
        if windows:
            least, most = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
            rows = rows.where(F.col("angle").between(least, most))  # reaches the files' statistics
            table = self.spark.createDataFrame([(c, *w) for c, w in windows.items()], "_cell int, _least double, _most double")
            rows = rows.join(F.broadcast(table), F.col("cell") == F.col("_cell")).where(F.col("angle").between(F.col("_least"), F.col("_most")))
            rows = rows.drop("_cell", "_least", "_most")
        return rows.drop("cell", "angle")

    def search(self, query: Sequence[float], page: S.Page | int, collections: Sequence[str] | None = None, allowed: DataFrame | None = None, excluded: DataFrame | None = None) -> Searched:
        """The page that ``search.top`` of the filtered and scored points gives, and what it took.

        Cells are opened until as many rows as the page ends at are found, twice as many each
        time; the last of these rows then tells which other cells can hold a better one.  A query without a
        length, or of another dimension than the cells, opens all.
        """
        page = page if isinstance(page, S.Page) else S.Page(page)
        _, centroids, stats = self._cells()
        q = np.asarray(query, float)
        counts: dict[int, int] = {}
        radius: dict[int, float] = {}
        total = 0
        for cell, collection, n, r in stats:
            total += n
            if not collections or collection in collections:
                counts[cell], radius[cell] = counts.get(cell, 0) + n, max(radius.get(cell, 0.0), r)
        cells = len({s[0] for s in stats})
        pick = lambda chosen, windows=None: S.scored(S.filtered(self._scan(chosen, windows), collections, allowed, excluded), query)

        def found(chosen, windows=None):
            return Searched(S.top(pick(chosen, windows), page), len(chosen), cells, sum(counts[c] for c in chosen), total)

        if len(q) != centroids.shape[1] or not np.linalg.norm(q) > TINY:
            return found(sorted(counts))
        inner = [c for c in counts if c != OTHER]
        angle = dict(zip(inner, np.arccos(np.clip(centroids[inner] @ (q / np.linalg.norm(q)), -1, 1)).tolist()))
        nearest = {c: max(0.0, angle[c] - radius[c] - SLACK) for c in inner}
        order = sorted(inner, key=lambda c: (nearest[c], angle[c]))
        wanted, at, held = page.offset + page.rows, 0, 0
        floor, goal = None, PROBE * wanted
        while floor is None and at < len(order):
            while at < len(order) and held < goal:
                held += counts[order[at]]
                at += 1
            if at == len(order):
                break
            got = [r.score for r in S.best(pick(order[:at]).select("id", "score"), wanted).collect()]
            floor = got[-1] if len(got) == wanted and got[-1] is not None else None
            goal *= 2
        if floor is None:
            return found(sorted(counts))
        reach = math.acos(max(-1.0, min(1.0, floor))) + SLACK
        chosen = [c for c in inner if nearest[c] <= reach]
        windows = {c: (angle[c] - reach - SLACK, angle[c] + reach + SLACK) for c in chosen}
        if floor <= 0 and OTHER in counts:  # points without a direction score 0
            chosen, windows = [*chosen, OTHER], windows | {OTHER: (0.0, 0.0)}
        return found(chosen, windows)
