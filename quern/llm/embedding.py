"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, components.

K-means on a sample of unit vectors gives about sqrt(n) / 4 cells.  A vector lives in the cell
A of its nearest centroid and visits other cells B whose centroid is nearly as near.  A
linked pair u in A, v in B is compared if either visits the other's cell.  If neither did,
``u.A - u.B`` and ``v.B - v.A`` would both exceed the margin, so their sum, which is
``(u - v).(A - B)``, would exceed twice the margin.

* With the margin ``L |A - B| / 2``, where ``L = sqrt(2 - 2 t)`` is the largest distance of vectors
  with a cosine of t, that is impossible and no link is lost (``spread=None``).  But in many
  dimensions cells are so wide that nearly half of them are visited.
* By default the margin is ``spread`` standard deviations of ``(u - v).(A - B)`` for differences of
  length L whose directions are spread like the vectors themselves, if that is less.  A pair
  right at the threshold then gets lost with a probability below 0.002, and it is still
  impossible to lose pairs that are so close that the margin covers their whole distance.

Vectors travel packed, as the matrix of a cell's vectors in a batch, so that rows are few
however often a vector visits.  Matrices are dealt to blocks and pairs of blocks meet in one
product, so a cell with a large share of all rows becomes many equal tasks.  Vectors
around one leader, so close to it that any two of them must be linked, are the cell's
core: its links are counted without comparing them, so a group of copies costs no more than
its size.  A block pair gives two small things, never its links one by one: for each vector
how many links it has there, and for each vector the least id of its component within the
block pair.  The counts are added up; the forests are joined to components across cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.operators.graph import connected_components
from quern.scratch import Scratch

THRESHOLD = 0.9
#: Standard deviations that the margin covers.
SPREAD = 3.0
#: Vectors of a block, two of which meet in a task, and of a packed matrix at most.
BLOCK, PACK = 4096, 1024
#: Up to so many vectors are one cell; cells there are at most.
SMALL, MOST_CELLS = 4096, 2048
#: Vectors per cell in the sample that k-means is fitted on, their numbers at most, and its rounds.
SAMPLE_PER_CELL, SAMPLE_NUMBERS, ROUNDS = 64, 16_000_000, 8
CORE, REST, VISITOR = 0, 1, 2


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of each row with the largest product, and the product; a run of rows at a time."""
    near, best = np.empty(len(x), int), np.empty(len(x))
    for a in range(0, len(x), 4096):
        sim = x[a : a + 4096] @ c.T
        near[a : a + 4096] = sim.argmax(1)
        best[a : a + 4096] = sim.max(1)
    return near, best


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids; an empty cell takes the worst-served vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, best = _nearest(x, c)
        c = np.zeros_like(c)
        np.add.at(c, near, x)
        norm = np.linalg.norm(c, axis=1)
        for i in np.flatnonzero(norm < 1e-9):
            j = int(best.argmin())
            c[i], best[j], norm[i] = x[j], np.inf, 1.0
        c /= norm[:, None]
    return c


@dataclass
class Cells:
    """What places vectors: centroids, the margins between each two, and the cores' leaders (zeros where there is none)."""

    centroids: np.ndarray
    margin: np.ndarray
    leaders: np.ndarray
    close: float

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, threshold: float, spread: float | None) -> Cells:
        c = spherical_kmeans(sample, k)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
        far = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
        margin = far * apart
        if spread is not None:
            centred = sample - sample.mean(0)
            cov = centred.T @ centred / len(sample)
            along = c @ cov @ c.T
            own = np.diag(along)
            variance = np.maximum(0.0, own[:, None] + own[None, :] - 2 * along) / max(np.trace(cov), 1e-300)
            margin = np.minimum(margin, spread * far * np.sqrt(variance))
        # any two vectors within half the angle of the threshold of a leader are linked
        close = math.sqrt((1 + threshold) / 2) + 1e-9
        leaders = np.zeros_like(c)
        near, _ = _nearest(sample, c)
        for i in range(k):
            own_ = sample[near == i]
            if len(own_):
                around = (own_ @ own_.T >= close).sum(1)
                if around.max() > 2:
                    leaders[i] = own_[around.argmax()]
        return cls(c, margin + 1e-9, leaders, close)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home of each unit vector, whether it is in the core there, and which cells it is in (home included)."""
        sim = x @ self.centroids.T
        home = sim.argmax(1)
        gap = sim[np.arange(len(x)), home][:, None] - sim
        return home, np.einsum("ij,ij->i", x, self.leaders[home]) >= self.close, gap <= self.margin[home]


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that can link: not null, no null or non-finite component, not zero."""
    v, each = F.col("v"), lambda test: F.forall("v", test)
    ok = v.isNotNull() & (F.size("v") > 0) & each(lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull()).where(ok)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaling first keeps tiny and huge ones exact."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, spread: float | None = SPREAD, cells: int | None = None) -> DataFrame:
    """One row per input row: (id_col, n_links, component_id, kept).

    * Vectors that are null, empty, zero, or hold null or non-finite components link with
      nothing; vectors of different lengths are never compared.
    * A null id has no links, a null component, and is not kept.
    * Rows that repeat an id and its vector are one.  Rows that repeat an id with another
      vector are vectors that share the id: all are compared, the links of all with vectors of
      other ids add up, and they have one component.
    * Equal vectors link like any others.  An empty table gives an empty result; columns
      other than the two named are not read.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    vectors = scratch.keep(valid_vectors(df, id_col, vector_col).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v")), "vectors")
    links = spark.createDataFrame([], "id long, n long")
    forest = spark.createDataFrame([], "id long, label long")
    for dim, n in sorted((r.dim, r.n) for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        k = cells or (1 if n <= SMALL else min(MOST_CELLS, round(math.sqrt(n) / 4)))
        c, f = _links(vectors.where(F.col("dim") == dim), n, dim, min(k, n), threshold, block, spread, scratch)
        links, forest = links.union(c), forest.union(f)
    labels = connected_components(forest, "id", "label").select(F.col("node").alias("id"), "label")
    total = links.groupBy("id").agg(F.sum("n").alias("n"))
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    out = ids.join(total, "id", "left").join(labels, "id", "left")
    component = F.coalesce("label", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _fit(vectors: DataFrame, n: int, dim: int, k: int, threshold: float, spread: float | None) -> Cells:
    # the fit is on a bounded sample, chosen by a hash of the id; every vector is placed
    take = max(k, min(n, SAMPLE_PER_CELL * k, SAMPLE_NUMBERS // dim))
    share = int(min(1.0, 1.2 * take / n) * (1 << 20)) + 1
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("v").limit(2 * take).toArrow()
    if chosen.num_rows < k:
        chosen = vectors.select("v").limit(take).toArrow()
    return Cells.fit(_unit(_matrix(chosen["v"].combine_chunks())), k, threshold, spread)


PACKED = "cell long, kind int, n long, ids binary, homes binary, vecs binary"


def _packed(cell: int, kind: int, ids: np.ndarray, homes: np.ndarray, raw: np.ndarray):
    """Rows of PACKED for vectors in one cell."""
    for a in range(0, len(ids), PACK):
        part = slice(a, a + PACK)
        yield int(cell), kind, len(ids[part]), ids[part].astype(np.int64).tobytes(), homes[part].astype(np.int32).tobytes(), raw[part].tobytes()


def _links(vectors: DataFrame, n: int, dim: int, k: int, threshold: float, block: int, spread: float | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    shared = vectors.sparkSession.sparkContext.broadcast(_fit(vectors, n, dim, k, threshold, spread))
    kind = np.float32 if "float" in vectors.schema["v"].dataType.simpleString() else np.float64
    names = [f.split()[0] for f in PACKED.split(", ")]
    step = max(1, 4_000_000 // (dim + k))

    def pack(batches):
        cells = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                ids, raw = batch.column(0).slice(a, step).to_numpy(), _matrix(batch.column(1).slice(a, step))
                home, core, visits = cells.place(_unit(raw))
                visits[np.arange(len(home)), home] = False
                rows = []
                for c in np.unique(home):
                    for which, on in ((CORE, (home == c) & core), (REST, (home == c) & ~core)):
                        rows += _packed(c, which, ids[on], home[on], raw[on])
                for c in np.flatnonzero(visits.any(0)):
                    on = visits[:, c]
                    rows += _packed(c, VISITOR, ids[on], home[on], raw[on])
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names)

    placed = scratch.keep(vectors.select("id", "v").mapInArrow(pack, PACKED), "cells")
    count = lambda which: F.coalesce(F.sum(F.when(F.col("kind") == which, F.col("n"))), F.lit(0))
    sizes = placed.groupBy("cell").agg(*[F.ceil(count(w) / block).cast("long").alias(name) for w, name in ((CORE, "c"), (REST, "r"), (VISITOR, "g"))])
    rows = placed.join(F.broadcast(sizes), "cell")  # at most a row per centroid
    blocks = F.when(F.col("kind") == CORE, F.col("c")).when(F.col("kind") == REST, F.col("r")).otherwise(F.col("g"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("ids", "kind"), blocks))
    # pairs of blocks: rest with rest (i <= j), core, and visitors; core with visitors
    none = F.expr("cast(array() as array<struct<one:int,two:int,i:bigint,j:bigint>>)")
    upto = lambda c, make: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(c) - 1), make)).otherwise(none)
    pair = lambda one, two, i, j: F.struct(F.lit(one).alias("one"), F.lit(two).alias("two"), i.alias("i"), j.alias("j"))
    p = F.col("part")
    tasks = (
        F.when(F.col("kind") == REST, F.concat(upto("r", lambda j: pair(REST, REST, F.least(p, j), F.greatest(p, j))), upto("c", lambda j: pair(REST, CORE, p, j)), upto("g", lambda j: pair(REST, VISITOR, p, j))))
        .when(F.col("kind") == CORE, F.concat(upto("r", lambda i: pair(REST, CORE, i, p)), upto("g", lambda j: pair(CORE, VISITOR, p, j))))
        .otherwise(F.concat(upto("r", lambda i: pair(REST, VISITOR, i, p)), upto("c", lambda i: pair(CORE, VISITOR, i, p))))
    )
    met = rows.select("cell", "kind", "part", "ids", "homes", "vecs", F.explode(tasks).alias("t")).select("cell", "kind", "part", "ids", "homes", "vecs", "t.*")

    def compare(table: pa.Table) -> pa.Table:
        cell, one, two, i, j = (table[c][0].as_py() for c in ("cell", "one", "two", "i", "j"))
        which, part = table["kind"].to_numpy(), table["part"].to_numpy()

        def side(of, number):
            rows = table.filter(pa.array((which == of) & (part == number)))
            joined = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
            return joined("ids", np.int64), joined("homes", np.int32), _unit(joined("vecs", kind).reshape(-1, dim)) if rows.num_rows else np.empty((0, dim))

        a_ids, _, a = side(one, i)
        alone = one == two and i == j
        b_ids, b_homes, b = (a_ids, None, a) if alone else side(two, j)
        linked = np.zeros((len(a), len(b)), bool)
        for x in range(0, len(a), 1024):
            linked[x : x + 1024] = a[x : x + 1024] @ b.T >= threshold
        linked &= a_ids[:, None] != b_ids[None, :]
        if two == VISITOR and linked.any():
            # a pair of which each visits the other's home is compared in the lower cell
            for home in np.unique(b_homes[b_homes < cell]):
                also = shared.value.place(a)[2][:, home]
                linked[np.ix_(also, b_homes == home)] = False
        counts = linked.sum(1) if alone else np.concatenate([linked.sum(1), linked.sum(0)])
        ids = a_ids if alone else np.concatenate([a_ids, b_ids])
        label = _least_linked(linked, a_ids, a_ids if alone else b_ids, alone)
        on = counts > 0
        return pa.table({"id": ids[on], "n": counts[on].astype(np.int64), "label": label[on]})

    found = scratch.keep(met.groupBy("cell", "one", "two", "i", "j").applyInArrow(compare, "id long, n long, label long"), "links")
    members = placed.where(F.col("kind") == CORE).select("cell", "ids").mapInArrow(_unpacked, "cell long, id long").groupBy("cell", "id").agg(F.count("*").alias("own"))
    members = scratch.keep(members, "cores")
    cores = F.broadcast(members.groupBy("cell").agg(F.sum("own").alias("m"), F.min("id").alias("label")))  # at most a row per centroid
    inside = members.join(cores, "cell").select("id", (F.col("own") * (F.col("m") - F.col("own"))).alias("n"), "label")
    everything = found.unionByName(inside)
    return everything.select("id", "n"), everything.select("id", "label")


def _unpacked(batches):
    for batch in batches:
        for cell, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(ids, np.int64)
            yield pa.record_batch([pa.array(np.full(len(x), cell)), pa.array(x)], ["cell", "id"])


def _least_linked(linked: np.ndarray, a: np.ndarray, b: np.ndarray, alone: bool) -> np.ndarray:
    """Least id of each vector's component in a block pair, rows first (rows and columns are the same if ``alone``)."""
    rows, cols = a.copy(), b.copy()
    touched = np.flatnonzero(linked.any(1))
    big = np.iinfo(np.int64).max
    while len(touched):
        old = rows.copy(), cols.copy()
        for x in range(0, len(touched), 512):
            at = touched[x : x + 512]
            m = linked[at]
            rows[at] = np.minimum(rows[at], np.where(m, cols, big).min(1))
            cols = np.minimum(cols, np.where(m, rows[at][:, None], big).min(0))
        if alone:
            rows = cols = np.minimum(rows, cols)
        if (rows == old[0]).all() and (cols == old[1]).all():
            break
    return rows if alone else np.concatenate([rows, cols])
