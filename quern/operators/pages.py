"""Pages of a table in the order of a key, read from few files: cursors, and shuffled browsing.

Rows are clustered by a whole number into parts, and a small table has each part's range and
its number of rows in each group.  A page after a cursor is planned from that table
alone: it opens the parts that can hold its rows, and no others.  Appended rows are parts of their
own, so a cursor stays good.  With a hash as the key the order is a shuffled one: the pages from any
place on, around the end to the beginning, are a random sample that never repeats a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.scratch import delete_path

PART_ROWS = 1 << 20
PARTS = "segment int, part int, grp string, low long, high long, n long"


@dataclass(frozen=True)
class Cursor:
    """The place behind a row."""

    key: int
    id: int


@dataclass(frozen=True)
class PageRead:
    rows: DataFrame
    n: int
    #: Parts that were opened.
    opened: int
    #: Where the next page begins; None if there are no more rows.
    after: Cursor | None


def shuffled(id: str = "id", salt: str = "") -> Column:
    """A key that puts rows in a random order: 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(id).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


class Pages:
    """A paged table below ``path``: its rows have a long ``id``; those without one are left out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Column, group: str | None = None, part_rows: int = PART_ROWS):
        self.spark, self.path, self.key, self.group, self.part_rows = spark, path.rstrip("/"), key, group, part_rows
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"_key long, {schema}"

    def append(self, rows: DataFrame, segment: int) -> None:
        """Add rows as a segment; a segment that is written again, after a failure, replaces itself.

        Its line in the table of parts is written last, so readers see all of it or nothing.
        """
        rows = rows.where("id is not null").select(self.key.alias("_key"), *self.columns)
        parts = max(1, -(-rows.count() // self.part_rows))
        folder = f"{self.path}/rows/segment={segment}"
        ranged = rows.repartitionByRange(parts, "_key", "id").sortWithinPartitions("_key", "id").withColumn("page_part", F.spark_partition_id())
        delete_path(self.spark, f"{self.path}/parts/segment={segment}")
        ranged.write.mode("overwrite").partitionBy("page_part").parquet(folder)
        group = F.coalesce(F.col(self.group).cast("string"), F.lit("")) if self.group else F.lit("")
        written = self.spark.read.schema(f"{self.schema}, page_part int").parquet(folder)
        ranges = written.groupBy(F.col("page_part").alias("part"), group.alias("grp")).agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.count("*").alias("n"))
        ranges.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts/segment={segment}")

    def parts(self, groups: list[str] | None = None) -> DataFrame:
        """(segment, part, low, high, n) of the parts that have rows of the groups (null is '')."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root) or not store.listStatus(root):
            all_parts = self.spark.createDataFrame([], PARTS)
        else:
            all_parts = self.spark.read.schema(PARTS).parquet(f"{self.path}/parts")
        some = all_parts.where(F.col("grp").isin(groups)) if groups is not None else all_parts
        return some.groupBy("segment", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))

    def _open(self, parts: list, groups: list[str] | None) -> DataFrame:
        folders = [f"{self.path}/rows/segment={p.segment}/page_part={p.part}" for p in parts]
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        return rows.where(F.coalesce(F.col(self.group).cast("string"), F.lit("")).isin(groups)) if groups is not None and self.group else rows

    def page(self, limit: int, after: Cursor | None = None, groups: list[str] | None = None) -> PageRead:
        """The next rows behind a cursor, or the first ones, by key and id; of some groups only, if these are given."""
        left = self.parts(groups) if after is None else self.parts(groups).where(F.col("high") >= after.key)
        # parts that lie behind the cursor as a whole have rows of known number up to their greatest key; what others have comes on top
        whole = left if after is None else left.where(F.col("low") > after.key)
        bound, seen = None, 0
        for p in whole.orderBy("high").limit(max(1, limit)).collect():
            seen += p.n
            if seen >= limit:
                bound = p.high
                break
        opened = [] if limit <= 0 else (left if bound is None else left.where(F.col("low") <= bound)).collect()
        rows = self._open(opened, groups)
        if bound is not None:
            rows = rows.where(F.col("_key") <= bound)
        if after is not None:
            rows = rows.where((F.col("_key") > after.key) | ((F.col("_key") == after.key) & (F.col("id") > after.id)))
        rows = rows.orderBy("_key", "id").limit(max(0, limit))
        last = rows.agg(F.count("*").alias("n"), F.max(F.struct("_key", "id")).alias("r")).first()
        return PageRead(rows, last.n, len(opened), Cursor(last.r[0], last.r.id) if last.n == limit and limit > 0 else None)

    def around(self, limit: int, after: Cursor | None = None, groups: list[str] | None = None) -> PageRead:
        """A page that goes on at the beginning where the end is reached; at most every row once."""
        first = self.page(limit, after, groups)
        if first.after is not None or after is None:
            return first
        rest = self.page(limit - first.n, None, groups)
        before = (F.col("_key") < after.key) | ((F.col("_key") == after.key) & (F.col("id") <= after.id))
        rows = rest.rows.where(before)
        return PageRead(first.rows.union(rows), first.n + rows.count(), first.opened + rest.opened, rest.after)

    def random_place(self, seed: str, groups: list[str] | None = None) -> Cursor | None:
        """A row's place, each row of the groups equally likely; None if there is none.

        A part wins by its number of rows (the least of exponential times), then a row of it by its rank.
        """
        keyed = self.parts(groups).withColumn("s", F.concat_ws("/", "segment", "part"))
        draw = (shuffled("s", f"{seed}/").cast("double") + 0.5) / float(1 << 60)
        part = keyed.orderBy(-F.log(draw) / F.col("n"), "s").limit(1).collect()
        if not part:
            return None
        rank = int(self.spark.range(1).select(F.pmod(F.conv(F.substring(F.md5(F.lit(f"{seed}/rank").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(part[0].n))).first()[0])
        row = self._open(part, groups).select("_key", "id").orderBy("_key", "id").offset(rank).limit(1).first()
        return Cursor(row[0], row.id)

    def compacted(self, path: str) -> Pages:
        """The same rows as one segment of a table below another path, so that no two parts overlap."""
        rows = self._open(self.parts().collect(), None)
        out = Pages(self.spark, path, self.schema.removeprefix("_key long, "), F.col("_key"), self.group, self.part_rows)
        out.append(rows, 0)
        out.key = self.key
        return out
