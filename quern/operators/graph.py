"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quern.scratch import Scratch

#: Edges of a graph whose rounds are written as few files, and edges for each of them.
SMALL_EDGES, FILE_EDGES = 4_000_000, 50_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected edge table with the least node of its component.

    Hooking and shortcutting (FastSV): in each round the least label of the labels of a node's
    neighbours goes to the node and to the node's label, and a node takes the label of its
    label.  So whole trees hook onto each other, whatever the order of the ids, and rounds
    go on until nothing changes.  Every exchange feeds either a partial
    aggregate or a plain equi-join that adaptive execution can split, so a node
    with very many edges does not fill one task.  Each round is written to the
    shared scratch folder, which cuts lineage and survives lost executors; a small
    graph as a few files, however many partitions shuffles have.

    Edges with a null end are ignored; self-loops keep the node in the result.
    Returns columns ``node`` and ``label``.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = scratch.keep(e.union(e.select("b", "a")).groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b"), "cc-edges")
    edges_known = both.count()
    files = math.ceil(edges_known / FILE_EDGES) if edges_known < SMALL_EDGES else None
    few = lambda df: df.coalesce(max(4, files)) if files is not None else df
    labels = scratch.keep(few(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"), F.lit(True).alias("changed"))), "cc-labels")
    changed = True
    while changed:
        at = labels.select(F.col("node").alias("at"), F.col("label").alias("seen"))
        none = F.lit(None).cast(labels.schema["label"].dataType).alias("old")
        jump = labels.join(at, labels.label == at["at"]).select("node", F.col("seen").alias("label"), F.col("label").alias("old"))
        far = jump.select(F.col("node").alias("at"), F.col("label").alias("seen"))
        near = both.join(far, both.b == far["at"]).groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("label"))
        near = scratch.keep(few(near), "cc-near")
        hook = near.withColumnRenamed("label", "least").join(labels.select("node", "label"), "node").select(F.col("label").alias("node"), F.col("least").alias("label"), none)
        new = jump.unionByName(near.select("node", "label", none)).unionByName(hook).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        new = scratch.keep(few(new.select("node", "label", (F.col("label") != F.col("old")).alias("changed"))), "cc-labels")
        scratch.drop(labels, near)
        labels = new
        changed = labels.where("changed").limit(1).count() > 0
    scratch.drop(both)
    return labels.select("node", "label")
