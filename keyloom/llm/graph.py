"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut


#: Edges that one task finishes at most (16 bytes each); more are contracted by distributed rounds first.
FINISH = 500_000


def _finish(batches):
    """Union-find over the edges of one partition."""
    batches = list(batches)
    if not batches:
        return
    a, b = (np.concatenate([x.column(c).to_numpy() for x in batches]) for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        up[max(i, j)] = min(i, j)
    for i in range(len(up)):  # parents are smaller, so theirs are final
        up[i] = up[up[i]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being its component's least node.

    While there are more than FINISH edges, large-star and small-star steps alternate: each node's neighbours are linked to the least of
    them, first the larger neighbours and then the smaller ones, until nothing changes. Every step is
    an aggregation with partial sums and an equi-join that can be split at a node of high degree; the
    edge list never grows beyond its first size, and lineage is cut by a checkpoint every round. What is
    left below FINISH edges, a bounded amount, is joined in one task.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    spark = edges.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism  # edges are few bytes: no more tasks than cores can use
    edges = cut(edges.distinct().coalesce(tasks))
    while edges.count() > FINISH:
        before = edges.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks))
        if edges.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == before:
            nodes = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return edges.coalesce(1).mapInArrow(_finish, "node long, root long")
