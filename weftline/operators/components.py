"""Connected components with the smallest id as label."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.stage import staged


#: Nodes that a task joins up in memory before it starts afresh; edges of half as many are joined up by one task.
FOREST_NODES = 500_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a partition, the same connections as edges (node, smallest node it is joined to), one for each node."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def forest() -> pa.RecordBatch:
        pairs = [(x, top(x)) for x in up]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a) if a in up else up.setdefault(a, a), top(b) if b in up else up.setdefault(b, b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST_NODES:
            yield forest()
            up.clear()
    yield forest()


def components(edges: DataFrame, vertices: DataFrame | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every end of an edge (and every vertex, if given): label is the smallest id that is reachable.

    Partitions first reduce their edges to forests. Where these have few edges, one task joins them up. Where not, every
    node joins its smallest neighbour, and the same goes on with the edges between those that were joined, until few are
    left; groups of a few nodes and stars are done with after one round. Each round is staged in the shared folder. Null
    ends and self loops add nothing but the node.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    work = staged(pairs.mapInArrow(_forest, "a long, b long"), "components")
    labels = _joined(work, work.count()).withColumnsRenamed({"a": "id", "b": "label"})
    if vertices is None:
        return labels
    every = vertices.select(F.col(vertices.columns[0]).cast("long").alias("id")).filter("id is not null").distinct()
    return every.join(labels, "id", "full").withColumn("label", F.coalesce("label", "id"))


def _joined(work: DataFrame, n: int) -> DataFrame:
    """(a, b) of each node of n edges (a self loop is one) and its smallest reachable node.

    A round is a min per node and two equi-joins. What it leaves is joined up by the next, and every node then takes the label of
    the node that it joined. Where over three quarters of the edges are left, as of paths that climb from one end to the other,
    large-star and small-star steps do the rest.
    """
    if n <= FOREST_NODES // 2:
        return staged(work.repartition(1).mapInArrow(_forest, "a long, b long"), "components")
    both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")), "components")
    moved = work.filter("a <> b").join(up.select("a", F.col("b").alias("x")), "a").join(up.select(F.col("a").alias("b"), F.col("b").alias("y")), "b").filter("x <> y")
    left = staged(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "components")
    m = left.count()
    if not m:
        return up
    rest = _stars(left) if 4 * m > 3 * n else _joined(left, m)
    return up.join(rest.select(F.col("a").alias("b"), F.col("b").alias("label")), "b", "left").select("a", F.coalesce("label", "b").alias("b"))


def _stars(work: DataFrame) -> DataFrame:
    """(a, b) of edges to each node's smallest reachable node, for the nodes that have a smaller one."""
    before = None
    while True:
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.filter("m < a").select("a", F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        work = staged(small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "components")
        now = tuple(work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return work
        before = now
