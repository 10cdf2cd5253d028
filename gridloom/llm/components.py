"""Connected components of a link table by alternating star contractions; nothing but counts reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Up to so many links are joined in one task; a constant, whatever the input.
AT_ONCE = 1 << 18


def _together(edges: DataFrame) -> DataFrame:
    """vertex, root of a table of few links, by union-find in one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}
        pairs, types = [], None
        for batch in batches:
            types = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                pairs.append((number.setdefault(u, len(number)), number.setdefault(v, len(number))))
        if not pairs:
            return
        names = list(number)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = [0] * len(names)
        for r, i in enumerate(order):
            rank[i] = r
        forest = Forest(len(names))  # over ranks, so that a root is its tree's smallest vertex
        for a, b in pairs:
            forest.join(rank[a], rank[b])
        roots = [names[order[forest.find(rank[i])]] for i in range(len(names))]
        for lo in range(0, len(names), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + (1 << 14)], types), pa.array(roots[lo : lo + (1 << 14)], types)], ["vertex", "root"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, f"vertex {kind}, root {kind}")


def components(links: DataFrame, work: Workspace, name: str = "components", at_once: int = AT_ONCE) -> DataFrame:
    """links: a, b (any orderable type, not null). Returns vertex, root (the smallest vertex of the component) for all
    vertices with a link to another. Few links (`at_once`) are joined in one task, more by rounds over all tasks. Each round is a table in shared storage, so a lost executor costs one round at most.
    """
    edges = work.keep(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    if edges.count() <= at_once:
        return _together(edges)
    state, step = None, 0
    while True:
        # larger neighbours go to the smallest vertex in reach
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # smaller neighbours and the vertex itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        step += 1
        edges = work.keep(small, f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("vertex"), "root").unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
        state = now


class Forest:
    """Union-find over 0..n-1; `join` tells whether it made a difference."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
