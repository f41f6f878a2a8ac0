"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint


class LocalUnion:
    """Union-find over the nodes one task sees; its edges form stars, at most one edge for each node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while p.get(x, x) != root:
            p[x], x = root, p[x]
        return root

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.parent.setdefault(min(x, y), min(x, y))

    def edges(self, size: int = 50_000):
        nodes = [x for x in self.parent if self.find(x) != x]
        for i in range(0, len(nodes), size):
            part = nodes[i : i + size]
            yield np.array(part, dtype=np.int64), np.array([self.find(x) for x in part], dtype=np.int64)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, root): every node that has an edge to another one, and the least node of its component.

    Large-star and small-star rounds: each keeps components, points nodes at smaller ones and ends in stars, in rounds
    about logarithmic in the size of a component. Minima are pre-aggregated. A star's centre is a hot key, so centres of
    over a thousandth of the edges (at most a thousand) are looked up by broadcast and only the others by a join. Each
    step ends in a checkpoint; only counts and a sum of hashes reach the driver. Null nodes are dropped; loops and
    repeated edges are immaterial.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
        e = checkpoint(_small_star(checkpoint(_large_star(e, now[0]))))
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """(u, v), u > v -> (u, the least of v and its neighbours)."""
    low = e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    ends = e.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(low, F.col("v") == F.col("w"), "left")
    ends = checkpoint(ends.select("v", "n", F.coalesce("m", "v").alias("m")))
    hot = F.broadcast(ends.where(F.col("n") * 1000 > total).select("v", "m"))
    cold = ends.where(F.col("n") * 1000 <= total).select("v", "m")
    rest = e.join(hot.select("v"), "v", "left_anti").join(cold, "v")
    return e.join(hot, "v").select("u", "m").unionAll(rest.select("u", "m")).distinct().select("u", F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours -> all to the least of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
