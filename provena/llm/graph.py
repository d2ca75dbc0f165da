"""Connected components of an edge table, by large and small stars; nothing is gathered on the driver.

Each round links every node straight to the smallest node it knows, first with its larger neighbours,
then with its smaller ones.  Rounds are written to the shared folder, so lineage stays short and a lost
executor costs one round at most.  Stops when a round changes nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import saved


class Sets:
    """Disjoint sets of 0..n-1; the smallest member leads."""

    def __init__(self, n: int):
        self.lead = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.lead[i], self.lead[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(self.lead, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.lead[self.lead]
                if np.array_equal(up, self.lead):
                    break
                self.lead = up


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _smallest(both).select("u", F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    least = _smallest(down)
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): for every node with a link, the smallest node it reaches."""
    now = saved(edges.select("a", "b").filter("a <> b").groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b"))
    before = None
    while True:
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if told == before or not told.n:
            break
        before = told
        stars = _small_star(_large_star(now))
        now = saved(stars.filter("a <> b").groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b"), told.n)
    # every node hangs on its smallest: a > b
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
