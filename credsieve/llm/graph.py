"""Connected components by alternating star operations over edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import staged


class Sets:
    """Disjoint sets of 0..n-1 within one task."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.find(a) for a in range(len(self.parent))], dtype=np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node it can reach.

    ``edges`` has columns ``a`` and ``b``. Large stars tie each node's larger neighbours to the smallest
    one, small stars the smaller ones; a node of very many neighbours is summed up before the shuffle
    and joined from the side of its edges. Ends when the edges are stars and stay so.
    """
    high, low = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    stars = staged(edges.filter("a <> b").select(high, low).distinct())
    mark = None
    while True:
        both = stars.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(
            stars.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        larger = stars.select(F.col("low").alias("u"), F.col("high").alias("v"))
        large = staged(
            larger.join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        )
        least = large.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        tied = large.join(least.withColumnRenamed("u", "high"), "high")
        stars = staged(
            tied.select(F.col("low").alias("high"), F.col("m").alias("low"))
            .filter("high <> low")
            .unionAll(least.select(F.col("u").alias("high"), F.col("m").alias("low")))
            .distinct()
        )
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("high", "low") % (1 << 40))).first()
        if now == mark:
            break
        mark = now
    return stars.select(F.col("high").alias("node"), F.col("low").alias("root")).unionAll(
        stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )
