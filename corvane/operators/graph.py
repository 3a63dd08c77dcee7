"""Components of string-keyed graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many edges one task joins in memory, about 150 MB of it.
TASK_EDGES = 1 << 18
_OUT = 1 << 16  # rows of a batch


def _union(at: DataFrame) -> DataFrame:
    """Union-find over all edges (u, v) in one task; of two roots the smaller stays one."""
    rows = _OUT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[str, str] = {}

        def root(x: str) -> str:
            while (up := above[x]) != x:
                above[x] = above[up]
                x = up
            return x

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
                above.setdefault(u, u)
                above.setdefault(v, v)
                if (p := root(u)) != (q := root(v)):
                    above[max(p, q)] = min(p, q)
        nodes = list(above)
        for k in range(0, len(nodes), rows):
            some = nodes[k : k + rows]
            yield pd.DataFrame({"node_key": some, "class_key": [root(x) for x in some]})

    return at.coalesce(1).mapInPandas(run, "node_key string, class_key string")


def components(edges: DataFrame, scratch, task_edges: int = TASK_EDGES) -> DataFrame:  # noqa: ANN001
    """edges a, b.  node_key, class_key (smallest member) of every node with an edge; loops and nulls are ignored.

    Up to `task_edges` edges are joined in one task.  More are drawn together by large-star and
    small-star steps in turn, which leave each component a star around its smallest node after about
    log2(size) rounds, in whatever order the keys stand along a chain; minima are partial aggregates
    and go back to the edges by plain joins, so that AQE can split a hub's edges.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    at = scratch.table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        if at.count() <= task_edges:
            return scratch.table(_union(at))
        state = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            roots = at.select("v").distinct().select("v", F.col("v").alias("r"))
            return at.unionByName(roots.toDF("u", "v")).toDF("node_key", "class_key")
        seen = state
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(small.unionByName(low.toDF("u", "v")).distinct())
        scratch.drop(at)
        scratch.drop(large)
        at = new
