"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: columns a, b (long).  Returns id, component_id for every id that has an edge to a smaller one.

    The edges of a component shrink to a star around its smallest id in about log2(size) steps.  A
    node's minimum is a partial aggregate and goes back to the edges by a plain join, so that AQE can
    split a hub's edges.  Loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    at = scratch.table(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        state = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return at.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        seen = state
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = scratch.table(small)
        scratch.drop(at)
        scratch.drop(large)
        at = new
