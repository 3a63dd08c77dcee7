"""Trees by path: Merkle rollup level by level, structural differences, covering chains.

tree: path, parent_path, depth (root 0), content (null for directories).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest
from ..functions.text import path_segments
from ..plans.scratch import Tables

VERSION = "corvane.node.v1"


def _preimage(children: Column, content: Column) -> Column:
    """JSON with sorted keys; children are sorted by name, then hash; an absent content has no key."""
    return F.to_json(F.struct(children.alias("children"), content.alias("content"), F.lit(VERSION).alias("v")))


def rollup(tree: DataFrame, scratch=None, top: int = 0) -> DataFrame:  # noqa: ANN001
    """path, parent_path, depth, content, subtree_hash: one grouped aggregation for each level, leaves first.

    A node's hash covers its content and its children's names (relative to it) and hashes, so a
    change moves exactly the hashes of its ancestors.  Levels above `top` are left out: no hash below
    needs them.  A level that another stands on is written, so that the next reads it and nothing
    below; a directory's children are one row, as the hash asks.
    """
    scratch = scratch or Tables(tree.sparkSession)
    tree = tree if hasattr(tree, "_corvane_table") else scratch.table(tree)
    depth = tree.agg(F.max("depth")).first()[0]
    name = F.element_at(F.split("path", "/"), -1)
    none = F.array().cast("array<struct<hash: string, name: string>>")
    done, below = None, None
    for level in range(depth if depth is not None else -1, top - 1, -1):
        nodes = tree.where(F.col("depth") == level)
        if below is None:
            nodes = nodes.withColumn("children", none)
        else:
            kids = below.groupBy(F.col("parent_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct(name.alias("name"), F.col("subtree_hash").alias("hash")))).alias("children"))
            ordered = F.transform("children", lambda c: F.struct(c["hash"].alias("hash"), c["name"].alias("name")))
            nodes = nodes.join(kids.select("path", ordered.alias("children")), "path", "left").withColumn("children", F.coalesce("children", none))
        below = nodes.select("path", "parent_path", "depth", "content", digest(_preimage(F.col("children"), F.col("content"))).alias("subtree_hash"))
        below = scratch.table(below) if level > top else below
        done = below if done is None else done.unionByName(below)
    if done is None:
        return tree.where("false").withColumn("subtree_hash", F.lit(None).cast("string"))
    return done


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change of every node that differs between two rollups: added, removed, changed."""
    a, b = before.select("path", F.col("subtree_hash").alias("a")), after.select("path", F.col("subtree_hash").alias("b"))
    rows = a.join(b, "path", "full_outer").where("not (a <=> b)")
    return rows.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def rehash_paths(rolled: DataFrame, changed: DataFrame) -> DataFrame:
    """Only the chains from changed leaves (path, content) to the root, with their new hashes."""
    segments = F.split("path", "/")
    chain = changed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, 1, i), "/"))).alias("path")).distinct()
    new = rolled.drop("subtree_hash").join(changed.select("path", F.col("content").alias("_new"), F.lit(True).alias("_is")), "path", "left")
    new = new.withColumn("content", F.when(F.col("_is"), F.col("_new")).otherwise(F.col("content"))).drop("_new", "_is")
    touched = new.join(chain, "path", "left_semi").select("path", "depth")
    # siblings keep their hashes: only what is on a chain is folded again
    depth = touched.agg(F.max("depth")).first()[0]
    hashes = rolled.select("path", "parent_path", "subtree_hash", "depth")
    name = F.element_at(F.split("path", "/"), -1)
    none = F.array().cast("array<struct<hash: string, name: string>>")
    out, fresh = None, None
    for level in range(depth if depth is not None else -1, -1, -1):
        nodes = new.join(touched.where(F.col("depth") == level).select("path"), "path", "left_semi")
        kids = hashes.where(F.col("depth") == level + 1).join(nodes.select(F.col("path").alias("parent_path")), "parent_path", "left_semi")
        if fresh is not None:
            kids = kids.join(fresh.select("path", F.col("subtree_hash").alias("_h")), "path", "left").withColumn("subtree_hash", F.coalesce("_h", "subtree_hash")).drop("_h")
        kids = kids.groupBy(F.col("parent_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct(name.alias("name"), F.col("subtree_hash").alias("hash")))).alias("k"))
        kids = kids.select("path", F.transform("k", lambda c: F.struct(c["hash"].alias("hash"), c["name"].alias("name"))).alias("k"))
        nodes = nodes.join(kids, "path", "left")
        fresh = nodes.select("path", digest(_preimage(F.coalesce("k", none), F.col("content"))).alias("subtree_hash"))
        out = fresh if out is None else out.unionByName(fresh)
    return out if out is not None else rolled.select("path", "subtree_hash").limit(0)


def covering_chain(queries: DataFrame, tree: DataFrame) -> DataFrame:
    """query, depth, path: the nodes from the root to each query's path; none if any of them is missing."""
    segments = path_segments(F.col("query"))
    steps = queries.select("query", segments.alias("s")).select("query", F.size("s").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1))), lambda i: F.array_join(F.slice("s", 1, i), "/"))).alias("depth", "path"))
    found = steps.join(tree.select("path"), "path")
    whole = found.groupBy("query", "n").agg(F.count("*").alias("got")).where("got = n").select("query")
    return found.join(whole, "query", "left_semi").select("query", "depth", "path")


def resolve(queries: DataFrame, tree: DataFrame) -> DataFrame:
    """The last node of each query's chain."""
    chain = covering_chain(queries, tree)
    return chain.groupBy("query").agg(F.max_by("path", "depth").alias("path"))


def by_unique_hash(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """subtree_hash, path: where a content has moved, if exactly one path has it."""
    one = nodes.join(wanted.select("subtree_hash").distinct(), "subtree_hash").groupBy("subtree_hash")
    return one.agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").select("subtree_hash", "path")


def under(tree: DataFrame, scope: str) -> DataFrame:
    """The nodes of a scope, by whole segments; the filter is on path alone and reaches the scan."""
    top = scope.rstrip("/")
    return tree.where((F.col("path") == top) | F.col("path").startswith(top + "/")) if top else tree
