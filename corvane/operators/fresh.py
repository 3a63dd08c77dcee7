"""Freshness: drift of anchored facts against a snapshot, gates, reconciliation, regrounding.

entries: fact, pos, path, subtree_hash (what the fact was grounded on); nodes: path, subtree_hash.
All verdicts fail closed: what is unknown or missing is DRIFTED or NA, never fresh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import by_unique_hash


def drift(facts: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """fact, freshness: FRESH if there is an entry, each has a hash and all equal the snapshot's; else DRIFTED."""
    seen = entries.join(nodes.select("path", F.col("subtree_hash").alias("now")), "path", "left")
    same = F.coalesce((F.col("subtree_hash") == F.col("now")) & (F.col("subtree_hash") != ""), F.lit(False))
    held = seen.groupBy("fact").agg(F.bool_and(same).alias("held"))
    return facts.select("fact").distinct().join(held, "fact", "left").select("fact", F.when(F.coalesce("held", F.lit(False)), "FRESH").otherwise("DRIFTED").alias("freshness"))


def gate(status: Column, grounded: Column, freshness: Column) -> Column:
    """HOLDS stands only for a grounded fresh fact, else NA; other statuses pass."""
    ok = F.coalesce(grounded, F.lit(False)) & F.coalesce(freshness == "FRESH", F.lit(False))
    return F.when(status == "HOLDS", F.when(ok, "HOLDS").otherwise("NA")).otherwise(status)


def relocations(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drifted entries with where their content is now (moved_to), if exactly one path has it."""
    seen = entries.join(nodes.select("path", F.col("subtree_hash").alias("now")), "path", "left").where("not (now <=> subtree_hash)").drop("now")
    moved = by_unique_hash(seen, nodes).withColumnRenamed("path", "moved_to")
    return seen.join(moved, "subtree_hash", "left").select("fact", "pos", "path", "subtree_hash", "moved_to")


def reconcile(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """fact, kind of each drifted fact: mechanical if every drifted entry has one place to move to, else semantic."""
    moved = relocations(entries, nodes)
    return moved.groupBy("fact").agg(F.when(F.bool_and(F.col("moved_to").isNotNull()), "mechanical").otherwise("semantic").alias("kind"))


def exit_code(reconciled: DataFrame) -> DataFrame:
    """One row: mechanical, semantic, code (2 if anything needs a person, else 0)."""
    n = reconciled.agg(F.count_if(F.col("kind") == "mechanical").alias("mechanical"), F.count_if(F.col("kind") == "semantic").alias("semantic"))
    return n.withColumn("code", F.when(F.col("semantic") > 0, 2).otherwise(0))


def reground(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """entries with moved anchors replaced, and whether the whole fact is FRESH again."""
    moved = relocations(entries, nodes).select("fact", "pos", F.lit(True).alias("_d"), "moved_to")
    rows = entries.join(moved, ["fact", "pos"], "left").withColumn("path", F.coalesce("moved_to", "path"))
    whole = rows.groupBy("fact").agg(F.when(F.bool_and(F.col("_d").isNull() | F.col("moved_to").isNotNull()), "FRESH").otherwise("DRIFTED").alias("freshness"))
    return rows.join(whole, "fact").select("fact", "pos", "path", "subtree_hash", "freshness")


def plans(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """fact, action, entries of each drifted fact: reground with the places its anchors moved to, or retire; sound facts have no plan.

    entries: how many anchors the fact has, with those that moved replaced where it is regrounded.
    """
    kind = reconcile(entries, nodes)
    moved = relocations(entries, nodes).select("fact", "pos", "moved_to")
    rows = entries.join(moved, ["fact", "pos"], "left").join(kind, "fact")
    to = F.when(F.col("kind") == "mechanical", F.coalesce("moved_to", "path")).otherwise(F.col("path"))
    out = rows.groupBy("fact", "kind").agg(F.count("*").alias("entries"), F.count_if(to != F.col("path")).alias("moved"))
    return out.select("fact", F.when(F.col("kind") == "mechanical", "reground").otherwise("retire").alias("action"), "entries", "moved")


def status(checks: DataFrame, freshness: DataFrame, verdicts: DataFrame) -> DataFrame:
    """fact, status, emitted: what a fact's own check tells, through the gate; only what holds is emitted.

    checks: fact, check_id, grounded; freshness: fact, freshness; verdicts: check_id, verdict.
    """
    rows = checks.join(verdicts, "check_id", "left").join(freshness, "fact", "left")
    out = gate(F.coalesce("verdict", F.lit("NA")), F.col("grounded"), F.col("freshness"))
    return rows.select("fact", out.alias("status"), (out == "HOLDS").alias("emitted"))


def ground(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """fact, pos, path, subtree_hash of the facts all of whose citations (fact, pos, path) resolve."""
    found = citations.join(nodes.select("path", "subtree_hash"), "path", "left")
    whole = found.groupBy("fact").agg(F.bool_and(F.col("subtree_hash").isNotNull()).alias("ok")).where("ok").select("fact")
    return found.join(whole, "fact", "left_semi").select("fact", "pos", "path", "subtree_hash")


def closure_fresh(before: DataFrame, after: DataFrame) -> DataFrame:
    """fact, fresh: whether the multisets of (node, state) that two versions give a fact are equal.

    Compared by counts of equal rows, so that no closure is gathered.
    """
    a = before.groupBy("fact", "node", "state").agg(F.count("*").alias("a"))
    b = after.groupBy("fact", "node", "state").agg(F.count("*").alias("b"))
    rows = a.join(b, ["fact", "node", "state"], "full_outer")
    return rows.groupBy("fact").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("fresh"))
