"""Packs: ranked, bounded, budget-limited rows, and the ledgers of what they served.

A budget that stops at the first row that doesn't fit is a running sum, since costs are not negative;
one that skips such a row and goes on is an ordered fold over the unit's own candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tier_rank
from .runs import running

PACK_CAP, OWN_CAP, OWN_ADVISORY_CAP, ADVISORY_CAP, CEILING = 2000, 1500, 750, 2000, 5000
EDGE_CAP, MANIFEST_CAP, RELATED_CAP = 8, 12, 8
MISCAP = 0.2
_NO_UNIT = object()
#: Kinds of injection, their caps, the order in which cold ones are dropped, and whether they never are.
KINDS = (
    ("awareness", 400, 99, True), ("orientation", 250, 5, False), ("projectMem", 500, 4, False), ("own", 1500, 3, False),
    ("pack", 2000, 2, False), ("protocols.safetyCritical", 500, 98, True), ("protocols.advisory", 500, 1, False), ("poke", 150, 0, False),
)


def kinds(spark: SparkSession) -> DataFrame:
    """kind, base (its cap), cold_rank, pinned of every kind of injection: eight rows."""
    return spark.createDataFrame(KINDS, "kind string, base int, cold_rank int, pinned boolean")


def pack_order() -> list[Column]:
    return [tier_rank(F.col("tier")).asc(), F.desc(F.coalesce("hits", F.lit(0))), F.desc("ppr"), F.asc("node_key")]


def fill(candidates: DataFrame, group: str, cap: int = PACK_CAP) -> DataFrame:
    """The candidates of T0 and T1 by rank, with used (running cost) and served (within the cap).

    candidates: group, node_key, tier, ppr, hits, cost.  Rows past the cap are the tail: returned, not
    dropped.  A group of any size is numbered in runs.
    """
    rows = candidates.where(F.col("tier").isin("T0", "T1"))
    return running(rows, [group], pack_order(), "cost").withColumn("served", F.col("used") <= cap)


def split_bands(rows: DataFrame, group: str, cap: int = ADVISORY_CAP) -> DataFrame:
    """band (governing, advisory or none) and served: governing rows are uncapped, advisory ones stop at the cap."""
    band = F.when(F.col("tier").isin("T0", "T1"), "governing").when(F.col("tier") == "T2", "advisory").otherwise("none")
    rows = running(rows.withColumn("band", band), [group, "band"], [F.asc("node_key")], "cost")
    served = F.when(F.col("band") == "governing", True).when(F.col("band") == "advisory", F.col("used") <= cap).otherwise(False)
    return rows.withColumn("served", served).drop("rank", "used")


def resolve_ceiling(injections: DataFrame, group: str, ceiling: int = CEILING) -> DataFrame:
    """dropped for each injection (kind, cost, hit_rate, hits, pinned, cold_rank) of a group.

    If anything was hit, the lowest rate goes first, else the cold order; pinned kinds stay.  A row
    goes as long as what is left before it is over the ceiling.
    """
    whole = Window.partitionBy(group)
    rows = injections.withColumn("_sum", F.sum("cost").over(whole)).withColumn("_warm", F.max("hits").over(whole) > 0)
    order = Window.partitionBy(group, "pinned").orderBy(F.when(F.col("_warm"), F.col("hit_rate")).otherwise(0.0), "cold_rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cost").over(order), F.lit(0))
    return rows.withColumn("dropped", ~F.col("pinned") & (F.col("_sum") - before > ceiling)).drop("_sum", "_warm")


def drop_order(injections: DataFrame, group: str) -> DataFrame:
    """group, kind, place: the order in which a group's kinds are dropped; pinned ones have no place."""
    rows = injections.withColumn("_warm", F.max("hits").over(Window.partitionBy(group)) > 0).where("not pinned")
    by = Window.partitionBy(group).orderBy(F.when(F.col("_warm"), F.col("hit_rate")).otherwise(0.0), "cold_rank")
    return rows.select(group, "kind", F.row_number().over(by).alias("place"))


def cap_for(kind: Column) -> Column:
    """The cap of a kind of injection; null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, cap, *_ in KINDS for x in (k, cap))), kind)


def ledger(hits: DataFrame, kinds: DataFrame, gain: float = 1.0) -> DataFrame:
    """kind, hits, served, hit_rate, cap of every kind (kind, base): the cap grows with the rate of hits."""
    n = hits.groupBy("kind").agg(F.count_if("hit").alias("hits"), F.count("*").alias("served"))
    rows = kinds.join(n, "kind", "left").na.fill(0, ["hits", "served"])
    rate = F.when(F.col("served") == 0, 0.0).otherwise(F.col("hits") / F.col("served"))
    return rows.withColumn("hit_rate", rate).withColumn("cap", F.floor(F.col("base") * (1 + gain * F.col("hit_rate")) + 0.5)).drop("base")


def off_index(turns: DataFrame, known: DataFrame, threshold: float = 0.2) -> DataFrame:
    """territory, served, misses, rate, crosses from turns (territory, missed); known territories without turns have 0."""
    n = turns.groupBy("territory").agg(F.count("*").alias("served"), F.count_if("missed").alias("misses"))
    rows = n.join(known.select("territory").distinct(), "territory", "full_outer").na.fill(0, ["served", "misses"])
    rate = F.when(F.col("served") == 0, 0.0).otherwise(F.col("misses") / F.col("served"))
    return rows.withColumn("rate", rate).withColumn("crosses", F.col("rate") > threshold)


def drop_counter(drops: DataFrame, turns: DataFrame) -> DataFrame:
    """kind, dropped, turns, rate, flagged from drops (turn, kind): in how many turns a kind was dropped."""
    total = turns.agg(F.countDistinct("turn").alias("turns"))
    n = drops.groupBy("kind").agg(F.countDistinct("turn").alias("dropped"))
    rate = F.when(F.col("turns") == 0, 0.0).otherwise(F.col("dropped") / F.col("turns"))
    return n.join(F.broadcast(total)).withColumn("rate", rate).withColumn("flagged", F.col("rate") > MISCAP)


def relate(related: DataFrame, group: str, cap: int = RELATED_CAP, hops: int = 2) -> DataFrame:
    """The first `cap` rows of each band by tier, ppr, distance and key, with the band's honest total."""
    rows = running(related.where(F.col("distance") <= hops), [group, "band"], [tier_rank(F.col("tier")).asc(), F.desc("ppr"), F.asc("distance"), F.asc("node_key")])
    total = rows.groupBy(F.col(group).alias("_g"), F.col("band").alias("_b")).agg(F.count("*").alias("total"))
    first = rows.where(F.col("rank") <= cap)
    return first.join(total, first[group].eqNullSafe(total["_g"]) & first["band"].eqNullSafe(total["_b"])).drop("_g", "_b")


def own(candidates: DataFrame, unit: str = "unit") -> DataFrame:
    """unit, node_key, feed, taken: four fills in a row that share one budget.

    candidates: unit, feed (invariant, gotcha, pointer, advisory), node_key, tier, hits, ppr, cost.
    Invariants and gotchas that don't fit are skipped and the fill goes on; pointers are at most
    MANIFEST_CAP; advisory rows stop at the first that fits neither the budget nor their own cap.
    unit is a string.
    """
    feed = F.when(F.col("feed") == "invariant", 0).when(F.col("feed") == "gotcha", 1).when(F.col("feed") == "pointer", 2).otherwise(3)
    ranked = F.when(feed == 2, 0).otherwise(tier_rank(F.col("tier")))
    hits = F.when(feed == 1, 0).otherwise(-F.coalesce("hits", F.lit(0)))
    ppr = F.when(feed.isin(0, 3), -F.coalesce("ppr", F.lit(0.0))).otherwise(0.0)
    rows = candidates.select(F.col(unit).alias("unit"), feed.alias("_f"), ranked.alias("_t"), hits.cast("long").alias("_h"), ppr.alias("_p"), "node_key", F.col("cost").cast("long").alias("cost"), "feed")
    # a unit's rows stand in one run, in order, and go through a fold of four numbers: none is gathered
    rows = rows.repartition("unit").sortWithinPartitions("unit", "_f", "_t", "_h", "_p", "node_key", "cost")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, used, pointers, advisory, capped = _NO_UNIT, 0, 0, 0, False
        for batch in batches:
            taken = []
            for u, f, cost in zip(batch["unit"].tolist(), batch["_f"].tolist(), batch["cost"].tolist(), strict=True):
                if u != here:
                    here, used, pointers, advisory, capped = u, 0, 0, 0, False
                fits = used + cost <= OWN_CAP and (f != 2 or pointers < MANIFEST_CAP) and (f != 3 or (not capped and advisory + cost <= OWN_ADVISORY_CAP))
                if fits:
                    used, pointers, advisory = used + cost, pointers + (f == 2), advisory + (cost if f == 3 else 0)
                capped = capped or (f == 3 and not fits)
                taken.append(fits)
            yield pd.DataFrame({"unit": batch["unit"], "node_key": batch["node_key"], "feed": batch["feed"], "taken": taken})

    return rows.mapInPandas(run, "unit string, node_key string, feed string, taken boolean").withColumnRenamed("unit", unit)


def dedup(pack: DataFrame, own_rows: DataFrame) -> DataFrame:
    """pack rows with pointer: whether the unit's own pack already has the row, which is then only pointed at."""
    have = own_rows.select("node_key").distinct().withColumn("_own", F.lit(True))
    return pack.join(have, "node_key", "left").withColumn("pointer", F.coalesce("_own", F.lit(False))).drop("_own")


def governing_gotchas(rows: DataFrame) -> DataFrame:
    """node_key, cost of the gotchas (by slot) of a governing tier; a row's claims, joined, are its cost."""
    return rows.where((F.col("slot") == "gotcha") & F.col("tier").isin("T0", "T1")).select("node_key", F.length(F.concat_ws("; ", "claims")).cast("long").alias("cost"))


def manifest(nodes: DataFrame) -> DataFrame:
    """unit, name, digest, cost of the packs one step finer: a pointer for each child (path, parent_path, subtree_hash) of a unit."""
    from ..functions.text import tool_name

    name = tool_name(F.col("path"))
    return nodes.where("parent_path is not null").select(F.col("parent_path").alias("unit"), name.alias("name"), F.col("subtree_hash").alias("digest"), F.length(name).cast("long").alias("cost"))


def roles(facts: DataFrame, unit: str) -> DataFrame:
    """unit, role: the claim of the first definition, by key, of each unit that has one."""
    rows = facts.where("slot = 'definition'").groupBy(unit).agg(F.min(F.struct("node_key", F.concat_ws("; ", "claims").alias("claim"))).alias("d"))
    return rows.select(unit, F.col("d.claim").alias("role"))
