"""Agent memory: recall, rules by frecency, logbook, orientation, awareness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY, SLOTS, FLOOR = 0.5, 12, 0.1


def recall(memory: DataFrame, **wanted: str | None) -> DataFrame:
    """The rows equal in every given column; a call without any gives none."""
    given = {k: v for k, v in wanted.items() if v is not None}
    out = memory
    for k, v in given.items():
        out = out.where(F.col(k) == v)
    return out if given else memory.limit(0)


def frecency(events: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """rule_id, score: the sum of DECAY^(last wave - wave) over governing events; one last wave for all rules."""
    rows = events.where("governing")
    last = now if now is not None else rows.agg(F.max("wave").alias("now"))
    n = rows.groupBy("rule_id", "wave").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(last)).groupBy("rule_id").agg(F.sum(F.col("n") * F.pow(F.lit(DECAY), F.col("now") - F.col("wave"))).alias("score"))


def rank_rules(rules: DataFrame, events: DataFrame, slab: str) -> DataFrame:
    """rules (slab, id) with score, rank and injected: from FLOOR on, the SLOTS best of a slab, ties by id."""
    scored = rules.join(frecency(events).withColumnRenamed("rule_id", "id"), "id", "left").na.fill(0.0, ["score"])
    by = Window.partitionBy(slab).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).withColumn("injected", (F.col("score") >= FLOOR) & (F.col("rank") <= SLOTS))


def orientation(log: DataFrame, channel: str) -> DataFrame:
    """channel, current, previous: the last entry of each channel by position, and the one before."""
    last = log.groupBy(channel).agg(F.max(F.struct("pos", "entry")).alias("l"))
    before = log.join(last.select(channel, F.col("l.pos").alias("_p")), channel).where("pos < _p").groupBy(channel).agg(F.max(F.struct("pos", "entry")).alias("b"))
    return last.join(before, channel, "left").select(channel, F.col("l.entry").alias("current"), F.col("b.entry").alias("previous"))


def cap_gate(entries: DataFrame, group: str, cap: int) -> DataFrame:
    """group, tokens, fits."""
    return entries.groupBy(group).agg(F.sum("tokens").alias("tokens")).withColumn("fits", F.col("tokens") <= cap)


def navigates(tool: Column, paths: Column) -> Column:
    """The scope that a call goes to: the path of a Read, Edit or Write of one file; null for any other call."""
    return F.when(tool.isin("Read", "Edit", "Write") & (F.size(paths) == 1), F.get(paths, 0))


def poke_runs(calls: DataFrame, least: int = 2) -> DataFrame:
    """session, pos, scope, run: the first call of each session and scope whose run of equal scopes reaches `least`.

    calls: session, pos, scope (null: no navigation; the navigator stays where it is, which lengthens
    the run, so that such a call can be the one that reaches `least`).  Calls before the first
    navigation belong to no run.
    """
    by = Window.partitionBy("session").orderBy("pos")
    here = F.last("scope", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    moves = calls.select("session", "pos", here.alias("scope")).where("scope is not null")
    rows = moves.withColumn("_new", F.coalesce((F.col("scope") != F.lag("scope").over(by)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(by))
    rows = rows.withColumn("run", F.row_number().over(Window.partitionBy("session", "_island").orderBy("pos")))
    first = rows.where(F.col("run") >= least).groupBy("session", "scope").agg(F.min(F.struct("pos", "run")).alias("f"))
    return first.select("session", "f.pos", "scope", "f.run")
