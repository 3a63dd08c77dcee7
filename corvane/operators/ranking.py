"""What is mined first and what it costs: orders of sites and units, cost policy, visits, runs, loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_part, is_tier, weaker
from .mining import CEILING
from .runs import running

INTERVIEW = 20
UNIT = "::"


def unit_order(units: DataFrame) -> DataFrame:
    """units (path, hash, exported, bytes) with file and place: in each file exported first, then the largest, path, hash."""
    rows = units.withColumn("file", file_part(F.col("path")))
    by = Window.partitionBy("file").orderBy(F.desc("exported"), F.desc("bytes"), "path", "hash")
    return rows.withColumn("place", F.row_number().over(by))


def ordinals(nodes: DataFrame, group: str) -> DataFrame:
    """nodes (group, type, name, start) with ordinal: how many of the same type and name stand before it in the group."""
    by = Window.partitionBy(group, "type", F.coalesce("name", F.lit(""))).orderBy("start")
    return nodes.withColumn("ordinal", F.row_number().over(by) - 1)


def correspondence(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subtree_hash, key) and (key, subtree_hash): the smallest partner of each, over all axes' nodes (key, subtree_hash)."""
    pairs = nodes.select("subtree_hash", "key").distinct()
    return pairs.groupBy("subtree_hash").agg(F.min("key").alias("key")), pairs.groupBy("key").agg(F.min("subtree_hash").alias("subtree_hash"))


def site_keys(sites: DataFrame, key_of: DataFrame, graph: DataFrame) -> DataFrame:
    """sites (path, hash) with key: the node of its content if the graph has it, else a unit's file, else that node, else unresolved:hash.

    key_of: subtree_hash, key; graph: node.
    """
    have = graph.select("node").distinct()
    rows = sites.join(key_of.select(F.col("subtree_hash").alias("hash"), F.col("key").alias("_direct")), "hash", "left")
    rows = rows.withColumn("_file", file_part(F.col("path")))
    rows = rows.join(have.select(F.col("node").alias("_direct"), F.lit(True).alias("_in")), "_direct", "left")
    rows = rows.join(have.select(F.col("node").alias("_file"), F.lit(True).alias("_file_in")), "_file", "left")
    unit = F.contains(F.col("path"), F.lit(UNIT))
    key = F.when(F.col("_in"), F.col("_direct")).when(unit & F.col("_file_in"), F.col("_file")).otherwise(F.coalesce("_direct", F.concat(F.lit("unresolved:"), "hash")))
    return rows.withColumn("key", key).drop("_direct", "_file", "_in", "_file_in")


def rank_sites(sites: DataFrame, scores: DataFrame, provable: Column | None = None) -> DataFrame:
    """sites (path, hash, key, group, sub, exported, bytes) with ppr and rank from 1.

    By score, then group, files before their units, exported first, the largest, path, hash; those that
    are provable come first as a whole if that is asked.  The order is one for all sites: places come
    from sorted ranges (runs.running).
    """
    rows = sites.join(scores.select(F.col("node").alias("key"), "score"), "key", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    rows = rows.withColumn("_all", F.lit(0)).withColumn("_first", F.lit(0) if provable is None else F.when(provable, 0).otherwise(1))
    order = [F.asc("_first"), F.desc("score"), F.asc("group"), F.asc("sub"), F.desc("exported"), F.desc("bytes"), F.asc("path"), F.asc("hash")]
    return running(rows, ["_all"], order).select("path", "key", "score", F.col("rank").cast("long").alias("rank"))


def default_ceiling(frontier: Column) -> Column:
    return F.least(frontier, F.lit(CEILING))


# --- cost policy


def tier_at_least(tier: Column, floor: Column) -> Column:
    return ~F.coalesce(weaker(tier, floor), F.lit(True))


def mechanisms(high_value: Column, uncertain: Column, checkable: Column, tier: Column) -> Column:
    """What a candidate is escalated to, comma-joined; '' if it isn't: only high value in doubt is."""
    made = F.concat_ws(
        ",", F.lit("self-consistency"), F.when(checkable & tier_at_least(tier, F.lit("T1")), "check-synthesis"), F.when(tier == "T0", "refuter")
    )
    return F.when(high_value & uncertain, made).otherwise("")


def default_kind(checkable: Column, tier: Column) -> Column:
    return F.when(checkable & tier_at_least(tier, F.lit("T1")), "predicate").otherwise("advisory")


def analyzer(expressible: Column) -> Column:
    return F.when(expressible, "semgrep").otherwise("codeql")


def planned(frontier: DataFrame, scope: str | None) -> DataFrame:
    """The candidates whose path starts with the scope as a text; all without one."""
    return frontier if scope is None else frontier.where(F.startswith("path", F.lit(scope)))


def stage_costs(calls: DataFrame) -> DataFrame:
    """stage, llm_calls."""
    return calls.groupBy("stage").agg(F.sum("calls").cast("long").alias("llm_calls"))


def seed_gate(grounded: Column, obviousness: Column) -> tuple[Column, Column]:
    """(seeded, reason): grounded candidates are seeded, however obvious they score themselves."""
    return F.coalesce(grounded, F.lit(False)), F.when(grounded, "loose-but-thin").otherwise("ungrounded")


# --- visits and runs


def classify_visit(facts: Column, why_not: Column) -> Column:
    """seeded by any fact, abstained by a reason, unrecorded otherwise."""
    return F.when(facts > 0, "seeded").when(why_not.isNotNull(), "abstained").otherwise("unrecorded")


def seeded_union(arms: DataFrame) -> DataFrame:
    """One row: arms, sum (of each arm's seeds), seeded (distinct over the arms) from arm, fact."""
    each = arms.select("arm", "fact").distinct()
    return each.agg(F.countDistinct("arm").alias("arms"), F.count("*").alias("sum"), F.countDistinct("fact").alias("seeded"))


def answers_witness(receipts: DataFrame, run: str) -> DataFrame:
    """run, answers_stored, answers_digest: how many receipts a run has and the digest of them, sorted, one a line."""
    rows = receipts.groupBy(run).agg(F.sort_array(F.collect_list("receipt")).alias("r"))
    return rows.select(run, F.size("r").cast("long").alias("answers_stored"), F.sha2(F.array_join("r", "\n"), 256).alias("answers_digest"))


def resume(sites: DataFrame, run: str, last: DataFrame) -> DataFrame:
    """The sites of each run after the rank that it has completed; a run without a token starts at its first."""
    return sites.join(last.select(run, F.col("rank").alias("_last")), run, "left").where(F.col("rank") > F.coalesce("_last", F.lit(-1))).drop("_last")


def rerun(sites: DataFrame, changed: DataFrame) -> DataFrame:
    """The sites (path) whose file is among the changed buckets (bucket)."""
    return sites.withColumn("bucket", file_part(F.col("path"))).join(changed.select("bucket").distinct(), "bucket", "left_semi")


def interview(questions: DataFrame, group: str) -> DataFrame:
    """questions (group, pos) with asked: the first INTERVIEW of each group; the rest is deferred, not dropped."""
    by = Window.partitionBy(group).orderBy("pos")
    return questions.withColumn("asked", F.row_number().over(by) <= INTERVIEW)


def loop(rounds: DataFrame, config: DataFrame) -> DataFrame:
    """loop, rounds, calls, revisions, stop of deepening loops: off, or why the last round was the last.

    rounds: loop, depth (from 0), calls, revisions, value; config: loop, enabled, max_depth, epsilon,
    ceiling.  A round spends at most what is left; a loop ends without revisions (fixpoint), under
    epsilon (marginal-value), without budget or at its depth.
    """
    by = Window.partitionBy("loop").orderBy("depth")
    rows = rounds.join(config, "loop").where(F.col("enabled") & (F.col("depth") < F.col("max_depth")))
    spent = F.least(F.sum("calls").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col("ceiling"))
    rows = rows.withColumn("spent", spent).withColumn("_before", F.coalesce(F.lag("spent").over(by), F.lit(0)))
    why = F.when(F.col("revisions") == 0, "fixpoint").when(F.col("value") < F.col("epsilon"), "marginal-value").when(F.col("spent") >= F.col("ceiling"), "budget")
    rows = rows.withColumn("why", why).withColumn("_end", F.min(F.when(F.col("why").isNotNull(), F.col("depth"))).over(Window.partitionBy("loop")))
    ran = rows.where((F.col("depth") <= F.coalesce("_end", F.col("depth"))) & (F.col("_before") < F.col("ceiling")))
    done = ran.groupBy("loop").agg(F.count("*").alias("rounds"), F.max("spent").alias("calls"), F.sum("revisions").alias("revisions"), F.max_by("why", "depth").alias("why"))
    out = config.join(done, "loop", "left")
    stop = F.when(~F.col("enabled"), "off").when(F.col("ceiling") <= 0, "budget").otherwise(F.coalesce("why", F.lit("depth")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("loop", zero("rounds"), zero("calls"), zero("revisions"), stop.alias("stop"))


def valid_tier(tier: Column) -> Column:
    return is_tier(tier)


def run_budgets(sites: DataFrame, run: str) -> DataFrame:
    """run, frontier, ceiling, deepening, llm_calls: what a run may spend by default; what it does before its first site costs no call."""
    n = sites.groupBy(run).agg(F.count("*").alias("frontier"))
    return n.select(run, "frontier", default_ceiling(F.col("frontier")).alias("ceiling"), F.lit("off").alias("deepening"), F.lit(0).cast("long").alias("llm_calls"))
