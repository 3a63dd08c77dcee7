"""Packs by scope, dependency and trigger; what relates to a scope; freshness of what is served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_part, tier_rank, under_scope
from ..plans.scratch import Tables
from . import packs
from .deps import MERGED, dependents


def closures(edges: DataFrame, targets: DataFrame, scratch=None) -> DataFrame:  # noqa: ANN001
    """target, node: what depends on each target over resolved edges; a target is not in its own closure.

    One loop for all targets, whose rounds carry (target, node) pairs that are new.
    """
    scratch = scratch or Tables(edges.sparkSession)
    back = scratch.table(edges.where("kind = 'resolved' and dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()).repartition("node").persist()
    edge = scratch.table(targets.select("target", F.col("target").alias("node")).distinct())
    seen, rounds = edge, 0
    while True:
        rounds += 1
        new = edge.join(back, "node").select("target", F.col("next").alias("node")).distinct().join(seen, ["target", "node"], "left_anti")
        edge = scratch.table(new)
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
        if rounds % MERGED == 0:
            seen = scratch.table(seen)
    back.unpersist()
    return seen.where("target <> node")


def by_dependency(facts: DataFrame, edges: DataFrame, targets: DataFrame, scratch=None) -> DataFrame:  # noqa: ANN001
    """target and the facts (anchor, content_hash, ...) anchored in its closure; several facts of an anchor all count."""
    return closures(edges, targets, scratch).join(facts, F.col("node") == F.col("anchor")).drop("node")


def by_trigger(facts: DataFrame, triggers: DataFrame, tags: DataFrame) -> DataFrame:
    """target and the facts that a tag names exactly; triggers: tag, content_hash; tags: target."""
    named = triggers.join(tags, F.col("tag") == F.col("target")).select("target", "content_hash").distinct()
    return named.join(facts, "content_hash")


def mint_pack(rows: DataFrame, freshness: DataFrame) -> DataFrame:
    """target, node_key, band, served, claim, freshness: facts of a target in key order, in bands, at most once each.

    rows: target, node_key, tier, claim.  A claim's length is its cost; unknown freshness is DRIFTED.
    """
    rows = rows.select("target", "node_key", "tier", "claim").distinct().join(freshness, "node_key", "left")
    rows = rows.withColumn("freshness", F.coalesce("freshness", F.lit("DRIFTED"))).withColumn("cost", F.length("claim").cast("long"))
    return packs.split_bands(rows, "target").select("target", "node_key", "band", "served", "claim", "freshness")


def pack_report(pack: DataFrame) -> DataFrame:
    """target, governing, advisory, advisory_dropped, tokens of minted packs."""
    kept = F.col("served")
    return pack.groupBy("target").agg(
        F.count_if((F.col("band") == "governing") & kept).alias("governing"), F.count_if((F.col("band") == "advisory") & kept).alias("advisory"),
        F.count_if((F.col("band") == "advisory") & ~kept).alias("advisory_dropped"), F.coalesce(F.sum(F.when(kept, F.length("claim"))), F.lit(0)).cast("long").alias("tokens"),
    )


def merged_pack(candidates: DataFrame, group: str, target: str, cap: int = packs.PACK_CAP) -> DataFrame:
    """group, node_key, target, rank, served: one budget for all targets of a group, ranked together; a key counts once."""
    first = Window.partitionBy(group, "node_key").orderBy(F.asc(target))
    rows = candidates.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return packs.fill(rows, group, cap)


def relation_set(facts: DataFrame, edges: DataFrame, scope: str, scratch=None) -> DataFrame:  # noqa: ANN001
    """node_key, tier, claim of the facts outside a scope that depend on a fact in it; each once.

    facts: node_key, tier, claim, anchor, path (what the scope is asked of).  One closure of all anchors
    in the scope; an anchor in the scope that has a fact outside of it too counts only if it depends on
    another one, which is asked of those few from their side.
    """
    scratch = scratch or Tables(edges.sparkSession)
    inside = under_scope(F.col("path"), F.lit(scope))
    roots = scratch.table(facts.where(inside).select(F.col("anchor").alias("node")).where("node is not null").distinct())
    outside = facts.where(~inside)
    reached = dependents(edges, roots, None, scratch).select("node")
    both = scratch.table(outside.select(F.col("anchor").alias("node")).distinct().join(roots, "node", "left_semi"))
    if not both.isEmpty():
        forward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind").where("src is not null")
        on = closures(forward, both.select(F.col("node").alias("target")), scratch).join(roots, "node", "left_semi")
        reached = reached.unionByName(on.select(F.col("target").alias("node")).distinct())
    return outside.join(reached, F.col("anchor") == F.col("node"), "left_semi").select("node_key", "tier", "claim")


def edges_of(related: DataFrame, unit: str, cap: int = packs.EDGE_CAP) -> DataFrame:
    """unit, relation, node_key of the first `cap` keys of each relation."""
    by = Window.partitionBy(unit, "relation").orderBy("node_key")
    return related.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= cap).select(unit, "relation", "node_key")


def co_change_band(co_changed: DataFrame, structural: DataFrame) -> DataFrame:
    """unit, node_key of what changes with a unit and isn't related to it by structure."""
    return co_changed.select("unit", "node_key").distinct().join(structural.select("unit", "node_key").distinct(), ["unit", "node_key"], "left_anti")


def epic(features: DataFrame, cap: int = packs.OWN_CAP) -> DataFrame:
    """epic, feature, pos, used, taken: packs of features (tokens) in order, each whole or not at all, in one budget.

    A feature that doesn't fit is skipped and the next is tried; the fold goes over the features of one
    epic in one row each.
    """
    zero = F.lit(0).cast("long")
    rows = features.groupBy("epic").agg(F.sort_array(F.collect_list(F.struct("pos", "feature", F.col("tokens").cast("long").alias("tokens")))).alias("rows"))
    start = F.struct(zero.alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(s: Column, r: Column) -> Column:
        fits = s["used"] + r["tokens"] <= cap
        return F.struct((s["used"] + F.when(fits, r["tokens"]).otherwise(zero)).alias("used"), F.array_append(s["taken"], fits).alias("taken"))

    folded = rows.select("epic", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step, lambda s: s["taken"]).alias("taken"))).alias("z"))
    return folded.select("epic", "z.rows.feature", "z.rows.pos", F.col("z.taken").alias("taken"))


def bind_freshness(drift: Column) -> Column:
    """FRESH only for a fact that has drifted in nothing; STALE and anything unknown is DRIFTED."""
    return F.when(F.coalesce(drift == "FRESH", F.lit(False)), "FRESH").otherwise("DRIFTED")


def freshness_oracle(base: Column, kind: Column, edge_model: Column, current_model: str) -> Column:
    """A negation is fresh only under the edge model that it was proven with."""
    return F.when((kind == "negation") & ~F.coalesce(edge_model == current_model, F.lit(False)), "DRIFTED").otherwise(bind_freshness(base))


def describe_freshness(freshness: Column) -> Column:
    """The sentence of each state."""
    return (
        F.when(freshness == "FRESH", "the cited unit and its dependencies' interfaces are structurally unchanged")
        .when(freshness == "DRIFTED", "the cited unit or a dependency's interface changed structurally")
        .when(freshness == "STALE", "an advisory fact’s grounding drifted structurally — served with flag, non-blocking")
    )


def stale(backings: DataFrame, group: str) -> DataFrame:
    """group, stale: whether any backing (drifted) of a pack has drifted."""
    return backings.groupBy(group).agg(F.bool_or("drifted").alias("stale"))


def serve_pack(stale_now: Column, stale_after: Column) -> Column:
    """fresh as it is, regrounded if that helped, refused otherwise."""
    return F.when(~stale_now, "served").when(~stale_after, "regrounded").otherwise("refused")


def resolve_current(keys: DataFrame, spatial: DataFrame, territory: DataFrame) -> DataFrame:
    """key, current: the hash of a key's node on the spatial axis, else on the territory axis; null if on neither.

    Nodes whose key is a hash (identity-keyed) are never met: keys are paths.
    """
    s, t = spatial.select(F.col("path").alias("key"), F.col("subtree_hash").alias("_s")), territory.select(F.col("path").alias("key"), F.col("subtree_hash").alias("_t"))
    return keys.join(s, "key", "left").join(t, "key", "left").select("key", F.coalesce("_s", "_t").alias("current"))


def stamp(new: DataFrame, before: DataFrame, built_at: str | None) -> DataFrame:
    """new (node_key, content_hash, derived_at) with the stamp carried where content is the same, else the build's."""
    old = before.select("node_key", F.col("content_hash").alias("_c"), F.col("derived_at").alias("_d"))
    rows = new.join(old, "node_key", "left")
    same = F.coalesce(F.col("_c") == F.col("content_hash"), F.lit(False))
    return rows.withColumn("derived_at", F.when(same, F.coalesce("derived_at", "_d")).otherwise(F.lit(built_at))).drop("_c", "_d")


def behind_head(derived_at: Column, built_at: Column, head: Column) -> Column:
    """Whether a row's stamp, or the build's, is known and not the head; false if the head is unknown."""
    known = F.coalesce(derived_at, built_at)
    return F.coalesce((known != head), F.lit(False))


def anchor_of(path: Column) -> Column:
    """The node that a fact's anchor stands for: its file."""
    return file_part(path)


def strict_first(tier: Column) -> Column:
    return tier_rank(tier)
