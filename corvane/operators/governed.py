"""Governed writes: gates in order, incumbents, negations with their ledger, links, promotion.

A gate gives the reason of a refusal; the first that a request fails is its outcome.  Authority comes
from policy tables, scopes (scope, actor) and owners (prefix, owner), and from the row that a write
would displace, never from the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_scope, is_tier, known_relation_kind, strictest, tier_rank, under_scope, weaker
from .deps import LOCAL
from .facts import fast_path, first_refusal
from .territory import longest_prefix
from .verify import Reverse, _open, _top

#: Who ratifies the strictest tier (a name that policy gives); the scope and the tier of mined facts.
STRICT_RATIFIER = "strict"
MINED_SCOPE, MINED_TIER = "mined", "T2"


def ratified(tier: Column, by: Column) -> Column:
    """Whether a named ratifier is enough: any for T1 and T2, only the strict one for T0."""
    return F.coalesce((F.length(by) > 0) & ((tier != "T0") | (by == STRICT_RATIFIER)), F.lit(False))


def members(scopes: DataFrame, actor: str) -> DataFrame:
    """The scopes that an actor is in; the empty one never."""
    return scopes.where((F.col("actor") == actor) & is_scope(F.col("scope"))).select("scope").distinct()


def relation_well_formed(kind: Column, a: Column, relation: Column, b: Column) -> Column:
    """Relations need two different ends and a kind of the vocabulary; other facts pass."""
    ends = F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (a != b), F.lit(False))
    return (kind != "relation") | (ends & known_relation_kind(relation))


def family(kind: Column, has_check: Column) -> Column:
    """A fact's family, or null where its kind and its check disagree: a predicate has a check, others none."""
    known = kind.isin("advisory", "predicate", "relation")
    return F.when(known & ((kind == "predicate") == has_check), kind)


def _in(scopes: DataFrame, column: str, mark: str) -> DataFrame:
    return scopes.select(F.col("scope").alias(column), F.lit(True).alias(mark))


def emit(requests: DataFrame, current: DataFrame, scopes: DataFrame, owners: DataFrame, actor: str, token: str) -> DataFrame:
    """node_key, outcome of each request: the first gate that refuses it, or emitted.

    requests: node_key, kind, has_check, tier, scope, endpoint_a, relation_kind, endpoint_b,
    primary_anchor, addressable, holds; current: node_key, scope, tier, stored_scope, stored_tier (null
    if its content can't be read).  Facts without a check go through without a ratifier where T2
    governs, the row's tier included; others need one.
    """
    mine = members(scopes, actor)
    rows = requests.join(_in(mine, "scope", "_member"), "scope", "left")
    owned = longest_prefix(requests.select(F.col("primary_anchor").alias("path")).where("path is not null"), owners)
    rows = rows.join(owned.select(F.col("path").alias("primary_anchor"), F.col("owner").alias("_owner")), "primary_anchor", "left")
    old = current.select("node_key", F.lit(True).alias("_there"), F.col("scope").alias("_row_scope"), F.col("tier").alias("_row_tier"), F.col("stored_scope").alias("_stored_scope"), F.col("stored_tier").alias("_stored_tier"))
    old = old.withColumn("_authority", F.coalesce("_row_scope", "_stored_scope")).join(_in(mine, "_authority", "_target"), "_authority", "left")
    rows = rows.join(old, "node_key", "left")
    new = F.col("_there").isNull()
    held = F.when(F.col("_row_tier").isNull(), F.col("_stored_tier")).otherwise(strictest(F.col("_row_tier"), F.col("_stored_tier")))
    governing = F.when(new | held.isNull(), F.col("tier")).otherwise(strictest(held, F.col("tier")))
    checked = F.when(F.col("has_check"), "predicate").otherwise("advisory")
    route = fast_path(F.col("holds"), F.lit(True), governing, checked, F.lit(False), F.lit(False))
    refusal = first_refusal(
        ("malformed-tier", is_tier(F.col("tier"))),
        ("malformed-scope", is_scope(F.col("scope"))),
        ("malformed-family", family(F.col("kind"), F.col("has_check")).isNotNull()),
        ("malformed-relation", relation_well_formed(F.col("kind"), F.col("endpoint_a"), F.col("relation_kind"), F.col("endpoint_b"))),
        ("unaddressable", F.col("addressable")),
        ("ungrounded", F.col("holds")),
        ("unauthorized", F.col("_member")),
        ("unauthorized-anchor", F.col("_owner").isNull() | (F.col("_owner") == F.col("scope"))),
        ("unauthorized-target", new | F.col("_target")),
        ("unverifiable-target", new | (F.col("_stored_scope").isNotNull() & F.coalesce(F.col("_row_scope") == F.col("_stored_scope"), F.lit(True)))),
        ("governance-relocation", new | (F.col("scope") == F.col("_stored_scope"))),
        ("governance-downgrade", new | ~F.coalesce(weaker(F.col("tier"), held), F.lit(False))),
        ("unratified", (route == "auto-accept") | ratified(F.col("tier"), F.lit(token))),
    )
    return rows.select("node_key", F.coalesce(refusal, F.lit("emitted")).alias("outcome"))


def emit_negations(proposals: DataFrame, view: Reverse, nodes: DataFrame, escapes: DataFrame, channels: DataFrame, scopes: DataFrame, owners: DataFrame, actor: str, token: str) -> DataFrame:
    """claim, outcome of negations: an abstention, a refusal, or emitted.

    proposals: claim, relation_kind, target, scope, tier; nodes: path of every structural node; escapes:
    target, site where a reference leaves what can be followed; channels: path of files that reach
    code by name.  A negation needs a scope that is there, in which nothing is opaque or dynamic, and
    a target that nothing lets escape; a caller in scope refutes it.  What the store has under the same
    key is upsert's matter.
    """
    rows = proposals.withColumn("_top", _top(F.col("scope")))
    flag = lambda df, by, name: df.select(F.col(by[0]).alias(by[1])).distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(nodes, ("path", "_top"), "_scope_there"), "_top", "left").join(flag(_open(view.opaque), ("top", "_top"), "_opaque"), "_top", "left")
    rows = rows.join(flag(_open(channels), ("top", "_top"), "_dynamic"), "_top", "left").join(flag(escapes, ("target", "target"), "_escape"), "target", "left")
    rows = rows.join(flag(view.definitions, ("symbol", "target"), "_known"), "target", "left")
    called = rows.select("claim", "target", "scope").join(view.callers.withColumnRenamed("symbol", "target"), "target")
    called = called.where(under_scope(F.col("path"), F.col("scope"))).select("claim").distinct().withColumn("_called", F.lit(True))
    mine = members(scopes, actor)
    rows = rows.join(called, "claim", "left").join(_in(mine, "scope", "_member"), "scope", "left")
    owned = longest_prefix(rows.select(F.col("_top").alias("path")).where("path <> ''"), owners).select(F.col("path").alias("_top"), F.col("owner").alias("_owner"))
    rows = rows.join(owned, "_top", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = first_refusal(
        ("malformed-negation", is_tier(F.col("tier")) & is_scope(F.col("scope")) & is_scope(F.col("target")) & known_relation_kind(F.col("relation_kind"))),
        ("target-not-global", ~F.startswith("target", F.lit(LOCAL))),
        ("scope-empty", yes("_scope_there")),
        ("target-unresolvable", yes("_known")),
        ("scope-open", ~yes("_opaque")),
        ("escape-open", ~yes("_escape")),
        ("scope-dynamic", ~yes("_dynamic")),
        ("negation-refuted", ~yes("_called")),
        ("unauthorized", yes("_member")),
        ("unauthorized-anchor", F.col("_owner").isNull() | (F.col("_owner") == F.col("scope"))),
        ("unratified", (F.col("tier") == "T2") | ratified(F.col("tier"), F.lit(token))),
    )
    return rows.select("claim", F.coalesce(outcome, F.lit("emitted")).alias("outcome"))


#: The outcomes of a negation that stay in the ledger of what was abstained from.
ABSTAINED = ("target-not-global", "scope-empty", "target-unresolvable", "scope-open", "escape-open", "scope-dynamic")


def abstentions(ledger: DataFrame, proposals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """relation_kind, target, scope, reason after a batch: one row a triple, the last claim's; what is emitted leaves the ledger.

    ledger: the same columns, before.  A refused negation changes nothing.
    """
    key = ["relation_kind", "target", "scope"]
    told = proposals.join(outcomes, "claim").where(F.col("outcome").isin(*ABSTAINED, "emitted"))
    last = told.groupBy(*key).agg(F.max(F.struct("claim", "outcome")).alias("l")).select(*key, F.col("l.outcome").alias("reason"))
    return ledger.select(*key, "reason").join(last, key, "left_anti").unionByName(last.where("reason <> 'emitted'"))


def abstentions_of(ledger: DataFrame, scope: str | None) -> DataFrame:
    """The abstentions under a scope, or all."""
    return ledger.where(under_scope(F.col("scope"), F.lit(scope))) if scope else ledger


# --- equivalence


def edge_state(pairs: DataFrame, asserted: DataFrame, retracted: DataFrame) -> DataFrame:
    """a, b, state of pairs of keys: retracted, else asserted, else absent; a key is never linked to itself."""
    norm = lambda df, mark: df.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct().withColumn(mark, F.lit(True))
    rows = pairs.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    rows = rows.join(norm(asserted, "_said"), ["_x", "_y"], "left").join(norm(retracted, "_gone"), ["_x", "_y"], "left")
    state = F.when(F.col("a") == F.col("b"), "absent").when(F.col("_gone"), "retracted").when(F.col("_said"), "asserted").otherwise("absent")
    return rows.withColumn("state", state).drop("_x", "_y", "_said", "_gone")


def link_same_as(edges: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (a, b) with the pairs of known, different keys, in both directions; a retraction is linked the same way."""
    known = nodes.select("node_key").distinct()
    sound = pairs.where("a <> b").join(known.withColumnRenamed("node_key", "a"), "a", "left_semi").join(known.withColumnRenamed("node_key", "b"), "b", "left_semi")
    both = sound.select("a", "b").unionByName(sound.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select("a", "b").unionByName(both).distinct()


def governed_link(requests: DataFrame, current: DataFrame, asserted: DataFrame, retracted: DataFrame, scopes: DataFrame, actor: str, token: str, scratch) -> DataFrame:  # noqa: ANN001
    """a, b, retract, outcome of link requests: linked, or the first reason against it.

    Authority and ratifier are asked of the merged class of both keys: every member must be the
    actor's, readable and not contradicted by its content, and the strictest tier decides who ratifies.
    current: node_key, scope, stored_scope, stored_tier.
    """
    from .graph import components

    mine = members(scopes, actor)
    rows = current.withColumn("_authority", F.coalesce("scope", "stored_scope")).join(_in(mine, "_authority", "_mine"), "_authority", "left")
    sound = F.col("stored_scope").isNotNull() & F.coalesce(F.col("scope") == F.col("stored_scope"), F.lit(True))
    rank = F.when(is_tier(F.col("stored_tier")), tier_rank(F.col("stored_tier"))).otherwise(0)
    rows = scratch.table(rows.select("node_key", F.coalesce("_mine", F.lit(False)).alias("mine"), sound.alias("sound"), rank.alias("rank")))
    known = asserted.join(rows.select(F.col("node_key").alias("a")), "a", "left_semi").join(rows.select(F.col("node_key").alias("b")), "b", "left_semi")
    classes = components(known.where("a <> b"), scratch)
    rows = rows.join(classes, "node_key", "left").withColumn("class_key", F.coalesce("class_key", "node_key"))
    of = rows.groupBy("class_key").agg(F.bool_and("mine").alias("all_mine"), F.bool_and("sound").alias("all_sound"), F.min("rank").alias("strict"))
    rows = rows.drop("rank").join(of, "class_key").drop("class_key")
    side = lambda k: rows.select(*(F.col(c).alias(k if c == "node_key" else f"{c}_{k}") for c in rows.columns))
    found = edge_state(requests, asserted, retracted).join(side("a"), "a", "left").join(side("b"), "b", "left")
    both = lambda c: F.col(f"{c}_a") & F.col(f"{c}_b")
    strict = F.concat(F.lit("T"), F.least("strict_a", "strict_b"))
    outcome = first_refusal(
        ("same", F.col("a") != F.col("b")),
        ("unauthorized", both("mine")),
        ("unverifiable", both("sound")),
        ("unauthorized", both("all_mine")),
        ("unverifiable", both("all_sound")),
        ("unratified", ratified(strict, F.lit(token))),
        ("not-linked", ~(F.col("retract") & (F.col("state") == "absent"))),
        ("already-retracted", ~(F.col("retract") & (F.col("state") == "retracted"))),
        ("retracted-pair", F.col("retract") | (F.col("state") != "retracted")),
    )
    return found.select("a", "b", "retract", F.coalesce(outcome, F.lit("linked")).alias("outcome"))


# --- staging


def stage(mined: DataFrame, staged: DataFrame, grounded: DataFrame) -> DataFrame:
    """The mined facts (node_key, claim, ...) that go to staging: redacted, in the mined scope and tier.

    What an earlier run has staged is left out unless this run has grounded it again.  grounded: node_key.
    """
    from ..functions.text import scrub

    old = staged.select("node_key").join(grounded.select("node_key"), "node_key", "left_anti")
    rows = mined.join(old, "node_key", "left_anti").withColumn("claim", scrub(F.col("claim")))
    return rows.withColumn("scope", F.lit(MINED_SCOPE)).withColumn("tier", F.lit(MINED_TIER))


def promote(staged: DataFrame, stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """node_key, settled, reason of each staged row: those whose content can be read go through the emit door.

    stored: node_key; outcomes: node_key, outcome of emit.
    """
    have = stored.select("node_key").distinct().withColumn("_read", F.lit(True))
    rows = staged.select("node_key").join(have, "node_key", "left").join(outcomes, "node_key", "left")
    reason = F.when(F.col("_read").isNull(), "candidate-unreadable").when(F.col("outcome") != "emitted", F.col("outcome")).when(F.col("outcome").isNull(), "no-outcome")
    return rows.select("node_key", reason.isNull().alias("settled"), reason.alias("reason"))


def promote_report(rows: DataFrame) -> DataFrame:
    """One row: candidates, promoted, refused."""
    return rows.agg(F.count("*").alias("candidates"), F.count_if("settled").alias("promoted"), F.count_if(~F.col("settled")).alias("refused"))
