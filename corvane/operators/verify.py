"""Verdicts over the reverse view of symbols: dependency, count and negation claims.

A claim (claim, kind, symbol, scope, world, at_least, exact) is about the callers of a symbol under a
scope.  What is witnessed is sound in any world; what is absent counts only where the view is closed:
no reference in the scope that nothing defines, and none that an indexer has made opaque.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_symbol, file_part, under_scope
from .deps import LOCAL

CLAIMS = "claim int, kind string, symbol string, scope string, world string, at_least int, exact boolean"


@dataclass
class Reverse:
    """definitions: symbol; callers: symbol, path; holes and opaque: path."""

    definitions: DataFrame
    callers: DataFrame
    holes: DataFrame
    opaque: DataFrame


def reverse(occurrences: DataFrame, trusted: bool = True) -> Reverse:
    """The view of occurrences (path, symbol, role).

    A reference goes to its symbol's definition, or to that of the source form of its symbol; one with
    neither is a hole of its file.  A local reference without a local definition in its own file is
    opaque; only a trusted indexer is known to write them so.
    """
    far = occurrences.where(~F.startswith("symbol", F.lit(LOCAL)))
    defined = far.where("role = 'definition'").select("symbol").distinct()
    refs = far.where("role = 'reference'").select("symbol", "path").distinct().withColumn("source", canonical_symbol(F.col("symbol")))
    mark = defined.withColumn("_own", F.lit(True))
    refs = refs.join(mark, "symbol", "left").join(mark.select(F.col("symbol").alias("source"), F.col("_own").alias("_src")), "source", "left")
    target = F.when(F.col("_own"), F.col("symbol")).when(F.col("_src"), F.col("source"))
    refs = refs.select(target.alias("symbol"), "path")
    near = occurrences.where(F.startswith("symbol", F.lit(LOCAL)))
    opaque = near.where("role = 'reference'").join(near.where("role = 'definition'").select("path", "symbol"), ["path", "symbol"], "left_anti")
    return Reverse(defined, refs.where("symbol is not null").distinct(), refs.where("symbol is null").select("path").distinct(), (opaque if trusted else opaque.limit(0)).select("path").distinct())


def _top(scope: Column) -> Column:
    return F.rtrim(scope, F.lit("/"))


def _open(paths: DataFrame) -> DataFrame:
    """Every scope, by whole segments, that holds one of the paths: what under_scope asks, as keys of an equi-join."""
    parts = F.split(file_part(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.select(F.explode(up).alias("top")).distinct()


def in_scope(claims: DataFrame, callers: DataFrame) -> DataFrame:
    """claim, found: how many files under the claim's scope call its symbol."""
    rows = claims.select("claim", "symbol", "scope").join(callers.select("symbol", "path").distinct(), "symbol", "left")
    hit = F.coalesce(under_scope(F.col("path"), F.col("scope")), F.lit(False))
    return rows.groupBy("claim").agg(F.count_if(hit).alias("found"))


def verify(claims: DataFrame, view: Reverse) -> DataFrame:
    """claim, kind, found, verdict (proven, refuted or abstain), reason (why it abstains, else null).

    dependency: proven by a caller in scope; its absence proves nothing.  count: proven by at_least
    callers in scope, or, if exact, by just as many in a world without holes.  negation: refuted by a
    caller in scope, else proven in a scope without holes and opaque references.  A claim with an empty
    part or a count under 1, about a local symbol, or about one that nothing defines, is abstained from.
    """
    holes = _open(view.holes).withColumn("_hole", F.lit(True))
    opaque = _open(view.opaque).withColumn("_opaque", F.lit(True))
    known = view.definitions.select("symbol").distinct().withColumn("_known", F.lit(True))
    rows = claims.join(in_scope(claims, view.callers), "claim").join(known, "symbol", "left")
    rows = rows.withColumn("_scope", _top(F.col("scope"))).withColumn("_world", _top(F.col("world")))
    rows = rows.join(holes.withColumnRenamed("top", "_scope"), "_scope", "left").withColumnRenamed("_hole", "_scope_hole")
    rows = rows.join(opaque.withColumnRenamed("top", "_scope"), "_scope", "left")
    rows = rows.join(holes.withColumnRenamed("top", "_world"), "_world", "left").withColumnRenamed("_hole", "_world_hole")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    missing = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    negation, count = F.col("kind") == "negation", F.col("kind") == "count"
    malformed = missing("symbol") | missing("scope") | (~negation & missing("world")) | (count & F.coalesce(F.col("at_least") < 1, F.lit(True)))
    reason = (
        F.when(malformed, "malformed")
        .when(F.startswith("symbol", F.lit(LOCAL)), "target-not-global")
        .when(~is_("_known"), "target-unresolvable")
        .when(negation, F.when((F.col("found") == 0) & (is_("_scope_hole") | is_("_opaque")), "scope-open"))
        .when(count & is_("exact"), F.when(is_("_world_hole"), "scope-open").when(F.col("found") != F.col("at_least"), "exact-count-mismatch"))
        .when(count, F.when(F.col("found") < F.col("at_least"), "below-witnessed-bound"))
        .when(F.col("found") == 0, F.when(is_("_world_hole"), "scope-open").otherwise("no-caller-in-scope"))
    )
    verdict = F.when(reason.isNotNull(), "abstain").when(negation & (F.col("found") > 0), "refuted").otherwise("proven")
    return rows.select("claim", "kind", F.when(reason.isin("malformed", "target-not-global", "target-unresolvable"), 0).otherwise(F.col("found")).cast("long").alias("found"), verdict.alias("verdict"), reason.alias("reason"))


def dependency(claims: DataFrame, view: Reverse) -> DataFrame:
    return verify(claims.where("kind = 'dependency'"), view)


def count(claims: DataFrame, view: Reverse) -> DataFrame:
    return verify(claims.where("kind = 'count'"), view)


def negation(claims: DataFrame, view: Reverse) -> DataFrame:
    return verify(claims.where("kind = 'negation'"), view)


def witness_claim(slot: Column, target: Column, scope: Column, at_least: Column) -> Column:
    """The sentence that a witness gives, from which a fact's claim is checked."""
    counted = F.concat(target, F.lit(" is referenced by at least "), at_least.cast("string"), F.lit(" distinct unit(s) under "), scope, F.lit(" (witnessed lower bound, sound oracle)"))
    return F.when((slot == "count") & at_least.isNotNull(), counted).otherwise(F.concat(scope, F.lit(" references "), target, F.lit(" (witnessed cross-unit reference, sound oracle)")))


def reverify(facts: DataFrame, view: Reverse, documents: DataFrame) -> DataFrame:
    """node_key, outcome, reason of every fact that is sealed as proven: its witness is replayed.

    facts: node_key, seal, tier, claim, primary_anchor, slot, target, scope, at_least (the witness's
    last four null without one); documents: path.  unverifiable: nothing to replay; broken: the fact
    is not what its witness proves, or the replay doesn't prove it; re-proven otherwise.
    """
    from ..functions.text import unit_scope

    rows = facts.where("seal = 'proven'").withColumn("claim_text", F.col("claim"))
    rows = rows.withColumn("_file", file_part(F.col("primary_anchor")))
    rows = rows.join(documents.select(F.col("path").alias("_file")).distinct().withColumn("_doc", F.lit(True)), "_file", "left")
    kind = F.when(F.col("slot") == "count", "count").otherwise("dependency")
    asked = rows.select(F.col("node_key").alias("claim"), kind.alias("kind"), F.col("target").alias("symbol"), "scope", F.col("scope").alias("world"), "at_least", F.lit(False).alias("exact"))
    told = verify(asked, view).select(F.col("claim").alias("node_key"), "verdict", F.col("reason").alias("_why"))
    rows = rows.join(told, "node_key", "left")
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    unverifiable = (
        F.when(F.col("slot").isNull(), "no-witness")
        .when(empty("target") | empty("scope"), "incomplete-witness")
        .when(~F.col("slot").isin("dependency", "count"), "unwitnessed-slot")
        .when((F.col("slot") == "count") & F.col("at_least").isNull(), "no-bound")
    )
    broken = (
        F.when(~F.col("tier").eqNullSafe(F.lit("T2")), "tampered-tier")
        .when(empty("primary_anchor") | ~unit_scope(F.col("primary_anchor")).eqNullSafe(F.col("scope")), "tampered-anchor")
        .when(F.col("_doc").isNull(), "tampered-document")
        .when(~F.col("claim_text").eqNullSafe(witness_claim(F.col("slot"), F.col("target"), F.col("scope"), F.col("at_least"))), "tampered-claim")
        .when(F.col("verdict") != "proven", F.concat(F.lit("replay-"), F.coalesce("_why", "verdict")))
    )
    outcome = F.when(unverifiable.isNotNull(), "unverifiable").when(broken.isNotNull(), "broken").otherwise("re-proven")
    return rows.select("node_key", outcome.alias("outcome"), F.coalesce(unverifiable, broken).alias("reason"))


def reverify_report(rows: DataFrame) -> DataFrame:
    """One row of reverify's: sealed_proven, re_proven, broken, unverifiable."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return rows.agg(F.count("*").alias("sealed_proven"), n("re-proven").alias("re_proven"), n("broken").alias("broken"), n("unverifiable").alias("unverifiable"))
