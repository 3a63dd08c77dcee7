"""Proposals of facts: what is admitted, demoted, dropped or abstained from, and the facts that are built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest, negation_key, relation_key
from ..functions.text import known_relation_kind
from .verify import Reverse, verify, witness_claim

PROPOSALS = (
    "node_key string, kind string, slot string, target string, scope string, at_least int, endpoint_a string, relation_kind string, endpoint_b string, "
    "claim string, tier string, grounded boolean, checked string, expressible boolean"
)


def _text(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def admit(proposals: DataFrame, view: Reverse) -> DataFrame:
    """node_key, outcome (admitted, dropped or abstained), fact (the kind of fact that is built), reason.

    Advisories must be grounded.  Relations need two different ends and a known kind too, negations a
    target, a scope and a known kind.  A claim of a dependency or a count is replayed: proven and
    grounded it is sound; unproven it is admitted as an advisory if it is grounded.  Any other
    predicate is sound if its slot is a type's to tell and the type holds; else its check decides:
    checked is null (no check could be made: an advisory), HOLDS, BROKEN, or toothless.
    """
    rows = proposals
    asked = rows.where("kind = 'predicate' and slot in ('dependency', 'count')")
    asked = asked.select(F.col("node_key").alias("claim"), F.col("slot").alias("kind"), F.col("target").alias("symbol"), "scope", F.col("scope").alias("world"), "at_least", F.lit(False).alias("exact"))
    told = verify(asked, view).select(F.col("claim").alias("node_key"), (F.col("verdict") == "proven").alias("_proven"))
    rows = rows.join(told, "node_key", "left")
    kind, slot = F.col("kind"), F.col("slot")
    replayed = (kind == "predicate") & F.coalesce(slot.isin("dependency", "count"), F.lit(False))
    proven, grounded = F.coalesce("_proven", F.lit(False)), F.coalesce("grounded", F.lit(False))
    malformed = ~_text("target") | ~_text("scope") | ((slot == "count") & F.coalesce(F.col("at_least") < 1, F.lit(True)))
    typed = (kind == "predicate") & ~replayed & F.coalesce("expressible", F.lit(False))
    own = (kind == "predicate") & ~replayed & ~typed
    ends = _text("endpoint_a") & _text("endpoint_b") & F.coalesce(F.col("endpoint_a") != F.col("endpoint_b"), F.lit(False))
    demoted = (replayed & ~proven) | (own & F.col("checked").isNull())
    reason = (
        F.when((kind == "relation") & ~(ends & known_relation_kind(F.col("relation_kind"))), "relation-malformed")
        .when((kind == "negation") & ~(_text("target") & _text("scope") & known_relation_kind(F.col("relation_kind"))), "negation-malformed")
        .when(replayed & malformed, F.concat(slot, F.lit("-malformed")))
        .when(typed & ~F.coalesce(F.col("checked") == "HOLDS", F.lit(False)), "type-broken")
        .when(own & (F.col("checked") != "HOLDS"), F.concat(F.lit("check-"), F.lower("checked")))
        .when((kind.isin("advisory", "relation") | replayed | demoted) & ~grounded, "ungrounded")
    )
    outcome = F.when(kind == "abstain", "abstained").when(reason.isNotNull(), "dropped").otherwise("admitted")
    fact = F.when(kind.isin("relation", "negation", "advisory"), kind).when(demoted, "advisory").when(replayed | typed, "sound").otherwise("predicate")
    return rows.select("node_key", outcome.alias("outcome"), F.when(outcome == "admitted", fact).alias("fact"), reason.alias("reason"))


def build_facts(proposals: DataFrame, admitted: DataFrame) -> DataFrame:
    """id, family, claim, authoring, seal, tier of the admitted proposals.

    A relation's and a negation's id is the digest of what identifies it; a sound fact's claim is the
    sentence that its witness gives, never the proposal's words.
    """
    rows = proposals.join(admitted.where("outcome = 'admitted'").select("node_key", "fact"), "node_key")
    fact = F.col("fact")
    key = F.when(fact == "relation", relation_key(F.col("endpoint_a"), F.col("relation_kind"), F.col("endpoint_b"))).when(fact == "negation", negation_key(F.col("relation_kind"), F.col("target"), F.col("scope"))).otherwise(F.col("node_key"))
    said = F.concat_ws(" ", "endpoint_a", "relation_kind", "endpoint_b")
    denied = F.concat(F.lit("NOT("), "target", F.lit(" "), "relation_kind", F.lit(")@"), "scope")
    witnessed = (fact == "sound") & F.col("slot").isin("dependency", "count")
    claim = F.when(fact == "relation", said).when(fact == "negation", denied).when(witnessed, witness_claim(F.col("slot"), F.col("target"), F.col("scope"), F.when(F.col("slot") == "count", F.col("at_least")))).otherwise(F.col("claim"))
    authoring = F.when(fact == "relation", "RELATED").when(fact == "negation", "NEGATED").when(fact == "predicate", "PREDICATE").otherwise("ADVISORY")
    family = F.when(fact == "sound", "advisory").otherwise(fact)
    return rows.select(key.alias("id"), family.alias("family"), claim.alias("claim"), authoring.alias("authoring"), F.when(fact == "sound", "proven").alias("seal"), "tier")


def retire(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """facts with authoring SUPERSEDED for those that are named (node_key)."""
    mark = gone.select("node_key").distinct().withColumn("_gone", F.lit(True))
    return facts.join(mark, "node_key", "left").withColumn("authoring", F.when(F.col("_gone"), "SUPERSEDED").otherwise(F.col("authoring"))).drop("_gone")


def produced(candidates: DataFrame) -> DataFrame:
    """The candidates (moment) that may become facts: those of the three moments of production."""
    return candidates.where(F.col("moment").isin("init-skeleton", "enrich-by-blast-radius", "wave-close-write"))


def seal_violation(absorbed: Column, why_not: Column) -> Column:
    """A seal that was neither absorbed nor says why not is a violation."""
    return ~(F.coalesce(absorbed, F.lit(False)) | F.coalesce(why_not, F.lit(False)))


def dependency_root(edges: DataFrame) -> DataFrame:
    """nodes, edges, root: the dependency axis' size and its hash over sorted edge keys and node keys.

    Edges and nodes are hashed one by one and their digests in order by the first two digits of each,
    so that no row holds them all: the root is the digest of 256 parts.
    """
    key = F.concat_ws("\x1f", "src", F.coalesce("dst", F.lit("")), "kind")
    rows = edges.select(digest(key).alias("h"), F.lit(1).alias("edge")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").select(digest("node").alias("h"), F.lit(0).alias("edge")).distinct()
    both = rows.unionByName(nodes)
    parts = both.groupBy("edge", F.substring("h", 1, 2).alias("p")).agg(digest(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("d"), F.count("*").alias("n"))
    whole = parts.agg(digest(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("edge", "p", "d"))), lambda x: x["d"]), "")).alias("root"), F.sum(F.when(F.col("edge") == 0, F.col("n"))).alias("nodes"), F.sum(F.when(F.col("edge") == 1, F.col("n"))).alias("edges"))
    return whole.select("nodes", "edges", "root")


# --- claims of a model's answers


def parsed_claims(answers: DataFrame, used: DataFrame, exports: DataFrame) -> DataFrame:
    """path, slot, target, scope, at_least, abstain of answers (path of a unit, answer).

    `DEPENDS-ON: name` is a claim about the symbol that the unit's file uses by that name (used: path,
    name, symbol), under the unit's folder; `COUNT: name` one about the file's own export of that name
    (exports: path, name, symbol, callers, scope), with what was counted.  A name that leads nowhere,
    or an answer of another form, is abstained from.
    """
    from ..functions import answers as a
    from ..functions.text import file_part, unit_scope

    rows = answers.withColumn("_file", file_part(F.col("path")))
    rows = rows.withColumn("_dep", a.claimed_name(F.col("answer"), a.DEPENDS_ON)).withColumn("_count", a.claimed_name(F.col("answer"), a.COUNT))
    dep = used.select(F.col("path").alias("_file"), F.col("name").alias("_dep"), F.col("symbol").alias("_ds"))
    own = exports.select(F.col("path").alias("_file"), F.col("name").alias("_count"), F.col("symbol").alias("_cs"), F.col("callers").cast("int").alias("_n"), F.col("scope").alias("_scope"))
    rows = rows.join(dep, ["_file", "_dep"], "left").join(own, ["_file", "_count"], "left")
    is_dep, is_count = F.col("_ds").isNotNull(), F.col("_cs").isNotNull()
    asked_count = F.upper(F.ltrim(F.col("answer"))).startswith("COUNT")
    abstain = F.when(a.abstains(F.col("answer")), "abstained").when(~is_dep & ~is_count, F.when(asked_count, a.COUNT_UNPARSEABLE).otherwise(a.DEPENDENCY_UNPARSEABLE))
    return rows.select(
        "path", F.when(is_dep, "dependency").when(is_count, "count").alias("slot"), F.coalesce("_ds", "_cs").alias("target"),
        F.when(is_dep, unit_scope(F.col("path"))).when(is_count, F.col("_scope")).alias("scope"), F.when(is_count, F.col("_n")).alias("at_least"), abstain.alias("abstain"),
    )


def aligned(written: DataFrame, asked: DataFrame) -> DataFrame:
    """written (node_key) with status: a candidate, however sure of itself, until an interview (node_key, accepted) ratifies it."""
    said = asked.where("accepted").select("node_key").distinct().withColumn("_yes", F.lit(True))
    return written.join(said, "node_key", "left").withColumn("status", F.when(F.col("_yes"), "ratified").otherwise("candidate")).drop("_yes")
