"""Facts: routing of writes, governed upsert, relations, negations, containment, equivalence.

current: node_key, family, content_hash, claims array<string>, primary_anchor, slot, scope, tier,
superseded_by.  requests: pos, node_key, family, content_hash, claims, primary_anchor, slot, scope, tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import claim_key, known_slot, tier_rank, under_scope, weaker


def route(content_known: Column, key_known: Column, family: Column, same_check: Column) -> Column:
    """DEDUP before CREATE before UPDATE (not for predicates) before SUPERSEDE (same check); else REFUSE."""
    return (
        F.when(content_known, "DEDUP").when(~key_known, "CREATE").when(family != "predicate", "UPDATE").when(same_check, "SUPERSEDE").otherwise("REFUSE")
    )


def write_decisions(requests: DataFrame, current: DataFrame, contents: DataFrame) -> DataFrame:
    """requests with decision; contents: the hashes of all bodies that are kept."""
    known = contents.select("content_hash").distinct().withColumn("_content", F.lit(True))
    keys = current.select("node_key", F.lit(True).alias("_key"))
    rows = requests.join(known, "content_hash", "left").join(keys, "node_key", "left")
    decision = route(F.coalesce("_content", F.lit(False)), F.coalesce("_key", F.lit(False)), F.col("family"), F.lit(True))
    return rows.withColumn("decision", decision).drop("_content", "_key")


def upsert(current: DataFrame, requests: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """The current rows after a batch, with outcome by key: how the last request of the key ended.

    Requests of one key are applied in order of pos.  A slot out of the vocabulary is refused
    (closed-slot); content that is kept already, in `contents` (by default the current rows') or by an
    earlier request of the key, changes nothing (DEDUP); a new key is made (CREATE).  What displaces a
    row must be in its scope (else governance-relocation) and not of a weaker tier
    (governance-downgrade), as far as the row states them.  Then a predicate replaces its row
    (SUPERSEDE, the old content in superseded_by) and others update it: claims are united, or are the
    request's alone where it raises the row to T0 or T1.  What a request leaves null stays.

    Keys that no request names pass through.  The fold is over one key's requests in one batch; other
    keys of the batch are not seen.
    """
    names = ["family", "content_hash", "claims", "primary_anchor", "slot", "scope", "tier", "superseded_by"]
    kept = (current if contents is None else contents).select("content_hash").distinct().withColumn("known", F.lit(True))
    row = F.struct("pos", "family", "content_hash", "claims", "primary_anchor", "slot", "scope", "tier", F.coalesce("known", F.lit(False)).alias("known"))
    batch = requests.join(kept, "content_hash", "left").groupBy("node_key").agg(F.sort_array(F.collect_list(row)).alias("requests"))
    none = F.array().cast("array<string>")
    old = current.select("node_key", F.struct(*names, F.lit("KEPT").alias("outcome"), F.lit(True).alias("there"), none.alias("added")).alias("s"))
    rows = old.join(batch, "node_key", "full_outer")
    whole = [*names, "outcome", "there", "added"]

    def state(**new: Column) -> Column:
        return F.named_struct(*(x for n in whole for x in (F.lit(n), new[n])))

    def step(s: Column, r: Column) -> Column:
        same = {n: s[n] for n in whole}
        stated = {n: F.coalesce(r[n], s[n]) for n in ("primary_anchor", "slot", "scope", "tier")}
        write = same | {"content_hash": r["content_hash"], "there": F.lit(True), "added": F.array_append(s["added"], r["content_hash"])}
        raised = r["tier"].isin("T0", "T1") & (s["tier"].isNull() | (tier_rank(r["tier"]) < tier_rank(s["tier"])))
        claims = F.when(F.coalesce(raised, F.lit(False)), r["claims"]).otherwise(F.array_union(s["claims"], r["claims"]))
        made = write | {n: r[n] for n in names[:-1]} | {"superseded_by": F.lit(None).cast("string")}
        hit = r["known"] | F.array_contains(s["added"], r["content_hash"])
        refused = (
            F.when(r["slot"].isNotNull() & ~known_slot(r["slot"]), "closed-slot")
            .when(hit, "DEDUP")
            .when(~s["there"], F.lit(None))
            .when(s["scope"].isNotNull() & ~s["scope"].eqNullSafe(r["scope"]), "governance-relocation")
            .when(s["tier"].isNotNull() & F.coalesce(weaker(r["tier"], s["tier"]), F.lit(True)), "governance-downgrade")
        )
        return (
            F.when(refused.isNotNull(), state(**same | {"outcome": refused}))
            .when(~s["there"], state(**made | {"outcome": F.lit("CREATE")}))
            .when(r["family"] == "predicate", state(**write | stated | {"family": r["family"], "claims": r["claims"], "superseded_by": s["content_hash"], "outcome": F.lit("SUPERSEDE")}))
            .otherwise(state(**write | stated | {"claims": claims, "outcome": F.lit("UPDATE")}))
        )

    kinds = dict(current.dtypes) | {"outcome": "string", "added": "array<string>"}
    empty = state(**{n: F.lit(None).cast(kinds[n]) for n in [*names, "outcome"]}, there=F.lit(False), added=none)
    nothing = F.array().cast("array<struct<pos: bigint, family: string, content_hash: string, claims: array<string>, primary_anchor: string, slot: string, scope: string, tier: string, known: boolean>>")
    rows = rows.select("node_key", F.aggregate(F.coalesce("requests", nothing), F.coalesce("s", empty), step).alias("s"))
    return rows.select("node_key", *(F.col(f"s.{n}") for n in [*names, "outcome"]))


def subsumes(current: DataFrame) -> DataFrame:
    """wider, narrower: rows whose anchor properly holds the other's, in one slot and family, with a claim in common.

    Joined on slot, family, claim and the wider anchor, which is one of the narrower's prefixes: an
    equi-join, in place of all pairs.
    """
    base = current.where("slot is not null and primary_anchor is not null")
    claims = base.select("node_key", "slot", "family", "primary_anchor", F.explode("claims").alias("c")).withColumn("c", claim_key(F.col("c")))
    parts = F.split("primary_anchor", "::")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "::")))
    narrow = claims.where(F.size(parts) > 1).select("slot", "family", "c", F.col("node_key").alias("narrower"), up.alias("primary_anchor"))
    return claims.withColumnRenamed("node_key", "wider").join(narrow, ["slot", "family", "c", "primary_anchor"]).select("wider", "narrower").distinct()


def relations_of(relations: DataFrame, key: str, direction: str = "both") -> DataFrame:
    """The well-formed relations (endpoint_a, relation_kind, endpoint_b) of a key: out, in or both."""
    sound = relations.where("endpoint_a <> '' and endpoint_b <> '' and endpoint_a <> endpoint_b and relation_kind is not null")
    a, b = F.col("endpoint_a") == key, F.col("endpoint_b") == key
    return sound.where(a if direction == "out" else b if direction == "in" else a | b)


def negations_of(negations: DataFrame, freshness: DataFrame, scope: str) -> DataFrame:
    """Negations under a scope with their freshness; what is unknown is DRIFTED."""
    rows = negations.where(under_scope(F.col("scope"), F.lit(scope)))
    return rows.join(freshness, "node_key", "left").withColumn("freshness", F.coalesce("freshness", F.lit("DRIFTED")))


def same_as(edges: DataFrame, retracted: DataFrame, nodes: DataFrame, scratch) -> DataFrame:  # noqa: ANN001
    """node_key, class_key: connected components of asserted edges (a, b) that aren't retracted, between known nodes.

    Classes stand in place of all pairs; the authority over a link asks for the classes of all edges,
    retracted ones included: pass an empty `retracted`.
    """
    from .graph import components

    norm = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    live = norm(edges).join(norm(retracted), ["a", "b"], "left_anti")
    known = nodes.select("node_key").distinct()
    live = live.join(known.withColumnRenamed("node_key", "a"), "a", "left_semi").join(known.withColumnRenamed("node_key", "b"), "b", "left_semi")
    return components(live, scratch)


def scope_query(current: DataFrame, freshness: DataFrame, scope: str) -> DataFrame:
    """node_key, tier, claim, freshness of the live rows anchored under a scope; unknown freshness is DRIFTED."""
    rows = current.where("superseded_by is null").where(under_scope(F.col("primary_anchor"), F.lit(scope)))
    rows = rows.join(freshness, "node_key", "left")
    return rows.select("node_key", "tier", F.concat_ws("; ", "claims").alias("claim"), F.coalesce("freshness", F.lit("DRIFTED")).alias("freshness"))


def fast_path(grounded: Column, low_risk: Column, tier: Column, family: Column, contested: Column, promoted: Column) -> Column:
    ok = grounded & low_risk & (tier == "T2") & (family == "advisory") & ~contested & ~promoted
    return F.when(F.coalesce(ok, F.lit(False)), "auto-accept").otherwise("full-ratify")


def first_refusal(*gates: tuple[str, Column]) -> Column:
    """The name of the first gate that a request fails, in order; null if it passes all."""
    out = F.lit(None).cast("string")
    for name, passes in reversed(gates):
        out = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(out)
    return out
