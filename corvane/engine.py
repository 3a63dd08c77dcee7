"""One object over a store's tables: what is asked by name gives a verdict, and nothing is thrown.

A verdict is ok with a DataFrame, or says why not: malformed arguments, a refusal, or a fault of the
engine's own.  exit_code maps that to 0, 1 (usage) and 2 (refused).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers
from .operators import deps, facts, fresh, governed, packs, retrieval, verify
from .plans.scratch import Tables
from .sources import portable

#: Arguments that have a value; any other flag is a switch.
VALUED = ("at", "by", "scope", "world", "min")


@dataclass
class Verdict:
    ok: bool
    result: DataFrame | None = None
    rejected: str | None = None


def fault(verdict: Verdict) -> str | None:
    """malformed-args, internal-fault or refused; None for a verdict that is ok."""
    if verdict.ok:
        return None
    head = (verdict.rejected or "").partition(":")[0]
    return head if head in (answers.MALFORMED, answers.INTERNAL) else "refused"


def exit_code(verdict: Verdict) -> int:
    return {None: 0, answers.MALFORMED: 1}.get(fault(verdict), 2)


def parse(argv: list[str]) -> tuple[str | None, list[str], dict[str, str | bool]]:
    """(command, arguments, flags): `--name value` for valued flags, `--name=value`, `--name` for switches; total."""
    words, flags, rest = [], {}, list(argv)
    while rest:
        word = rest.pop(0)
        if not word.startswith("--"):
            words.append(word)
            continue
        name, is_, value = word[2:].partition("=")
        flags[name] = value if is_ else rest.pop(0) if name in VALUED and rest and not rest[0].startswith("--") else True
    return (words[0] if words else None), words[1:], flags


class Refused(Exception):
    """What a tool refuses, with the reason as its text."""


@dataclass
class Engine:
    """tables: current (node_key, tier, claims, primary_anchor, scope, content_hash, superseded_by, anchor),
    freshness (node_key, freshness), edges (src, dst, kind), triggers (tag, content_hash), entries (fact,
    pos, path, subtree_hash), nodes (path, subtree_hash), relations, negations, occurrences, scopes,
    owners, stored (node_key, scope, tier), same_as and retracted (a, b)."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    actor: str = ""
    token: str = ""
    tools: dict[str, tuple[tuple[str, ...], Callable]] = field(init=False)

    def __post_init__(self) -> None:
        self.tools = {
            "query": (("scope",), self.query), "relate": (("scope",), self.relate), "own": (("unit",), self.own), "emit": (("requests",), self.emit), "reconcile": ((), self.reconcile),
            "relations": (("key",), self.relations), "negations": (("scope",), self.negations), "verify-fact": (("claims",), self.verify_fact), "verify": (("kind", "target", "scope"), self.verify),
            "verify-store": ((), self.verify_store), "link": (("pairs",), self.link), "plans": ((), self.plans),
            "archive": ((), self.archive), "why": (("fact",), self.why), "hotset": (("budget",), self.hot_set), "reground": (("fact",), self.reground),
        }

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise Refused(f"no-such-table: {name}")
        return self.tables[name]

    def call(self, tool: str, **args: object) -> Verdict:
        """The verdict of a tool; its arguments are checked before it is run."""
        if tool not in self.tools:
            return Verdict(False, rejected=f"{answers.MALFORMED}: no tool '{tool}'")
        required, run = self.tools[tool]
        if missing := [k for k in required if args.get(k) is None]:
            return Verdict(False, rejected=f"{answers.MALFORMED}: '{tool}' requires {', '.join(map(repr, missing))}; not supplied")
        try:
            return Verdict(True, run(**args))
        except Refused as e:
            return Verdict(False, rejected=str(e))
        except TypeError as e:
            return Verdict(False, rejected=f"{answers.MALFORMED if 'argument' in str(e) else answers.INTERNAL}: {e}")
        except Exception as e:  # noqa: BLE001  a caller is told, whatever it was
            return Verdict(False, rejected=f"{answers.INTERNAL}: {type(e).__name__} while serving '{tool}'")

    # --- reads

    def query(self, scope: str, by: str = "scope") -> DataFrame:
        """The pack of a scope, of what depends on an anchor, or of a trigger."""
        current, freshness = self._table("current"), self._table("freshness")
        if by == "scope":
            rows = facts.scope_query(current, freshness, scope).select(F.lit(scope).alias("target"), "node_key", "tier", "claim")
        elif by in ("dependency", "trigger"):
            live = current.where("superseded_by is null").select("node_key", "tier", F.concat_ws("; ", "claims").alias("claim"), "anchor", "content_hash")
            asked = self.spark.createDataFrame([(scope,)], "target string")
            rows = retrieval.by_dependency(live, self._table("edges"), asked, Tables(self.spark)) if by == "dependency" else retrieval.by_trigger(live, self._table("triggers"), asked)
        else:
            raise Refused(f"unknown-mode: {by}")
        return retrieval.mint_pack(rows.select("target", "node_key", "tier", "claim"), freshness)

    def relate(self, scope: str) -> DataFrame:
        live = self._table("current").where("superseded_by is null").select("node_key", "tier", F.concat_ws("; ", "claims").alias("claim"), "anchor", F.col("primary_anchor").alias("path"))
        return retrieval.relation_set(live, self._table("edges"), scope, Tables(self.spark))

    def own(self, unit: str) -> DataFrame:
        return packs.own(self._table("feeds").where(F.col("unit") == unit))

    def relations(self, key: str, direction: str = "both") -> DataFrame:
        if direction not in ("out", "in", "both"):
            raise Refused(f"unknown-direction: {direction}")
        return facts.relations_of(self._table("relations"), key, direction)

    def negations(self, scope: str, abstained: bool = False) -> DataFrame:
        """The negations under a scope, or what was abstained from there."""
        if abstained:
            return governed.abstentions_of(self._table("abstained"), scope)
        return facts.negations_of(self._table("negations"), self._table("freshness"), scope)

    def verify(self, kind: str, target: str, scope: str, world: str | None = None, least: int | None = None, exact: bool = False) -> DataFrame:
        """One claim's verdict; a world that isn't given is the scope."""
        if kind not in ("dependency", "count", "negation"):
            raise Refused(f"unknown-kind: {kind}")
        if kind == "count" and least is None:
            raise Refused("missing-bound: a count needs the least number of callers")
        claim = (0, kind, target, scope, world or scope, least, exact)
        return self.verify_fact(self.spark.createDataFrame([claim], verify.CLAIMS))

    def verify_store(self) -> DataFrame:
        """One row: how the sealed facts of the store (sealed) come out when their witnesses are replayed."""
        occurrences = self._table("occurrences")
        return verify.reverify_report(verify.reverify(self._table("sealed"), verify.reverse(occurrences), occurrences.select("path")))

    def verify_fact(self, claims: DataFrame) -> DataFrame:
        return verify.verify(claims, verify.reverse(self._table("occurrences")))

    # --- writes

    def emit(self, requests: DataFrame) -> DataFrame:
        """The outcome of each request; the door decides, the caller upserts what is emitted."""
        stored = self._table("stored").select("node_key", F.col("scope").alias("stored_scope"), F.col("tier").alias("stored_tier"))
        current = self._table("current").select("node_key", "scope", "tier").join(stored, "node_key", "left")
        return governed.emit(requests, current, self._table("scopes"), self._table("owners"), self.actor, self.token)

    def link(self, pairs: DataFrame) -> DataFrame:
        stored = self._table("stored").select("node_key", F.col("scope").alias("stored_scope"), F.col("tier").alias("stored_tier"))
        current = self._table("current").select("node_key", "scope").join(stored, "node_key", "left")
        return governed.governed_link(pairs, current, self._table("same_as"), self._table("retracted"), self._table("scopes"), self.actor, self.token, Tables(self.spark))

    # --- drift

    def reconcile(self) -> DataFrame:
        """One row: mechanical, semantic, code."""
        return fresh.exit_code(fresh.reconcile(self._table("entries"), self._table("nodes")))

    def archive(self, scope: str | None = None) -> DataFrame:
        return portable.lineage(self._table("current"), scope)

    def why(self, fact: str) -> DataFrame:
        return fresh.relocations(self._table("entries").where(F.col("fact") == fact), self._table("nodes"))

    def hot_set(self, budget: int) -> DataFrame:
        n = self._table("current").where("superseded_by is null").agg(F.count("*").alias("size"))
        return n.select("size", F.lit(int(budget)).cast("long").alias("budget"), (F.col("size") > int(budget)).alias("over"))

    def reground(self, fact: str) -> DataFrame:
        return fresh.reground(self._table("entries").where(F.col("fact") == fact), self._table("nodes"))

    def plans(self) -> DataFrame:
        """What to do with each drifted fact."""
        return fresh.plans(self._table("entries"), self._table("nodes"))

    def dependents(self, node: str) -> DataFrame:
        return deps.dependents(self._table("edges"), self.spark.createDataFrame([(node,)], "node string"), None, Tables(self.spark))
