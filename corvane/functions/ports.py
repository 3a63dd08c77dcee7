"""What a caller can put in place of a default: each port is a callable with one, and what uses it takes it as an argument.

Encoders, thresholds and oracles are column expressions; scanners, proposers and models are Python
callables that run on batches of the executors.  register() gives the column ports names in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CREDENTIAL, tier_rank


def encoder(text: Column) -> Column:
    """The digest of a canonical text."""
    return F.sha2(text, 256)


def calibrate(hits: Column) -> Column:
    """The threshold that a number of hits gives: hits / (hits + 1), so that none gives 0."""
    return hits / (hits + 1)


def re_derives(moved_to: Column) -> Column:
    """Whether a drifted anchor can be derived again: its content has one place to be."""
    return moved_to.isNotNull()


def mint(candidates: DataFrame) -> DataFrame:
    """Facts of candidates: fresh advisories."""
    return candidates.withColumn("freshness", F.lit("FRESH")).withColumn("family", F.lit("advisory"))


def freshness(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """facts (node_key) with their freshness from verdicts (node_key, freshness); unknown is DRIFTED."""
    return facts.join(verdicts, "node_key", "left").withColumn("freshness", F.coalesce("freshness", F.lit("DRIFTED")))


@dataclass(frozen=True)
class Doors:
    """The two doors of a bar: is a claim grounded, and how obvious is it (0 to 1; it never decides)."""

    grounded: Callable[[Column], Column] = lambda entries: F.coalesce(F.size(entries) > 0, F.lit(False))
    obviousness: Callable[[Column], Column] = lambda claim: F.lit(0.0)


@dataclass(frozen=True)
class Predicate:
    """How a check is made for a site, told on the index, and shown to bite: columns that are null where that is not possible."""

    synthesize: Callable[[Column], Column] = lambda site: F.lit(None).cast("string")
    verify: Callable[[Column], Column] = lambda check: F.lit("NA")
    teeth: Callable[[Column, Column], Column] = lambda check, site: F.lit(False)


@dataclass(frozen=True)
class Types:
    """What a type system can tell of a slot: nothing by default."""

    expressible: Callable[[Column], Column] = lambda slot: F.lit(False)
    diagnose: Callable[[Column, Column], Column] = lambda site, slot: F.lit("NA")


@dataclass(frozen=True)
class Signals:
    """The cheap signals of a candidate: is it of high value, uncertain, checkable, and its tier."""

    high_value: Callable[[DataFrame], Column] = lambda rows: F.lit(False)
    uncertain: Callable[[DataFrame], Column] = lambda rows: F.lit(False)
    checkable: Callable[[DataFrame], Column] = lambda rows: F.lit(False)
    tier: Callable[[DataFrame], Column] = lambda rows: F.lit("T2")


@dataclass(frozen=True)
class Scanner:
    """A named scanner of texts: whether one holds a secret.  One without a name is refused where it is used."""

    name: str = "credentials"
    scan: Callable[[Column], Column] = lambda text: text.rlike(CREDENTIAL)


def write_with_scanner(store: DataFrame, records: DataFrame, column: str, scanner: Scanner | None = None) -> DataFrame:
    """store with the records, any of which the scanner hits is an error that names it: nothing is written then."""
    scanner = scanner or Scanner()
    if not scanner.name:
        raise ValueError("a scanner before a write needs a name")
    hit = F.coalesce(scanner.scan(F.col(column)), F.lit(False))
    checked = records.withColumn(column, F.when(hit, F.raise_error(F.lit(f"blocked by {scanner.name}"))).otherwise(F.col(column)))
    return store.unionByName(checked)


def abstain(sites: pd.DataFrame) -> pd.Series:
    """The default model: it says nothing of any site."""
    return pd.Series(["NO-FACT"] * len(sites), index=sites.index, dtype=object)


def propose(sites: DataFrame, model: Callable[[pd.DataFrame], pd.Series] = abstain) -> DataFrame:
    """sites with answer: a model's answer to each row, asked in batches; an error of the model is no answer."""
    schema = T.StructType([*(f for f in sites.schema.fields if f.name != "answer"), T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = model(batch)
            except Exception:  # noqa: BLE001  whatever a model does, the other batches go on
                answers = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            yield batch.assign(answer=answers)[schema.names]

    return sites.mapInPandas(run, schema)


@dataclass
class OwnFeeds:
    """The feeds of a unit's own pack, each unit, node_key, tier, hits, ppr, cost; one that is left out is empty."""

    invariants: DataFrame | None = None
    gotchas: DataFrame | None = None
    pointers: DataFrame | None = None
    advisory: DataFrame | None = None

    def candidates(self) -> DataFrame | None:
        out = None
        for feed, rows in (("invariant", self.invariants), ("gotcha", self.gotchas), ("pointer", self.pointers), ("advisory", self.advisory)):
            if rows is not None:
                some = rows.select("unit", "node_key", "tier", "hits", "ppr", "cost", F.lit(feed).alias("feed"))
                out = some if out is None else out.unionByName(some)
        return out


@dataclass
class Neighbours:
    """The feeds of what relates to a unit, each unit, node_key, tier, ppr, distance."""

    enclosing: DataFrame | None = None
    dependents: DataFrame | None = None
    dependencies: DataFrame | None = None
    governing: DataFrame | None = None

    def related(self) -> DataFrame | None:
        out = None
        for band in ("enclosing", "dependents", "dependencies", "governing"):
            rows = getattr(self, band)
            if rows is not None:
                some = rows.select("unit", "node_key", "tier", "ppr", "distance", F.lit(band).alias("band"))
                out = some if out is None else out.unionByName(some)
        return out


Pull = Callable[[str], DataFrame]  # a scope's fresh pack, asked for by a harness that can


def injection(scope: str, native: bool, pull: Pull | None, push: Pull) -> DataFrame:
    """The fresh pack of a scope: pulled where the harness can and a pull is given, else what is pushed."""
    return pull(scope) if native and pull is not None else push(scope)


def register(spark: SparkSession) -> None:
    """corvane_digest(text), corvane_calibrate(hits) and corvane_tier_rank(tier) as SQL functions that Catalyst inlines."""
    for name, args, body in (
        ("corvane_digest", "t string", "sha2(t, 256)"),
        ("corvane_calibrate", "hits double", "hits / (hits + 1)"),
        ("corvane_tier_rank", "tier string", "case tier when 'T0' then 0 when 'T1' then 1 when 'T2' then 2 else 3 end"),
    ):
        kind = {"corvane_digest": "string", "corvane_calibrate": "double", "corvane_tier_rank": "int"}[name]
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")


__all__ = ["Doors", "Neighbours", "OwnFeeds", "Predicate", "Scanner", "Signals", "Types", "abstain", "calibrate", "encoder", "freshness", "injection", "mint", "propose", "re_derives", "register", "tier_rank", "write_with_scanner"]
