"""A fact's life: checks against the index, status, hits and decay, awareness, metering, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import scrub, words

AWARENESS_CAP = 400
#: The five facets of awareness, in their order, and the line of one without a source.
FACETS = ("mission", "constitution", "terrain", "ontology", "taste")
UNSEEDED = "UN-SEEDED ({}): source absent \u2014 no self-model line fabricated"


def evaluate(checks: DataFrame, nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """check_id, verdict (HOLDS, BROKEN or NA) of checks (check_id, query).

    `exists | key`, `absent | key`, `has-object | hash`, `child-count | key | n`, `subtree-hash | key |
    hash`; anything else is NA, as is an assertion about a node that isn't there.  nodes: path,
    parent_path, subtree_hash; objects: hash.
    """
    part = lambda i: F.trim(F.get(F.split("query", "\\|"), i))
    c = checks.select("check_id", part(0).alias("op"), F.coalesce(part(1), F.lit("")).alias("key"), F.coalesce(part(2), F.lit("")).alias("value"), F.size(F.split("query", "\\|")).alias("n"))
    asked = c.select("key").distinct()
    here = nodes.join(asked, F.col("path") == F.col("key"), "left_semi").select(F.col("path").alias("key"), "subtree_hash", F.lit(True).alias("found"))
    kids = nodes.join(asked, F.col("parent_path") == F.col("key"), "left_semi").groupBy(F.col("parent_path").alias("key")).agg(F.count("*").alias("kids"))
    held = objects.select(F.col("hash").alias("key")).distinct().join(asked, "key", "left_semi").withColumn("object", F.lit(True))
    rows = c.join(here, "key", "left").join(kids, "key", "left").join(held, "key", "left")
    is_ = lambda x: F.when(x, "HOLDS").otherwise("BROKEN")
    found = F.coalesce("found", F.lit(False))
    verdict = (
        F.when((F.col("key") == "") | F.col("op").isNull(), "NA")
        .when(F.col("op") == "exists", is_(found))
        .when(F.col("op") == "absent", is_(~found))
        .when(F.col("op") == "has-object", is_(F.coalesce("object", F.lit(False))))
        .when((F.col("n") != 3) | ~found, "NA")
        .when((F.col("op") == "child-count") & F.col("value").rlike("^\\d+$"), is_(F.coalesce("kids", F.lit(0)) == F.expr("try_cast(value as long)")))
        .when((F.col("op") == "subtree-hash") & (F.col("value") != ""), is_(F.col("subtree_hash") == F.col("value")))
        .otherwise("NA")
    )
    return rows.select("check_id", verdict.alias("verdict"))


def decay(served: DataFrame, hits: DataFrame) -> DataFrame:
    """node_key, hits, state of what was served: retained, or decayed without a hit; a later hit brings it back."""
    n = hits.groupBy("node_key").agg(F.count("*").alias("hits"))
    rows = served.select("node_key").distinct().join(n, "node_key", "left").na.fill(0, ["hits"])
    return rows.withColumn("state", F.when(F.col("hits") == 0, "decayed").otherwise("retained"))


def awareness(facets: DataFrame, owner: str) -> DataFrame:
    """owner, facet, content, state, within_cap from facets (owner, facet, tiers, moved): the first tier of each of five.

    A facet without a source is UN-SEEDED and never made up; what moved is drifted.  The tiers of
    ontology are its curated definitions (see definitions).  within_cap: whether an owner's contents
    have AWARENESS_CAP words at most.
    """
    spark = facets.sparkSession
    names = spark.createDataFrame([(i, f) for i, f in enumerate(FACETS)], "ord int, facet string")
    grid = facets.select(owner).distinct().join(F.broadcast(names))  # five rows for each owner
    rows = grid.join(facets.select(owner, "facet", F.get("tiers", 0).alias("top"), "moved"), [owner, "facet"], "left")
    before, after = UNSEEDED.split("{}")
    content = F.coalesce("top", F.concat(F.lit(before), F.col("facet"), F.lit(after)))
    state = F.when(F.col("top").isNull(), "UN-SEEDED").when(F.col("moved"), "drifted").otherwise("seeded")
    rows = rows.select(owner, "facet", content.alias("content"), state.alias("state"))
    total = rows.groupBy(owner).agg((F.sum(words(F.col("content"))) <= AWARENESS_CAP).alias("within_cap"))
    return rows.join(total, owner)


def definitions(nodes: DataFrame, owner: str, curator: str) -> DataFrame:
    """owner, text, pos of the nodes (slot, curated_by) that may be a line of ontology: definitions by their curator."""
    return nodes.where((F.col("slot") == "definition") & (F.col("curated_by") == curator)).select(owner, "text", "pos")


def pull_tail(facets: DataFrame) -> DataFrame:
    """The tiers after the first."""
    return facets.withColumn("tail", F.slice("tiers", 2, F.greatest(F.size("tiers") - 1, F.lit(0)))).drop("tiers")


def meter(records: DataFrame) -> DataFrame:
    """Metering records with defaults for what is missing."""
    numbers = ("tokens_in", "tokens_out", "tokens_cache", "tool_uses", "wall_time", "retries", "reworks")
    have = set(records.columns)
    number = [F.coalesce(F.col(c) if c in have else F.lit(None), F.lit(0)).cast("long").alias(c) for c in numbers]
    text = [F.coalesce(F.col(c) if c in have else F.lit(None).cast("string"), F.lit("")).alias(c) for c in ("model", "verdict", "transcript")]
    return records.select(*(c for c in records.columns if c not in {*numbers, "model", "verdict", "transcript"}), *number, *text)


def transcripts(bodies: DataFrame) -> DataFrame:
    """hash, body: redacted first, then addressed by what is left; equal bodies are kept once."""
    clean = bodies.select(scrub(F.col("body")).alias("body"))
    return clean.select(F.sha2("body", 256).alias("hash"), "body").dropDuplicates(["hash"])


def attach(records: DataFrame, bodies: str) -> DataFrame:
    """records with a pointer (the digest of the redacted body) in place of the body."""
    return records.withColumn("pointer", F.sha2(scrub(F.col(bodies)), 256)).drop(bodies)
