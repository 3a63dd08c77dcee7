"""Content stores and bundles: guarded rows, bundles of objects and of memory, textual merges, homes of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_json, digest

# The envelopes of bundles.
OBJECTS, RECORDS = ("corvane-objects", 1), ("corvane-memory", 1)


def guard(rows: DataFrame) -> DataFrame:
    """rows (key, body) with admitted: whether a body (JSON) has the digest of its canonical text as its key.

    The same on write and on read; a body without a canonical text is never admitted.
    """
    return rows.withColumn("admitted", F.coalesce(digest(canonical_json(F.col("body"))) == F.col("key"), F.lit(False)))


def put(store: DataFrame, bodies: DataFrame) -> DataFrame:
    """store (key, body) with the canonical bodies that it hasn't; putting twice changes nothing, and what has no canonical text is left out."""
    made = bodies.select(canonical_json(F.col("body")).alias("body")).where("body is not null")
    made = made.select(digest("body").alias("key"), "body").dropDuplicates(["key"])
    return store.select("key", "body").unionByName(made.join(store.select("key"), "key", "left_anti"))


def drift_eligible(asked: DataFrame, store: DataFrame) -> DataFrame:
    """asked (key) with eligible: whether the store has registered the key."""
    have = store.select("key").distinct().withColumn("_have", F.lit(True))
    return asked.join(have, "key", "left").withColumn("eligible", F.coalesce("_have", F.lit(False))).drop("_have")


def export_objects(store: DataFrame, path: str) -> None:
    """A bundle as a folder of JSON lines, sorted by key in ranges, each with the envelope's format and version."""
    line = F.to_json(F.struct(F.lit(OBJECTS[0]).alias("format"), F.lit(OBJECTS[1]).alias("version"), "key", "body"))
    store.select("key", "body").distinct().repartitionByRange("key").sortWithinPartitions("key").select(line.alias("value")).write.text(path)


def import_objects(spark: SparkSession, path: str) -> DataFrame:
    """key, body of a bundle.  A line of another envelope, or whose body hasn't its key's digest, is an error."""
    rows = spark.read.schema("format string, version int, key string, body string").json(path)
    sound = (F.col("format") == OBJECTS[0]) & (F.col("version") == OBJECTS[1])
    rows = guard(rows.withColumn("_sound", F.coalesce(sound, F.lit(False))))
    ok = F.when(F.col("_sound") & F.col("admitted"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("malformed bundle at "), F.coalesce("key", F.lit("null")))))
    return rows.select(ok.alias("key"), "body")


def export_memory(records: DataFrame, path: str) -> None:
    """Records as JSON lines under the memory envelope."""
    line = F.to_json(F.struct(F.lit(RECORDS[0]).alias("format"), F.lit(RECORDS[1]).alias("version"), F.struct(*records.columns).alias("record")))
    records.select(line.alias("value")).write.text(path)


def import_memory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a memory bundle; a line of another envelope is an error."""
    rows = spark.read.schema(f"format string, version int, record struct<{schema}>").json(path)
    sound = F.coalesce((F.col("format") == RECORDS[0]) & (F.col("version") == RECORDS[1]) & F.col("record").isNotNull(), F.lit(False))
    rows = rows.withColumn("_ok", F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("malformed memory bundle")).cast("boolean")))
    return rows.where("_ok").select("record.*")


def merge_lines(ours: DataFrame, theirs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """id, line of two (or three) texts of JSON lines (columns line): the union by id, in which ours stands where both have one.

    Blank lines and lines without an id are left out.
    """
    out = None
    for rank, part in enumerate(p for p in (ours, theirs, base) if p is not None):
        rows = part.select(F.get_json_object("line", "$.id").alias("id"), "line", F.lit(rank).alias("rank")).where("id is not null")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("id").agg(F.min(F.struct("rank", "line")).alias("l")).select("id", "l.line")


def clone(values: DataFrame) -> DataFrame:
    """key, body of the values (body, homes) that travel with a clone: those with a home in the store."""
    return put(values.select(F.lit("").alias("key"), "body").limit(0), values.where(F.array_contains("homes", "store")).select("body"))


def sole_home_violations(values: DataFrame) -> DataFrame:
    """The values whose only home is an attachment of a pull request."""
    homes = F.array_distinct("homes")
    return values.where((F.size(homes) == 1) & F.array_contains(homes, "pr-attachment"))


def direct_calls(calls: DataFrame) -> DataFrame:
    """The forge calls (op, via) that go past the adapter."""
    return calls.where("not (via <=> 'host-adapter')")


def carries_notes(refspecs: DataFrame) -> DataFrame:
    """One row, carries: whether a push takes notes along."""
    return refspecs.agg(F.coalesce(F.bool_or(F.startswith("refspec", F.lit("refs/notes/"))), F.lit(False)).alias("carries"))


def archive(store: DataFrame, entries: DataFrame) -> DataFrame:
    """store (id, ...) with the entries that it hasn't; nothing is ever taken out."""
    return store.unionByName(entries.dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti").select(store.columns))


def respawn(store: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id) with found: whether the archive has the entry."""
    have = store.select("id").distinct().withColumn("_have", F.lit(True))
    return asked.join(have, "id", "left").withColumn("found", F.coalesce("_have", F.lit(False))).drop("_have")


def lineage(current: DataFrame, scope: str | None = None) -> DataFrame:
    """content_hash: what the rows of a scope (or all) have as content, and what that superseded, one step back; each once."""
    rows = current if scope is None else current.where(F.col("scope") == scope)
    return rows.select(F.explode(F.array("content_hash", "superseded_by")).alias("content_hash")).where("content_hash is not null").distinct()
