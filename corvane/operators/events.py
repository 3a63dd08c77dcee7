"""The event log: keyed fold, convergent merge, heads, differences, rewinding.

log: id, seq, node_key, content_hash, fresh, supersedes array<string>, payload.  All operators are
independent of arrival order: equal sets of events give equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Tables

LOG = "id string, seq long, node_key string, content_hash string, fresh boolean, supersedes array<string>, payload string"


def merge(*logs: DataFrame) -> DataFrame:
    """The union by id; commutative, associative, idempotent."""
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other)
    return out.dropDuplicates(["id"])


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union by id in which the first log's row stands where both have one."""
    return first.dropDuplicates(["id"]).unionByName(second.dropDuplicates(["id"]).join(first.select("id"), "id", "left_anti"))


def reseq(log: DataFrame, order: str = "id", scratch=None) -> DataFrame:  # noqa: ANN001
    """Local order numbers from 0, ids unchanged: each run of a range-sorted log starts after those before it.

    The sorted log is written once, so that what is counted is what is numbered.
    """
    ranged = log.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranged = (scratch or Tables(log.sparkSession)).table(ranged)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that sorted
    before = sizes.select("_p", "first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    return ranged.join(F.broadcast(before), "_p").withColumn("seq", F.col("_m") - F.col("first") + F.col("base")).select(*log.columns)


def fold(log: DataFrame) -> DataFrame:
    """One event for each (node_key, content_hash): the largest id, with seq 0; null keys are left out."""
    best = F.max(F.struct("id", "fresh", "supersedes", "payload")).alias("e")
    rows = log.where("node_key is not null").groupBy("node_key", "content_hash").agg(best)
    return rows.select("node_key", "content_hash", "e.*", F.lit(0).cast("long").alias("seq"))


def head(state: DataFrame) -> DataFrame:
    """For each node the fresh entry with the largest content hash that no entry of the node supersedes."""
    gone = state.select("node_key", F.explode("supersedes").alias("content_hash")).distinct()
    alive = state.where("fresh").join(gone, ["node_key", "content_hash"], "left_anti")
    best = alive.groupBy("node_key").agg(F.max(F.struct("content_hash", "id", "payload")).alias("h"))
    return best.select("node_key", "h.*")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """node_key, change, content_hash, provenance between two logs: added, edited, superseded, decayed heads.

    A head that the later state replaces is superseded if an entry of its node names it, else edited;
    superseded and decayed rows carry the old content, added and edited the new.  Provenance is the
    payload of the event that tells of the change: the new head, or what supersedes the old one (of
    several the largest id), or the old head itself.  A change without provenance isn't shown.
    """
    state = fold(b)
    x = head(fold(a)).select("node_key", F.col("content_hash").alias("old"), F.col("payload").alias("old_payload"))
    y = head(state).select("node_key", F.col("content_hash").alias("new"), F.col("payload").alias("new_payload"))
    named = state.select("node_key", F.explode("supersedes").alias("old"), "id", "payload").groupBy("node_key", "old").agg(F.max(F.struct("id", "payload")).alias("by"))
    rows = x.join(y, "node_key", "full_outer").where("not (old <=> new)").join(named, ["node_key", "old"], "left")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "decayed").when(F.col("by").isNotNull(), "superseded").otherwise("edited")
    fresh = change.isin("added", "edited")
    told = F.when(fresh, F.col("new_payload")).when(F.col("by").isNotNull(), F.col("by.payload")).otherwise(F.col("old_payload"))
    rows = rows.select("node_key", change.alias("change"), F.when(fresh, F.col("new")).otherwise(F.col("old")).alias("content_hash"), told.alias("provenance"))
    return rows.where("provenance is not null")


def rewind(log: DataFrame, gone: DataFrame) -> DataFrame:
    """The state of the log without the events of `gone` (column id)."""
    return fold(log.join(gone.select("id"), "id", "left_anti"))


def forget(active: DataFrame, gone: DataFrame) -> DataFrame:
    """Leaves the active rows only; what is archived is never deleted."""
    return active.join(gone.select("id"), "id", "left_anti")


def state_texts(state: DataFrame) -> DataFrame:
    """node_key, text, digest: the canonical text of each node's entries by content hash, which equal states share.

    A node's entries are one row, as its text asks.
    """
    entry = F.to_json(F.struct("content_hash", "fresh", "id", F.col("payload").alias("payload"), F.lit(0).alias("seq"), "supersedes"), {"ignoreNullFields": "false"})
    rows = state.select("node_key", F.struct("content_hash", F.concat(F.lit('"'), "content_hash", F.lit('":'), entry).alias("t")).alias("e"))
    rows = rows.groupBy("node_key").agg(F.sort_array(F.collect_list("e")).alias("es"))
    text = F.concat(F.lit('{"entries":{'), F.array_join(F.transform("es", lambda e: e["t"]), ","), F.lit('},"nodeKey":"'), "node_key", F.lit('"}'))
    return rows.select("node_key", text.alias("text"), F.sha2(text, 256).alias("digest"))


def content_keyed(log: DataFrame) -> DataFrame:
    """The events whose id is that of their content."""
    from ..functions.identity import event_id

    made = event_id(F.col("node_key"), F.col("content_hash"), F.col("fresh"), F.col("supersedes"), F.col("payload"))
    return log.where(F.col("id") == made)
