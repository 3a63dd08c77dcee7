"""What a repository holds beside its tree: tracked files, policy, dossiers of commits, sources of units."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_part
from ..plans.scratch import Tables

#: The fields of a commit's trailer, in the order of its lines.
TRAILER = ("WP", "Model", "Gates", "Verdict", "TranscriptSha")


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    """mode, oid, path from NUL-ended records `mode oid stage TAB path` of a listing; others are left out."""
    rows = spark.read.option("lineSep", "\x00").text(path)
    meta, name = F.split(F.substring_index("value", "\t", 1), " "), F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1)
    rows = rows.where(F.contains("value", F.lit("\t"))).select(F.get(meta, 0).alias("mode"), F.get(meta, 1).alias("oid"), name.alias("path"))
    return rows.where("oid is not null and path <> ''")


def parse_policy(spark: SparkSession, text: str | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(scopes, owners, keywords) of a policy's JSON: scope, actor; prefix, owner; what names a strict territory.

    Anything malformed anywhere denies all: no scope has an actor, no prefix an owner.
    """
    scopes, owners, words = [], [], []
    try:
        raw = json.loads(text or "")
        words = raw["t0Heuristic"]["keywords"]
        sound = isinstance(words, list) and all(isinstance(w, str) for w in words) and isinstance(raw["authz"]["scopes"], dict)
        for scope, actors in raw["authz"]["scopes"].items():
            sound = sound and isinstance(actors, list) and all(isinstance(x, str) for x in actors)
            scopes += [(scope, x) for x in actors] if sound else []
        anchors = raw["authz"].get("anchors", {})
        sound = sound and isinstance(anchors, dict) and all(isinstance(o, str) and o and p for p, o in anchors.items())
        owners = list(anchors.items()) if sound else []
    except (ValueError, KeyError, TypeError, AttributeError):
        sound = False
    if not sound:
        scopes, owners, words = [], [], []
    return spark.createDataFrame(scopes, "scope string, actor string"), spark.createDataFrame(owners, "prefix string, owner string"), words


def trailer_text(fields: dict[str, Column]) -> Column:
    """A trailer's lines `Name: value`, in their order; an absent value is empty."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), F.coalesce(fields.get(n, F.lit(None)), F.lit(""))) for n in TRAILER))


def trailer_field(text: Column, name: str) -> Column:
    """A field of a trailer's lines; '' if it has none, null without a trailer."""
    return F.when(text.isNotNull(), F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1))


def dossier(text: Column) -> Column:
    """The trailer (a JSON object) of a serialized dossier; null for a text that is blank, no JSON, or has no trailer object."""
    part = F.get_json_object(text, "$.trailer")
    return F.when(F.coalesce(part.rlike(r"^\{"), F.lit(False)), part)


def unit_source(sites: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """path, content of each site: a file's own text, or a unit's; null for a unit that its file doesn't have.

    sites: path; files: path, content; units: path, content.
    """
    both = files.select("path", "content").unionByName(units.select("path", "content"))
    return sites.select("path").distinct().join(both, "path", "left")


def siblings(site: DataFrame, units: DataFrame, cap: int = 8, scratch: Tables | None = None) -> DataFrame:
    """path, sibling, depth: units of a site's file that its text mentions, then those that these mention, at most `cap`.

    site: path; units: path, name, content.  Breadth first; units that enclose the site come before all
    mentions, the innermost first, then by depth and path.  What a file holds bounds a site's search;
    every round is written.
    """
    scratch = scratch or Tables(units.sparkSession)
    u = units.withColumn("file", file_part(F.col("path"))).withColumn("words", F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))))
    u = scratch.table(u.select("file", "name", "path", "words"))
    start = scratch.table(site.select(F.col("path").alias("site")).distinct().join(u.withColumnRenamed("path", "site"), "site").select("site", "file", F.col("site").alias("path"), "words"))
    around = start.select("site", "file").join(u.select("file", F.col("path").alias("sibling")), "file")
    found = around.where(F.startswith("site", F.concat("sibling", F.lit("::")))).select("site", "sibling", (-F.length("sibling")).alias("depth"))
    seen, edge = start.select("site", "path"), start
    for depth in range(1, cap + 1):  # a round finds one at least, or none is left
        named = edge.select("site", "file", F.explode("words").alias("name")).distinct().join(u, ["file", "name"])
        edge = scratch.table(named.select("site", "file", "path", "words").join(seen, ["site", "path"], "left_anti").dropDuplicates(["site", "path"]))
        if edge.isEmpty():
            break
        found = found.unionByName(edge.select("site", F.col("path").alias("sibling"), F.lit(depth).alias("depth")))
        seen = seen.unionByName(edge.select("site", "path"))
    first = found.groupBy("site", "sibling").agg(F.min("depth").alias("depth"))
    by = Window.partitionBy("site").orderBy("depth", "sibling")
    return first.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= cap).select(F.col("site").alias("path"), "sibling", "depth")


def untrusted_stores(tracked: DataFrame, stores: DataFrame) -> DataFrame:
    """store, untrusted: whether a repository tracks anything in a store's folder (store) but its policy; what was committed came through no door."""
    inside = tracked.select("path").where(~F.endswith("path", F.lit("/policy.json")))
    parts = F.split("path", "/")
    above = inside.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("store")).distinct()
    rows = stores.select("store").distinct().join(above.withColumn("_in", F.lit(True)), "store", "left")
    return rows.select("store", F.coalesce("_in", F.lit(False)).alias("untrusted"))
