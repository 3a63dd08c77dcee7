"""Territories: glob assignment, ownership, coverage gates.

territories: decl (order of declaration), name, owner, tier, globs array<string>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folders, glob_folder, glob_literal_length, glob_regex, glob_zone

#: A T0 territory with a larger part of unresolved references fails.
GATE = 0.15


def globs(territories: DataFrame) -> DataFrame:
    """decl, name, owner, tier, pattern, literal, folder, zone for each glob."""
    g = F.col("g")
    rows = territories.select("decl", "name", "owner", "tier", F.explode("globs").alias("g"))
    return rows.select("decl", "name", "owner", "tier", glob_regex(g).alias("pattern"), glob_literal_length(g).alias("literal"), glob_folder(g).alias("folder"), glob_zone(g).alias("zone"))


def assign(paths: DataFrame, territories: DataFrame) -> DataFrame:
    """path, territory, owner, tier, verdict: the glob with the longest literal prefix wins, then the first declared.

    An uncovered path is denied below the zone of a T0 territory and open elsewhere.  A path meets only
    the globs whose literal folder is one of its own: an equi-join, whose pairs the pattern filters.
    """
    g = globs(territories)
    steps = paths.select("path").distinct().select("path", F.explode(folders(F.col("path"))).alias("folder"))
    matched = steps.join(g, "folder").where(F.expr("path rlike pattern"))
    best = matched.groupBy("path").agg(F.min(F.struct((-F.col("literal")).alias("l"), "decl", "name", "owner", "tier")).alias("b"))
    zones = g.where("tier = 'T0' and zone <> ''").select(F.col("zone").alias("folder")).distinct()
    denied = steps.join(zones, "folder", "left_semi").select("path").distinct().withColumn("denied", F.lit(True))
    out = paths.select("path").distinct().join(best, "path", "left").join(denied, "path", "left")
    verdict = F.when(F.col("b.name").isNotNull(), "covered").when(F.col("denied"), "deny").otherwise("open")
    return out.select("path", F.col("b.name").alias("territory"), F.col("b.owner").alias("owner"), F.col("b.tier").alias("tier"), verdict.alias("verdict"))


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value by key, ties to the smallest: counted before it is compared."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value))


def ownership(assigned: DataFrame, authors: DataFrame) -> DataFrame:
    """unit, owner, source: a territory's declared owner, else its most frequent author; unclaimed paths by directory.

    authors: path, author.
    """
    folder = F.when(F.instr("path", "/") == 0, F.lit(".")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    rows = assigned.select("path", "territory", "owner").withColumn("unit", F.coalesce("territory", folder))
    declared = rows.groupBy("unit").agg(F.max(F.when(F.col("owner") != "", F.col("owner"))).alias("declared"))
    most = mode(rows.join(authors, "path"), "unit", "author")
    out = declared.join(most, "unit", "left")
    source = F.when(F.col("declared").isNotNull(), "declared").when(F.col("author").isNotNull(), "authors").otherwise("none")
    return out.select("unit", F.coalesce("declared", "author").alias("owner"), source.alias("source"))


def coverage(tallies: DataFrame) -> DataFrame:
    """territory, tier, unresolved, total, ratio, passes from rows territory, tier, resolved."""
    rows = tallies.groupBy("territory", "tier").agg(F.count_if(~F.col("resolved")).alias("unresolved"), F.count("*").alias("total"))
    ratio = F.when(F.col("total") == 0, 0.0).otherwise(F.col("unresolved") / F.col("total"))
    return rows.withColumn("ratio", ratio).withColumn("passes", ~((F.col("tier") == "T0") & (F.col("ratio") > GATE)))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """path, owner: the owner of the longest prefix (column prefix), by whole segments, that holds the path.

    An equi-join on every prefix of a path, so that prefixes may be as many as paths.
    """
    parts = F.split("path", "/")
    steps = paths.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("n", "prefix"))
    found = steps.join(prefixes, "prefix")
    return found.groupBy("path").agg(F.max_by("owner", "n").alias("owner"))


def strictest_tier(members: DataFrame, key: str) -> DataFrame:
    """The strictest tier of each group; one off the lattice counts as T0."""
    rank = F.when(F.col("tier").isin("T0", "T1", "T2"), F.substring("tier", 2, 1).cast("int")).otherwise(0)
    return members.groupBy(key).agg(F.concat(F.lit("T"), F.min(rank)).alias("tier"))


def latest_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
