"""Dependencies: symbol edges, callers, exports, closures, dirty marks.

edges: src, dst (null if unresolved), kind in resolved, unresolved, dynamic.
occurrences: path, ord, symbol, role in definition, reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_symbol, common_prefix, terminal_name
from ..plans.scratch import Tables

LOCAL = "local "
HOPS = 2
MERGED = 16  # rounds of a closure after which their tables become one


def derive_edges(occurrences: DataFrame) -> DataFrame:
    """An edge from each file to the first definition of what it references; unknown symbols stay, unresolved.

    A reference that has no definition by its own name is looked up by its source's name.  Local
    symbols and references within the defining file make no edge.
    """
    rows = occurrences.where(~F.startswith("symbol", F.lit(LOCAL)))
    first = rows.where("role = 'definition'").groupBy("symbol").agg(F.min(F.struct("path", "ord")).alias("d")).select("symbol", F.col("d.path").alias("to"))
    refs = rows.where("role = 'reference'").select("path", "symbol").distinct().withColumn("source", canonical_symbol(F.col("symbol")))
    found = refs.join(first, "symbol", "left").join(first.select(F.col("symbol").alias("source"), F.col("to").alias("other")), "source", "left")
    dst = F.coalesce("to", "other")
    return found.select(F.col("path").alias("src"), dst.alias("dst"), F.when(dst.isNull(), "unresolved").otherwise("resolved").alias("kind")).where("dst is null or src <> dst").distinct()


def callers(occurrences: DataFrame) -> DataFrame:
    """symbol, callers: in how many files other than its own a defined symbol is referenced; 0 for uncalled ones."""
    rows = occurrences.where(~F.startswith("symbol", F.lit(LOCAL)))
    own = rows.where("role = 'definition'").select("symbol", F.col("path").alias("own")).distinct()
    refs = rows.where("role = 'reference'").select("symbol", "path").distinct()
    return own.join(refs, "symbol", "left").groupBy("symbol").agg(F.countDistinct(F.when(F.col("path") != F.col("own"), F.col("path"))).alias("callers"))


def holes(occurrences: DataFrame) -> DataFrame:
    """path, unknown: files with references that nothing defines."""
    known = occurrences.where("role = 'definition'").select("symbol").distinct()
    refs = occurrences.where((F.col("role") == "reference") & ~F.startswith("symbol", F.lit(LOCAL))).select("path", "symbol").distinct()
    return refs.join(known, "symbol", "left_anti").groupBy("path").agg(F.count("*").alias("unknown"))


def unit_exports(occurrences: DataFrame) -> DataFrame:
    """symbol, callers, scope: exports with a foreign caller, and the callers' common path prefix ('' is left out)."""
    rows = occurrences.where(~F.startswith("symbol", F.lit(LOCAL)))
    own = rows.where("role = 'definition'").groupBy("symbol").agg(F.min("path").alias("own"))
    refs = rows.where("role = 'reference'").select("symbol", "path").distinct()
    # the common prefix of a set of paths is that of its smallest and its largest: no list of callers is gathered
    out = refs.join(own, "symbol").where("path <> own").groupBy("symbol").agg(F.countDistinct("path").alias("callers"), F.min("path").alias("a"), F.max("path").alias("b"))
    return out.select("symbol", "callers", common_prefix(F.array("a", "b"), "/").alias("scope")).where("scope <> ''")


def unit_deps(occurrences: DataFrame) -> DataFrame:
    """path, name, symbol: what a file uses of others, by terminal name; of several symbols the smallest."""
    rows = occurrences.where(~F.startswith("symbol", F.lit(LOCAL)))
    own = rows.where("role = 'definition'").select("symbol", F.col("path").alias("own"))
    refs = rows.where("role = 'reference'").select("path", "symbol").distinct()
    used = refs.join(own, "symbol").where("path <> own").withColumn("name", terminal_name(F.col("symbol")))
    return used.groupBy("path", "name").agg(F.min("symbol").alias("symbol"))


def dependents(edges: DataFrame, roots: DataFrame, hops: int | None = None, scratch=None) -> DataFrame:  # noqa: ANN001
    """node, distance: what depends on the roots (column node) over resolved edges, at most `hops` away.

    A breadth-first loop of joins.  Each round takes what is new and writes only that, so cycles end
    and nothing is written twice but once in MERGED rounds; the roots are not their own dependents.
    """
    scratch = scratch or Tables(edges.sparkSession)
    back = edges.where("kind = 'resolved' and dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    back = scratch.table(back).repartition("node").persist()
    edge, distance = scratch.table(roots.select("node").distinct().withColumn("distance", F.lit(0))), 0
    seen = edge
    while hops is None or distance < hops:
        distance += 1
        new = edge.join(back, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        edge = scratch.table(new.withColumn("distance", F.lit(distance)))
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
        if distance % MERGED == 0:
            seen = scratch.table(seen)
    back.unpersist()
    return seen.where("distance > 0")


def under_approximate(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """One row, under_approx: whether a node of the scope has an edge that leads nowhere known."""
    return edges.where("dst is null").join(scope.select(F.col("node").alias("src")), "src", "left_semi").agg((F.count("*") > 0).alias("under_approx"))


def dirty_marks(edges: DataFrame, changed: DataFrame, scratch=None) -> DataFrame:  # noqa: ANN001
    """node, mark: changed itself, eager (up to HOPS away: hashed again at once) or suspect (looked at when read)."""
    far = dependents(edges, changed, None, scratch)
    mark = F.when(F.col("distance") <= HOPS, "eager").otherwise("suspect")
    return changed.select("node", F.lit("changed").alias("mark")).distinct().unionByName(far.select("node", mark.alias("mark")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: distinct resolved edges in and out."""
    known = edges.where("kind = 'resolved' and dst is not null").select("src", "dst").distinct()
    return known.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def candidates(occurrences: DataFrame) -> DataFrame:
    """path, kind, name of what a claim about a file can name: what it uses of others, and its own symbols that others use."""
    used = unit_deps(occurrences).select("path", F.lit("dependency").alias("kind"), "name")
    own = occurrences.where("role = 'definition'").select("path", "symbol").join(callers(occurrences).where("callers > 0"), "symbol")
    return used.unionByName(own.select("path", F.lit("count").alias("kind"), terminal_name(F.col("symbol")).alias("name"))).distinct()
