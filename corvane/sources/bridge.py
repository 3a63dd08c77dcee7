"""Views that give the synthetic tables the shapes of the operators' inputs; SQL beside each for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SLOTS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(column: str) -> str:
    return f"cast(round({column} * 100) as bigint)"


def geo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo / region / nation / customer, with customers as leaves."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nations = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    region, nation = F.concat(F.lit("repo/"), "r_name"), F.concat_ws("/", F.lit("repo"), "r_name", "n_name")
    none, of = F.lit(None).cast("string"), c.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    leaf = F.expr(f"concat(c_name, '|', c_mktsegment, '|', cast({cents('c_acctbal')} as string))")
    return (
        spark.range(1).select(F.lit("repo").alias("path"), none.alias("parent_path"), F.lit(0).alias("depth"), none.alias("content"))
        .unionByName(r.select(region.alias("path"), F.lit("repo").alias("parent_path"), F.lit(1).alias("depth"), none.alias("content")))
        .unionByName(nations.select(nation.alias("path"), region.alias("parent_path"), F.lit(2).alias("depth"), none.alias("content")))
        .unionByName(of.select(F.concat(nation, F.lit("/"), "c_name").alias("path"), nation.alias("parent_path"), F.lit(3).alias("depth"), leaf.alias("content")))
    )


TREE_SQL = f"""
tree AS (SELECT 'repo' AS path, NULL::VARCHAR AS parent_path, 0 AS depth, NULL::VARCHAR AS content
  UNION ALL SELECT 'repo/' || r_name, 'repo', 1, NULL FROM region
  UNION ALL SELECT 'repo/' || r_name || '/' || n_name, 'repo/' || r_name, 2, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'repo/' || r_name || '/' || n_name || '/' || c_name, 'repo/' || r_name || '/' || n_name, 3,
    c_name || '|' || c_mktsegment || '|' || {cents("c_acctbal")}
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user; each names the content of the user's previous event of its type as superseded."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("node_key"), "event_type", F.expr(f"sha2(concat(event_type, '|', cast({cents('value')} as string)), 256)").alias("content_hash"))
    prev = F.lag("content_hash").over(Window.partitionBy("node_key", "event_type").orderBy("event_id"))
    e = e.withColumn("fresh", F.col("event_type") != "error").withColumn("supersedes", F.when(prev.isNotNull() & (prev != F.col("content_hash")), F.array(prev)).otherwise(F.array().cast("array<string>")))
    ident = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "node_key", "content_hash"), 256)
    return e.select(ident.alias("id"), F.col("event_id").alias("seq"), "node_key", "content_hash", "fresh", "supersedes", F.col("event_id").cast("string").alias("payload"))


LOG_SQL = f"""
e0 AS (SELECT event_id, user_id::VARCHAR AS node_key, event_type, sha256(event_type || '|' || {cents("value")}) AS content_hash FROM events),
e1 AS (SELECT *, lag(content_hash) OVER (PARTITION BY node_key, event_type ORDER BY event_id) AS prev FROM e0),
log AS (SELECT sha256(event_id || '|' || node_key || '|' || content_hash) AS id, event_id AS seq, node_key, content_hash, event_type <> 'error' AS fresh,
  CASE WHEN prev IS NOT NULL AND prev <> content_hash THEN prev END AS gone, event_id::VARCHAR AS payload FROM e1)"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is defined by its lowest order and referenced by the others; every 29th part is defined by none."""
    x = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("o")).distinct()
    first = x.groupBy("p").agg(F.min("o").alias("first"))
    rows = x.join(first, "p").select(F.col("o").cast("string").alias("path"), F.lit(0).alias("ord"), F.concat(F.lit("part/"), "p").alias("symbol"), F.when((F.col("o") == F.col("first")) & (F.col("p") % 29 != 0), "definition").otherwise("reference").alias("role"))
    return rows


OCC_SQL = """
x AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem),
occ AS (SELECT o::VARCHAR AS path, 'part/' || p AS symbol,
  CASE WHEN o = min(o) OVER (PARTITION BY p) AND p % 29 <> 0 THEN 'definition' ELSE 'reference' END AS role FROM x)"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, their parts as files, customers as authors, urgent ones as fixes."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), (F.col("o_orderpriority") == "1-URGENT").alias("is_fix"))
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path")).distinct()
    return o.join(x, "commit")


BASKET_SQL = """
basket AS (SELECT DISTINCT o_orderkey AS "commit", o_custkey AS author, o_orderpriority = '1-URGENT' AS is_fix, l_partkey AS path
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""

def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts: anchored in source and language, tier by label, text as the only claim."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    tier = F.when(F.col("toxic") == 1, "T0").when(F.col("quality") == 1, "T1").otherwise("T2")
    slot = F.element_at(F.array(*map(F.lit, SLOTS)), (F.col("doc_id") % 13 + 1).cast("int"))
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("node_key"), "doc_id", F.lit("advisory").alias("family"), F.sha2("text", 256).alias("content_hash"), F.array(F.sha2("text", 256)).alias("claims"),
        F.concat_ws("/", "source", F.concat("lang", F.lit(".txt"))).alias("file"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".txt::"), F.col("doc_id")).alias("primary_anchor"),
        slot.alias("slot"), F.col("source").alias("scope"), tier.alias("tier"), F.lit(None).cast("string").alias("superseded_by"), F.col("n_chars").alias("cost"), (F.col("doc_id") % 7).alias("hits"), ((F.col("doc_id") % 11) / 16).alias("ppr"),
    )


FACT_SQL = f"""
fact AS (SELECT doc_id::VARCHAR AS node_key, doc_id, 'advisory' AS family, sha256(text) AS content_hash, source || '/' || lang || '.txt::' || doc_id AS primary_anchor,
  ({list(SLOTS)})[doc_id % 13 + 1] AS slot, source AS scope, CASE WHEN toxic = 1 THEN 'T0' WHEN quality = 1 THEN 'T1' ELSE 'T2' END AS tier, n_chars AS cost, doc_id % 7 AS hits, (doc_id % 11) / 16.0 AS ppr
  FROM documents LEFT JOIN labels USING (doc_id))"""
