"""Queries over trees, events, dependencies and territories, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deps, events, territory, tree
from ..sources import bridge as b
from .scratch import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- events

FOLD = f"""{b.LOG_SQL},
st AS (SELECT node_key, content_hash, max(id) AS id FROM log GROUP BY ALL)"""
HEADS = f"""{FOLD},
es AS (SELECT log.* FROM log JOIN st USING (node_key, content_hash, id)),
gn AS (SELECT DISTINCT node_key, gone AS content_hash FROM es WHERE gone IS NOT NULL),
hd AS (SELECT node_key, max(content_hash) AS content_hash FROM es ANTI JOIN gn USING (node_key, content_hash) WHERE fresh GROUP BY node_key)"""


@query(f"WITH {FOLD} SELECT log.node_key, log.content_hash, log.id, log.fresh, 0::BIGINT AS seq FROM log JOIN st USING (node_key, content_hash, id)")
def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.fold(b.event_log(spark, sf_dir)).select("node_key", "content_hash", "id", "fresh", "seq")


@query(f"WITH {HEADS} SELECT * FROM hd")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.head(events.fold(b.event_log(spark, sf_dir))).select("node_key", "content_hash")


@query(f"WITH {b.LOG_SQL} SELECT count(*) AS n, count(DISTINCT id) AS ids, min(seq) AS first, max(seq) AS last FROM log")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping halves of a log give the log."""
    log = b.event_log(spark, sf_dir)
    out = events.merge(log.where("seq % 3 < 2"), log.where("seq % 3 > 0"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query(f"WITH {b.LOG_SQL} SELECT id, CASE WHEN seq % 3 < 2 THEN 'ours' ELSE 'theirs' END AS payload FROM log")
def combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = b.event_log(spark, sf_dir)
    ours, theirs = log.where("seq % 3 < 2").withColumn("payload", F.lit("ours")), log.where("seq % 3 > 0").withColumn("payload", F.lit("theirs"))
    return events.combine(ours, theirs).select("id", "payload")


@query(f"WITH {b.LOG_SQL} SELECT id, row_number() OVER (ORDER BY id) - 1 AS seq FROM log")
def reseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.reseq(b.event_log(spark, sf_dir)).select("id", "seq")


def _part(cut: str, name: str) -> str:
    return f"""
{name}l AS (SELECT * FROM log WHERE {cut}),
{name}i AS (SELECT node_key, content_hash, max(id) AS id FROM {name}l GROUP BY ALL),
{name}s AS (SELECT {name}l.*, CASE WHEN seq % 11 <> 0 THEN payload END AS told FROM {name}l JOIN {name}i USING (node_key, content_hash, id)),
{name}g AS (SELECT DISTINCT node_key, gone AS content_hash FROM {name}s WHERE gone IS NOT NULL),
{name}h AS (SELECT node_key, max(row(content_hash, id, told))[1] AS content_hash, max(row(content_hash, id, told))[3] AS told FROM {name}s ANTI JOIN {name}g USING (node_key, content_hash) WHERE fresh GROUP BY node_key)"""


@query(f"""WITH {b.LOG_SQL}, {_part("seq % 2 = 0", "pa")}, {_part("true", "pb")}
SELECT node_key, change, CASE WHEN change IN ('added', 'edited') THEN n ELSE o END AS content_hash, CASE WHEN change IN ('added', 'edited') THEN nt WHEN b IS NOT NULL THEN b[2] ELSE ot END AS provenance FROM (
  SELECT *, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'decayed' WHEN b IS NOT NULL THEN 'superseded' ELSE 'edited' END AS change FROM (
    SELECT node_key, pah.content_hash AS o, pbh.content_hash AS n, pah.told AS ot, pbh.told AS nt, (SELECT max(row(id, told)) FROM pbs WHERE pbs.node_key = pah.node_key AND pbs.gone = pah.content_hash) AS b
    FROM pah FULL JOIN pbh USING (node_key) WHERE pah.content_hash IS DISTINCT FROM pbh.content_hash)) WHERE provenance IS NOT NULL""")
def diff_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh event has no provenance."""
    log = b.event_log(spark, sf_dir).withColumn("payload", F.when(F.col("seq") % 11 != 0, F.col("payload")))
    return events.diff(log.where("seq % 2 = 0"), log)


@query(f"WITH {b.LOG_SQL} SELECT node_key, content_hash, max(id) AS id FROM log WHERE seq % 5 <> 0 GROUP BY ALL")
def rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = b.event_log(spark, sf_dir)
    return events.rewind(log, log.where("seq % 5 = 0")).select("node_key", "content_hash", "id")


# --- trees


def _tree_hash(tree_name: str, out: str) -> str:
    level = lambda d, kids: f"""{out}{d} AS (SELECT path, parent_path, depth, sha256('{{"children":[' || {kids} || ']' || coalesce(',"content":"' || content || '"', '') || ',"v":"{tree.VERSION}"}}') AS h FROM {tree_name} WHERE depth = {d})"""
    made = [level(3, "''")]
    for d in (2, 1, 0):
        kids = f"""coalesce((SELECT string_agg('{{"hash":"' || k.h || '","name":"' || string_split(k.path, '/')[-1] || '"}}', ',' ORDER BY string_split(k.path, '/')[-1], k.h) FROM {out}{d + 1} k WHERE k.parent_path = {tree_name}.path), '')"""
        made.append(level(d, kids))
    return ",\n".join(made) + f",\n{out} AS (" + " UNION ALL ".join(f"SELECT * FROM {out}{d}" for d in range(4)) + ")"


_CHANGED = "CASE WHEN depth = 3 AND path LIKE '%7' THEN content || '!' ELSE content END"
TWO_TREES = f"""{b.TREE_SQL}, tree2 AS (SELECT path, parent_path, depth, {_CHANGED} AS content FROM tree WHERE NOT (depth = 3 AND path LIKE '%13')),
{_tree_hash("tree", "ha")}, {_tree_hash("tree2", "hb")}"""


def _edited(t: DataFrame) -> DataFrame:
    leaf = F.col("depth") == 3
    return t.where(~(leaf & F.col("path").endswith("13"))).withColumn("content", F.when(leaf & F.col("path").endswith("7"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))


@query(f"WITH {b.TREE_SQL}, {_tree_hash('tree', 'ha')} SELECT path, depth, h AS subtree_hash FROM ha")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.rollup(b.geo_tree(spark, sf_dir)).select("path", "depth", "subtree_hash")


@query(f"""WITH {TWO_TREES} SELECT path, CASE WHEN ha.h IS NULL THEN 'added' WHEN hb.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM ha FULL JOIN hb USING (path) WHERE ha.h IS DISTINCT FROM hb.h""")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark)
    t = s.table(b.geo_tree(spark, sf_dir))
    return tree.delta(tree.rollup(t, s), tree.rollup(_edited(t), s))


@query(f"""WITH {b.TREE_SQL}, tree3 AS (SELECT path, parent_path, depth, {_CHANGED} AS content FROM tree), {_tree_hash("tree3", "hc")}
SELECT path, h AS subtree_hash FROM hc WHERE EXISTS (SELECT 1 FROM tree c WHERE c.depth = 3 AND c.path LIKE '%7' AND (c.path = hc.path OR starts_with(c.path, hc.path || '/')))""")
def rehash_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.geo_tree(spark, sf_dir)
    changed = t.where((F.col("depth") == 3) & F.col("path").endswith("7")).select("path", F.concat("content", F.lit("!")).alias("content"))
    kept = Tables(spark)
    return tree.rehash_paths(kept.table(tree.rollup(t)), kept.table(changed))


_ASK = "SELECT path AS query FROM tree WHERE depth = 3 UNION ALL SELECT path || '/x' FROM tree WHERE depth = 2"


@query(f"""WITH {b.TREE_SQL}, q AS ({_ASK})
SELECT query, (len(string_split(t.path, '/')) - 1)::INT AS depth, t.path FROM q JOIN tree t ON t.path = query OR starts_with(query, t.path || '/')
WHERE EXISTS (SELECT 1 FROM tree u WHERE u.path = query)""")
def covering_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.geo_tree(spark, sf_dir)
    asked = t.where("depth = 3").select(F.col("path").alias("query")).unionByName(t.where("depth = 2").select(F.concat("path", F.lit("/x")).alias("query")))
    return tree.covering_chain(asked, t)


@query(f"WITH {b.TREE_SQL} SELECT path, content FROM tree WHERE path = 'repo/ASIA' OR path LIKE 'repo/ASIA/%'")
def by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.under(b.geo_tree(spark, sf_dir), "repo/ASIA").select("path", "content")


# --- dependencies

EDGES = f"""{b.OCC_SQL},
def AS (SELECT symbol, min(path) AS target FROM occ WHERE role = 'definition' GROUP BY symbol),
edge AS (SELECT DISTINCT path AS src, target AS dst, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS kind
  FROM (SELECT DISTINCT path, symbol FROM occ WHERE role = 'reference') LEFT JOIN def USING (symbol) WHERE target IS NULL OR target <> path)"""


@query(f"WITH {EDGES} SELECT * FROM edge")
def derive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.derive_edges(b.occurrences(spark, sf_dir))


@query(f"""WITH {b.OCC_SQL} SELECT d.symbol, count(DISTINCT CASE WHEN r.path <> d.path THEN r.path END) AS callers
FROM (SELECT DISTINCT symbol, path FROM occ WHERE role = 'definition') d LEFT JOIN occ r ON r.symbol = d.symbol AND r.role = 'reference' GROUP BY d.symbol""")
def symbol_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.callers(b.occurrences(spark, sf_dir))


@query(f"""WITH {b.OCC_SQL} SELECT path, count(DISTINCT symbol) AS unknown FROM occ
WHERE role = 'reference' AND symbol NOT IN (SELECT symbol FROM occ WHERE role = 'definition') GROUP BY path""")
def symbol_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.holes(b.occurrences(spark, sf_dir))


@query(f"""WITH {b.OCC_SQL}, t AS (SELECT path, max(regexp_extract(symbol, '([A-Za-z_$][A-Za-z0-9_$]*)[^A-Za-z0-9_$]*$', 1)) FROM occ GROUP BY path)
SELECT r.path, regexp_extract(r.symbol, '([A-Za-z_$][A-Za-z0-9_$]*)[^A-Za-z0-9_$]*$', 1) AS name, min(r.symbol) AS symbol
FROM occ r JOIN occ d ON d.symbol = r.symbol AND d.role = 'definition' AND d.path <> r.path WHERE r.role = 'reference' GROUP BY ALL""")
def unit_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.unit_deps(b.occurrences(spark, sf_dir))


ROOTS = "SELECT '1' AS node UNION SELECT '50' UNION SELECT '333'"


def _roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("1",), ("50",), ("333",)], "node string")


@query(f"""WITH RECURSIVE {EDGES}, roots AS ({ROOTS}),
reach(node) AS (SELECT node FROM roots UNION SELECT src FROM edge JOIN reach ON dst = node)
SELECT node FROM reach WHERE node NOT IN (SELECT node FROM roots)""")
def reverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark)
    return deps.dependents(t.table(deps.derive_edges(b.occurrences(spark, sf_dir))), _roots(spark), None, t).select("node")


@query(f"""WITH {EDGES}, roots AS ({ROOTS}),
one AS (SELECT DISTINCT src AS node FROM edge WHERE dst IN (SELECT node FROM roots) AND src NOT IN (SELECT node FROM roots)),
two AS (SELECT DISTINCT src AS node FROM edge WHERE dst IN (SELECT node FROM one) AND src NOT IN (SELECT node FROM roots) AND src NOT IN (SELECT node FROM one))
SELECT node, 1 AS distance FROM one UNION ALL SELECT node, 2 FROM two""")
def eager_rehash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark)
    return deps.dependents(t.table(deps.derive_edges(b.occurrences(spark, sf_dir))), _roots(spark), deps.HOPS, t)


@query(f"WITH {EDGES} SELECT count(*) > 0 AS under_approx FROM edge WHERE dst IS NULL AND src IN ({ROOTS.replace(' AS node', '')})")
def under_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.under_approximate(deps.derive_edges(b.occurrences(spark, sf_dir)), _roots(spark))


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge WHERE dst IS NOT NULL UNION ALL SELECT dst FROM edge WHERE dst IS NOT NULL) GROUP BY node")
def structural_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.degrees(deps.derive_edges(b.occurrences(spark, sf_dir)))


# --- territories

TERRITORIES = [
    (0, "asia", "ann", "T0", ["repo/ASIA/**"]),
    (1, "china", "", "T1", ["repo/ASIA/CHINA/**", "repo/ASIA/JAPAN/*"]),
    (2, "europe", "eve", "T2", ["repo/EUROPE/F*/**"]),
    (3, "sevens", "", "T2", ["repo/AMERICA/*/*7"]),
]
TERRITORY_SQL = """terr(decl, name, owner, tier, rx, lit) AS (VALUES
  (0, 'asia', 'ann', 'T0', '^repo/ASIA/.*$', 10), (1, 'china', '', 'T1', '^repo/ASIA/CHINA/.*$', 16), (1, 'china', '', 'T1', '^repo/ASIA/JAPAN/[^/]*$', 16),
  (2, 'europe', 'eve', 'T2', '^repo/EUROPE/F[^/]*/.*$', 13), (3, 'sevens', '', 'T2', '^repo/AMERICA/[^/]*/[^/]*7$', 13))"""
ASSIGN = f"""{b.TREE_SQL}, {TERRITORY_SQL},
asg AS (SELECT path, name AS territory, owner, tier FROM (SELECT tree.path, t.*, row_number() OVER (PARTITION BY tree.path ORDER BY lit DESC, decl) AS n
  FROM tree LEFT JOIN terr t ON regexp_matches(tree.path, t.rx)) WHERE n = 1)"""


def _territories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERRITORIES, "decl int, name string, owner string, tier string, globs array<string>")


@query(f"""WITH {ASSIGN} SELECT path, territory, tier, CASE WHEN territory IS NOT NULL THEN 'covered' WHEN path = 'repo/ASIA' OR path LIKE 'repo/ASIA/%' THEN 'deny' ELSE 'open' END AS verdict FROM asg""")
def assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return territory.assign(b.geo_tree(spark, sf_dir), _territories(spark)).select("path", "territory", "tier", "verdict")


@query(f"""WITH {ASSIGN}, au AS (SELECT path, string_split(content, '|')[2] AS author FROM tree WHERE content IS NOT NULL),
u AS (SELECT path, coalesce(territory, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END) AS unit, owner FROM asg),
dc AS (SELECT unit, max(CASE WHEN owner <> '' THEN owner END) AS declared FROM u GROUP BY unit),
mc AS (SELECT unit, author, count(*) AS c FROM u JOIN au USING (path) GROUP BY unit, author),
md AS (SELECT unit, author FROM (SELECT unit, author, row_number() OVER (PARTITION BY unit ORDER BY c DESC, author) AS n FROM mc) WHERE n = 1)
SELECT unit, coalesce(declared, author) AS owner, CASE WHEN declared IS NOT NULL THEN 'declared' WHEN author IS NOT NULL THEN 'authors' ELSE 'none' END AS source FROM dc LEFT JOIN md USING (unit)""")
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.geo_tree(spark, sf_dir)
    authors = t.where("content is not null").select("path", F.element_at(F.split("content", "\\|"), 2).alias("author"))
    return territory.ownership(territory.assign(t, _territories(spark)), authors)


@query(f"""WITH {EDGES}, r AS (SELECT 'z' || (src::BIGINT % 6) AS territory, 'T' || (src::BIGINT % 6 % 3) AS tier, dst IS NOT NULL AS ok FROM edge)
SELECT *, unresolved / total AS ratio, NOT (tier = 'T0' AND unresolved / total > {territory.GATE}) AS passes
FROM (SELECT territory, tier, count(*) FILTER (NOT ok) AS unresolved, count(*) AS total FROM r GROUP BY territory, tier)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.col("src").cast("long") % 6
    e = deps.derive_edges(b.occurrences(spark, sf_dir))
    return territory.coverage(e.select(F.concat(F.lit("z"), zone).alias("territory"), F.concat(F.lit("T"), zone % 3).alias("tier"), (F.col("kind") == "resolved").alias("resolved")))


@query(f"""WITH {b.TREE_SQL}, p(prefix, owner) AS (VALUES ('repo', 'root'), ('repo/ASIA', 'ann'), ('repo/ASIA/CHINA', 'chi'), ('repo/EUR', 'nobody'))
SELECT path, owner FROM (SELECT path, owner, row_number() OVER (PARTITION BY path ORDER BY len(prefix) DESC) AS n FROM tree JOIN p ON path = prefix OR starts_with(path, prefix || '/')) WHERE n = 1""")
def anchor_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("repo", "root"), ("repo/ASIA", "ann"), ("repo/ASIA/CHINA", "chi"), ("repo/EUR", "nobody")], "prefix string, owner string")
    return territory.longest_prefix(b.geo_tree(spark, sf_dir), p)
