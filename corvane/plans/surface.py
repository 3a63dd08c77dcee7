"""Queries over governed writes, retrieval, ranking, agents' memory, answers and portable stores, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as a
from ..functions import identity
from ..functions import text as t
from ..operators import admission, agents, deps, events, fresh, governed, lifecycle, memory, mining, packs, ranking, retrieval, territory, tree, verify
from ..sources import bridge as b
from ..sources import portable, repository, scip
from .knowledge import CLAIM_SQL, INJECT, LEAVES, _injections, _two, _view
from .knowledge import _entries as _cited
from .scratch import Tables
from .structure import EDGES, FOLD, TWO_TREES, _edited, _tree_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _mod(n: int, r: int = 0):  # noqa: ANN202
    return F.col("doc_id") % n == r


_RANK = "CASE {} WHEN 'T0' THEN 0 WHEN 'T1' THEN 1 WHEN 'T2' THEN 2 ELSE 3 END"
_STRICT = "'T' || least(" + ", ".join(f"CASE {{{i}}} WHEN 'T1' THEN 1 WHEN 'T2' THEN 2 ELSE 0 END" for i in range(2)) + ")"

# --- governed writes

SCOPES = [(f"src{i}", "ann") for i in range(12)] + [("src1", "bob"), ("", "ann")]
OWNERS = [("src2", "src3"), ("src4/en.txt", "src4"), ("src5", "src5"), ("src6", "src6"), ("src6/fr.txt", "src7")]
REQUESTED = f"""{b.FACT_SQL}, rq AS (SELECT doc_id, node_key, CASE WHEN doc_id % 7 = 0 THEN 'predicate' WHEN doc_id % 11 = 0 THEN 'relation' WHEN doc_id % 13 = 0 THEN 'rumour' ELSE 'advisory' END AS kind,
  (doc_id % 7 = 0) <> (doc_id % 17 = 0) AS has_check, CASE WHEN doc_id % 19 = 0 THEN 'T9' ELSE tier END AS tier, CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 5 = 0 THEN 'src1' ELSE scope END AS scope,
  CASE WHEN doc_id % 2 = 0 THEN 'calls' ELSE 'rhymes' END AS relation_kind, CASE WHEN doc_id % 22 = 0 THEN node_key ELSE 'x' END AS endpoint_b, split_part(primary_anchor, '::', 1) AS anchor, doc_id % 29 <> 0 AS addressable, doc_id % 4 <> 3 AS holds FROM fact),
cu AS (SELECT node_key, CASE WHEN doc_id % 8 <> 0 THEN scope END AS row_scope, CASE WHEN doc_id % 12 <> 0 THEN tier END AS row_tier,
  CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 14 = 0 THEN 'other' ELSE scope END AS st_scope, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN 'T1' ELSE tier END AS st_tier FROM fact WHERE doc_id % 2 = 0),
po(scope) AS (SELECT 'src' || i FROM range(12) r(i)), ow(prefix, owner) AS (VALUES {", ".join(map(str, OWNERS))})"""


@query(f"""WITH {REQUESTED}, x AS (SELECT rq.*, cu.node_key IS NULL AS fresh, row_scope, row_tier, st_scope, st_tier,
  (SELECT owner FROM ow WHERE anchor = prefix OR starts_with(anchor, prefix || '/') ORDER BY len(prefix) DESC LIMIT 1) AS owner,
  CASE WHEN row_tier IS NULL THEN st_tier ELSE {_STRICT.format("row_tier", "st_tier")} END AS held FROM rq LEFT JOIN cu USING (node_key))
SELECT node_key, CASE WHEN tier = 'T9' THEN 'malformed-tier' WHEN scope = '' THEN 'malformed-scope' WHEN kind = 'rumour' OR (kind = 'predicate') <> has_check THEN 'malformed-family'
  WHEN kind = 'relation' AND (relation_kind = 'rhymes' OR endpoint_b = node_key) THEN 'malformed-relation' WHEN NOT addressable THEN 'unaddressable' WHEN NOT holds THEN 'ungrounded'
  WHEN scope NOT IN (SELECT scope FROM po) THEN 'unauthorized' WHEN owner <> scope THEN 'unauthorized-anchor'
  WHEN NOT fresh AND coalesce(coalesce(row_scope, st_scope) NOT IN (SELECT scope FROM po), true) THEN 'unauthorized-target' WHEN NOT fresh AND (st_scope IS NULL OR coalesce(row_scope <> st_scope, false)) THEN 'unverifiable-target'
  WHEN NOT fresh AND scope <> st_scope THEN 'governance-relocation' WHEN NOT fresh AND {_RANK.format("tier")} > {_RANK.format("held")} THEN 'governance-downgrade'
  WHEN (has_check OR (CASE WHEN fresh THEN tier ELSE {_STRICT.format("held", "tier")} END) <> 'T2') AND tier = 'T0' THEN 'unratified' ELSE 'emitted' END AS outcome FROM x""")
def emit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every arm against half the facts as incumbents."""
    f = b.facts(spark, sf_dir)
    kind = F.when(_mod(7), "predicate").when(_mod(11), "relation").when(_mod(13), "rumour").otherwise("advisory")
    requests = f.select(
        "node_key", kind.alias("kind"), (_mod(7) != _mod(17)).alias("has_check"), F.when(_mod(19), "T9").otherwise(F.col("tier")).alias("tier"), F.when(_mod(23), "").when(_mod(5), "src1").otherwise(F.col("scope")).alias("scope"),
        F.col("node_key").alias("endpoint_a"), F.when(_mod(2), "calls").otherwise("rhymes").alias("relation_kind"), F.when(_mod(22), F.col("node_key")).otherwise("x").alias("endpoint_b"),
        F.col("file").alias("primary_anchor"), (~_mod(29)).alias("addressable"), (F.col("doc_id") % 4 != 3).alias("holds"),
    )
    current = f.where(_mod(2)).select(
        "node_key", F.when(~_mod(8), F.col("scope")).alias("scope"), F.when(~_mod(12), F.col("tier")).alias("tier"),
        F.when(_mod(10), F.lit(None)).when(_mod(14), "other").otherwise(F.col("scope")).alias("stored_scope"), F.when(_mod(10), F.lit(None)).when(_mod(6), "T1").otherwise(F.col("tier")).alias("stored_tier"),
    )
    return governed.emit(requests, current, spark.createDataFrame(SCOPES, "scope string, actor string"), spark.createDataFrame(OWNERS, "prefix string, owner string"), "ann", "carl")


@query(f"WITH {b.FACT_SQL} SELECT node_key, tier, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'strict' ELSE 'carl' END AS ratifier, CASE WHEN doc_id % 3 = 0 THEN false WHEN tier = 'T0' THEN doc_id % 3 = 1 ELSE true END AS ratified, scope = 'src0' AS t0_candidate, 'T2' AS view_tier FROM fact")
def ratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratifiers of all facts, and the territory view of their places: always T2, candidates named."""
    by = F.when(_mod(3), "").when(_mod(3, 1), "strict").otherwise("carl")
    place = F.when(F.col("scope") == "src0", "lib/Auth/x").otherwise(F.concat(F.lit("lib/"), "scope", F.lit("/authors")))
    return b.facts(spark, sf_dir).select("node_key", "tier", by.alias("ratifier"), governed.ratified(F.col("tier"), by).alias("ratified"), t.is_critical(place).alias("t0_candidate"), F.lit("T2").alias("view_tier"))


NEGATED = f"""{CLAIM_SQL} 'negation'"""
_NEG_TIER, _NEG_KIND = "CASE WHEN claim % 13 = 0 THEN 'T7' WHEN claim % 5 = 0 THEN 'T0' ELSE 'T2' END", "CASE WHEN claim % 11 = 0 THEN 'rhymes' ELSE 'calls' END"
NEGATION_SQL = CLAIM_SQL[: CLAIM_SQL.index("fd AS (")] + f"""
pr AS (SELECT claim, symbol AS target, scope, rtrim(scope, '/') AS top, {_NEG_TIER} AS tier, {_NEG_KIND} AS relation_kind FROM c WHERE kind = 'negation'),
ne AS (SELECT *, CASE WHEN tier = 'T7' OR scope = '' OR target = '' OR relation_kind = 'rhymes' THEN 'malformed-negation' WHEN starts_with(target, 'local ') THEN 'target-not-global'
  WHEN NOT EXISTS (SELECT 1 FROM oc WHERE path = top OR starts_with(path, top || '/')) THEN 'scope-empty' WHEN target NOT IN (SELECT symbol FROM df) THEN 'target-unresolvable'
  WHEN EXISTS (SELECT 1 FROM qu WHERE path = top OR starts_with(path, top || '/')) THEN 'scope-open' WHEN target = 'part/100' THEN 'escape-open'
  WHEN EXISTS (SELECT 1 FROM (VALUES ('d0/7'), ('d3/3')) x(path) WHERE path = top OR starts_with(path, top || '/')) THEN 'scope-dynamic'
  WHEN EXISTS (SELECT 1 FROM cl WHERE cl.symbol = target AND (path = top OR starts_with(path, top || '/'))) THEN 'negation-refuted'
  WHEN scope <> 'd1' THEN 'unauthorized' WHEN tier = 'T0' THEN 'unratified' ELSE 'emitted' END AS outcome FROM pr)"""


def _negations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    claims, view = _view(spark, sf_dir)
    n = F.col("claim")
    proposals = claims.where("kind = 'negation'").select("claim", F.when(n % 11 == 0, "rhymes").otherwise("calls").alias("relation_kind"), F.col("symbol").alias("target"), "scope", F.when(n % 13 == 0, "T7").when(n % 5 == 0, "T0").otherwise("T2").alias("tier"))
    files = b.occurrences(spark, sf_dir).select(F.concat(F.lit("d"), F.col("path").cast("long") % 7, F.lit("/"), "path").alias("path")).distinct()
    nodes = files.select(F.explode(t.folders(F.col("path"))).alias("path")).distinct()
    escapes, channels = spark.createDataFrame([("part/100", "d1/1:3")], "target string, site string"), spark.createDataFrame([("d0/7",), ("d3/3",)], "path string")
    policy = spark.createDataFrame([("d1", "ann"), ("d1", "bob")], "scope string, actor string"), spark.createDataFrame([("d2", "other")], "prefix string, owner string")
    return proposals, governed.emit_negations(proposals, view, nodes, escapes, channels, *policy, "ann", "carl")


@query(f"WITH {NEGATION_SQL} SELECT claim, outcome FROM ne")
def emit_negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negations(spark, sf_dir)[1]


@query(f"""WITH {NEGATION_SQL}, old(relation_kind, target, scope, reason) AS (VALUES ('calls', 'part/1', 'd1', 'scope-open'), ('calls', 'part/9', 'd9', 'scope-empty'), ('calls', 'part/29', 'd2/', 'scope-open')),
la AS (SELECT relation_kind, target, scope, max_by(outcome, claim) AS reason FROM ne WHERE outcome NOT IN ('malformed-negation', 'negation-refuted', 'unauthorized', 'unratified') GROUP BY ALL)
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.relation_kind = old.relation_kind AND la.target = old.target AND la.scope = old.scope) UNION ALL SELECT * FROM la WHERE reason <> 'emitted'""")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after a batch of negations, of an older one with three rows."""
    proposals, outcomes = _negations(spark, sf_dir)
    old = spark.createDataFrame([("calls", "part/1", "d1", "scope-open"), ("calls", "part/9", "d9", "scope-empty"), ("calls", "part/29", "d2/", "scope-open")], "relation_kind string, target string, scope string, reason string")
    return governed.abstentions(old, proposals, outcomes)


LINKS = f"""{b.FACT_SQL}, ed AS (SELECT f.node_key AS a, (f.doc_id + 10)::VARCHAR AS b, f.doc_id FROM fact f WHERE doc_id % 10 IN (1, 2)),
ret AS (SELECT a, b FROM ed WHERE doc_id % 70 = 1), rq AS (SELECT node_key AS a, (doc_id + CASE WHEN doc_id % 6 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 10 ELSE 7 END)::VARCHAR AS b, doc_id % 3 = 0 AS retract FROM fact
  UNION ALL SELECT a, b, doc_id % 20 = 1 FROM ed)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    f = b.facts(spark, sf_dir)
    edges = f.where(F.col("doc_id") % 10 < 3).where(~_mod(10)).select(F.col("node_key").alias("a"), (F.col("doc_id") + 10).cast("string").alias("b"), "doc_id")
    step = F.when(_mod(6), 0).when(_mod(4), 10).otherwise(7)
    asked = f.select(F.col("node_key").alias("a"), (F.col("doc_id") + step).cast("string").alias("b"), _mod(3).alias("retract"))
    return f, edges.select("a", "b"), edges.where(F.col("doc_id") % 70 == 1).select("a", "b"), asked.unionByName(edges.select("a", "b", (F.col("doc_id") % 20 == 1).alias("retract")))


@query(f"""WITH {LINKS}, un AS (SELECT least(a, b) AS x, greatest(a, b) AS y FROM ed), rt AS (SELECT least(a, b) AS x, greatest(a, b) AS y FROM ret)
SELECT a, b, retract, CASE WHEN a = b THEN 'absent' WHEN (least(a, b), greatest(a, b)) IN (SELECT (x, y) FROM rt) THEN 'retracted' WHEN (least(a, b), greatest(a, b)) IN (SELECT (x, y) FROM un) THEN 'asserted' ELSE 'absent' END AS state FROM rq""")
def same_as_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asserted, retracted, asked = _linked(spark, sf_dir)
    return governed.edge_state(asked, asserted, retracted)


@query(f"""WITH {LINKS}, known AS (SELECT node_key FROM fact) SELECT DISTINCT a, b FROM (SELECT a, b FROM ed UNION ALL
  SELECT a, b FROM rq WHERE a <> b AND a IN (SELECT node_key FROM known) AND b IN (SELECT node_key FROM known) UNION ALL SELECT b, a FROM rq WHERE a <> b AND a IN (SELECT node_key FROM known) AND b IN (SELECT node_key FROM known))""")
def same_as_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, asserted, _, asked = _linked(spark, sf_dir)
    return governed.link_same_as(asserted, asked, f)


@query(f"""WITH RECURSIVE {LINKS}, cu AS (SELECT node_key, CASE WHEN doc_id % 8 <> 0 THEN scope END AS s, CASE WHEN doc_id % 60 = 0 THEN NULL WHEN doc_id % 84 = 0 THEN 'other' ELSE scope END AS ss, tier FROM fact),
m AS (SELECT node_key, coalesce(coalesce(s, ss) IN (SELECT 'src' || i FROM range(18) r(i)), false) AS mine, ss IS NOT NULL AND coalesce(s = ss, true) AS sound, CASE tier WHEN 'T1' THEN 1 WHEN 'T2' THEN 2 ELSE 0 END AS rk FROM cu),
nb AS (SELECT a AS x, b AS y FROM ed WHERE b IN (SELECT node_key FROM fact) UNION SELECT b, a FROM ed WHERE b IN (SELECT node_key FROM fact)), rc(x, y) AS (SELECT node_key, node_key FROM fact UNION SELECT rc.x, nb.y FROM rc JOIN nb ON nb.x = rc.y),
cl AS (SELECT x AS node_key, bool_and(mine) AS am, bool_and(sound) AS asd, min(rk) AS st FROM rc JOIN m ON m.node_key = rc.y GROUP BY x),
un AS (SELECT least(a, b) AS x, greatest(a, b) AS y FROM ed), rt AS (SELECT least(a, b) AS x, greatest(a, b) AS y FROM ret),
q AS (SELECT rq.*, ma.mine AND mb.mine AS mine, ma.sound AND mb.sound AS sound, ca.am AND cb.am AS am, ca.asd AND cb.asd AS asd, least(ca.st, cb.st) AS st,
  CASE WHEN (least(a, b), greatest(a, b)) IN (SELECT (x, y) FROM rt) THEN 'retracted' WHEN (least(a, b), greatest(a, b)) IN (SELECT (x, y) FROM un) THEN 'asserted' ELSE 'absent' END AS state
  FROM rq LEFT JOIN m ma ON ma.node_key = a LEFT JOIN m mb ON mb.node_key = b LEFT JOIN cl ca ON ca.node_key = a LEFT JOIN cl cb ON cb.node_key = b)
SELECT a, b, retract, CASE WHEN a = b THEN 'same' WHEN NOT coalesce(mine, false) THEN 'unauthorized' WHEN NOT sound THEN 'unverifiable' WHEN NOT am THEN 'unauthorized' WHEN NOT asd THEN 'unverifiable' WHEN st = 0 THEN 'unratified'
  WHEN retract AND state = 'absent' THEN 'not-linked' WHEN retract AND state = 'retracted' THEN 'already-retracted' WHEN NOT retract AND state = 'retracted' THEN 'retracted-pair' ELSE 'linked' END AS outcome FROM q""")
def governed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, asserted, retracted, asked = _linked(spark, sf_dir)
    current = f.select("node_key", F.when(~_mod(8), F.col("scope")).alias("scope"), F.when(_mod(60), F.lit(None)).when(_mod(84), "other").otherwise(F.col("scope")).alias("stored_scope"), F.col("tier").alias("stored_tier"))
    scopes = spark.createDataFrame([(f"src{i}", "ann") for i in range(18)], "scope string, actor string")
    return governed.governed_link(asked, current, asserted, retracted, scopes, "ann", "carl", Tables(spark))


@query(f"""WITH {b.FACT_SQL} SELECT node_key, 'key [REDACTED] of ' || node_key AS claim, 'mined' AS scope, 'T2' AS tier FROM fact WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0)""")
def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined facts with a secret in their claim; a third is staged already, of which a fifth is grounded again."""
    f = b.facts(spark, sf_dir)
    mined = f.select("node_key", F.concat(F.lit("key ghp_A1b2C3d4 of "), "node_key").alias("claim"), "scope", "tier")
    return governed.stage(mined, f.where(_mod(3)), f.where(_mod(15)))


@query(f"""WITH {b.FACT_SQL} SELECT count(*) AS candidates, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 = 0) AS promoted, count(*) FILTER (NOT (doc_id % 7 <> 0 AND doc_id % 3 = 0)) AS refused FROM fact""")
def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.facts(spark, sf_dir)
    outcomes = f.select("node_key", F.when(_mod(3), "emitted").otherwise("ungrounded").alias("outcome"))
    return governed.promote_report(governed.promote(f, f.where(~_mod(7)), outcomes))


# --- retrieval

ANCHORED = f"{EDGES}, {b.FACT_SQL}, an AS (SELECT *, (doc_id + 1)::VARCHAR AS anchor FROM fact)"


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts anchored on orders: that of their number and one."""
    f = b.facts(spark, sf_dir).withColumn("claim", F.concat_ws("; ", "claims"))
    return f.withColumn("anchor", (F.col("doc_id") + 1).cast("string"))


TARGETS = ["1", "50", "333", "999999999"]
CLOSED = f"""{ANCHORED}, reach(target, node) AS (SELECT v, v FROM (VALUES {", ".join(f"('{x}')" for x in TARGETS)}) r(v) UNION SELECT target, src FROM edge JOIN reach ON dst = node)"""


@query(f"""WITH RECURSIVE {CLOSED}, p AS (SELECT target, node_key, tier, content_hash AS claim FROM reach JOIN an ON anchor = node WHERE target <> node),
bd AS (SELECT p.*, CASE WHEN tier IN ('T0', 'T1') THEN 'governing' ELSE 'advisory' END AS band FROM p)
SELECT target, node_key, band, band = 'governing' OR sum(64) OVER (PARTITION BY target, band ORDER BY node_key ROWS UNBOUNDED PRECEDING) <= 2000 AS served, claim, CASE WHEN node_key::BIGINT % 3 = 0 THEN 'FRESH' ELSE 'DRIFTED' END AS freshness FROM bd""")
def dependency_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of what depends on four orders, one of which nobody knows."""
    s = Tables(spark)
    f, edges = _anchored(spark, sf_dir), s.table(deps.derive_edges(b.occurrences(spark, sf_dir)))
    rows = retrieval.by_dependency(f.select("node_key", "tier", "claim", "anchor"), edges, spark.createDataFrame([(x,) for x in TARGETS], "target string"), s)
    return retrieval.mint_pack(rows, f.where(F.col("doc_id") % 3 < 2).select("node_key", F.when(_mod(3), "FRESH").otherwise("DRIFTED").alias("freshness")))


TRIGGERED = f"{b.FACT_SQL}, tg AS (SELECT DISTINCT 'lang:' || split_part(split_part(primary_anchor, '/', 2), '.', 1) AS tag, content_hash FROM fact WHERE doc_id % 5 = 0), pk AS (SELECT tag AS target, node_key, tier, content_hash AS claim FROM tg JOIN fact USING (content_hash) WHERE tag IN ('lang:en', 'lang:fr', 'lang:'))"


@query(f"""WITH {TRIGGERED}, x AS (SELECT *, CASE WHEN tier IN ('T0', 'T1') THEN 'governing' ELSE 'advisory' END AS band FROM pk),
y AS (SELECT *, band = 'governing' OR sum(64) OVER (PARTITION BY target, band ORDER BY node_key ROWS UNBOUNDED PRECEDING) <= 2000 AS served FROM x)
SELECT target, count(*) FILTER (band = 'governing') AS governing, count(*) FILTER (band = 'advisory' AND served) AS advisory, count(*) FILTER (band = 'advisory' AND NOT served) AS advisory_dropped, coalesce(64 * count(*) FILTER (served), 0)::BIGINT AS tokens FROM y GROUP BY target""")
def trigger_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of the facts that a tag names; a part of a tag names none."""
    f = b.facts(spark, sf_dir).withColumn("claim", F.concat_ws("; ", "claims"))
    tags = f.where(_mod(5)).select(F.concat(F.lit("lang:"), F.regexp_extract("file", r"/([^/.]*)\.", 1)).alias("tag"), "content_hash").distinct()
    asked = spark.createDataFrame([("lang:en",), ("lang:fr",), ("lang:",)], "target string")
    rows = retrieval.by_trigger(f.select("node_key", "tier", "claim", "content_hash"), tags, asked)
    return retrieval.pack_report(retrieval.mint_pack(rows, f.select("node_key", F.lit("FRESH").alias("freshness"))))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT 'g' || (doc_id % 3) AS grp, scope, node_key, tier, hits, ppr, cost FROM fact WHERE tier IN ('T0', 'T1')),
y AS (SELECT *, (row_number() OVER w)::INT AS rank, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) <= 2000 AS served FROM x WINDOW w AS (PARTITION BY grp ORDER BY {_RANK.format("tier")}, hits DESC, ppr DESC, node_key))
SELECT grp, scope, node_key, rank, served FROM y""")
def merged_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One budget for all territories of a group; a key that two of them have counts once."""
    f = b.facts(spark, sf_dir).withColumn("grp", F.concat(F.lit("g"), F.col("doc_id") % 3))
    twice = f.unionByName(f.where(_mod(4)).withColumn("scope", F.concat(F.lit("z"), "scope")))
    return retrieval.merged_pack(twice, "grp", "scope").select("grp", "scope", "node_key", "rank", "served")


@query(f"""WITH RECURSIVE {ANCHORED}, reach(target, node) AS (SELECT anchor, anchor FROM an WHERE scope = 'src3' UNION SELECT target, src FROM edge JOIN reach ON dst = node)
SELECT node_key, tier, content_hash AS claim FROM an WHERE scope <> 'src3' AND anchor IN (SELECT node FROM reach WHERE node <> target)""")
def relation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark)
    f = _anchored(spark, sf_dir).select("node_key", "tier", "claim", "anchor", F.col("primary_anchor").alias("path"))
    return retrieval.relation_set(f, s.table(deps.derive_edges(b.occurrences(spark, sf_dir))), "src3", s)


@query(f"""WITH {EDGES}, r AS (SELECT dst AS unit, 'dependents' AS relation, src AS node_key FROM edge WHERE dst IS NOT NULL UNION ALL SELECT src, 'dependencies', dst FROM edge WHERE dst IS NOT NULL)
SELECT unit, relation, node_key FROM r QUALIFY row_number() OVER (PARTITION BY unit, relation ORDER BY node_key) <= 8""")
def unit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark).table(deps.derive_edges(b.occurrences(spark, sf_dir)).where("dst is not null"))
    rows = e.select(F.col("dst").alias("unit"), F.lit("dependents").alias("relation"), F.col("src").alias("node_key")).unionByName(e.select(F.col("src").alias("unit"), F.lit("dependencies").alias("relation"), F.col("dst").alias("node_key")))
    return retrieval.edges_of(rows, "unit")


@query(f"""WITH {b.BASKET_SQL}, f AS (SELECT DISTINCT "commit", path FROM basket), co AS (SELECT x.path AS unit, y.path AS node_key FROM f x JOIN f y ON x."commit" = y."commit" AND x.path <> y.path GROUP BY ALL HAVING count(*) >= 2)
SELECT unit, node_key FROM co WHERE (unit + node_key) % 4 <> 0""")
def co_change_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that change together without a structural relation; a fourth of the pairs has one."""
    co = mining.co_changed(b.baskets(spark, sf_dir)).select(F.col("path").alias("unit"), F.col("other").alias("node_key"))
    co = Tables(spark).table(co)
    return retrieval.co_change_band(co, co.where((F.col("unit") + F.col("node_key")) % 4 == 0))


@query("""WITH RECURSIVE f AS (SELECT o_custkey AS epic, o_orderkey AS feature, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, (o_totalprice::BIGINT % 900) AS tokens FROM orders),
s AS (SELECT epic, 0::BIGINT AS pos, 0::BIGINT AS feature, 0::BIGINT AS used, false AS taken FROM (SELECT DISTINCT epic FROM f)
  UNION ALL SELECT f.epic, f.pos, f.feature, CASE WHEN used + tokens <= 1500 THEN used + tokens ELSE used END, used + tokens <= 1500 FROM s JOIN f ON f.epic = s.epic AND f.pos = s.pos + 1)
SELECT epic, feature, pos, taken FROM s WHERE pos > 0""")
def own_epic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as features of an epic; halves of a price go to the even number, as in SQL's cast."""
    from pyspark.sql import Window

    o = b.read(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return retrieval.epic(o.select(F.col("o_custkey").alias("epic"), F.col("o_orderkey").alias("feature"), pos.alias("pos"), (F.rint("o_totalprice").cast("long") % 900).alias("tokens")))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'FRESH' WHEN 1 THEN 'DRIFTED' WHEN 2 THEN 'STALE' END AS d FROM fact)
SELECT node_key, CASE WHEN d = 'FRESH' AND NOT (doc_id % 6 = 0 AND doc_id % 12 <> 0) THEN 'FRESH' ELSE 'DRIFTED' END AS freshness, CASE WHEN d = 'FRESH' THEN 'FRESH' ELSE 'DRIFTED' END AS bound,
  CASE d WHEN 'FRESH' THEN 'the cited unit and its dependencies'' interfaces are structurally unchanged' WHEN 'DRIFTED' THEN 'the cited unit or a dependency''s interface changed structurally'
    WHEN 'STALE' THEN 'an advisory fact’s grounding drifted structurally — served with flag, non-blocking' END AS told,
  CASE WHEN d = 'FRESH' THEN 'HOLDS' ELSE 'NA' END AS gate, CASE WHEN doc_id % 3 > 0 THEN 'served' WHEN doc_id % 2 > 0 THEN 'regrounded' ELSE 'refused' END AS pack FROM x""")
def freshness_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of facts, a sixth of which are negations, half of these under an older edge model."""
    f = b.facts(spark, sf_dir)
    d = F.when(_mod(4), "FRESH").when(_mod(4, 1), "DRIFTED").when(_mod(4, 2), "STALE")
    oracle = retrieval.freshness_oracle(d, F.when(_mod(6), "negation").otherwise("advisory"), F.when(_mod(12), "m2").otherwise("m1"), "m2")
    gate = fresh.gate(F.lit("HOLDS"), F.lit(True), retrieval.bind_freshness(d))
    return f.select("node_key", oracle.alias("freshness"), retrieval.bind_freshness(d).alias("bound"), retrieval.describe_freshness(d).alias("told"), gate.alias("gate"), retrieval.serve_pack(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("pack"))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT scope, bool_or(doc_id % 9 = 0) AS stale FROM fact GROUP BY scope) SELECT scope, stale, NOT stale AS trusted FROM x""")
def stale_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.facts(spark, sf_dir).select("scope", _mod(9).alias("drifted"))
    return retrieval.stale(f, "scope").withColumn("trusted", ~F.col("stale"))


@query(f"""WITH {TWO_TREES}, k AS (SELECT path AS key FROM tree WHERE depth >= 2 UNION ALL SELECT path || '/x' FROM tree WHERE depth = 2)
SELECT key, coalesce(ha.h, hb.h) AS current FROM k LEFT JOIN (SELECT * FROM ha WHERE depth < 3) ha ON ha.path = key LEFT JOIN hb ON hb.path = key""")
def resolve_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes by key: of the upper levels on one axis, of an edited tree on the other."""
    s = Tables(spark)
    geo = s.table(b.geo_tree(spark, sf_dir))
    keys = geo.where("depth >= 2").select(F.col("path").alias("key")).unionByName(geo.where("depth = 2").select(F.concat("path", F.lit("/x")).alias("key")))
    return retrieval.resolve_current(keys, tree.rollup(geo, s).where("depth < 3"), tree.rollup(_edited(geo), s))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT *, doc_id % 5 <> 0 AS had, doc_id % 3 = 0 AS moved FROM fact), y AS (SELECT node_key, CASE WHEN had AND NOT moved THEN CASE WHEN doc_id % 2 = 0 THEN 'own' WHEN doc_id % 7 <> 0 THEN 'c1' END ELSE 'c9' END AS derived_at FROM x)
SELECT node_key, derived_at, coalesce(derived_at, 'c1') <> 'c9' AS behind FROM y""")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of a new build (c9) over an older one, and which rows are behind its head."""
    f = b.facts(spark, sf_dir)
    new = f.select("node_key", "content_hash", F.when(_mod(2), "own").alias("derived_at"))
    old = f.where(~_mod(5)).select("node_key", F.when(_mod(3), "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(~_mod(7), "c1").alias("derived_at"))
    rows = retrieval.stamp(new, old, "c9")
    return rows.select("node_key", "derived_at", retrieval.behind_head(F.col("derived_at"), F.lit("c1"), F.lit("c9")).alias("behind"))


# --- verification


WITNESS = f"""{b.OCC_SQL}, oc AS (SELECT 'd' || path::BIGINT % 7 || '/' || path AS path, symbol, role FROM occ), df AS (SELECT DISTINCT symbol FROM oc WHERE role = 'definition'), dc AS (SELECT DISTINCT path FROM oc),
w AS (SELECT p_partkey AS p, 'part/' || (CASE WHEN p_partkey % 31 = 0 THEN 900000000 ELSE p_partkey END) AS target, 'd' || p_partkey % 7 AS scope, CASE WHEN p_partkey % 5 = 0 THEN 'dependency' WHEN p_partkey % 17 = 0 THEN 'invariant' WHEN p_partkey % 19 <> 0 THEN 'count' END AS slot, p_partkey % 4 AS n FROM part),
v AS (SELECT *, CASE WHEN p % 37 = 0 THEN 'T1' ELSE 'T2' END AS tier, 'd' || p % 7 || CASE WHEN p % 41 = 0 THEN '/x' ELSE '' END || '/' || (p % 7 + 7 * (p % 9)) || '::f' AS anchor, CASE WHEN p % 43 = 0 THEN '' ELSE target END AS tg,
  CASE WHEN slot = 'count' AND p % 11 <> 0 THEN n END AS al,
  (SELECT count(DISTINCT r.path) FROM oc r WHERE r.role = 'reference' AND r.symbol = target AND starts_with(r.path, scope || '/')) AS found FROM w WHERE p % 3 <> 0)"""


@query(f"""WITH {WITNESS}, o AS (SELECT *, CASE WHEN slot IS NULL THEN 'no-witness' WHEN tg = '' THEN 'incomplete-witness' WHEN slot = 'invariant' THEN 'unwitnessed-slot' WHEN slot = 'count' AND al IS NULL THEN 'no-bound' END AS u,
  CASE WHEN tier = 'T1' THEN 'tampered-tier' WHEN regexp_extract(split_part(anchor, '::', 1), '^(.*)/[^/]*$', 1) <> scope THEN 'tampered-anchor' WHEN split_part(anchor, '::', 1) NOT IN (SELECT path FROM dc) THEN 'tampered-document'
    WHEN p % 23 = 0 THEN 'tampered-claim' WHEN slot = 'count' AND coalesce(al, 0) < 1 THEN 'replay-malformed' WHEN target NOT IN (SELECT symbol FROM df) THEN 'replay-target-unresolvable'
    WHEN slot = 'count' AND found < al THEN 'replay-below-witnessed-bound' WHEN slot = 'dependency' AND found = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM oc WHERE role = 'reference' AND symbol NOT IN (SELECT symbol FROM df) AND starts_with(path, scope || '/')) THEN 'replay-scope-open' ELSE 'replay-no-caller-in-scope' END END AS k FROM v)
SELECT p::VARCHAR AS node_key, CASE WHEN u IS NOT NULL THEN 'unverifiable' WHEN k IS NOT NULL THEN 'broken' ELSE 're-proven' END AS outcome, coalesce(u, k) AS reason FROM o""")
def reverify_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses of parts replayed: some incomplete, some tampered with, some no longer true."""
    p = F.col("p_partkey")
    occ = Tables(spark).table(b.occurrences(spark, sf_dir).select(F.concat(F.lit("d"), F.col("path").cast("long") % 7, F.lit("/"), "path").alias("path"), "symbol", "role"))
    target, scope = F.concat(F.lit("part/"), F.when(p % 31 == 0, 900000000).otherwise(p)), F.concat(F.lit("d"), p % 7)
    slot = F.when(p % 5 == 0, "dependency").when(p % 17 == 0, "invariant").when(p % 19 != 0, "count")
    bound = F.when((slot == "count") & (p % 11 != 0), (p % 4).cast("int"))
    anchor = F.concat(scope, F.when(p % 41 == 0, "/x").otherwise(""), F.lit("/"), (p % 7 + 7 * (p % 9)).cast("string"), F.lit("::f"))
    rows = b.read(spark, sf_dir, "part").select(
        p.cast("string").alias("node_key"), F.when(p % 3 != 0, "proven").alias("seal"), F.when(p % 37 == 0, "T1").otherwise("T2").alias("tier"), F.when(p % 23 == 0, "other words").otherwise(verify.witness_claim(slot, target, scope, bound)).alias("claim"),
        anchor.alias("primary_anchor"), slot.alias("slot"), F.when(p % 43 == 0, "").otherwise(target).alias("target"), scope.alias("scope"), bound.alias("at_least"),
    )
    return verify.reverify(rows, verify.reverse(occ), occ.select("path"))


# --- ranking

UNITS = "u AS (SELECT l_orderkey || '::' || l_linenumber AS path, l_orderkey::VARCHAR AS file, md5(l_orderkey || '-' || l_linenumber) AS hash, l_returnflag = 'A' AS exported, l_quantity::BIGINT AS bytes FROM lineitem)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.read(spark, sf_dir, "lineitem")
    return x.select(F.concat("l_orderkey", F.lit("::"), "l_linenumber").alias("path"), F.md5(F.concat("l_orderkey", F.lit("-"), "l_linenumber")).alias("hash"), (F.col("l_returnflag") == "A").alias("exported"), F.col("l_quantity").cast("long").alias("bytes"))


@query(f"WITH {UNITS} SELECT path, file, (row_number() OVER (PARTITION BY file ORDER BY exported DESC, bytes DESC, path, hash))::INT AS place FROM u")
def unit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.unit_order(_units(spark, sf_dir)).select("path", "file", "place")


@query("""SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || event_id % 2 END ORDER BY event_id) - 1)::INT AS ordinal FROM events""")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.read(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("v"), F.col("event_id") % 2))
    return ranking.ordinals(e.select("event_id", F.col("user_id").alias("g"), F.col("event_type").alias("type"), name.alias("name"), F.col("event_id").alias("start")), "g").select("event_id", "ordinal")


RANKED = f"""{EDGES}, gr AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge WHERE dst IS NOT NULL), {UNITS},
si AS (SELECT path, file, hash, exported, bytes, hash AS h FROM u UNION ALL SELECT o_orderkey::VARCHAR, o_orderkey::VARCHAR, md5(o_orderkey::VARCHAR), false, 0, md5(o_orderkey::VARCHAR) FROM orders WHERE o_orderkey % 4 < 2),
ko AS (SELECT md5(o_orderkey::VARCHAR) AS hash, o_orderkey::VARCHAR AS key FROM orders),
ky AS (SELECT si.*, CASE WHEN ko.key IN (SELECT node FROM gr) THEN ko.key WHEN contains(path, '::') AND file IN (SELECT node FROM gr) THEN file ELSE coalesce(ko.key, 'unresolved:' || si.hash) END AS key FROM si LEFT JOIN ko USING (hash)),
sc AS (SELECT node, count(*) AS score FROM (SELECT src AS node FROM edge WHERE dst IS NOT NULL UNION ALL SELECT dst FROM edge WHERE dst IS NOT NULL) GROUP BY node)"""


@query(f"""WITH {RANKED} SELECT path, key, coalesce(score, 0) AS score, row_number() OVER (ORDER BY (bytes >= 40)::INT DESC, coalesce(score, 0) DESC, file COLLATE "binary", contains(path, '::'), exported DESC, bytes DESC, path COLLATE "binary", hash) AS rank FROM ky LEFT JOIN sc ON node = key""")
def ranked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and half the files by the degree of their node, large units first as a whole."""
    s = Tables(spark)
    edges = s.table(deps.derive_edges(b.occurrences(spark, sf_dir)))
    graph = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    o = b.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderkey")
    units = _units(spark, sf_dir).withColumn("sub", F.lit(True))
    files = o.where("o_orderkey % 4 < 2").select(F.col("k").alias("path"), F.md5("k").alias("hash"), F.lit(False).alias("exported"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("sub"))
    nodes = o.select(F.md5("k").alias("subtree_hash"), F.col("k").alias("key"))
    sites = units.unionByName(files).withColumn("group", t.file_part(F.col("path")))
    sites = ranking.site_keys(sites, ranking.correspondence(nodes)[0], graph)
    return ranking.rank_sites(sites, deps.degrees(edges).withColumnRenamed("degree", "score"), F.col("bytes") >= 40)


_SIG = "doc_id % 2 = 0 AS high, doc_id % 3 <> 0 AS unsure, doc_id % 5 < 3 AS checkable, CASE WHEN doc_id % 17 = 0 THEN 'T5' ELSE tier END AS tr"


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT *, {_SIG} FROM fact) SELECT node_key, CASE WHEN high AND unsure THEN 'self-consistency' || CASE WHEN checkable AND tr IN ('T0', 'T1') THEN ',check-synthesis' ELSE '' END || CASE WHEN tr = 'T0' THEN ',refuter' ELSE '' END ELSE '' END AS mechanisms,
  CASE WHEN checkable AND tr IN ('T0', 'T1') THEN 'predicate' ELSE 'advisory' END AS kind, CASE WHEN doc_id % 4 = 0 THEN 'semgrep' ELSE 'codeql' END AS analyzer, doc_id % 6 <> 0 AS seeded, CASE WHEN doc_id % 6 = 0 THEN 'ungrounded' ELSE 'loose-but-thin' END AS reason FROM x WHERE starts_with(primary_anchor, 'src1')""")
def cost_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalation, kind, analyzer and seeding of the facts whose path starts with a text: src1, and src10 to src19."""
    f = ranking.planned(b.facts(spark, sf_dir).withColumn("path", F.col("primary_anchor")), "src1")
    tier = F.when(_mod(17), "T5").otherwise(F.col("tier"))
    seeded, reason = ranking.seed_gate(~_mod(6), F.lit(0.5))
    return f.select("node_key", ranking.mechanisms(_mod(2), ~_mod(3), F.col("doc_id") % 5 < 3, tier).alias("mechanisms"), ranking.default_kind(F.col("doc_id") % 5 < 3, tier).alias("kind"), ranking.analyzer(_mod(4)).alias("analyzer"), seeded.alias("seeded"), reason.alias("reason"))


@query("SELECT event_type AS stage, sum(event_id % 4)::BIGINT AS llm_calls FROM events GROUP BY 1")
def stage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stage_costs(b.read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 4).alias("calls")))


@query("""WITH x AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 0 ELSE 0 END AS facts, o_orderkey % 3 = 1 AS told FROM orders)
SELECT run, rank, CASE WHEN facts > 0 THEN 'seeded' WHEN told THEN 'abstained' ELSE 'unrecorded' END AS visit FROM x WHERE rank > CASE WHEN run % 2 = 0 THEN 3 ELSE -1 END""")
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of runs, half of which are taken up again after their third site."""
    from pyspark.sql import Window

    o = b.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("run"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("rank"), F.when(k % 3 == 0, 2).otherwise(0).alias("facts"), F.when(k % 3 == 1, "silent").alias("why"))
    rows = ranking.resume(rows, "run", o.select(F.col("o_custkey").alias("run"), F.lit(3).alias("rank")).where("run % 2 = 0").distinct())
    return rows.select("run", "rank", ranking.classify_visit(F.col("facts"), F.col("why")).alias("visit"))


@query("SELECT count(DISTINCT l_returnflag) AS arms, count(DISTINCT (l_returnflag, l_partkey)) AS \"sum\", count(DISTINCT l_partkey) AS seeded FROM lineitem")
def seeded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.seeded_union(b.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_partkey").alias("fact")))


@query("SELECT o_custkey AS run, count(*) AS answers_stored, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS answers_digest FROM orders GROUP BY 1")
def answers_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.answers_witness(b.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").cast("string").alias("receipt")), "run")


@query(f"WITH {UNITS} SELECT path, file AS bucket FROM u WHERE file::BIGINT % 9 = 0")
def rerun_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = b.read(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").cast("string").alias("bucket"))
    return ranking.rerun(_units(spark, sf_dir), changed).select("path", "bucket")


@query("SELECT o_custkey AS who, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 20 AS asked FROM orders")
def interview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.interview(b.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("pos")), "who")


LOOPS = """cf AS (SELECT c_custkey AS loop, c_custkey % 5 <> 0 AS enabled, c_custkey % 7 AS max_depth, 1.5 AS epsilon, c_custkey % 11 * 2 AS ceiling FROM customer),
rd AS (SELECT o_custkey AS loop, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS depth, o_orderkey % 4 AS calls, o_orderkey % 6 AS revisions, (o_orderkey % 6)::DOUBLE AS value FROM orders)"""


@query(f"""WITH RECURSIVE {LOOPS}, st AS (SELECT loop, 0::BIGINT AS rounds, 0::BIGINT AS calls, 0::BIGINT AS revisions, CASE WHEN NOT enabled THEN 'off' WHEN ceiling <= 0 THEN 'budget' END AS stop FROM cf
  UNION ALL SELECT st.loop, rounds + 1, st.calls + least(rd.calls, ceiling - st.calls), st.revisions + rd.revisions, CASE WHEN rd.revisions = 0 THEN 'fixpoint' WHEN value < epsilon THEN 'marginal-value' WHEN st.calls + rd.calls >= ceiling THEN 'budget' END
  FROM st JOIN cf ON cf.loop = st.loop JOIN rd ON rd.loop = st.loop AND rd.depth = st.rounds WHERE stop IS NULL AND rounds < max_depth)
SELECT loop, rounds, calls, revisions, coalesce(stop, 'depth') AS stop FROM st QUALIFY row_number() OVER (PARTITION BY loop ORDER BY rounds DESC) = 1""")
def deepening_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c, o = b.read(spark, sf_dir, "customer"), b.read(spark, sf_dir, "orders")
    k, n = F.col("c_custkey"), F.col("o_orderkey")
    config = c.select(k.alias("loop"), (k % 5 != 0).alias("enabled"), (k % 7).alias("max_depth"), F.lit(1.5).alias("epsilon"), (k % 11 * 2).alias("ceiling"))
    depth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return ranking.loop(o.select(F.col("o_custkey").alias("loop"), depth.alias("depth"), (n % 4).alias("calls"), (n % 6).alias("revisions"), (n % 6).cast("double").alias("value")), config)


# --- answers, checks, spans, faults, places

ANSWERS = ["NO-FACT", " `no-fact`. ", "DEPENDS-ON: part/{}", "depends-on:  part/{}  ", "COUNT: part/{}", "COUNT: ", "it depends", "", "one\\x07two {}", "[No-Fact] indeed"]
_ANSWER_SQL = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN " + "||".join(f"'{p}'" if j % 2 == 0 else p for j, p in enumerate(x.replace("\\x07", "'||chr(7)||'").replace("{}", "§doc_id§").split("§"))) for i, x in enumerate(ANSWERS)) + " END"


@query(f"""WITH x AS (SELECT doc_id, {_ANSWER_SQL} AS an FROM documents), y AS (SELECT doc_id, trim(an) AS w, contains(an, chr(7)) AS spliced FROM x), z AS (SELECT *, upper(trim(w, ' `.')) = 'NO-FACT' AS ab FROM y)
SELECT doc_id, ab AS abstains, CASE WHEN w <> '' AND NOT ab AND NOT spliced THEN w END AS claim, CASE WHEN w <> '' AND NOT ab AND spliced THEN 'answer-malformed:multi-response' END AS reason,
  CASE WHEN doc_id % 10 IN (2, 3) THEN 'part/' || doc_id END AS dependency, CASE WHEN doc_id % 10 = 4 THEN 'part/' || doc_id END AS counted FROM z""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.read(spark, sf_dir, "documents").select("doc_id")
    text = None
    for i, x in enumerate(ANSWERS):
        value = F.format_string(x.replace("\\x07", "\x07").replace("{}", "%s"), F.col("doc_id").cast("string")) if "{}" in x else F.lit(x)
        text = F.when(F.col("doc_id") % 10 == i, value) if text is None else text.when(F.col("doc_id") % 10 == i, value)
    d = d.withColumn("an", text)
    claim, reason = a.admit_answer(F.col("an"))
    return d.select("doc_id", a.abstains(F.col("an")).alias("abstains"), claim.alias("claim"), reason.alias("reason"), a.claimed_name(F.col("an"), a.DEPENDS_ON).alias("dependency"), a.claimed_name(F.col("an"), a.COUNT).alias("counted"))


CHECKS = [
    ("index-query", "exists|a/b", "evaluable"), ("index-query", " absent | x|y ", "evaluable"), ("index-query", "has-object|", "malformed-check"), ("index-query", "count|a", "malformed-check"), ("index-query", "exists", "malformed-check"),
    ("assertion", "child-count|k| 12 ", "evaluable"), ("assertion", "child-count|k|-1", "malformed-check"), ("assertion", "child-count|k|1|2", "malformed-check"), ("assertion", "child-count||1", "malformed-check"), ("assertion", "subtree-hash|k|h", "evaluable"),
    ("assertion", "subtree-hash|k|", "malformed-check"), ("assertion", "exists|k", "malformed-check"), ("code-exec", "rm", "code-exec"), ("runtime", "is fast", "runtime"), ("wish", "exists|k", "malformed-check"),
]


@query(f"WITH k(i, verdict) AS (VALUES {', '.join(f'({i}, {v!r})' for i, (*_, v) in enumerate(CHECKS))}) SELECT doc_id, verdict FROM documents JOIN k ON i = doc_id % {len(CHECKS)}")
def admitted_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed checks of every form, with the verdicts that the grammar gives written out in the SQL."""
    k = spark.createDataFrame([(i, kind, text) for i, (kind, text, _) in enumerate(CHECKS)], "i int, kind string, text string")
    d = b.read(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(k), F.col("doc_id") % len(CHECKS) == F.col("i"))
    return d.select("doc_id", a.admit_check(F.col("kind"), F.col("text")).alias("verdict"))


@query("""WITH x AS (SELECT doc_id, text, encode(text) AS e, doc_id % 40 AS s, doc_id % 40 + 1 + doc_id % 7 AS n FROM documents),
y AS (SELECT *, s < n AND n <= octet_length(e) AS ok, hex(e) AS hx FROM x), z AS (SELECT *, ok AND NOT (hx[s * 2 + 1] IN ('8', '9', 'A', 'B')) AND NOT (n < octet_length(e) AND hx[n * 2 + 1] IN ('8', '9', 'A', 'B')) AS sound FROM y)
SELECT doc_id, CASE WHEN sound THEN sha256(text) END AS digest, CASE WHEN sound AND doc_id % 3 <> 0 THEN decode(unhex(hx[s * 2 + 1 : n * 2])) END AS span FROM z""")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte spans of texts: minted where they cut no character, read back where the text has kept its digest."""
    d = b.read(spark, sf_dir, "documents").select("doc_id", "text")
    start, end = (F.col("doc_id") % 40).cast("int"), (F.col("doc_id") % 40 + 1 + F.col("doc_id") % 7).cast("int")
    d = d.withColumn("digest", a.mint_span(F.col("text"), start, end))
    now = F.when(_mod(3), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select("doc_id", "digest", a.read_span(now, F.col("digest"), start, end).alias("span"))


@query("""WITH x AS (SELECT event_id, event_id % 5 = 0 AS ok, CASE event_id % 4 WHEN 0 THEN 'malformed-args: no x' WHEN 1 THEN 'internal-fault: y' WHEN 2 THEN 'unauthorized: z' ELSE 'plain' END AS rejected,
  CASE WHEN event_id % 9 = 0 THEN 'malformed-args' END AS tag, CASE event_id % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'Error' END AS name FROM events)
SELECT event_id, CASE WHEN NOT ok THEN CASE event_id % 4 WHEN 0 THEN 'malformed-args' WHEN 1 THEN 'internal-fault' ELSE 'refused' END END AS fault, coalesce(tag, CASE WHEN event_id % 3 = 1 THEN 'refused' ELSE 'internal-fault' END) AS thrown,
  CASE WHEN event_id % 4 = 0 THEN rejected ELSE 'malformed-args: ' || rejected END AS malformed, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'malformed-args: ''emit'' requires ''at''; not supplied' ELSE 'malformed-args: ''emit'' requires ''fact'', ''at''; not supplied' END AS missing FROM x""")
def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.read(spark, sf_dir, "events").select("event_id")
    n = F.col("event_id")
    rejected = F.when(n % 4 == 0, "malformed-args: no x").when(n % 4 == 1, "internal-fault: y").when(n % 4 == 2, "unauthorized: z").otherwise("plain")
    name = F.when(n % 3 == 0, "TypeError").when(n % 3 == 1, "Error")
    given = F.when(n % 3 == 0, F.array(F.lit("at"), F.lit("fact"))).when(n % 3 == 1, F.array(F.lit("fact"), F.lit("by"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", a.fault_of(n % 5 == 0, rejected).alias("fault"), a.thrown(F.when(n % 9 == 0, "malformed-args"), name).alias("thrown"), a.malformed_reason(rejected).alias("malformed"), a.missing_reason(F.lit("emit"), F.array(F.lit("fact"), F.lit("at")), given).alias("missing"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS req, CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_orderkey END AS tr, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey END AS no, o_orderkey % 5 = 0 AS rewritten, o_orderkey % 7 <> 0 AS fetched FROM orders)
SELECT o_orderkey, CASE WHEN req THEN 'trailer' ELSE 'note' END AS home, rewritten AS orphaned, CASE WHEN tr IS NOT NULL THEN 'trailer' WHEN no IS NOT NULL AND fetched AND NOT rewritten THEN 'note' END AS origin,
  CASE WHEN tr IS NOT NULL THEN tr WHEN no IS NOT NULL AND fetched AND NOT rewritten THEN no END AS value FROM x""")
def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where values of commits live, and what a bare clone still reads after a fifth of them was rewritten."""
    o = b.read(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    sha, key = F.concat(F.lit("s"), k, F.when(k % 5 == 0, "+").otherwise("")), F.concat(F.lit("s"), k)
    trailer, note = F.when(k % 3 == 0, F.concat(F.lit("t"), k)), F.when(k % 2 == 0, F.concat(F.lit("n"), k))
    origin, value = a.read_after_clone(trailer, note, sha, key, k % 7 != 0)
    return o.select("o_orderkey", a.place(k % 3 == 0).alias("home"), a.note_orphaned(sha, key).alias("orphaned"), origin.alias("origin"), value.alias("value"))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT *, 'lib/' || scope || '/' || slot || '.ts' AS file FROM fact)
SELECT node_key, 'lib/' || scope AS unit_scope, 'own_' || slot || '.ts' AS tool, CASE WHEN doc_id % 3 = 0 THEN file || '::A' WHEN doc_id % 3 = 1 THEN file ELSE NULL END AS anchor, 'index-query' || chr(31) || 'exists|é' || doc_id AS normal,
  doc_id % 4 <> 0 AS known_slot, doc_id % 2 = 0 AS known_relation, doc_id % 3 <> 2 AS axis, CASE WHEN doc_id % 4 = 0 THEN 'closed-slot: ''purpose'' is none of invariant, contract, precondition, postcondition, sideeffect, ownership, perf-bound, security-property, gotcha, rationale, dependency, count, definition' END AS refusal,
  CASE WHEN doc_id % 2 = 0 THEN 'tree' ELSE 'manifest' END AS source FROM x""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, tool names, vocabularies and normal checks of facts in a source tree."""
    f = b.facts(spark, sf_dir)
    file = F.concat(F.lit("lib/"), "scope", F.lit("/"), "slot", F.lit(".ts"))
    ends = F.when(_mod(3), F.array(F.concat(file, F.lit("::A::f")), F.concat(file, F.lit("::A::g::h")))).when(_mod(3, 1), F.array(F.concat(file, F.lit("::A")), F.concat(file, F.lit("::B")))).otherwise(F.array(file, F.lit("other.ts::B")))
    slot = F.when(_mod(4), "purpose").otherwise(F.col("slot"))
    check = F.concat(F.lit(" exists|é"), "node_key", F.lit("\n"))
    return f.select(
        "node_key", t.unit_scope(F.concat(file, F.lit("::A"))).alias("unit_scope"), t.tool_name(file).alias("tool"), t.primary_anchor(ends).alias("anchor"), t.normal_check(F.lit("index-query"), check).alias("normal"), t.known_slot(slot).alias("known_slot"),
        t.known_relation_kind(F.when(_mod(2), "calls").otherwise("relates-to")).alias("known_relation"), t.is_axis(F.when(_mod(3), "spatial").when(_mod(3, 1), "dependency").otherwise("time")).alias("axis"), t.closed_slot_refusal(slot).alias("refusal"),
        a.grounding_source(F.when(_mod(4), "crate").when(_mod(2), "module").otherwise("file")).alias("source"),
    )


# --- agents' memory

ENTRY_SQL = """en AS (SELECT conv_id AS pr_id, turn AS pos, CASE WHEN turn % 7 = 6 THEN 'ann' ELSE 'orch' END AS author, turn % 3 AS v, length(text) AS n FROM conversations)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.read(spark, sf_dir, "conversations")
    v = F.col("turn") % 3
    sections = {"shipped": F.substring("text", 1, 300), "decisions": F.when(v == 1, " ").otherwise("d"), "tradeoffs": F.lit("t"), "risks": F.lit("r"), "openThreads": F.lit("o")}
    fields = [F.lit("p").alias("prId"), F.lit("2026").alias("at"), F.lit("x").alias("territories"), *(x.alias(k) for k, x in sections.items()), F.when(v != 2, "l").alias("links"), F.when(F.col("turn") % 4 == 3, "chat").alias("note")]
    return c.select(F.col("conv_id").alias("pr_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 7 == 6, "ann").otherwise("orch").alias("author"), F.to_json(F.struct(*fields)).alias("entry"))


FAULTS_SQL = """ft AS (SELECT *, concat_ws('; ', CASE WHEN v = 2 THEN 'missing field: links' END, CASE WHEN pos % 4 = 3 THEN 'out-of-section prose: note' END, CASE WHEN n = 0 THEN 'unfilled section: shipped' WHEN n > 280 THEN 'section over cap: shipped' END, CASE WHEN v = 1 THEN 'unfilled section: decisions' END) AS faults FROM en)"""


@query(f"WITH {ENTRY_SQL}, {FAULTS_SQL} SELECT pr_id, pos, faults FROM ft")
def logbook_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logbook entries that lack links, have prose of their own, or a section that is blank or too long."""
    return _entries(spark, sf_dir).select("pr_id", "pos", F.array_join(agents.logbook_faults(F.col("entry")), "; ").alias("faults"))


@query(f"WITH {ENTRY_SQL}, {FAULTS_SQL} SELECT pr_id, min(pos) AS pos FROM ft WHERE author = 'orch' AND faults = '' AND pr_id % 5 <> 0 GROUP BY pr_id UNION ALL SELECT DISTINCT pr_id, -1 FROM en WHERE pr_id % 5 = 0")
def logbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which every fifth PR is told of, after all entries were offered to it."""
    e = _entries(spark, sf_dir)
    log = e.where("pr_id % 5 = 0").select("pr_id", F.lit(-1).cast("long").alias("pos"), F.lit("orch").alias("author"), F.lit("{}").alias("entry")).distinct()
    return agents.append_logbook(log, e).select("pr_id", "pos")


@query("SELECT conv_id, turn, 'taskId=\"' || conv_id || '\"' || chr(10) || 'attempted=\"a\\\"b\"' || chr(10) || 'lesson=\"l\"' || CASE WHEN turn % 2 = 0 THEN chr(10) || 'ref=\"r\"' ELSE '' END AS rendered, CASE WHEN turn % 3 = 0 THEN 'knowledge' ELSE 'memory' END AS partition, CASE WHEN role = 'user' THEN 500 ELSE 0 END AS budget FROM conversations")
def rendered_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.read(spark, sf_dir, "conversations")
    entry = F.to_json(F.struct(F.lit("l").alias("lesson"), F.when(F.col("turn") % 2 == 0, "r").alias("ref"), F.lit('a"b').alias("attempted"), F.col("conv_id").cast("string").alias("taskId")))
    kind = F.when(F.col("turn") % 3 == 0, "advisory").otherwise("task")
    return c.select("conv_id", "turn", agents.render("task", entry).alias("rendered"), agents.partition(kind).alias("partition"), agents.surface_budget(F.when(F.col("role") == "user", "projectMem").otherwise("pack")).alias("budget"))


_DAY = "date_diff('day', DATE '1970-01-01', ts::DATE)"


@query(f"""WITH w AS (SELECT user_id::VARCHAR AS rule_id, {_DAY} // 30 AS wave FROM events WHERE event_type = 'purchase'), z AS (SELECT max(wave) AS now FROM w), r AS (SELECT DISTINCT user_id::VARCHAR AS id, user_id % 5 AS slab, user_id % 4 = 0 AS old FROM events),
s AS (SELECT r.*, coalesce(sum(pow(0.5, now - wave)), 0) AS score FROM r LEFT JOIN w ON w.rule_id = r.id LEFT JOIN z ON true WHERE NOT old GROUP BY ALL),
k AS (SELECT id, slab, score >= 0.1 AND row_number() OVER (PARTITION BY slab ORDER BY score DESC, id) <= 12 AS keep FROM s)
SELECT r.id, r.slab, CASE WHEN keep OR r.id::BIGINT % 8 = 0 THEN 'active' ELSE 'archived' END AS state FROM r LEFT JOIN k USING (id)""")
def rule_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules after a ranking, a fourth being archived before, and half of these asked back."""
    e = b.read(spark, sf_dir, "events").withColumn("rule_id", F.col("user_id").cast("string"))
    rules = e.select(F.col("rule_id").alias("id"), (F.col("user_id") % 5).alias("slab"), F.when(F.col("user_id") % 4 == 0, "archived").otherwise("active").alias("state")).distinct()
    wave = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")) / 30)
    ranked = agents.apply_ranking(rules, e.select("rule_id", wave.alias("wave"), (F.col("event_type") == "purchase").alias("governing")), "slab")
    return agents.respawn_rules(ranked, rules.where("cast(id as long) % 8 = 0")).select("id", "slab", "state")


@query("""SELECT c_custkey AS owner, s.o AS task_id, c_custkey % 2 = 0 AND s.o = 1 AS found, CASE WHEN c_custkey % 2 = 0 AND s.o = 1 THEN c_name END AS attempted, CASE WHEN c_custkey % 2 = 0 AND s.o = 1 THEN c_mktsegment END AS lesson FROM customer, (VALUES (1), (2)) s(o)""")
def spawn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.read(spark, sf_dir, "customer")
    owner = F.col("c_custkey").alias("owner")
    records = c.select(owner, F.when(F.col("c_custkey") % 2 == 0, "task").otherwise("pr").alias("kind"), F.lit(1).alias("task_id"), F.col("c_name").alias("attempted"), F.lit("f").alias("failed_with"), F.lit("s").alias("stopped_at"), F.col("c_mktsegment").alias("lesson"))
    asked = c.select(owner, F.explode(F.array(F.lit(1), F.lit(2))).alias("task_id"))
    return agents.spawn_recall(agents.closing_folds(records), asked).select("owner", "task_id", "found", "attempted", "lesson")


@query("""WITH x AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations)
SELECT conv_id, turn, 1 + 2 * n AS tokens, 1 + 2 * n <= 250 AS fits, sha256('{"channel":"milestone","label":"' || conv_id || '/' || turn || '"}') AS event FROM x""")
def orientation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.read(spark, sf_dir, "conversations")
    tokens = agents.orientation_tokens(F.lit("goal"), F.col("text"), F.col("text"), F.lit(None).cast("string"))
    return c.select("conv_id", "turn", tokens.cast("long").alias("tokens"), agents.injected_orientation(tokens).alias("fits"), agents.orient_event(F.lit("milestone"), F.concat("conv_id", F.lit("/"), "turn")).alias("event"))


@query("""WITH p AS (SELECT p_partkey AS facet, p_partkey % 3 = 0 AS moved, p_partkey % 7 = 0 AS fresh FROM part) SELECT facet, moved OR fresh AS rerolled, moved AND NOT fresh AS moved FROM p""")
def facet_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of parts: a seventh was never seen, the source of a third has moved."""
    p = b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("facet"), F.col("p_name").alias("key"))
    before = p.where("facet % 7 <> 0").withColumn("key", F.when(F.col("facet") % 3 == 0, "old").otherwise(F.col("key")))
    return agents.facet_memo(before, p).select("facet", "rerolled", "moved")


@query("""WITH s AS (SELECT DISTINCT user_id AS owner FROM events) SELECT owner, count(*) FILTER (event_type = 'click') AS rules, CASE WHEN owner % 2 = 0 THEN 5 ELSE 0 END::BIGINT AS facets, owner % 3 = 0 AS oriented FROM s JOIN events ON user_id = owner GROUP BY owner""")
def turn_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.when(F.col("event_type") == "click", "project").otherwise("task").alias("kind"))
    seats = e.select("owner").distinct()
    return agents.turn_header(e, seats.where("owner % 2 = 0").select("owner", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("facet")), seats.where("owner % 3 = 0"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def seat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.read(spark, sf_dir, "conversations").withColumn("owner", F.col("role"))
    return agents.inject_for(c, "user").select("conv_id", "turn", "text")


# --- portable stores


@query("""WITH x AS (SELECT p_partkey, '{"a":' || p_size || ',"n":"' || p_brand || '"}' AS body FROM part) SELECT p_partkey, p_partkey % 4 <> 0 AS admitted FROM x""")
def store_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the digest of their canonical body, whatever the order of its keys; every fourth key is forged."""
    p = b.read(spark, sf_dir, "part")
    canonical = F.concat(F.lit('{"a":'), "p_size", F.lit(',"n":"'), "p_brand", F.lit('"}'))
    loose = F.concat(F.lit('{ "n": "'), "p_brand", F.lit('", "a": '), "p_size", F.lit("}"))
    key = F.sha2(F.when(F.col("p_partkey") % 4 == 0, F.concat(canonical, F.lit("!"))).otherwise(canonical), 256)
    return portable.guard(p.select("p_partkey", key.alias("key"), loose.alias("body"))).select("p_partkey", "admitted")


@query("""WITH x AS (SELECT DISTINCT '{"a":' || p_size || ',"n":"' || p_brand || '"}' AS body FROM part) SELECT sha256(body) AS key, body FROM x""")
def store_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies put twice into a store that has some of them, with one that has no canonical text."""
    p = b.read(spark, sf_dir, "part")
    loose = p.select(F.concat(F.lit('{ "n": "'), "p_brand", F.lit('", "a": '), "p_size", F.lit("}")).alias("body"))
    empty = spark.createDataFrame([], "key string, body string")
    some = portable.put(empty, loose.where("length(body) % 2 = 0"))
    return portable.put(some, loose.unionByName(spark.createDataFrame([('{"x":0.5}',), ("{",)], "body string")))


@query("""SELECT o_orderkey::VARCHAR AS id, '{"id":"' || o_orderkey || '","of":"' || CASE WHEN o_orderkey % 3 < 2 THEN 'ours' WHEN o_orderkey % 5 > 0 THEN 'theirs' ELSE 'base' END || '"}' AS line FROM orders""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three texts of JSON lines: two thirds are ours, four fifths theirs, all the base's."""
    o = b.read(spark, sf_dir, "orders").select("o_orderkey")
    line = lambda who: F.concat(F.lit('{"id":"'), "o_orderkey", F.lit(f'","of":"{who}"}}')).alias("line")
    blank = spark.createDataFrame([("",), ("{}",)], "line string")
    return portable.merge_lines(o.where("o_orderkey % 3 < 2").select(line("ours")).unionByName(blank), o.where("o_orderkey % 5 > 0").select(line("theirs")), o.select(line("base")))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'p' WHEN 2 THEN 'pp' ELSE 'sp' END AS h FROM fact)
SELECT node_key, h IN ('p', 'pp') AS violation, h IN ('s', 'sp') AS travels FROM x""")
def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by their homes: the store, an attachment, an attachment named twice, or both."""
    f = b.facts(spark, sf_dir)
    pr, store = F.lit("pr-attachment"), F.lit("store")
    f = f.select("node_key", F.concat(F.lit('{"k":"'), "node_key", F.lit('"}')).alias("body"), F.when(_mod(4), F.array(store)).when(_mod(4, 1), F.array(pr)).when(_mod(4, 2), F.array(pr, pr)).otherwise(F.array(store, pr)).alias("homes"))
    bad = portable.sole_home_violations(f).select("node_key", F.lit(True).alias("_v"))
    gone = portable.clone(f).select(F.get_json_object("body", "$.k").alias("node_key"), F.lit(True).alias("_t"))
    rows = f.select("node_key").join(bad, "node_key", "left").join(gone, "node_key", "left")
    return rows.select("node_key", F.coalesce("_v", F.lit(False)).alias("violation"), F.coalesce("_t", F.lit(False)).alias("travels"))


@query(f"""WITH {b.FACT_SQL} SELECT content_hash FROM fact WHERE scope = 'src3' UNION SELECT sha256('old' || node_key) FROM fact WHERE scope = 'src3' AND doc_id % 2 = 0""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.facts(spark, sf_dir).withColumn("superseded_by", F.when(_mod(2), F.sha2(F.concat(F.lit("old"), "node_key"), 256)))
    return portable.lineage(f, "src3")


@query("""WITH d AS (SELECT c_custkey FROM customer) SELECT c_custkey AS id, c_custkey % 3 <> 0 OR c_custkey % 2 = 0 AS found FROM d""")
def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of two thirds, to which the even ones are added; who can come back."""
    c = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    store = portable.archive(c.where("id % 3 <> 0"), c.where("id % 2 = 0"))
    return portable.respawn(store, c.select("id"))


@query("""SELECT (SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'view')) AS direct, true AS carries""")
def forge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that go past the adapter, and whether the push takes notes along."""
    e = b.read(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.when(F.col("event_type").isin("click", "view"), "host-adapter").when(F.col("event_type") == "error", F.lit(None)).otherwise("shell").alias("via"))
    specs = spark.createDataFrame([("refs/heads/main",), ("refs/notes/*:refs/notes/*",)], "refspec string")
    return portable.direct_calls(e).agg(F.count("*").alias("direct")).crossJoin(portable.carries_notes(specs))


# --- move-in and diagnosis


@query(f"""WITH {b.TREE_SQL} SELECT path AS name, 'T2' AS tier, path LIKE '%/CHINA' OR path LIKE '%/INDIA' AS t0_candidate FROM tree WHERE depth = 2""")
def move_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Territories of a new repository, always T2; two nations are spelled as folders that name candidates."""
    nations = b.geo_tree(spark, sf_dir).where("depth = 2").select(F.col("path").alias("name"))
    spelled = F.regexp_replace(F.regexp_replace("name", "/CHINA$", "/Billing"), "/INDIA$", "/crypto/india")
    return nations.select("name", F.lit("T2").alias("tier"), t.is_critical(spelled).alias("t0_candidate"))


@query(f"""WITH {TWO_TREES}, e AS (SELECT parent_path AS fact, path, h FROM ha WHERE depth = 3), d AS (SELECT e.fact, e.path, e.h FROM e LEFT JOIN hb USING (path) WHERE hb.h IS DISTINCT FROM e.h),
u AS (SELECT h, min(path) AS moved_to FROM hb GROUP BY h HAVING count(DISTINCT path) = 1)
SELECT fact, d.path, moved_to, bool_and(moved_to IS NOT NULL) OVER (PARTITION BY fact) AS mechanical FROM d LEFT JOIN u USING (h)""")
def why_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which anchors of a fact have drifted, and whether a move explains all of them."""
    from pyspark.sql import Window

    s = Tables(spark)
    geo = s.table(b.geo_tree(spark, sf_dir))
    entries = tree.rollup(geo, s, LEAVES).select(F.col("parent_path").alias("fact"), F.lit(1).alias("pos"), "path", "subtree_hash")
    moved = fresh.relocations(entries, tree.rollup(_edited(geo), s, LEAVES))
    return moved.select("fact", "path", "moved_to", F.bool_and(F.col("moved_to").isNotNull()).over(Window.partitionBy("fact")).alias("mechanical"))


@query(f"""WITH {b.TREE_SQL}, {_tree_hash("tree", "ha")}, p(prefix, owner) AS (VALUES ('repo/ASIA', 'ann'), ('repo/ASIA/CHINA', 'chi'))
SELECT ha.path, depth, h AS axis_hash, (SELECT owner FROM p WHERE ha.path = prefix OR starts_with(ha.path, prefix || '/') ORDER BY len(prefix) DESC LIMIT 1) AS owner, (SELECT count(*) FROM tree k WHERE k.parent_path = ha.path) AS children FROM ha WHERE depth < 3""")
def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covering territories with their hash, owner and children: what the index gives a pack to stand on."""
    s = Tables(spark)
    geo = s.table(b.geo_tree(spark, sf_dir))
    owners = territory.longest_prefix(geo, spark.createDataFrame([("repo/ASIA", "ann"), ("repo/ASIA/CHINA", "chi")], "prefix string, owner string"))
    kids = geo.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("children"))
    rows = tree.rollup(geo, s).where("depth < 3").join(owners, "path", "left").join(kids, "path", "left")
    return rows.select("path", "depth", F.col("subtree_hash").alias("axis_hash"), "owner", F.coalesce("children", F.lit(0)).alias("children"))


# --- proposals and what they build

PROPOSED = f"""{b.OCC_SQL}, oc AS (SELECT 'd' || path::BIGINT % 7 || '/' || path AS path, symbol, role FROM occ), df AS (SELECT DISTINCT symbol FROM oc WHERE role = 'definition'),
pp AS (SELECT p_partkey AS p, p_partkey::VARCHAR AS node_key, CASE p_partkey % 6 WHEN 0 THEN 'advisory' WHEN 1 THEN 'relation' WHEN 2 THEN 'negation' WHEN 5 THEN 'abstain' ELSE 'predicate' END AS kind,
  CASE WHEN p_partkey % 4 = 0 THEN 'dependency' WHEN p_partkey % 4 = 1 THEN 'count' ELSE 'contract' END AS slot, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'part/' || p_partkey END AS target, 'd' || p_partkey % 7 AS scope, p_partkey % 3 AS at_least,
  'x' AS ea, CASE WHEN p_partkey % 8 < 6 THEN 'calls' ELSE 'likes' END AS rk, CASE WHEN p_partkey % 10 = 1 THEN 'x' ELSE 'y' END AS eb, p_name AS claim, p_partkey % 5 > 0 AS grounded, CASE p_partkey % 7 WHEN 0 THEN 'HOLDS' WHEN 1 THEN 'BROKEN' WHEN 2 THEN 'toothless' WHEN 3 THEN 'HOLDS' END AS checked, p_partkey % 9 < 4 AS expressible FROM part),
ad0 AS (SELECT *, kind = 'predicate' AND slot <> 'contract' AS rp, kind = 'predicate' AND slot = 'contract' AND expressible AS ty, kind = 'predicate' AND slot = 'contract' AND NOT expressible AS ow,
  (SELECT count(DISTINCT path) FROM oc WHERE role = 'reference' AND oc.symbol = pp.target AND starts_with(path, pp.scope || '/')) AS found, target IN (SELECT symbol FROM df) AS known FROM pp),
ad1 AS (SELECT *, rp AND known AND found >= CASE WHEN slot = 'count' THEN greatest(at_least, 1) ELSE 1 END AS proven FROM ad0), ad2 AS (SELECT *, rp AND NOT proven OR ow AND checked IS NULL AS dm FROM ad1),
ad AS (SELECT *, CASE WHEN kind = 'relation' AND (rk <> 'calls' OR ea = eb) THEN 'relation-malformed' WHEN kind = 'negation' AND (target = '' OR rk <> 'calls') THEN 'negation-malformed' WHEN rp AND (target = '' OR slot = 'count' AND at_least < 1) THEN slot || '-malformed'
  WHEN ty AND checked IS DISTINCT FROM 'HOLDS' THEN 'type-broken' WHEN ow AND checked <> 'HOLDS' THEN 'check-' || lower(checked) WHEN (kind IN ('advisory', 'relation') OR rp OR dm) AND NOT grounded THEN 'ungrounded' END AS reason,
  CASE WHEN kind IN ('relation', 'negation', 'advisory') THEN kind WHEN dm THEN 'advisory' WHEN rp OR ty THEN 'sound' ELSE 'predicate' END AS fact FROM ad2)"""


def _proposals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("p_partkey")
    occ = Tables(spark).table(b.occurrences(spark, sf_dir).select(F.concat(F.lit("d"), F.col("path").cast("long") % 7, F.lit("/"), "path").alias("path"), "symbol", "role"))
    kind = F.when(p % 6 == 0, "advisory").when(p % 6 == 1, "relation").when(p % 6 == 2, "negation").when(p % 6 == 5, "abstain").otherwise("predicate")
    checked = F.when(p % 7 == 0, "HOLDS").when(p % 7 == 1, "BROKEN").when(p % 7 == 2, "toothless").when(p % 7 == 3, "HOLDS")
    rows = b.read(spark, sf_dir, "part").select(
        p.cast("string").alias("node_key"), kind.alias("kind"), F.when(p % 4 == 0, "dependency").when(p % 4 == 1, "count").otherwise("contract").alias("slot"), F.when(p % 13 == 0, "").otherwise(F.concat(F.lit("part/"), p)).alias("target"), F.concat(F.lit("d"), p % 7).alias("scope"),
        (p % 3).cast("int").alias("at_least"), F.lit("x").alias("endpoint_a"), F.when(p % 8 < 6, "calls").otherwise("likes").alias("relation_kind"), F.when(p % 10 == 1, "x").otherwise("y").alias("endpoint_b"), F.col("p_name").alias("claim"), F.lit("T2").alias("tier"),
        (p % 5 > 0).alias("grounded"), checked.alias("checked"), (p % 9 < 4).alias("expressible"),
    )
    return rows, admission.admit(rows, verify.reverse(occ))


@query(f"WITH {PROPOSED} SELECT node_key, CASE WHEN kind = 'abstain' THEN 'abstained' WHEN reason IS NOT NULL THEN 'dropped' ELSE 'admitted' END AS outcome, CASE WHEN kind <> 'abstain' AND reason IS NULL THEN fact END AS fact, reason FROM ad")
def admitted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposals(spark, sf_dir)[1]


@query(f"""WITH {PROPOSED} SELECT CASE fact WHEN 'relation' THEN sha256('{{"a":"' || ea || '","b":"' || eb || '","k":"' || rk || '"}}') WHEN 'negation' THEN sha256('{{"neg":"' || rk || '","s":"' || scope || '","t":"' || target || '"}}') ELSE node_key END AS id,
  CASE WHEN fact = 'sound' THEN 'advisory' ELSE fact END AS family, CASE WHEN fact = 'relation' THEN ea || ' ' || rk || ' ' || eb WHEN fact = 'negation' THEN 'NOT(' || target || ' ' || rk || ')@' || scope
    WHEN fact = 'sound' AND slot = 'count' THEN target || ' is referenced by at least ' || at_least || ' distinct unit(s) under ' || scope || ' (witnessed lower bound, sound oracle)' WHEN fact = 'sound' AND slot = 'dependency' THEN scope || ' references ' || target || ' (witnessed cross-unit reference, sound oracle)' ELSE claim END AS claim,
  CASE fact WHEN 'relation' THEN 'RELATED' WHEN 'negation' THEN 'NEGATED' WHEN 'predicate' THEN 'PREDICATE' ELSE 'ADVISORY' END AS authoring, CASE WHEN fact = 'sound' THEN 'proven' END AS seal, 'T2' AS tier FROM ad WHERE kind <> 'abstain' AND reason IS NULL""")
def built_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.build_facts(*_proposals(spark, sf_dir))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT *, ['init-skeleton', 'enrich-by-blast-radius', 'wave-close-write', 'sweep'][doc_id % 4 + 1] AS moment FROM fact)
SELECT node_key, moment, CASE WHEN doc_id % 5 = 0 THEN 'SUPERSEDED' ELSE 'ADVISORY' END AS authoring, doc_id % 6 IN (1, 5) AS violation FROM x WHERE moment <> 'sweep'""")
def produced_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the moments of production; a fifth is retired; seals that neither tell nor were absorbed."""
    f = b.facts(spark, sf_dir)
    moment = F.element_at(F.array(*map(F.lit, ("init-skeleton", "enrich-by-blast-radius", "wave-close-write", "sweep"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = admission.produced(f.withColumn("moment", moment)).withColumn("authoring", F.lit("ADVISORY"))
    return admission.retire(rows, f.where(_mod(5))).select("node_key", "moment", "authoring", admission.seal_violation(_mod(2), _mod(3)).alias("violation"))


@query(f"""WITH {EDGES}, h AS (SELECT DISTINCT sha256(src || chr(31) || coalesce(dst, '') || chr(31) || kind) AS h, 1 AS e FROM edge UNION ALL SELECT DISTINCT sha256(node), 0 FROM (SELECT src AS node FROM edge UNION SELECT dst FROM edge WHERE dst IS NOT NULL)),
p AS (SELECT e, h[1:2] AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY ALL)
SELECT sum(n) FILTER (e = 0)::BIGINT AS nodes, sum(n) FILTER (e = 1)::BIGINT AS edges, sha256(string_agg(d, '' ORDER BY e, p)) AS root FROM p""")
def dependency_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.dependency_root(deps.derive_edges(b.occurrences(spark, sf_dir)))


# --- repositories

_EXT = ["ts", "py", "rs", "tsx", "md", "go"]


@query(f"""WITH x AS (SELECT ({_EXT})[o_orderkey % 6 + 1] AS e FROM orders WHERE o_orderkey % 7 > 0), y AS (SELECT CASE e WHEN 'tsx' THEN 'ts' WHEN 'md' THEN NULL ELSE e END AS lang FROM x)
SELECT lang, count(*) AS files, CASE lang WHEN 'ts' THEN 'scip-typescript' WHEN 'py' THEN 'scip-python' ELSE 'honest-hole' END AS tool FROM y WHERE lang IS NOT NULL GROUP BY lang""")
def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (o % 6 + 1).cast("int"))
    return scip.index_plan(b.read(spark, sf_dir, "orders").select(F.concat(F.lit("a.b/f"), o, F.when(o % 7 > 0, F.concat(F.lit("."), ext)).otherwise("")).alias("path")))


@query("""SELECT c_custkey, 'WP: ' || c_name || chr(10) || 'Model: m' || chr(10) || 'Gates: ' || chr(10) || 'Verdict: ' || CASE WHEN c_custkey % 2 = 0 THEN 'ok' ELSE '' END || chr(10) || 'TranscriptSha: ' AS trailer, c_name AS wp, CASE WHEN c_custkey % 2 = 0 THEN 'ok' ELSE '' END AS verdict,
  CASE WHEN c_custkey % 4 = 0 THEN '{"WP":"' || c_custkey || '"}' END AS dossier FROM customer""")
def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailers written and read back, and dossiers of which one form in four can be read."""
    c = b.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = repository.trailer_text({"WP": F.col("c_name"), "Model": F.lit("m"), "Verdict": F.when(k % 2 == 0, "ok")})
    whole = F.when(k % 4 == 0, F.concat(F.lit('{"trailer":{"WP":"'), k, F.lit('"},"x":1}'))).when(k % 4 == 1, '{"trailer":"no"}').when(k % 4 == 2, " ").otherwise("{broken")
    return c.select("c_custkey", text.alias("trailer"), repository.trailer_field(text, "WP").alias("wp"), repository.trailer_field(text, "Verdict").alias("verdict"), repository.dossier(whole).alias("dossier"))


UNIT_TEXT = """ut AS (SELECT DISTINCT l_orderkey || '.ts::fn' || l_linenumber AS path, l_orderkey || '.ts' AS file, 'fn' || l_linenumber AS name, l_linenumber AS n FROM lineitem)"""


@query(f"""WITH RECURSIVE {UNIT_TEXT}, si AS (SELECT path, file, n FROM ut WHERE n = 1), st AS (SELECT path, file, 1 AS n, 0 AS depth FROM si UNION ALL SELECT st.path, st.file, u.n, depth + 1 FROM st JOIN ut u ON u.file = st.file AND u.n = st.n + 1)
SELECT path, file || '::fn' || n AS sibling, depth FROM st WHERE depth BETWEEN 1 AND 8""")
def unit_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that name the next one of their file: the first one's siblings, a step each."""
    x = b.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    u = x.select(F.concat("l_orderkey", F.lit(".ts::fn"), "l_linenumber").alias("path"), F.concat(F.lit("fn"), "l_linenumber").alias("name"), F.concat(F.lit("return fn"), F.col("l_linenumber") + 1, F.lit("(fn"), "l_linenumber", F.lit(")")).alias("content"), "l_linenumber")
    u = Tables(spark).table(u)
    return repository.siblings(u.where("l_linenumber = 1"), u)


# --- calls, keys, states, claims


_TOOLS = ["Read", "Edit", "Write", "Grep", "Bash"]


@query(f"""WITH x AS (SELECT event_id, ({_TOOLS})[event_id % 5 + 1] AS tool, event_id % 3 AS n, 'src/' || event_type || '/f' || event_id % 7 || '.ts' AS p FROM events)
SELECT event_id, CASE WHEN event_id % 5 < 3 AND n = 1 THEN p END AS scope, 'own_f' || event_id % 7 || '.ts' AS tool FROM x""")
def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with no, one or two paths: those that go to a scope, and the tool of a path's pack."""
    n = F.col("event_id")
    path = F.concat(F.lit("src/"), "event_type", F.lit("/f"), n % 7, F.lit(".ts"))
    paths = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(path)).otherwise(F.array(path, F.lit("x")))
    tool = F.element_at(F.array(*map(F.lit, _TOOLS)), (n % 5 + 1).cast("int"))
    return b.read(spark, sf_dir, "events").select("event_id", memory.navigates(tool, paths).alias("scope"), t.tool_name(path).alias("tool"))


@query(f"""WITH {INJECT} SELECT session, kind, (row_number() OVER (PARTITION BY session ORDER BY CASE WHEN hits > 0 THEN hit_rate ELSE 0 END, cold))::INT AS place,
  CASE kind WHEN 'poke' THEN 150 WHEN 'pack' THEN 2000 WHEN 'own' THEN 1500 WHEN 'orientation' THEN 250 ELSE 500 END AS cap FROM inj WHERE NOT pinned""")
def drop_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.drop_order(_injections(spark, sf_dir), "session").withColumn("cap", packs.cap_for(F.col("kind")))


@query(f"""WITH {b.FACT_SQL}, x AS (SELECT *, split_part(primary_anchor, '::', 1) AS f, CASE WHEN doc_id % 7 = 0 THEN '' ELSE primary_anchor END AS an, CASE WHEN doc_id % 5 = 0 THEN node_key ELSE 'y' END AS e FROM fact)
SELECT node_key, CASE WHEN an <> '' THEN sha256('{{"a":"' || an || '","s":"' || slot || '"}}') END AS advisory, CASE WHEN an <> '' THEN sha256('{{"a":"' || an || '","c":"assertion\\u001F' || 'k","s":"' || slot || '"}}') END AS predicate,
  CASE WHEN e <> node_key THEN sha256('{{"a":"' || node_key || '","b":"' || e || '","k":"calls"}}') END AS relation, CASE WHEN an <> '' THEN sha256('{{"neg":"calls","s":"' || scope || '","t":"' || an || '"}}') END AS negation,
  replace(f, ':', '%3A') || '::' || doc_id || '%25' AS minted, sha256('{{"brief":"' || node_key || '","kind":"Seat"}}') AS seat FROM x""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of facts, relations, negations, nodes and seats; parts that are empty, or ends that are one, have none."""
    f = b.facts(spark, sf_dir)
    anchor, end = F.when(_mod(7), "").otherwise(F.col("primary_anchor")), F.when(_mod(5), F.col("node_key")).otherwise("y")
    file_key = identity.minted_key(F.col("file"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return f.select(
        "node_key", identity.node_key(anchor, F.col("slot")).alias("advisory"), identity.node_key(anchor, F.col("slot"), t.normal_check(F.lit("assertion"), F.lit(" k "))).alias("predicate"),
        identity.relation_key(F.col("node_key"), F.lit("calls"), end).alias("relation"), identity.negation_key(F.lit("calls"), anchor, F.col("scope")).alias("negation"),
        identity.minted_key(F.concat("primary_anchor", F.lit("%")), file_key, F.col("file")).alias("minted"), identity.seat_id(F.col("node_key")).alias("seat"),
    )


@query(f"""WITH {FOLD}, s AS (SELECT log.* FROM log JOIN st USING (node_key, content_hash, id)),
x AS (SELECT node_key, '{{"entries":{{' || string_agg('"' || content_hash || '":{{"content_hash":"' || content_hash || '","fresh":' || fresh || ',"id":"' || id || '","payload":"' || payload || '","seq":0,"supersedes":[' || coalesce('"' || gone || '"', '') || ']}}', ',' ORDER BY content_hash) || '}},"nodeKey":"' || node_key || '"}}' AS text FROM s GROUP BY node_key)
SELECT node_key, length(text) AS size, sha256(text) AS digest FROM x""")
def state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of every node's state, by its length and digest."""
    return events.state_texts(events.fold(b.event_log(spark, sf_dir))).select("node_key", F.length("text").cast("long").alias("size"), "digest")


PARSED = f"""{b.OCC_SQL}, de AS (SELECT r.path, 'n' || split_part(r.symbol, '/', 2) AS name, min(r.symbol) AS symbol FROM occ r JOIN occ d ON d.symbol = r.symbol AND d.role = 'definition' AND d.path <> r.path WHERE r.role = 'reference' GROUP BY ALL),
ex AS (SELECT d.path, 'n' || split_part(d.symbol, '/', 2) AS name, d.symbol, count(DISTINCT r.path) AS callers FROM occ d JOIN occ r ON r.symbol = d.symbol AND r.role = 'reference' AND r.path <> d.path WHERE d.role = 'definition' GROUP BY ALL),
an AS (SELECT path, symbol, role, symbol[6:]::BIGINT % 6 AS k, 'n' || split_part(symbol, '/', 2) AS nm FROM (SELECT path, min(symbol) AS symbol, min_by(role, symbol) AS role FROM occ GROUP BY path)),
aw AS (SELECT path, nm, k, CASE k WHEN 0 THEN 'no-fact.' WHEN 1 THEN 'COUNT: ' || nm WHEN 2 THEN 'because' WHEN 3 THEN 'COUNT: nobody' ELSE 'depends-on: ' || nm END AS answer FROM an)"""


@query(f"""WITH {PARSED} SELECT 'lib/' || aw.path || '::u' AS path, CASE WHEN k > 3 AND de.symbol IS NOT NULL THEN 'dependency' WHEN k = 1 AND ex.symbol IS NOT NULL THEN 'count' END AS slot, CASE WHEN k > 3 THEN de.symbol WHEN k = 1 THEN ex.symbol END AS target,
  CASE WHEN k > 3 AND de.symbol IS NOT NULL THEN 'lib' WHEN k = 1 AND ex.symbol IS NOT NULL THEN 's' END AS scope, CASE WHEN k = 1 THEN ex.callers END::INT AS at_least,
  CASE WHEN k = 0 THEN 'abstained' WHEN k > 3 AND de.symbol IS NOT NULL OR k = 1 AND ex.symbol IS NOT NULL THEN NULL WHEN k IN (1, 3) THEN 'count-answer-unparseable' ELSE 'dependency-answer-unparseable' END AS abstain
FROM aw LEFT JOIN de ON de.path = aw.path AND de.name = nm LEFT JOIN ex ON ex.path = aw.path AND ex.name = nm""")
def parsed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every form about what a file uses and what it exports."""
    occ = Tables(spark).table(b.occurrences(spark, sf_dir).withColumn("path", F.concat(F.lit("lib/"), "path")).withColumn("name", F.concat(F.lit("n"), F.substring_index("symbol", "/", -1))))
    used = deps.unit_deps(occ).drop("name").withColumn("name", F.concat(F.lit("n"), F.substring_index("symbol", "/", -1)))
    own = occ.where("role = 'definition'").select("path", "name", "symbol")
    exports = own.join(deps.callers(occ), "symbol").where("callers > 0").withColumn("scope", F.lit("s"))
    first = occ.groupBy("path").agg(F.min_by("name", "symbol").alias("nm"), F.min("symbol").alias("symbol"))
    k = F.substring_index("symbol", "/", -1).cast("long") % 6
    answer = F.when(k == 0, "no-fact.").when(k == 1, F.concat(F.lit("COUNT: "), "nm")).when(k == 2, "because").when(k == 3, "COUNT: nobody").otherwise(F.concat(F.lit("depends-on: "), "nm"))
    return admission.parsed_claims(first.select(F.concat("path", F.lit("::u")).alias("path"), answer.alias("answer")), used, exports)


@query(f"""WITH {b.FACT_SQL} SELECT node_key, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'ratified' ELSE 'candidate' END AS status FROM fact""")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.facts(spark, sf_dir)
    return admission.aligned(f.select("node_key"), f.where(_mod(3)).select("node_key", _mod(2).alias("accepted")))


@query("SELECT o_custkey AS run, count(*) AS frontier, least(count(*), 200) AS ceiling, 'off' AS deepening, 0::BIGINT AS llm_calls FROM orders GROUP BY 1")
def run_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.run_budgets(b.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run")), "run")


@query("SELECT 'r' || c_nationkey || '/.store' AS store, bool_or(c_custkey % 9 = 0) AS untrusted FROM customer GROUP BY 1")
def untrusted_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of which some track files of their store, and all its policy."""
    c = b.read(spark, sf_dir, "customer")
    root = F.concat(F.lit("r"), "c_nationkey")
    tracked = c.select(F.concat(root, F.when(F.col("c_custkey") % 9 == 0, "/.store/gen/a").otherwise("/src/.store")).alias("path")).unionByName(c.select(F.concat(root, F.lit("/.store/policy.json")).alias("path")))
    return repository.untrusted_stores(tracked, c.select(F.concat(root, F.lit("/.store")).alias("store")))


@query("""SELECT kind, count(*) AS records, count(DISTINCT id) AS ids FROM (SELECT DISTINCT sha256('{"entry":"' || l_linestatus || '","kind":"' || l_returnflag || '","owner":"' || l_suppkey || '"}') AS id, l_returnflag AS kind FROM lineitem) GROUP BY kind""")
def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("owner"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("entry"))
    log = agents.memory_log(x)
    return log.join(agents.kinds_in(log), "kind").groupBy("kind").agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))


# --- plans, status, own packs' sources

PLANNED = f"""{TWO_TREES}, e AS (SELECT parent_path AS fact, path, h FROM ha WHERE depth = 3), hm AS (SELECT CASE WHEN depth = 3 AND path LIKE '%1' THEN path || 'm' ELSE path END AS path, h FROM hb),
d AS (SELECT e.* FROM e LEFT JOIN hm USING (path) WHERE hm.h IS DISTINCT FROM e.h), uq AS (SELECT h, min(path) AS moved_to FROM hm GROUP BY h HAVING count(DISTINCT path) = 1),
k AS (SELECT fact, bool_and(moved_to IS NOT NULL) AS m, count(moved_to) AS n FROM d LEFT JOIN uq USING (h) GROUP BY fact)"""


@query(f"WITH {PLANNED} SELECT fact, CASE WHEN m THEN 'reground' ELSE 'retire' END AS action, (SELECT count(*) FROM e WHERE e.fact = k.fact) AS entries, CASE WHEN m THEN n ELSE 0 END AS moved FROM k")
def reground_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with the facts of nations after edits, removals and moves of their customers."""
    before, after = _two(spark, sf_dir)
    return fresh.plans(_cited(before), after)


@query(f"""WITH {b.TREE_SQL}, c AS (SELECT path AS fact, depth, row_number() OVER (ORDER BY path) % 5 AS k FROM tree WHERE depth BETWEEN 1 AND 2),
v AS (SELECT fact, CASE WHEN k = 0 THEN 'BROKEN' WHEN k = 1 THEN 'NA' ELSE 'HOLDS' END AS verdict, k <> 2 AS grounded, k <> 3 AS fresh FROM c),
s AS (SELECT fact, CASE WHEN verdict = 'HOLDS' AND NOT (grounded AND fresh) THEN 'NA' ELSE verdict END AS status FROM v) SELECT fact, status, status = 'HOLDS' AS emitted FROM s""")
def recomputed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks about regions and nations, some broken or unreadable, on facts some of which are ungrounded or have drifted."""
    from pyspark.sql import Window

    s = Tables(spark)
    geo = s.table(b.geo_tree(spark, sf_dir))
    rolled = s.table(tree.rollup(geo, s))
    c = geo.where("depth between 1 and 2").select(F.col("path").alias("fact"), F.row_number().over(Window.orderBy("path")).alias("check_id")).withColumn("k", F.col("check_id") % 5)
    text = F.when(F.col("k") == 0, F.concat(F.lit("absent|"), "fact")).when(F.col("k") == 1, "child-count|x").otherwise(F.concat(F.lit("exists|"), "fact"))
    c = s.table(c.withColumn("query", text))
    verdicts = lifecycle.evaluate(c.select("check_id", "query"), rolled, rolled.select(F.col("subtree_hash").alias("hash")))
    return fresh.status(c.select("fact", "check_id", (F.col("k") != 2).alias("grounded")), c.select("fact", F.when(F.col("k") != 3, "FRESH").otherwise("DRIFTED").alias("freshness")), verdicts)


@query(f"""WITH {b.TREE_SQL}, {_tree_hash("tree", "ha")} SELECT parent_path AS unit, 'own_' || string_split(path, '/')[-1] AS name, h AS digest, length('own_' || string_split(path, '/')[-1]) AS cost FROM ha WHERE depth > 0""")
def own_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer for each child of a unit: what its own pack refers to one step finer.  Names have no colon or slash but in paths."""
    s = Tables(spark)
    return packs.manifest(tree.rollup(s.table(b.geo_tree(spark, sf_dir)), s).withColumn("path", F.col("path")))


@query(f"WITH {b.FACT_SQL} SELECT node_key, 64 AS cost FROM fact WHERE slot = 'gotcha' AND tier IN ('T0', 'T1')")
def governing_gotchas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.governing_gotchas(b.facts(spark, sf_dir))


@query(f"WITH {b.FACT_SQL} SELECT scope, min_by(content_hash, node_key) AS role FROM fact WHERE slot = 'definition' GROUP BY scope")
def own_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.roles(b.facts(spark, sf_dir), "scope")


@query(f"""WITH {b.OCC_SQL}, oc AS (SELECT path, 'pkg#p' || symbol[6:] || '()' AS symbol, 'p' || symbol[6:] AS name, role FROM occ)
SELECT DISTINCT r.path, 'dependency' AS kind, r.name FROM oc r JOIN oc d ON d.symbol = r.symbol AND d.role = 'definition' AND d.path <> r.path WHERE r.role = 'reference'
UNION ALL SELECT DISTINCT d.path, 'count', d.name FROM oc d JOIN oc r ON d.symbol = r.symbol AND r.role = 'reference' AND d.path <> r.path WHERE d.role = 'definition'""")
def unit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = b.occurrences(spark, sf_dir).withColumn("symbol", F.concat(F.lit("pkg#p"), F.substring_index("symbol", "/", -1), F.lit("()")))
    return deps.candidates(Tables(spark).table(occ))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'unstamped' WHEN 1 THEN 'unstamped' WHEN 2 THEN 'current' ELSE 'foreign' END AS identity, contains(c_mktsegment, 'AUTO') OR contains(c_mktsegment, 'MACH') AS candidate FROM customer""")
def store_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by the identity schema that they are stamped with; names that hold a policy's keywords."""
    k = F.col("c_custkey")
    stamp = F.when(k % 4 == 1, "").when(k % 4 == 2, "v2").when(k % 4 == 3, "v1")
    return b.read(spark, sf_dir, "customer").select("c_custkey", a.identity_verdict(stamp, "v2").alias("identity"), a.names_candidate(F.col("c_mktsegment"), ("AUTO", "MACH")).alias("candidate"))
