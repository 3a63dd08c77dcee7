"""Sources, ports and the facade, on small literal inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane import engine
from corvane.functions import ports
from corvane.operators import verify
from corvane.sources import portable, repository, scip


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    return b"".join(varint(k << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for k, v in fields)


def test_scip(spark, tmp_path):
    occ = lambda s, r: message((2, s.encode()), (3, r)) if r else message((1, b"\x01\x02"), (2, s.encode()))
    data = message((1, message((2, message((1, b"scip-x"), (2, b"1"))))), (2, message((1, b"a/\xc3\xa9.ts"), (2, occ("f", 1)), (2, occ("g" * 200, 8)), (4, b"ts"))), (2, message((1, b"b.ts"), (2, occ("f", 0)))))
    (tmp_path / "one.scip").write_bytes(data)
    (tmp_path / "cut.scip").write_bytes(data[:-3])
    (tmp_path / "bad.scip").write_bytes(b"\xff" * 40)
    want = {("a/é.ts", 0, "f", "definition"), ("a/é.ts", 1, "g" * 200, "reference"), ("b.ts", 0, "f", "reference")}
    assert {tuple(r) for r in scip.read(spark, f"{tmp_path}/one.scip").collect()} == want
    assert scip.read(spark, f"{tmp_path}/cut.scip").count() == scip.read(spark, f"{tmp_path}/bad.scip").count() == scip.read(spark, f"{tmp_path}/none.scip").count() == 0
    assert scip.read(spark, f"{tmp_path}/*.scip").count() == 3
    assert scip.indexer(data) == "scip-x" and scip.indexer(b"") is None and scip.indexer(b"\xff") is None


def test_tracked_files_and_policy(spark, tmp_path):
    (tmp_path / "ls").write_text("100644 abc 0\ta b.ts\x00120000 def 0\tlink\x00broken\x00")
    assert {tuple(r) for r in repository.read_tracked(spark, f"{tmp_path}/ls").collect()} == {("100644", "abc", "a b.ts"), ("120000", "def", "link")}
    good = '{"t0Heuristic":{"keywords":["auth"]},"authz":{"scopes":{"s":["ann","bob"]},"anchors":{"src":"s"}}}'
    scopes, owners, words = repository.parse_policy(spark, good)
    assert {tuple(r) for r in scopes.collect()} == {("s", "ann"), ("s", "bob")} and [tuple(r) for r in owners.collect()] == [("src", "s")] and words == ["auth"]
    for bad in (None, "", "{", "[]", good.replace('"auth"', "1"), good.replace('["ann","bob"]', '"ann"'), good.replace('"src":"s"', '"src":""'), good.replace('"keywords"', '"k"')):
        assert [x.count() for x in repository.parse_policy(spark, bad)[:2]] == [0, 0]


def test_bundles(spark, tmp_path):
    store = portable.put(spark.createDataFrame([], "key string, body string"), spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":2,"b":1}',), ('{"x":0.5}',), ('["é"]',)], "body string"))
    assert store.count() == 2
    portable.export_objects(store, f"{tmp_path}/o")
    assert sorted(portable.import_objects(spark, f"{tmp_path}/o").collect()) == sorted(store.collect())
    (tmp_path / "forged").write_text('{"format":"corvane-objects","version":1,"key":"abc","body":"{}"}\n')
    with pytest.raises(Exception, match="malformed bundle"):
        portable.import_objects(spark, f"{tmp_path}/forged").collect()
    records = spark.createDataFrame([("ann", "task", 1)], "owner string, kind string, n int")
    portable.export_memory(records, f"{tmp_path}/m")
    assert portable.import_memory(spark, f"{tmp_path}/m", "owner string, kind string, n int").collect() == records.collect()
    with pytest.raises(Exception, match="malformed memory"):
        portable.import_memory(spark, f"{tmp_path}/o", "owner string").collect()


def test_ports(spark):
    sites = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    assert {r.answer for r in ports.propose(sites).collect()} == {"NO-FACT"}
    assert {(r.path, r.answer) for r in ports.propose(sites, lambda x: x["path"] + "!").collect()} == {("a", "a!"), ("b", "b!")}
    assert {r.answer for r in ports.propose(sites, lambda x: 1 / 0).collect()} == {None}
    texts = spark.createDataFrame([("fine",)], "t string")
    assert ports.write_with_scanner(texts, texts, "t").count() == 2
    with pytest.raises(Exception, match="blocked by credentials"):
        ports.write_with_scanner(texts, spark.createDataFrame([("ghp_A1b2C3d4",)], "t string"), "t").collect()
    with pytest.raises(ValueError):
        ports.write_with_scanner(texts, texts, "t", ports.Scanner(name=""))
    ports.register(spark)
    assert tuple(spark.sql("select corvane_digest('a'), corvane_calibrate(3), corvane_tier_rank('T9')").first())[1:] == (0.75, 3)
    feeds = ports.OwnFeeds(invariants=spark.createDataFrame([("u", "k", "T1", 1, 0.5, 10)], "unit string, node_key string, tier string, hits int, ppr double, cost int"))
    assert [r.feed for r in feeds.candidates().collect()] == ["invariant"] and ports.OwnFeeds().candidates() is None
    assert ports.injection("s", True, lambda s: "pulled", lambda s: "pushed") == "pulled" and ports.injection("s", True, None, lambda s: "pushed") == "pushed"
    near = ports.Neighbours(dependents=spark.createDataFrame([("u", "k", "T1", 0.5, 1)], "unit string, node_key string, tier string, ppr double, distance int"))
    assert [r.band for r in near.related().collect()] == ["dependents"]
    bar, check, types, cheap = ports.Doors(), ports.Predicate(), ports.Types(), ports.Signals()
    row = sites.select(bar.grounded(F.array()), bar.obviousness(F.col("path")), check.synthesize(F.col("path")), check.verify(F.col("path")), types.expressible(F.col("path")), cheap.tier(sites), ports.re_derives(F.lit(None))).first()
    assert tuple(row) == (False, 0.0, None, "NA", False, "T2", False)
    fact = ports.freshness(ports.mint(sites.withColumnRenamed("path", "node_key")).drop("freshness"), spark.createDataFrame([("a", "FRESH")], "node_key string, freshness string"))
    assert {(r.node_key, r.freshness) for r in fact.collect()} == {("a", "FRESH"), ("b", "DRIFTED")}


def test_engine(spark):
    current = [("k", "T1", ["c"], "src/a.ts::f", "z", "h", None, "1"), ("l", "T2", ["d"], "lib/b.ts", "z", "i", "old", "2")]
    tables = {
        "current": spark.createDataFrame(current, "node_key string, tier string, claims array<string>, primary_anchor string, scope string, content_hash string, superseded_by string, anchor string"),
        "freshness": spark.createDataFrame([("k", "FRESH")], "node_key string, freshness string"),
        "edges": spark.createDataFrame([("1", "2", "resolved"), ("3", "1", "resolved")], "src string, dst string, kind string"),
        "triggers": spark.createDataFrame([("t", "h")], "tag string, content_hash string"),
        "entries": spark.createDataFrame([("k", 1, "a", "x")], "fact string, pos int, path string, subtree_hash string"),
        "nodes": spark.createDataFrame([("b", "x")], "path string, subtree_hash string"),
        "occurrences": spark.createDataFrame([("a", "s", "definition"), ("b/c", "s", "reference")], "path string, symbol string, role string"),
        "scopes": spark.createDataFrame([("z", "ann")], "scope string, actor string"),
        "owners": spark.createDataFrame([], "prefix string, owner string"),
        "stored": spark.createDataFrame([("k", "z", "T1"), ("l", "z", "T2")], "node_key string, scope string, tier string"),
        "same_as": spark.createDataFrame([], "a string, b string"),
        "retracted": spark.createDataFrame([], "a string, b string"),
    }
    e = engine.Engine(spark, tables, "ann", "carl")
    got = {by: [r.node_key for r in e.call("query", scope=s, by=by).result.collect()] for by, s in (("scope", "src"), ("dependency", "2"), ("trigger", "t"))}
    assert got == {"scope": ["k"], "dependency": ["k"], "trigger": ["k"]}
    assert [tuple(r) for r in e.call("reconcile").result.collect()] == [(1, 0, 0)] and [r.moved_to for r in e.call("why", fact="k").result.collect()] == ["b"]
    assert tuple(e.call("hotset", budget=0).result.first()) == (1, 0, True) and {r[0] for r in e.call("archive").result.collect()} == {"h", "i", "old"}
    claims = spark.createDataFrame([(0, "negation", "s", "a", None, None, None)], verify.CLAIMS)
    assert e.call("verify-fact", claims=claims).result.first().verdict == "proven"
    assert e.call("link", pairs=spark.createDataFrame([("k", "l", False)], "a string, b string, retract boolean")).result.first().outcome == "linked"
    request = ("k", "advisory", False, "T2", "z", "", "", "", "src/a.ts", True, True)
    names = "node_key string, kind string, has_check boolean, tier string, scope string, endpoint_a string, relation_kind string, endpoint_b string, primary_anchor string, addressable boolean, holds boolean"
    assert e.call("emit", requests=spark.createDataFrame([request], names)).result.first().outcome == "governance-downgrade"
    assert {r.node for r in e.dependents("2").collect()} == {"1", "3"}
    assert e.call("verify", kind="count", target="s", scope="b", least=1, exact=True).result.first().verdict == "proven"
    assert [tuple(r) for r in e.call("plans").result.collect()] == [("k", "reground", 1, 1)]
    for verdict, code in ((e.call("query"), 1), (e.call("nothing"), 1), (e.call("query", scope="x", by="luck"), 2), (e.call("own", unit="u"), 2), (e.call("relations", key="k", direction="up"), 2), (e.call("verify", kind="luck", target="s", scope="b"), 2), (e.call("verify", kind="count", target="s", scope="b"), 2), (e.call("reconcile", odd=1), 1)):
        assert not verdict.ok and engine.exit_code(verdict) == code
    assert engine.exit_code(e.call("reconcile")) == 0 and engine.fault(engine.Verdict(False, rejected="internal-fault: x")) == "internal-fault"
    assert engine.parse(["query", "src", "--by", "scope", "--dry", "--at=x=y", "--min"]) == ("query", ["src"], {"by": "scope", "dry": True, "at": "x=y", "min": True})
    assert engine.parse([]) == (None, [], {})




def test_relation_set_is_the_union_of_single_closures(spark):
    """Random graphs with cycles; some anchors have facts inside and outside of the scope."""
    import random

    from corvane.operators import retrieval

    rng = random.Random(5)
    edges = {(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(22)}
    facts = [(f"k{i}", "T2", "c", str(rng.randrange(14)), rng.choice(["in/a", "out/b"])) for i in range(26)]
    want = set()
    for anchor in {f[3] for f in facts if f[4] == "in/a"}:
        seen, edge = {anchor}, {anchor}
        while edge:
            edge = {s for s, d in edges if d in edge} - seen
            seen |= edge
        want |= {f[0] for f in facts if f[4] == "out/b" and f[3] in seen - {anchor}}
    frame = spark.createDataFrame([(s, d, "resolved") for s, d in edges], "src string, dst string, kind string")
    got = retrieval.relation_set(spark.createDataFrame(facts, "node_key string, tier string, claim string, anchor string, path string"), frame, "in")
    assert {r.node_key for r in got.collect()} == want and want
