"""Queries that take the whole of their input, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import pandas as pd

from corvane import catalog
from corvane.operators import graph, lifecycle, mining
from corvane.plans.scratch import Tables

CHAIN = 12


def test_pagerank_follows_paths_of_any_length(spark, tmp_path):
    """Order k + 1 uses what order k defines: the seed's score has to pass more than four edges."""
    lines = [(k, 30 + k) for k in range(10, 10 + CHAIN)] + [(k + 1, 30 + k) for k in range(10, 10 + CHAIN)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey"]).to_parquet(tmp_path / "lineitem.parquet")
    got = {r.node: r.score for r in catalog.QUERIES["pagerank"](spark, str(tmp_path)).collect()}
    out = {str(k + 1): [str(k)] for k in range(10, 10 + CHAIN) if (30 + k) % 29}
    nodes = set(out) | {t for x in out.values() for t in x}
    seeds = {n for n in nodes if int(n) % 10 == 0}
    score = dict.fromkeys(nodes, mining.SCALE // len(nodes))
    for _ in range(64):
        inflow = dict.fromkeys(nodes, 0)
        for n, targets in out.items():
            for t in targets:
                inflow[t] += score[n] // len(targets)
        loose = sum(s for n, s in score.items() if n not in out) // len(seeds)
        score = {n: (15 * (mining.SCALE // len(seeds)) // 100 if n in seeds else 0) + 85 * (inflow[n] + (loose if n in seeds else 0)) // 100 for n in nodes}
    assert got == score


def test_pagerank_ends_when_no_score_moves(spark):
    """Random graphs with nodes that nothing leads to, or that lead nowhere, or neither; no seed is all seeds."""
    rng = random.Random(7)
    for acyclic, seeds in ((True, {"3", "7", "40"}), (False, {"1", "49"}), (True, set())):
        nodes = [str(k) for k in range(50)]
        edges = {(str(a), str(b)) for a, b in ((rng.randrange(12, 46), rng.randrange(30)) for _ in range(120)) if a > b or (not acyclic and a != b)}
        start, out = seeds or set(nodes), {n: [t for s, t in edges if s == n] for n in nodes}
        score, moves = dict.fromkeys(nodes, mining.SCALE // 50), []
        for _ in range(64):
            inflow = dict.fromkeys(nodes, 0)
            for n in nodes:
                for t in out[n]:
                    inflow[t] += score[n] // len(out[n])
            loose = sum(score[n] for n in nodes if not out[n]) // len(start)
            new = {n: (15 * (mining.SCALE // len(start)) // 100 if n in start else 0) + 85 * (inflow[n] + (loose if n in start else 0)) // 100 for n in nodes}
            moves, score = [*moves, new != score], new
        t = Tables(spark)
        given = spark.createDataFrame([(n,) for n in start], "node string") if seeds else None
        got = mining.pagerank(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(sorted(edges), "src string, dst string"), given, scratch=t)
        assert {r.node: r.score for r in got.collect()} == score
        assert t.n == 3 + sum(moves) + (not all(moves))  # edges, nodes, first scores, and one table a round


def test_co_changed_has_every_pair_in_both_directions(spark, tmp_path):
    orders = {1: (1, 2, 10), 2: (1, 2, 10), 3: (1, 3), 4: (3, 1, 10)}
    pd.DataFrame([(o, 1, "1-URGENT") for o in orders], columns=["o_orderkey", "o_custkey", "o_orderpriority"]).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame([(o, p) for o, parts in orders.items() for p in parts], columns=["l_orderkey", "l_partkey"]).to_parquet(tmp_path / "lineitem.parquet")
    want = Counter(x for parts in orders.values() for x in itertools.permutations(parts, 2))
    got = [(r.path, r.other, r.support) for r in catalog.QUERIES["co_changed"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((*x, n) for x, n in want.items() if n >= 2)


def test_own_epic_rounds_halves_to_even(spark, tmp_path):
    """898.5 is 898 and 601.5 is 602: both fit the budget of 1,500 together, and nothing else does; 1.5 and 0.5 are 2 and 0."""
    orders = [(1, 1, 898.5), (2, 1, 601.5), (3, 1, 0.5), (4, 1, 1.5), (5, 2, 0.5), (6, 2, 899.4), (7, 2, 601.0), (8, 2, 600.5)]
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_totalprice"]).to_parquet(tmp_path / "orders.parquet")
    got = sorted((r.epic, r.pos, r.feature, r.taken) for r in catalog.QUERIES["own_epic"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 2, True), (1, 3, 3, True), (1, 4, 4, False), (2, 1, 5, True), (2, 2, 6, True), (2, 3, 7, True), (2, 4, 8, False)]


def test_components_of_a_long_chain_take_few_rounds(spark):
    """Keys along the chain are in no order; a cycle, a hub, loops and nulls stand beside it, in one task and by stars."""
    order = [hashlib.md5(str(k).encode()).hexdigest() for k in range(400)]
    chain = list(itertools.pairwise(order))
    hub = [("h", f"i{k}") for k in range(50)] + [(f"i{k}", "h") for k in range(5)]
    rows = chain + hub + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "w"), ("v", None)]
    want = dict.fromkeys(order, min(order)) | {"h": "h"} | {f"i{k}": "h" for k in range(50)} | dict.fromkeys("xyz", "x")
    frame = spark.createDataFrame(rows, "a string, b string")
    for task_edges in (graph.TASK_EDGES, 0):
        t = Tables(spark)
        got = graph.components(frame, t, task_edges).collect()
        assert len(got) == len(want) and {r.node_key: r.class_key for r in got} == want
        assert t.n <= 30  # tables that were written; one for each step
    assert graph.components(frame.limit(0), Tables(spark), 0).isEmpty()


def test_freshness_sees_every_leaf(spark, tmp_path):
    """Past its third leaf, nation 0 has an edit (ends in 7), nation 1 a move (ends in 1) and nation 2 nothing."""
    leaves = {0: "00 02 03 04 07 08".split(), 1: "10 12 14 15 21".split(), 2: "30 32 34 35 36".split()}
    pd.DataFrame([(0, "R")], columns=["r_regionkey", "r_name"]).to_parquet(tmp_path / "region.parquet")
    pd.DataFrame([(n, f"N{n}", 0) for n in leaves], columns=["n_nationkey", "n_name", "n_regionkey"]).to_parquet(tmp_path / "nation.parquet")
    pd.DataFrame([(x, n, "M", 1.0) for n, names in leaves.items() for x in names], columns=["c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]).to_parquet(tmp_path / "customer.parquet")
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    n0, n1, n2 = (f"repo/R/N{n}" for n in leaves)
    assert sorted(run("drift_detect")) == [(n0, "DRIFTED"), (n1, "FRESH"), (n2, "FRESH")]
    assert sorted(run("reconcile_drift")) == [(n0, "semantic"), (n1, "mechanical")]
    assert run("reconcile_exit") == [(1, 1, 2)]
    fact = {n0: "DRIFTED", n1: "FRESH", n2: "FRESH"}
    every = [(f"repo/R/N{n}", i, f"repo/R/N{n}/{x}") for n, names in leaves.items() for i, x in enumerate(names, 1)]
    assert sorted(run("reground")) == sorted((f, i, p + "m" * p.endswith("/21"), fact[f]) for f, i, p in every)
    assert sorted(r[:3] for r in run("ground")) == sorted(every)


def test_awareness_has_the_latest_turn_of_each_facet(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", f"said {t}") for t in range(7)] + [(2, 8, "user", "word " * 401)]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    got = {(r.conv_id, r.facet): (r.content[:7], r.state, r.within_cap) for r in catalog.QUERIES["awareness"](spark, str(tmp_path)).collect()}
    want = {(1, f): (f"said {t}", "drifted" if t % 2 else "seeded", True) for f, t in zip(lifecycle.FACETS, (5, 6, 2, 3, 4), strict=True)}
    want |= {(2, f): ("UN-SEED", "UN-SEEDED", False) for f in lifecycle.FACETS} | {(2, lifecycle.FACETS[3]): ("word wo", "drifted", False)}
    assert got == want
