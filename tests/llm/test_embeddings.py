from __future__ import annotations

import numpy as np

from corvane.llm.embeddings import embedding_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, copies int"


def brute(rows, limit=0.93):
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def unit(e):
        if e is None or any(v is None or not np.isfinite(v) for v in e):
            return None
        e = np.array(e, dtype=np.float32).astype(float)
        return e / np.linalg.norm(e) if len(e) and np.linalg.norm(e) > 0 else None

    units = [unit(r[1]) for r in rows]
    for i in range(n):
        for j in range(i):
            if rows[i][2] is None or rows[i][2] != rows[j][2] or units[i] is None or units[j] is None or len(units[i]) != len(units[j]):
                continue
            if units[i] @ units[j] >= limit:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {(r[0], links[i], rows[root(i)][0], rows[root(i)][0] == r[0]) for i, r in enumerate(rows)}


def test_like_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal((12, 16))
    for i in range(260):
        e = base[i % 12] + rng.standard_normal(16) * (0.06 if i % 3 else 0.9)
        rows.append((i, [float(v) for v in e.astype(np.float32)], i % 2, 0))
    rows += [(1000 + i, rows[4][1], rows[4][2], 1) for i in range(30)]  # copies
    rows += [(2000, None, 0, 0), (2001, [0.0] * 16, 0, 0), (2002, [1.0, None] * 8, 0, 0), (2003, [float("nan")] * 16, 0, 0), (2004, rows[4][1], None, 0), (2005, [float("inf")] * 16, 0, 0), (2006, [], 0, 0), (2007, [1.0, 2.0], 0, 0), (2008, [0.0, 1.0], 1, 0), (2009, [-0.0, 1.0], 1, 0)]
    got = {tuple(r) for r in embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    # the tables may miss a pair just over the limit; the chance is under 0.5 %
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert len(got ^ want) <= 0.04 * len(rows)


def test_recall_on_a_table(spark):
    """Recall of links against brute force on the smallest tables that have vectors."""
    import os

    import pytest

    where = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(where):
        pytest.skip("no tables")
    rows = [(r.vec_id, r.embedding, r.label, 0) for r in spark.read.parquet(where).collect()]
    got = {r.vec_id: r.n_links for r in embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())


def run(spark, rows):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_empty_and_null_ids(spark):
    assert run(spark, []) == []
    one = [1.0, 0.0]
    got = run(spark, [(None, one, 1, 0), (4, one, 1, 0), (4, one, 1, 0), (None, [1.0, 0.01], 1, 0), (None, [0.0, 1.0], 1, 0), (None, [0.0, 1.0], 1, 0), (None, None, 1, 0)])
    assert got == sorted([(None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (None, 3, 4, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_huge_and_tiny_vectors(spark):
    big, small = 3e38, 1e-44  # near the ends of a float; doubles below
    rows = [(1, [big, big], 0, 0), (2, [big, big * 0.9], 0, 0), (3, [1.0, 1.0], 0, 0), (4, [small, small], 0, 0), (5, [small, 0.0], 0, 0)]
    assert run(spark, rows) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True)]
    frame = spark.createDataFrame([(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1.01e-200], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_duplicates(frame).collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1)]
