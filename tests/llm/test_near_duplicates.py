from __future__ import annotations

import random
import re

import pytest

from corvane.llm.near_duplicates import near_duplicates

SCHEMA = "doc_id long, text string, n string, low string, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent):
    sets, parent = [], {r[0]: r[0] for r in rows}
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return {(r[0], len(s), root(r[0]), root(r[0]) == r[0]) for r, s in zip(rows, sets)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = [rng.choice(vocabulary) for _ in range(60)]  # a passage of many texts
    texts = []
    for k in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 120, 500]))] + (common if k % 2 else [])
        for _ in range(rng.choice([1, 3, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += ["", None, "One", "one ", "É a b", "é a b", " \n\t"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("percent", [85, 80])
def test_like_brute_force(spark, percent):
    rows = corpus(percent)
    frame = spark.createDataFrame([(i, t, "n", "l", "c") for i, t in rows], SCHEMA)
    assert {tuple(r) for r in near_duplicates(frame, percent).collect()} == brute(rows, percent)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", "", "", ""), (3, "a b c", "", "", ""), (3, "a b c", "", "", ""), (1, "A B  c", "", "", "")]
    got = sorted(map(str, (tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == ["(1, 1, 1, True)", "(3, 1, 1, False)", "(3, 1, 1, False)", "(None, 1, None, True)"]
