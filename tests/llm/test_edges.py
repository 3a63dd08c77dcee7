"""All document operators on one table of odd rows: nulls in any column, empty and very long texts, repeated rows, clashing names."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

from corvane.llm import decontamination, languages, licenses, mixing, near_duplicates, quotations, sharding, tokens, toxicity
from corvane.llm.queries import TOKENIZER

LONG = "The quick brown fox jumps over the lazy dog, again. " * 20_000 + "mit license"  # 1 MB and more
ROWS = [
    (None, None, None, None, None), (None, None, None, None, None), (None, "mit license", "en", "s", 1), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, LONG, "en", "s", 9), (3, LONG, None, None, 9),
    (4, "cc by cc by", "en", "s", 1), (4, "cc by cc by", "en", "s", 1), (4, "another text of the same number", "xx", "s", 1), (5, "\n\t ", "xx", None, 2), (6, "½ ² !", "xx", "t", 2),
]
CLASH = ["score", "labels", "spans", "size", "shard", "run", "slot", "n", "id", "a", "b", "component_id", "kept", "taken", "row_key", "start", "lang_pred", "item_id", "part", "_tie", "_place", "_run"]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *(f"'x' as `{c}`" for c in CLASH))


OPERATORS = {
    "licenses": lambda d, s: licenses.scan_licenses(d).drop("spans"),
    "toxicity": lambda d, s: toxicity.toxicity(d, s.createDataFrame([(1, 1, 0), (2, 1, 1), (None, None, 1), (4, None, None)], "doc_id long, quality int, toxic int")),
    "sharding": lambda d, s: sharding.shard_documents(d),
    "mixing": lambda d, s: mixing.mix(d).drop("shard_words"),
    "languages": lambda d, s: languages.languages(d),
    "near_duplicates": lambda d, s: near_duplicates.near_duplicates(d),
    "tokens": lambda d, s: tokens.token_table(d, TOKENIZER),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    """A row for each row, equal rows alike but for what numbers them, the same again from other partitions; an empty table gives none."""
    run = OPERATORS[name]
    docs = frame(spark, ROWS)
    got = run(docs, spark)
    rows = [tuple(r) for r in got.collect()]
    assert Counter(r[got.columns.index("doc_id")] for r in rows) == Counter(r[0] for r in ROWS)
    plain = [i for i, c in enumerate(got.columns) if c not in ("slot", "start", "taken")]
    count = Counter(tuple(r[i] for i in plain) for r in rows)
    assert sum(n == 2 for n in count.values()) >= 2  # the repeated rows
    again = run(frame(spark, ROWS[::-1]).repartition(5), spark)
    assert Counter(tuple(r[i] for i in plain) for r in map(tuple, again.collect())) == count
    assert run(frame(spark, []), spark).count() == 0


def test_pairs_and_talks_of_odd_rows(spark):
    bench = spark.createDataFrame([(7, "The quick brown fox jumps over the lazy dog, again."), (None, "x"), (8, None), (9, ""), (7, "The quick brown fox jumps over the lazy dog, again.")], "item_id long, text string")
    got = decontamination.contaminated(frame(spark, ROWS), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 7), (3, 7)} and len(got) == 2
    talks = spark.createDataFrame([(None, None, None, None), (1, None, None, LONG), (1, 1, "u", "> " + LONG), (1, 1, "u", "> " + LONG), (2, 0, "u", "")], "conv_id long, turn long, role string, text string")
    rows = quotations.link_quotations(talks.selectExpr("*", "1 as m", "2 as hash", "3 as origin")).collect()
    assert Counter((r.conv_id, r.turn, r.n_linked) for r in rows) == Counter([(None, None, 0), (1, None, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0)])


def test_near_duplicates_of_a_table_like_brute_force(spark):
    """Every component of sf0.01's documents at 85 %, over all pairs that share a shingle."""
    where = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(where):
        pytest.skip("no tables")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, lists = {}, defaultdict(list)
    docs = spark.read.parquet(where)
    for r in docs.collect():
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r.doc_id]:
            lists[s].append(r.doc_id)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    both = Counter((x, y) for some in lists.values() for k, x in enumerate(some) for y in some[k + 1 :])
    for (x, y), n in both.items():
        if 100 * n >= 85 * (len(sets[x]) + len(sets[y]) - n):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()} and len({c for _, c in got.values()}) < len(got)
