from __future__ import annotations

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import mixing
from corvane.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(tmp_path):
    """Clean documents with a toxic word, copies, edited copies and benchmark passages planted."""
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(3000)]
    item = " ".join(f"bench{i}" for i in range(30)) + "."
    rows, labels = [], []
    for i in range(240):
        w, y = [rng.choice(vocabulary) for _ in range(rng.choice([20, 80, 200]))], int(i % 6 == 0)
        if y:
            w.insert(rng.randrange(len(w)), "scumbag")
        rows.append([i, " ".join(w), "en", rng.choice(["a", "b", "c"]), 0])
        labels.append((i, 1, y))
    clean = [r for r in rows if r[0] % 6]
    copies = {1000 + k: clean[k][0] for k in range(10)}
    rows += [[k, clean[k - 1000][1], "en", "b", 0] for k in copies]
    edited = {1100 + k: clean[20 + k][0] for k in range(8) if len(clean[20 + k][1].split()) >= 80}
    for k in edited:
        w = clean[k - 1080][1].split()
        w[len(w) // 2] = "edited"
        rows.append([k, " ".join(w), "en", "c", 0])
    leaks = list(range(1200, 1206))
    rows += [[k, f"{clean[40 + k - 1200][1]} new{k} {item} {rng.choice(vocabulary)}", "en", None, 0] for k in leaks]
    rows += [[2000, None, None, None, None], [2001, "", "en", "a", 0], [None, "no id at all here", "en", "a", 0]]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    con.execute("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.execute("insert into benchmark values (7, ?)", [item])
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    return rows, {i for i, _, y in labels if y}, copies, edited, leaks


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows, toxic, copies, edited, leaks = tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append([tuple(r) for r in docs.collect()])
    ids = [{r[0] for r in s} for s in seen]
    assert ids[0] == {r[0] for r in rows} - toxic
    assert ids[1] == ids[0] - set(copies) - set(edited) and len(seen[1]) == len(ids[1])
    assert ids[2] == ids[1] - set(leaks)
    size = Counter()
    for r in seen[2]:
        size[r[3]] += len((r[1] or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[n] for n in names])))
    got = Counter()
    for r in seen[3]:
        got[r[3]] += len((r[1] or "").split())
    longest = max(len((r[1] or "").split()) for r in seen[2])
    assert all(abs(got[n] - want[n]) <= 2 * mixing.BLOCK + longest / 2 for n in names)
    assert max(Counter(r[:2] for r in seen[3]).values()) <= mixing.MOST

    whole, expected = Tokenizer.from_file(TOKENIZER), Counter()
    for r in seen[3]:
        t = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        expected[r[0], len(t), zlib.crc32(t.tobytes())] += 1
    made = sorted((tuple(r) for r in p.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert Counter((i, n, c) for i, _, n, c in made) == expected
    assert [r[1] for r in made] == [sum(r[2] for r in made[:k]) for k in range(len(made))]
    assert [r[0] for r in made] == sorted((r[0] for r in made), key=lambda i: (i is not None, i or 0))


def test_extra_and_clashing_columns_and_ties(spark, tmp_path):
    """Columns with the names that stages use inside, none of n_chars, rows that tie or repeat, nulls in every column."""
    import corpus_pipeline as p

    tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").drop("n_chars")
    odd = [(None, None, None, None), (None, None, None, None), (3000, "same words here", "x", "a"), (3000, "same words here", "x", "a"), (3000, "other words here", None, None), (3001, "same words here", "x", "a")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    for c, kind in (("score", "string"), ("predicted", "int"), ("_doc", "string"), ("_id", "long"), ("_kept", "string"), ("_n", "int"), ("row_key", "string"), ("taken", "long"), ("copies", "int"), ("size", "int"), ("target", "string"), ("item_id", "long"), ("component_id", "int"), ("times", "long"), ("_times", "int"), ("_copy", "int"), ("a b", "string")):
        docs = docs.withColumn(c, F.lit("7").cast(kind))
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[4:6] == ["score", "predicted"] and len(docs.columns) == 21
        assert docs.where("`a b` <> '7' or _n <> 7 or taken <> 7").count() == 0
        rows = Counter((r.doc_id, r.text) for r in docs.where("doc_id >= 3000 or doc_id is null").collect())
        if name == "near_duplicates":  # equal rows are one; a doc_id whose texts differ keeps them
            assert rows == Counter({(None, None): 1, (None, "no id at all here"): 1, (3000, "same words here"): 1, (3000, "other words here"): 1})
        assert docs.count() <= before or name == "mixing"
    assert p.token_ids(spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0
