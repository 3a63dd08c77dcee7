from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import _words, decontamination, languages, licenses, quotations, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return ALNUM.findall((text or "").translate(LOW))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\t.éß\x1cñ", max_size=40)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_hashed_words(texts):
    for mask, pattern in ((_words.ALNUM, ALNUM), (_words.SPACED, SPACED)):
        got = [h[at[i] : at[i + 1]] for lo, hi, at, h in _words.hashed_words(pa.array(texts, pa.string()), mask) for i in range(hi - lo)]
        want = [pattern.findall((t or "").translate(LOW)) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        table = {}
        for g, w in zip(got, want):
            for h, x in zip(g.tolist(), w):
                assert table.setdefault(x, h) == h
        assert len(set(table.values())) == len(table)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"Wört{i}" for i in range(3000)) + " " + "x" * 5000 + " end"
    whole = next(iter(_words.hashed_words(pa.array([text]), _words.SPACED)))
    monkeypatch.setattr(_words, "PIECE", 700)
    cut = next(iter(_words.hashed_words(pa.array([text]), _words.SPACED)))
    assert (whole[3] == cut[3]).all() and cut[2].tolist() == [0, 3002]


# --- licences


def phrase_places(text):
    w = words(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences(spark):
    rng = random.Random(2)
    bits = [*licenses.PHRASES, *(t for some in licenses.TEMPLATES.values() for t in some), "gnu general", "the", "license", "foo", "CC-BY", "MIT, License", "cc cc by by"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "word " * 40000 + "mit license", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, t, "c", 1.0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrase_places(t)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        for label, some in licenses.TEMPLATES.items():
            if any(f" {x} " in f" {' '.join(words(t))} " for x in some):
                assert label in r.labels.split(",")
    assert got[303].labels == "apache,apache-notice" and got[303].spans[0].first_word == 0 and got[303].score == 1.0
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matching_statistics_are_the_longest_substrings():
    auto = licenses.build({"a b a": "x", "b a c a b": "y"}, {"z": ["a b a c a", "c c a"]})
    templates = [t.split() for t in ("a b a", "b a c a b", "a b a c a", "c c a")]
    known = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    number = {w: int(np.searchsorted(auto.words, next(iter(_words.hashed_words(pa.array([w]), _words.ALNUM)))[3][0])) for w in "abc"}
    rng = random.Random(8)
    for _ in range(50):
        text = [rng.choice("abc") for _ in range(30)]
        for i, s, n in licenses.statistics(auto, [number[w] for w in text]):
            assert n == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in known), default=0)
            for k, end in auto.ends[s]:
                assert templates[k][end - n : end] == text[i + 1 - n : i + 1]


# --- decontamination


def parts(text):
    """Question and answer, by a scan from the end."""
    blank, t = " \t\n\v\f\r", text.rstrip(" \t\n\v\f\r")
    for e in range(len(t) - 2, -1, -1):
        if t[e] in ".!?" and t[e + 1] in blank:
            return text[: e + 1], text[e + 1 :]
    return text, ""


def runs(w, n):
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()


def leaks(rows, items):
    out = Counter()
    for k, x in items:
        length = decontamination.PASSAGE
        while length < 2 * len(words(x)):
            length *= 2
        sides = [words(t) for t in (x, *parts(x))]
        own = [(min(5, len(v)), runs(v, min(5, len(v)))) for v in sides]
        for i, t in rows if sides[0] else ():
            w, ok = words(t), []
            for lo in range(0, len(w), length // 2):
                got = tuple(len(o & runs(w[lo : lo + length], n)) for n, o in own)
                if all(g >= c * len(o) - 1e-9 for g, (_, o), c in zip(got, own, (0.8, 0.5, 0.5))):
                    ok.append(got)
            if ok:
                out[i, k, len(own[0][1]), *max(ok), len(ok)] += 1
    return out


NAMES = ["doc_id", "item_id", "n_item", "n_found", "n_question", "n_answer", "n_passages"]


def test_decontamination(spark):
    """Full rows against brute force, and the same rows however items are dealt and whatever other items there are."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 14, 50, 90]))) + rng.choice([". Yes it is.", "! A b c d e f g h i j k.", "?"])) for k in range(25)]
    items += [(90, "Two words"), (91, ""), (92, "!!"), (93, "Spread out. " + " ".join(f"s{i}" for i in range(12)))]
    rows = []
    for i in range(160):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 4, 90, 400]))]
        if i % 3 == 0:
            v = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if v:
                    v[rng.randrange(len(v))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = v[: rng.choice([len(v), len(v), max(1, len(v) * 9 // 10)])]
        rows.append((i, " ".join(w)))
    v = words(items[-1][1])
    rows.append((800, " ".join(" ".join(v[j : j + 5]) + " gap" * 150 for j in range(len(v) - 4))))  # every shingle, no passage
    rows += [(900, None), (901, ""), (902, "x, TWO-words y"), (None, "x, TWO-words y"), (903, "v1 " * 9000 + items[4][1])]
    rows += [rows[0]] * 2
    docs = spark.createDataFrame([(i, t, "a", 2) for i, t in rows], "doc_id long, text string, item_id string, score int")
    long = (99, " ".join(f"long{i}" for i in range(3000)))
    want = leaks(rows, items)
    assert len(want) > 10 and not any(k[0] == 800 for k in want)
    for some, shard_words in ((items, 1_000_000), (items, 60), ([*items, long], 1_000_000), ([*items, long], 300)):
        got = decontamination.contaminated(docs, spark.createDataFrame(some, "item_id long, text string"), shard_words=shard_words)
        assert got.columns == NAMES and Counter(tuple(r) for r in got.collect()) == want
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = Counter(r.doc_id for r in decontamination.clean(docs, bench).collect())
    assert kept == Counter(i for i, _ in rows if i not in {k[0] for k in want})
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == len(rows)


def test_question_and_answer_both_decide(spark):
    """An item whose question is there but not its answer, or the other way round, is not found."""
    question, answer = " ".join(f"q{i}" for i in range(40)) + ".", " the answer is blue"
    item = question + answer
    docs = [(1, item), (2, question), (3, answer), (4, f"{question} noise {answer}"), (5, f"{answer} {question}"), (6, question + " the answer is red")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r.doc_id: (r.n_item, r.n_found, r.n_question, r.n_answer) for r in got.collect()} == {1: (40, 40, 36, 1), 4: (40, 36, 36, 1), 5: (40, 36, 36, 1)}


def test_sql_of_decontamination(spark, tmp_path):
    import duckdb

    from corvane.llm import queries

    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.choice([2, 6, 30, 70]))) + ".\nThe end it is" + " so" * (k % 7)) for k in range(12)]
    docs = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(60)) + " " + (items[i % 12][1] if i % 2 else "")) for i in range(60)] + [(None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(NAMES)} from ({queries.OP4_SQL})").fetchall()
    got = [tuple(r) for r in queries.op4_decontamination(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) >= 30


def test_wand_gives_all_scores_at_the_limit():
    rng = random.Random(9)
    items = [(k, " ".join(f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(3, 40)))) for k in range(150)]
    [index] = decontamination.build(items)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), min(len(index.terms), rng.randint(1, 40))))
        score = Counter()
        for t in terms:
            for p in range(index.starts[t], index.starts[t + 1]):
                score[int(index.posted[p])] += index.impact[p]
        for limit in (0.2, 1.0):
            got = decontamination.wand(index, terms, limit)
            assert {k for k, _ in got} == {k for k, s in score.items() if s >= limit} and all(abs(s - score[k]) < 1e-9 for k, s in got)


# --- classifiers


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w, y = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([5, 60, 300]))], int(i % 8 == 0)
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(["idiota", "vilest", "scummy"]))
        rows.append((i, " ".join(w), "x", 0.5))
        labels.append((i, 1, y))
    rows += [(5000, None, "x", 0.1), (5001, "", "x", 0.1), (None, "w1 vilest", "x", 0.1)]
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted double")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in held) >= 0.97 * len(held)
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in none} == {0.5}


def test_language_on_held_out_rows(spark):
    rng = random.Random(7)
    parts = {"aa": ["the", "ing", "ou"], "bb": ["sch", "ß", "ung"], "cc": ["ción", "ñ", "ll"]}
    rows = []
    for i in range(600):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.choice([3, 30]))), lang if i % 50 else None, "x"))
    rows += [(7000, None, "aa", ""), (7001, "12 34 !?", "aa", ""), (7002, "", None, ""), (None, "the theing", "aa", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in languages.languages(frame).collect()}
    assert got[7000].lang_pred == got[7001].lang_pred == got[7002].lang_pred == "und" and got[7000].score == 0 and got[None].lang_pred == "aa"
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].lang_pred == sorted(parts)[i % 3] for i in held) >= 0.98 * len(held)
    assert languages.languages(frame.limit(0)).count() == 0


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ab cd, \u00e9\u4e2d\U0001f600" * 500
    whole = languages.counts(text)
    monkeypatch.setattr(languages, "PIECE", 97)
    assert (languages.counts(text) == whole).all()


# --- quotations


def test_parse():
    quoted, own = quotations.parse("Hi\n> > Deep  one\n>Two\n> two B\nmine\n> again")
    assert quoted == [(0, 2, "deep one"), (1, 1, "two"), (1, 1, "two b"), (2, 1, "again")] and own == "Hi\nmine"
    assert quotations.parse(None) == ([], "") and quotations.parse("a > b") == ([], "a > b")


@pytest.mark.parametrize("seed", [1, 2])
def test_quotations_like_sql(spark, seed, tmp_path):
    import duckdb

    from corvane.llm.queries import OP7_SQL

    rng = random.Random(seed)
    rows = []
    for c in range(12):
        said = []
        for turn in range(rng.choice([1, 4, 40])):
            lines = [f"line {rng.randrange(30)} of {c}" for _ in range(rng.randint(1, 3))]
            if said and rng.random() < 0.6:
                old = rng.choice(said).split("\n")
                lines = [*(rng.choice(["> ", ">", "> > "]) + x for x in old[: rng.randint(1, 3)]), *([] if rng.random() < 0.1 else ["Reply   here", *lines])]
            said.append("\n".join(lines))
            rows.append((c if c else None, turn // (2 if c == 3 else 1), rng.choice(["user", None]), said[-1]))
    rows += [(4, None, None, None), (4, 1, "user", ""), rows[20], rows[20]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/c/*.parquet')")
    want = con.execute(f"select conv_id, turn, role, n_quoted, n_linked, reply_to, thread_turn, position, own_text from ({OP7_SQL})").fetchall()
    extra = frame.selectExpr("*", "'x' as position", "1 as m")
    got = [tuple(r) for r in quotations.link_quotations(extra).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[4] > 0 for r in got) > 10
    assert quotations.link_quotations(frame.limit(0)).count() == 0
