"""The learned and chained methods against plain loops over dictionaries."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import _words, languages, licenses, toxicity

MASK = (1 << 64) - 1


def plain_mix(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 33


def plain_features(text):
    """Words, four-byte stems, pairs of neighbours and pairs over one or two words."""
    out = set()
    [(_, _, _, words, stems)] = _words.hashed_words(pa.array([text]), _words.ALNUM, toxicity.STEM)
    words, stems = words.tolist(), stems.tolist()
    for i, w in enumerate(words):
        out |= {plain_mix(w + 1 & MASK) >> 44, plain_mix(stems[i] + 2 & MASK) >> 44}
        for gap in (1, 2, 3):
            if i >= gap:
                out.add(plain_mix(words[i - gap] * 0x9E3779B97F4A7C15 + w + 2 + gap & MASK) >> 44)
    return out


def plain_ftrl(examples, order, alpha=1.0, beta=1.0, l1=5.0, l2=0.1):
    """Per-coordinate FTRL-proximal as published; coordinate None is the intercept, without l1."""
    z, n = Counter(), Counter()

    def weight(i):
        bound = 0.0 if i is None else l1
        return 0.0 if abs(z[i]) <= bound else -(z[i] - math.copysign(bound, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for k in order:
        f, y = examples[k]
        some = [*f, None]
        w = {i: weight(i) for i in some}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in some:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return weight


def test_ftrl_and_scores_like_plain_loops(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["bad", "Good", "the", "x", "été", "worst"]) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    labels = [int("worst" in t) for t in texts]
    got = [set(f.tolist()) for f in toxicity.distinct_features(pa.array(texts))]
    assert got == [plain_features(t) for t in texts]
    examples = [(np.array(sorted(f), np.int32), y) for f, y in zip(got, labels)]
    model = toxicity.learn(examples, toxicity.Ftrl(l1=0.5), 120)
    seeded = np.random.Generator(np.random.PCG64(11))
    weight = plain_ftrl([(f.tolist(), y) for f, y in examples], [k for _ in range(3) for k in seeded.permutation(40).tolist()], l1=0.5)
    index, value, intercept = model.compact()
    assert len(index) and intercept == pytest.approx(weight(None))
    assert all(v == pytest.approx(weight(i), rel=1e-5) for i, v in zip(index.tolist(), value.tolist()))
    frame = spark.createDataFrame([*enumerate(texts), (90, None), (91, "worst " * 30000), (0, texts[0])], "doc_id long, text string")
    scores = {(r.doc_id): r.score for r in toxicity.score(frame, model.compact()).collect()}
    for i, t in [*enumerate(texts), (90, ""), (91, "worst " * 30000)]:
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-sum(weight(f) for f in [*plain_features(t), None]))), abs=1e-5)
    kept = toxicity.accepted(frame, model.compact()).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, *_ in [*enumerate(texts), (90,), (91,), (0,)] if scores[i] < toxicity.CUT)


def test_settings_are_compared_without_the_held_out_fold(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(20)) + (" vile" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    held = {i for i, _ in rows if toxicity.zlib.crc32(str(i).encode()) % 4 == 2}
    lies = [(i, 1 - y if i in held else y) for i, y in labels]
    a, b = (toxicity.losses(docs, spark.createDataFrame(x, "doc_id long, toxic int"), [{"l1": 0.5}, {"l1": 1e6}], updates=600) for x in (labels, lies))
    assert a == b and a[0][2] == {"l1": 0.5} and a[0][1] < 0.1


def plain_counts(text):
    out = Counter()
    signs = ["".join(" " if ord(c) < 128 and not c.isalpha() else c.lower() if ord(c) < 128 else c) for c in text]
    for n in languages.WIDTHS:
        for i in range(len(signs) - n + 1):
            h = 0
            for c in signs[i : i + n]:
                h = h * 0x01000193 + ord(c) & 0xFFFFFFFF
            h = (h ^ n * 0x9E3779B1 & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF
            out[h >> 19] += 1
    return out


def test_languages_like_plain_loops(spark):
    rng = random.Random(5)
    words = {"a": ["the", "and", "of"], "b": ["и", "не", "что"], "c": ["的", "是", "不"]}
    known = [(lang, " ".join(rng.choice(words[lang]) for _ in range(8))) for lang in words for _ in range(20)]
    model = languages.fit([(lang, languages.counts(t)) for lang, t in known], 2)
    texts = [t for _, t in known[::7]] + ["½ ² Ⅷ ①", "12!", "", None, "the 的", "½ x", "Q" * 90000]
    got = [tuple(r) for r in languages.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").select("lang_pred", "score").collect()]
    for (lang, score), t in zip(got, texts):
        c = plain_counts(t or "")
        assert dict(c) == {i: n for i, n in enumerate(languages.counts(t or "").tolist()) if n}
        if not t or not any(x.isalpha() and x not in "Ⅷ①" for x in t):
            assert (lang, score) == ("und", 0.0)
            continue
        v = {i: math.log1p(n) * model.idf[i] for i, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * m[i] for i, x in v.items()) / size for m in model.centroids]
        assert score == pytest.approx(min(1, max(0, max(cosines))), abs=1e-9) and lang == model.language[int(np.argmax(cosines))]


def plain_chains(placed, size):
    """(covered, first, end) of the best chain up to each match, then the best ones that don't overlap."""
    best = []
    for start, inner, n in sorted(set(placed)):
        mine = (n, start, start + n, inner + n)
        for covered, first, end, at in reversed(best):
            cut = max(0, end - start, at - inner)
            if start - end <= licenses.GAP and inner - at <= licenses.GAP and cut < n and covered + n - cut > mine[0]:
                mine = (covered + n - cut, first, start + n, inner + n)
        best.append(mine)
    out = []
    for covered, first, end, _ in sorted(best, key=lambda c: (-c[0], c[1:])):
        if all(end <= lo or first >= hi for _, lo, hi in out):
            out.append((covered, first, end))
    return sorted((first, end, min(1.0, covered / size)) for covered, first, end in out)


def test_chains_and_score_like_plain_loops():
    rng = random.Random(6)
    alphabet = "abcdef"
    templates = {"x": [" ".join(rng.choice(alphabet) for _ in range(14))], "y": [" ".join(rng.choice(alphabet) for _ in range(9))]}
    auto = licenses.build({"a b": "base"}, templates)
    texts = [t.split() for some in templates.values() for t in some]
    number = {w: int(np.searchsorted(auto.words, next(iter(_words.hashed_words(pa.array([w]), _words.ALNUM)))[3][0])) for w in alphabet}
    known = [["a", "b"], *texts]
    for _ in range(120):
        text = [rng.choice(alphabet) for _ in range(rng.choice([0, 10, 60]))]
        for _ in range(2):
            t = list(rng.choice(texts))
            if rng.random() < 0.7:
                t[rng.randrange(len(t)) : rng.randrange(len(t))] = ["a"]
            at = rng.randint(0, len(text))
            text[at:at] = t
        # maximal matches by trying every length at every place
        ends = []
        for i in range(len(text)):
            n = max((n for n in range(1, i + 2) if any(t[j : j + n] == text[i + 1 - n : i + 1] for t in known for j in range(len(t)))), default=0)
            ends.append(n)
        placed = {k: [] for k in range(len(known))}
        for i, n in enumerate(ends):
            if n >= 2 and (i + 1 == len(ends) or ends[i + 1] <= n):
                for k, t in enumerate(known):
                    for j in range(len(t) - n + 1):
                        if t[j : j + n] == text[i + 1 - n : i + 1] and n >= min(licenses.LEAST, len(t)):
                            placed[k].append((i + 1 - n, j, n))
        for k, t in enumerate(known):
            placed[k] += [(i, 0, len(t)) for i in range(len(text)) if text[i : i + len(t)] == t]
        want = sorted((k, *c) for k, some in placed.items() for c in plain_chains(some, len(known[k])))
        hashed = auto.words[[number[w] for w in text]] if text else np.zeros(0, np.uint64)
        got = licenses.scan(auto, hashed)
        assert got["score"] == max((c for *_, c in want), default=0.0)
        assert got["spans"] == [(auto.label[k], a, b, c) for k, a, b, c in want if k and c >= licenses.COVER]
        assert got["labels"] == ",".join(sorted({auto.label[k] for k, _, _, c in want if c >= licenses.COVER and k} | ({"base"} if got["n_base"] else set())))


def test_equal_places_of_a_template_take_linear_time():
    auto = licenses.build()
    one = "licensed under the mit license foo "
    took = []
    for n in (4000, 16000):
        words = next(iter(_words.hashed_words(pa.array([one * n]), _words.ALNUM)))[3]
        began = time.perf_counter()
        assert len(licenses.scan(auto, words)["spans"]) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_whole_licence_texts_give_their_label(spark):
    rows = [(i, f"Copyright 2020 Some One\n{text}") for i, text in enumerate(licenses.TEXTS.values())]
    rows.append((99, licenses.TEXTS["mit-text"].replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME CORPORATION") + " and more words"))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(licenses.TEXTS):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert any(s.label == label and s.first_word == 4 and s.end_word == got[i].n_words for s in got[i].spans)
    assert "mit-text" in got[99].labels.split(",")


def test_examples_come_in_parts(spark, monkeypatch):
    """The sum of features is cut at the same place for rows in any order, and no task holds all rows' features for it."""
    texts = {k: " ".join(f"w{k}x{j}" for j in range(3 + k % 7)) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, toxic int")
    plans, take = [], type(docs).toLocalIterator
    monkeypatch.setattr(type(docs), "toLocalIterator", lambda self, *a: plans.append(self._jdf.queryExecution().toString()) or take(self, *a))
    all_ = {i: len(f) for i, (f, _) in toxicity._examples(docs, labels, 1000, None)}
    order = sorted(texts, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    most, want, total = sum(all_.values()) // 2, set(), 0
    for k in order:
        total += all_[k]
        if total > most:
            break
        want.add(k)
    assert set(all_) == set(texts) and {i for i, _ in toxicity._examples(docs, labels, 1000, None, most)} == want
    assert toxicity._examples(docs, labels, 1000, None, 1) == []
    assert plans and not any("Window" in p for p in plans)
