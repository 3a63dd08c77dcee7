from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def jump(key: int, n: int) -> int:
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def documents():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "bé", "c\n"]) for _ in range(rng.choice([0, 1, 5, 400]))), "en", f"s{i % 7}" if i % 3 else "hot", 0, "x", "y") for i in range(400)]
    return [*rows, (None, None, None, None, None, None, None), (5, "w " * 9000, "en", None, 0, "", ""), *[(-9, "same text", "en", "s1", 0, "", "")] * 12]


def test_jump_hash(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *(random.Random(1).getrandbits(62) for _ in range(300))]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        got = {r[0]: r[1] for r in frame.select("k", sharding.jump_hash(F.col("k"), n)).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_shards(spark):
    rows = documents()
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        want[i, len(b) + 1, zlib.crc32(b), "key", jump(i or 0, 16), jump(i or 0, 17)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_targets_and_seats():
    assert mixing.targets([100, 100, 100]) == [200.0, 100 * 250 / 150 * 1.0, 250 / 3] or sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.choice([0, 1, 50, 1000, 10**6]) for _ in range(rng.randint(1, 9))]
        want, w = mixing.targets(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert sum(want) == pytest.approx(1.5 * sum(sizes))
        free = [t / x for t, x, s in zip(want, w, sizes) if t < 2 * s - 1e-6]
        assert all(t <= 2 * s for t, s in zip(want, sizes)) and (not free or max(free) - min(free) <= 1e-6 * max(free))
        house = rng.randint(0, 200)
        most = [rng.randint(0, 80) for _ in sizes]
        quotients = sorted(((-v / (2 * s + 1), i) for i, v in enumerate(want) if v > 0 for s in range(most[i])))[:house]
        plain = Counter(i for _, i in quotients)
        assert mixing.seats(want, house, most) == [plain[i] for i in range(len(sizes))]
        quotas = mixing.shard_quotas(want, house, most, 4)
        assert all(min(q) >= 0 for q in quotas) and [sum(x) for x in zip(*quotas)] == mixing.seats(want, house, most)


def test_mix(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        key = (r.source_size, r.target)
        size[key] += r["size"]
        taken[key] += r.taken
    for key in size:
        assert abs(taken[key] - key[1]) <= 2 * mixing.BLOCK * max(1, size[key] // max(key[0], 1))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    # words by shard are the taken words
    assert all(sum(r.shard_words.values()) == r.taken for r in got)


def test_blocks_of_each_shard_are_its_quota(spark):
    sizes = {"a": 6400, "b": 1000, "c": 640, "d": 0, None: 70}
    plan = mixing.plan(spark, spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    names = ["a", "b", "c", "d", None]
    want = mixing.targets([sizes[n] for n in names])
    blocks = [-(-sizes[n] // mixing.BLOCK) for n in names]
    house = round(1.5 * sum(sizes.values()) / mixing.BLOCK)
    quotas = mixing.shard_quotas(want, house, [2 * b for b in blocks], mixing.SHARDS)
    got = mixing.selected(plan).collect()
    assert Counter((r.source, r.shard) for r in got) == Counter({(n, k): q for k, row in enumerate(quotas) for n, q in zip(names, row) if q})
    times = Counter((r.source, r.block) for r in got)
    for n, b in zip(names, blocks):  # rounds of one source differ by one at most, and none is over MOST
        mine = [times[n, k] for k in range(b)]
        assert not mine or (max(mine) - min(mine) <= 1 and max(mine) <= mixing.MOST)


def test_words_of_a_shard_come_from_its_blocks(spark):
    """taken and shard_words against a walk over the line, block by block."""
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(frame).collect()
    size = Counter()
    for r in got:
        size[r.source] += r["size"]
    plan = mixing.plan(spark, spark.createDataFrame(list(size.items()), "source string, source_size long"))
    seats = defaultdict(list)
    for r in mixing.selected(plan).collect():
        seats[r.source, r.block].append(r.shard)
    line, want = Counter(), Counter()
    for r in sorted(got, key=lambda r: (str(r.source), r.row_key, r.doc_id or 0, r["size"])):
        words = Counter()
        for w in range(line[r.source], line[r.source] + r["size"]):
            words.update(seats[r.source, w // mixing.BLOCK])
        line[r.source] += r["size"]
        want[r.doc_id, r.source, r["size"], tuple(sorted(words.items()))] += 1
    assert Counter((r.doc_id, r.source, r["size"], tuple(sorted(r.shard_words.items()))) for r in got) == want


def test_mixed_sends_what_the_mix_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 5)  # equal rows over several places
    rows = [*documents(), *[(None, "no id", "en", f"l{i % 2}", 0, "", "") for i in range(6)]]
    frame = spark.createDataFrame([(*r[:2], f"e{i}", *r[3:]) for i, r in enumerate(rows)], SCHEMA)
    taken, size = Counter(), Counter()
    for r in mixing.mix(frame).collect():
        taken[r.source] += r.taken
        size[r.source] += r["size"]
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    sent, times = Counter(), Counter()
    for r in out.collect():
        sent[r.source] += len((r.text or "").split())
        times[r.lang] += 1
    assert max(times.values()) <= mixing.MOST
    for s in taken:
        longest = max(len((r[1] or "").split()) for r in rows if r[3] == s)
        assert 2 * abs(sent[s] - taken[s]) <= longest, s
    assert mixing.mixed(frame.limit(0)).count() == 0
