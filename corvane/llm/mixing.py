"""Mixing sources to target weights: Sainte-Lague seats of equal-token blocks, then seeded blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import Scratch
from ._ship import arrow

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix has 3/2 of all sizes
MOST = 2  # times that a word can be taken
BLOCK = 64  # words in a block
SHARDS = 16
SEED = 7
PRIMES = (1000000007, 998244353, 2147483647)
ROWS = 1 << 12  # rows of a source that mixed() balances in one group, about
COPIES = 1 << 12  # of an equal row that are expanded in one place


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> list[float]:
    """Each source's words: its weight's part of `share` of all sizes, at most `most` times its size.

    What is over a stop is dealt again by weight until no source is above: the common level below
    which a source has weight x level, and from which on it has its stop.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, weight = Fraction(sum(sizes) * share[0], share[1]), sum(w)
    level = 0.0
    for i in sorted(range(len(sizes)), key=lambda i: (Fraction(sizes[i], w[i]), i)):
        if left * w[i] <= Fraction(most * sizes[i] * weight):
            level = float(left) / weight
            break
        left, weight = left - most * sizes[i], weight - w[i]
    else:
        return [float(most * s) for s in sizes]
    return [min(float(most * s), x * level) for s, x in zip(sizes, w, strict=True)]


def seats(votes: list[float], house: int, most: list[int]) -> list[int]:
    """Sainte-Lague: `house` seats by the highest quotients votes / (2 s + 1), ties to the first.

    A bisection over the divisor finds all seats but the last few, which are given one by one, so the
    time follows the number of sources, not of seats.  No source gets more than `most` seats.
    """
    house = min(house, sum(most))
    if house <= 0:
        return [0] * len(votes)

    def above(limit: float) -> list[int]:  # seats whose quotient is over the limit
        out = []
        for v, m in zip(votes, most, strict=True):
            s = min(m, max(0, int((v / limit + 1) / 2))) if v > 0 else 0
            while s < m and v / (2 * s + 1) > limit:
                s += 1
            while s and not v / (2 * s - 1) > limit:
                s -= 1
            out.append(s)
        return out

    low, high = 0.0, max(votes) * 2 + 1
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(above(middle)) >= house:
            low = middle
        else:
            high = middle
    got = above(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
    heapq.heapify(heap)
    for _ in range(house - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(votes: list[float], house: int, most: list[int], shards: int) -> list[list[int]]:
    """Integer quotas by shard and source; a divisor method never takes a seat back as the house grows."""
    marks = [seats(votes, house * k // shards, most) for k in range(shards + 1)]
    return [[b - a for a, b in zip(x, y, strict=True)] for x, y in zip(marks, marks[1:], strict=False)]


def _stride(n: int, seed: int) -> tuple[int, int]:
    """A step that has no factor in common with n, and a start: i -> (step * i + start) mod n visits all."""
    return (next(p for p in PRIMES if n % p) % n if n > 1 else 0), (seed * 2654435761 % n if n else 0)


def plan(spark: SparkSession, sizes: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """sizes: source, source_size.  Returns a row for each source: its target, its blocks and what they get.

    marks has the seats of the source up to each shard's end, so that shard k's quota is marks[k] -
    marks[k - 1].  Seat j goes to the block at place j mod blocks of the source's seeded order.  The
    driver holds one row of about 300 bytes for each source.
    """
    found = sorted(((r["source"], int(r["source_size"])) for r in sizes.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    size = [s for _, s in found]
    want = targets(size, weights, share)
    blocks = [-(-s // block) for s in size]
    house = (2 * share[0] * sum(size) + share[1] * block) // (2 * share[1] * block)
    quotas = shard_quotas(want, house, [MOST * b for b in blocks], shards)
    rows = []
    for i, (source, s) in enumerate(found):
        marks = [sum(q[i] for q in quotas[: k + 1]) for k in range(shards)]
        rows.append((source, s, want[i], blocks[i], *_stride(blocks[i], seed + i), marks))
    schema = T.StructType(
        [T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]
        + [T.StructField(c, T.LongType()) for c in ("blocks", "step", "start")] + [T.StructField("marks", T.ArrayType(T.LongType()))]
    )
    return spark.createDataFrame(rows, schema)


def _place(block: Column) -> Column:
    """A block's place in its source's seeded order."""
    return ((F.col("step").cast("decimal(19,0)") * block.cast("decimal(18,0)") + F.col("start")) % F.col("blocks")).cast("long")


def _seats(block: Column) -> Column:
    """How many seats a block has in all shards together: one for each round of the order that reaches its place."""
    return F.floor((F.element_at("marks", -1) - 1 - _place(block)) / F.col("blocks")) + 1


def selected(sources: DataFrame) -> DataFrame:
    """source, block, shard of every seat: shard by shard, each source's quota of blocks in its seeded order."""
    seats = sources.where("blocks > 0 and element_at(marks, -1) > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    seats = seats.where(_seats(F.col("block")) > 0).withColumn("round", F.explode(F.sequence(F.lit(0), _seats(F.col("block")) - 1)))
    seat = _place(F.col("block")) + F.col("round") * F.col("blocks")
    return seats.select("source", "block", _shard(seat).alias("shard"))


def _shard(seat: Column) -> Column:
    """The shard whose quota a seat is part of."""
    return F.size(F.filter("marks", lambda m: m <= seat)).cast("int")


def row_key(seed: int = SEED) -> Column:
    """The place of a row of documents in its source's line: seeded, by doc_id and text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.col("text"))))


def _lined(docs: DataFrame, block: int, shards: int, seed: int, weights: tuple[int, ...]) -> DataFrame:
    """Folded rows (doc_id, source, size, row_key, copies) with their first word's place in the source's line, and the plan."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(seed).alias("row_key"),
        F.spark_partition_id().alias("_part"),
    )
    # equal rows are one row for each task that reads them; the words are counted once: the later steps read this table
    rows = rows.groupBy("doc_id", "source", "size", "row_key", "_part").agg(F.count("*").alias("copies"))
    rows = Scratch(spark, "mix").table(rows.withColumn("_run", F.conv(F.substring("row_key", 1, 3), 16, 10).cast("int")))
    words = F.col("size") * F.col("copies")
    runs = rows.groupBy("source", "_run").agg(F.sum(words).alias("_sum"))
    sources = plan(spark, runs.groupBy("source").agg(F.sum("_sum").alias("source_size")), block, shards, seed, weights)
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    first = runs.select("source", "_run", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_first"))
    within = Window.partitionBy("source", "_run").orderBy("row_key", "doc_id", "size", "_part").rowsBetween(Window.unboundedPreceding, -1)
    lined = rows.withColumn("_at", F.coalesce(F.sum(words).over(within), F.lit(0).cast("long")))
    a, b = lined.alias("a"), first.alias("b")
    lined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._run") == F.col("b._run"))).select("a.*", (F.col("a._at") + F.col("b._first")).alias("_from"))
    a, b = lined.alias("a"), sources.alias("b")
    lined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).drop(F.col("b.source"))
    if (rows.agg(F.max("copies")).first()[0] or 0) > COPIES:  # a row that repeats without end goes to many tasks
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
        lined = lined.withColumn("_some", part).withColumn("_from", F.col("_from") + F.col("_some") * COPIES * F.col("size"))
        lined = lined.withColumn("copies", F.least(F.col("copies") - F.col("_some") * COPIES, F.lit(COPIES))).drop("_some").repartition(F.col("_from"), F.col("source"))
    return lined.withColumn("_from", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: F.col("_from") + k * F.col("size"))))


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard_words, row_key, source of every row of docs.

    A source's words stand in one line: its documents by the md5 of seed, doc_id and text, in 4,096
    runs whose first places come from their sums, so that no task holds a source.  The line is cut
    into blocks.  Sainte-Lague seats give every shard of the mix an integer quota of each source's
    blocks; shard after shard takes its quota from the source's seeded order of blocks, which starts
    again when it is through.  taken is what the document's part of the line gets in all shards,
    shard_words that number for each shard that gets any, as a map.  Null text: size 0, taken 0.  A null
    source is a source of its own, the last.  Equal rows follow one another in the line; they are
    counted before they are shuffled.  An empty table gives no rows.
    """
    lined = _lined(docs, block, shards, seed, weights)
    low, high = F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block)
    within = lambda i: F.least(F.col("_from") + F.col("size"), (i + 1) * block) - F.greatest(F.col("_from"), i * block)
    seats = F.transform(F.sequence(low, high), lambda i: F.struct(_place(i).alias("place"), _seats(i).alias("n"), within(i).alias("words")))
    lined = lined.withColumn("_seats", F.when(F.col("size") > 0, seats).otherwise(F.array().cast("array<struct<place: bigint, n: bigint, words: bigint>>")))
    taken = F.aggregate("_seats", F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["words"])
    none = F.array_repeat(F.lit(0).cast("long"), shards)

    def added(s: Column, seat: Column, words: Column) -> Column:
        return F.transform(s, lambda w, i: w + F.when(i == seat, words).otherwise(0))

    def dealt(s: Column, x: Column) -> Column:  # one seat a round, at most MOST rounds
        for k in range(MOST):
            s = added(s, F.when(x["n"] > k, _shard(x["place"] + k * F.col("blocks"))), x["words"])
        return s

    words = F.aggregate("_seats", none, dealt)
    by_shard = F.map_from_entries(F.filter(F.transform(words, lambda w, i: F.struct(i.alias("shard"), w.alias("words"))), lambda e: e["words"] > 0))
    return lined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), by_shard.alias("shard_words"), "row_key", "source")


def _balanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often whole documents go into the mix, so that a group's words come to what its documents take.

    A group's rows come in a row, the largest documents first; each gets its whole rounds, and one
    more, or one of several less, if that brings the sum nearer.
    """
    here, owed = None, 0
    for batch in batches:
        source, group, key, size, taken, copies = batch.columns
        times = []
        for g, words, got, rows in zip(zip(source.to_pylist(), group.to_pylist(), strict=True), size.to_pylist(), taken.to_pylist(), copies.to_pylist(), strict=True):
            if g != here:
                here, owed = g, 0
            n, rest = divmod(got, words)
            owed += rest
            while n < MOST * rows and 2 * owed >= words:
                n, owed = n + 1, owed - words
            while n > rows and 2 * owed <= -words:
                n, owed = n - 1, owed + words
            times.append(n)
        yield pa.RecordBatch.from_arrays([source, key, copies, pa.array(times, pa.int64())], ["source", "row_key", "copies", "times"])


def mixed(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, with all their columns, as often as the words that mix() takes of them ask for.

    Documents stay whole: of each source, in groups of about ROWS rows, the largest first, a document
    comes once more, or once less if it comes several times, where that brings the words sent nearer to
    the words taken; a group's difference is at most half of its longest document's words.  No row comes
    more than MOST times; one without words never.  Rows of equal doc_id, text and source share their
    number, whatever else they hold; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    taken = mix(docs, block, shards, seed, weights).where("size > 0").groupBy("source", "row_key").agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("copies"))
    taken = scratch.table(taken)
    groups = taken.groupBy(F.col("source").alias("_s")).agg(F.ceil(F.count("*") / ROWS).alias("_groups"))
    grouped = taken.join(groups, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_group", F.pmod(F.xxhash64("row_key"), F.col("_groups")))
    group = ["source", "_group"]
    times = grouped.select(*group, "row_key", "size", "taken", "copies").repartition(*group).sortWithinPartitions(*group, F.desc("size"), "row_key", "taken")
    times = scratch.table(times.transform(arrow, _balanced, "source string, row_key string, copies long, times long").where("times > 0"))
    # the rows as one column: no name of theirs can clash with a name here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(seed).alias("key"), F.col("source").cast("string").alias("of"))
    same = (F.col("key") == F.col("row_key")) & F.col("of").eqNullSafe(F.col("source"))
    out = rows.join(times.where("copies = 1"), same)
    if times.where("copies > 1").head(1):  # rows that repeat share what their key has
        order = Window.partitionBy("key", "of").orderBy(F.xxhash64("row"))
        again = rows.join(times.where("copies > 1"), same).withColumn("n", F.row_number().over(order))
        again = again.withColumn("times", F.floor(F.col("times") / F.col("copies")) + F.when(F.col("n") <= F.col("times") % F.col("copies"), 1).otherwise(0)).drop("n")
        out = out.unionByName(again.where("times > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
