"""MinHash near-duplicates: bottom-k sketches of one hash, inverted lists, exact Jaccard, components.

1. One pass over the texts gives each row its set's size, a 128-bit signature of the set and the
   SMALL smallest shingle hashes.  Rows of one signature are one class; its smallest doc_id stands for it.
2. Values that two classes retain are counted.  A class goes on only if so many of its values are
   shared that a partner is possible (the sketches of a pair at the threshold overlap in at least
   `small_need` values but for a chance under 1e-6).
3. For the classes left, a second pass keeps the whole sets, and LARGE retained values of each.  Each
   class is put into the inverted lists of its rarest shared values only: if a pair overlaps in o
   values, it meets in the (size - o + 1) rarest of either.  Frequent passages are last in this
   order, so their lists stay short.
4. In each list every class is compared with the list's most typical member, its hub; what is not
   linked to it is compared with all members of other components.  A pair of one list is left out
   only if its sizes, its shared values, its overlaps with the hub, the union-sketch estimate or an
   existing link rule it out.
5. Exact Jaccard on whole sets confirms links; large-star/small-star finds the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._scratch import Scratch
from ._ship import arrow
from ._words import SPACED, hashed_words, shingles

WIDTH = 5  # words in a shingle
SMALL, LARGE = 32, 1024  # retained values in the first and second sketch
MISS = 1e-6  # chance that a pair at the threshold is not met


def need(k: int, threshold: float, miss: float = MISS) -> int:
    """The largest overlap that bottom-k sketches of a pair at the threshold miss with a chance of at most `miss`."""
    total, c = 0.0, 0
    while c < k:
        total += comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if total > miss:
            return max(c, 1)
        c += 1
    return k


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes in ascending order."""
    for lo, hi, at, words in hashed_words(column, SPACED):
        for i in range(hi - lo):
            yield np.unique(shingles(words[at[i] : at[i + 1]], WIDTH))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, low = [], [], [], []
        for s in _sets(batch.column(1)):
            n.append(len(s))
            one.append(int((s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            two.append(int(np.bitwise_xor.reduce(s * (s >> np.uint64(32) | np.uint64(1))).view(np.int64)) if len(s) else 0)
            low.append(s[:SMALL].copy())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(low)],
            ["doc_id", "n", "sig1", "sig2", "low"],
        )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, part, size = [], [], 0
        for i, s in zip(batch.column(0).to_pylist(), _sets(batch.column(1)), strict=True):
            ids.append(i)
            part.append(s)
            size += len(s)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(part)], ["id", "hashes"])
                ids, part, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(part)], ["id", "hashes"])


def _shared(sketches: DataFrame) -> DataFrame:
    """id, n, v, count of every retained value that several classes have.  sketches: id, n, low."""
    values = sketches.select("id", "n", F.explode("low").alias("v"))
    several = values.groupBy("v").agg(F.count("*").alias("count")).where("count > 1")
    return values.join(several, "v")


def _rare(threshold: float, large_need: float, n: Column, kept: Column) -> Column:
    """How many retained values a partner must share: exact while all sets that fit are kept whole."""
    sure = F.ceil(F.lit(threshold) * n - 1e-9)
    likely = F.ceil(F.lit(large_need) * kept - 1e-9)
    return F.when(n <= int(threshold * LARGE), sure).otherwise(likely)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, both, linked: sizes of the intersections of whole sets, and 100 * both >= percent * union."""
    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("_x"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("_y"))
    rows = pairs.join(x, "a").join(y, "b")
    rows = rows.select("a", "b", F.size(F.array_intersect("_x", "_y")).alias("both"), (F.size("_x") + F.size("_y")).alias("all"))
    return rows.select("a", "b", "both", (100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).alias("linked"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (columns doc_id, text; others are ignored).

    Null or empty texts have no set and are linked with nothing; with fewer than five words the whole
    sequence is the only shingle.  Texts of any length are taken whole.  Rows that repeat a doc_id are
    looked at each by its own text; a row without doc_id keeps component_id null and kept true, and
    stands for no other.  component_id is the smallest doc_id that links reach.  Nothing is dropped: a
    row comes back for each row, and an empty table gives none.
    """
    threshold = percent / 100
    scratch = Scratch(docs.sparkSession, "near")
    base = scratch.table(
        docs.select(F.col("doc_id").cast("long"), "text").transform(arrow, _sketch, "doc_id long, n long, sig1 long, sig2 long, low array<long>")
    )
    least = F.min(F.struct("doc_id", "low"))
    classes = base.where("n > 0 and doc_id is not null").groupBy("sig1", "sig2", "n").agg(least.alias("x"))
    classes = scratch.table(classes.select("sig1", "sig2", "n", F.col("x.doc_id").alias("id"), F.col("x.low").alias("low")))

    # classes that can have a partner at all
    few = need(SMALL, threshold) / SMALL
    kept = F.least(F.max("n"), F.lit(SMALL))
    enough = F.count("*") >= F.ceil(few * kept - 1e-9)
    alive = scratch.table(_shared(classes).groupBy("id").agg(enough.alias("enough")).where("enough").select("id"))

    # whole sets of these, and the lists of their rarest shared values
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(alive, "id", "left_semi").distinct()
    sets = scratch.table(texts.transform(arrow, _whole, "id long, hashes array<long>").where(F.size("hashes") > 0))
    sized = sets.select("id", F.size("hashes").alias("n"), F.slice("hashes", 1, LARGE).alias("low"))
    by_id = Window.partitionBy("id")
    held = F.least(F.col("n"), F.lit(LARGE))
    listed = (
        _shared(sized)
        .withColumn("place", F.row_number().over(by_id.orderBy("count", "v")))
        .withColumn("of", F.count("*").over(by_id))
        .withColumn("common", F.sum("count").over(by_id))
        .where(F.col("place") <= F.col("of") - _rare(threshold, need(LARGE, threshold) / LARGE, F.col("n"), held) + 1)
        .select("id", "v", "n", "of", "place", "common")
    )
    listed = scratch.table(listed)

    # every member against the most typical one of its list
    hub = listed.groupBy("v").agg(F.max(F.struct("common", (-F.col("id")).alias("minus"), "n")).alias("h"), F.count("*").alias("members")).where("members > 1")
    hub = hub.select("v", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))
    pairs = listed.join(hub.drop("hub_n"), "v").where("id <> hub").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    compared = scratch.table(_compared(pairs, sets, percent))
    found = scratch.table(components(compared.where("linked"), scratch))

    # what its list's hub did not link, against all members of other components
    label = listed.join(found, "id", "left").withColumn("component", F.coalesce("component_id", "id")).drop("component_id")
    hubs = hub.join(found.withColumnRenamed("id", "hub"), "hub", "left").select("v", F.coalesce("component_id", "hub").alias("hub_component"), "hub", "hub_n")
    label = label.join(hubs, "v").withColumn("a", F.greatest("id", "hub")).withColumn("b", F.least("id", "hub"))
    label = label.join(compared.select("a", "b", "both"), ["a", "b"], "left").withColumn("both", F.when(F.col("hub_n") <= LARGE, F.coalesce("both", "n")))
    label = scratch.table(label.select("v", "id", "n", "of", "place", "component", "both", (F.col("component") != F.col("hub_component")).alias("loose")))
    loose = label.where("loose").select("v", *(F.col(c).alias(f"{c}_") for c in ("id", "n", "of", "place", "component", "both")))
    least_overlap = (F.col("n") + F.col("n_")) * percent / (100 + percent) - 1e-6
    whole = (F.col("n") <= LARGE) & (F.col("n_") <= LARGE)
    near = (F.col("n") >= F.col("n_") * threshold - 1e-6) & (F.col("n_") >= F.col("n") * threshold - 1e-6)
    # of whole sets: if v is the rarest common value, the rest of either side's shared values must suffice; and what
    # both have of the hub, with what other classes share of the remainder, bounds the overlap
    after = F.least(F.col("of") - F.col("place"), F.col("of_") - F.col("place_")) + 1
    by_hub = F.least("both", "both_") + F.least(F.col("of") - F.col("both"), F.col("of_") - F.col("both_"))
    unknown = F.col("both").isNull() | F.col("both_").isNull()
    possible = ~whole | ((after >= least_overlap) & (unknown | (by_hub >= least_overlap)))
    rest = (
        label.join(loose, "v")
        .where((F.col("component") != F.col("component_")) & near & possible)
        .select(F.greatest("id", "id_").alias("a"), F.least("id", "id_").alias("b"))
        .distinct()
    )
    rest = _compared(_estimated(rest, sized, threshold), sets, percent).where("linked")
    star = found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    found = components(star.unionByName(rest.select("a", "b")), scratch)

    root = classes.join(found, "id", "left").select("sig1", "sig2", "n", F.coalesce("component_id", "id").alias("component_id"))
    return (
        base.select("doc_id", "n", "sig1", "sig2")
        .join(root, ["sig1", "sig2", "n"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _estimated(pairs: DataFrame, sized: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose union sketch (the LARGE smallest values of both) holds enough values of both sides.

    Of the k smallest values of the union a share equal to the Jaccard is expected in both sketches;
    the limit leaves out a pair at the threshold with a chance under MISS.
    """
    x = sized.select(F.col("id").alias("a"), F.col("low").alias("_x"))
    y = sized.select(F.col("id").alias("b"), F.col("low").alias("_y"))
    least = need(LARGE, threshold) / LARGE
    # values are unsigned hashes in longs: shifted by 2^63 their order is that of the sketches
    turned = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(2**63)).cast("long")))
    union = F.slice(F.array_sort(turned(F.array_union("_x", "_y"))), 1, LARGE)
    both = F.size(F.array_intersect(union, turned(F.array_intersect("_x", "_y"))))
    return pairs.join(x, "a").join(y, "b").where(both >= F.ceil(least * F.size(union) - 1e-9)).select("a", "b")
