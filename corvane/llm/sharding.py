"""Jump consistent hashing: stable keys to shards without a ring table (JVM expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published generator: key = key * 2862933555777941757 + 1 (mod 2^64).
_MULTIPLIER = 2862933555777941757
_M_LOW, _M_HIGH = _MULTIPLIER & 0xFFFFFFFF, _MULTIPLIER >> 32

#: Runs that each shard's rows are numbered in.
RUNS = 4096


def _low_product(x: Column, c: int) -> tuple[Column, Column]:
    """x * c for x, c < 2^32 as (value >> 16 of the upper part, exact sum parts): all terms stay under 2^50."""
    low, high = x * F.lit(c & 0xFFFF), x * F.lit(c >> 16)
    return low + F.shiftleft(high.bitwiseAND(0xFFFF), 16), F.shiftright(high, 16)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state, as two 32-bit halves in longs; nothing overflows a long."""
    first, carry = _low_product(low, _M_LOW)
    first = first + 1
    cross_a, _ = _low_product(high, _M_LOW)
    cross_b, _ = _low_product(low, _M_HIGH)
    upper = F.shiftright(first, 32) + carry + cross_a.bitwiseAND(0xFFFFFFFF) + cross_b.bitwiseAND(0xFFFFFFFF)
    return upper.bitwiseAND(0xFFFFFFFF), first.bitwiseAND(0xFFFFFFFF)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key.  A null key counts as 0.

    With one more shard a key either stays or goes to the new one.  The loop is a fold over at most
    `shards` steps; a step whose jump is already past the end changes nothing.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def state(*parts: Column) -> Column:
        return F.named_struct(*(x for name, part in zip("bjhl", parts, strict=True) for x in (F.lit(name), part)))

    zero = F.lit(0).cast("long")
    start = state(zero, zero, F.shiftrightunsigned(key, 32).bitwiseAND(0xFFFFFFFF), key.bitwiseAND(0xFFFFFFFF))

    def step(s: Column, _: Column) -> Column:
        high, low = _step(s["h"], s["l"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(s["j"] < shards, state(s["j"], jump.cast("long"), high, low)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds to key and text: size, text_crc32, law, shard, slot, grown_shard.

    slot numbers a shard's rows without gaps.  Each shard is cut into RUNS runs by the md5 of the key
    and the text's checksum; the counts of runs (at most shards x RUNS rows) give each run's first
    slot, so that no task holds a shard.  Equal rows are counted before they are shuffled and
    expanded afterwards: a key that repeats without end stays one row until then.
    Null text: size 1, checksum 0.  Null keys: shard 0's key.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    )
    run = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "text_crc32", "size").cast("binary")), 1, 3), 16, 10)
    rows = (
        rows.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("shard", jump_hash(F.col("doc_id"), shards))
        .withColumn("run", run.cast("int"))
    )
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("upto", F.sum("copies").over(within))
    counts = rows.groupBy("shard", "run").agg(F.sum("copies").alias("all"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "run", F.coalesce(F.sum("all").over(before), F.lit(0).cast("long")).alias("first"))
    # at most shards x RUNS rows of 16 bytes; null-safe, so that no filter on the shard goes below the first
    # shuffle on one side: both sides read the same one, and the texts once
    a, b = numbered.alias("a"), F.broadcast(first).alias("b")
    same = F.col("a.shard").eqNullSafe(F.col("b.shard")) & F.col("a.run").eqNullSafe(F.col("b.run"))
    placed = a.join(b, same).select("a.*", "first")
    start = F.col("first") + F.col("upto") - F.col("copies")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("slot"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
