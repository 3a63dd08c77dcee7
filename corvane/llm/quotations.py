"""Quotation linking: nested quotes joined to the messages they quote, conversations in reply order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._scratch import Scratch
from ._ship import arrow

_MARKS = re.compile(r"[ \t]*(?:>[ \t]*)*")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(text: str | None) -> tuple[list[tuple[int, int, str]], str]:
    """((passage, level, normalised line) of quoted lines, own lines as they are without the quoted ones).

    Level is the number of > signs before a line.  A run of lines of one level over 0 is a passage.
    A line normalised has its marks off, A-Z lower-cased, white space runs as one space, ends trimmed.
    """
    quoted, own, passage, before = [], [], -1, 0
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)[0]
        level = marks.count(">")
        if level and level != before:
            passage += 1
        before = level
        if level:
            quoted.append((passage, level, normal(line[len(marks) :])))
        else:
            own.append(line)
    return quoted, "\n".join(own).strip("\n") if quoted else (text or "")


def normal(line: str) -> str:
    return _SPACE.sub(" ", line).strip(" ").translate(_LOWER)


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


_PASSAGES = "array<struct<passage: int, level: int, lines: array<long>>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("lines", pa.list_(pa.int64()))]))
    for batch in batches:
        quotes, own, texts, passages = [], [], [], []
        for text in batch.column(1).to_pylist():
            quoted, rest = parse(text)
            some: dict[tuple[int, int], list[int]] = {}
            for p, n, line in quoted:
                if line:
                    some.setdefault((p, n), []).append(_hash(line))
            quotes.append([{"passage": p, "level": n, "lines": lines} for (p, n), lines in some.items()])
            own.append([_hash(x) for x in map(normal, rest.split("\n")) if x])
            texts.append(rest)
            passages.append(quoted[-1][0] + 1 if quoted else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(passages, pa.int32()), pa.array(quotes, kind), pa.array(own, pa.list_(pa.int64())), pa.array(texts, pa.string())],
            ["m", "n_quoted", "quotes", "own", "own_text"],
        )


def _sorted(rows: DataFrame, scratch: Scratch, *by: str) -> DataFrame:
    """rows in ranges of `by`, with _part and _spot: a key's rows may lie in several parts, in order."""
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return scratch.table(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_spot")))


def _positions(rows: DataFrame, group: str) -> DataFrame:
    """rows (from _sorted by group first) with `position`, from 0 in each group, in that order."""
    parts = rows.groupBy("_part", group).agg(F.min("_spot").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))
    a, b = rows.alias("a"), parts.alias("b")
    same = (F.col("a._part") == F.col("b._part")) & F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))
    return a.join(b, same).select("a.*", (F.col("a._spot") - F.col("_first") + F.col("_before")).alias("position"))


def _latest_owner(quotes: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """For each quoted line (m, conv_id, passage, level, hash) the latest earlier message that has it as its own.

    Both kinds of lines are sorted by conversation, hash and message in ranges, so that neither a long
    conversation nor a common line is one task's; what a range needs from those before it is one
    number for each key that goes over its edge.
    """
    none = F.lit(None)
    both = own.select("conv_id", "hash", "m", F.lit(1).alias("kind"), none.cast("int").alias("passage"), none.cast("int").alias("level"))
    both = both.unionByName(quotes.select("conv_id", "hash", "m", F.lit(0).alias("kind"), "passage", "level"))
    both = _sorted(both, scratch, "conv_id", "hash", "m", "kind")  # a message's quotes come before its own lines
    key = ["conv_id", "hash"]
    here = Window.partitionBy("_part", *key).orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("origin", F.max(F.when(F.col("kind") == 1, F.col("m"))).over(here))
    ends = both.groupBy("_part", *key).agg(F.max(F.when(F.col("kind") == 1, F.col("m"))).alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_last", F.max("_last").over(earlier)).where("_last is not null")
    lines = both.where("kind = 0").join(ends, ["_part", *key], "left")
    return lines.select("m", "passage", "level", F.coalesce("origin", "_last").alias("origin"))


def _whole_passages(passages: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """m, passage, level, b (lines, origin) of the passages that an earlier message has whole, as lines in a row.

    passages: m, conv_id, passage, level, lines; own: m, conv_id, own.  A passage's hash is that of its
    normalised lines; a message has one for each of its runs of lines that is as long as a passage
    quoted in its conversation.
    """
    hashed = passages.withColumn("k", F.size("lines")).withColumn("hash", F.xxhash64("k", "lines"))
    lengths = hashed.select("conv_id", "k").distinct()
    runs = own.join(lengths, "conv_id").where(F.size("own") >= F.col("k"))
    starts = F.sequence(F.lit(1), F.size("own") - F.col("k") + 1)
    runs = runs.select("m", "conv_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.col("k"), F.slice("own", i, F.col("k")))))).alias("hash"))
    runs = runs.join(hashed.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    found = _latest_owner(hashed, runs, scratch).where("origin is not null")
    sizes = hashed.select("m", "passage", F.col("k").cast("long").alias("n"))
    return found.join(sizes, ["m", "passage"]).select("m", "passage", "level", F.struct("n", "origin").alias("b"))


def _by_lines(passages: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """m, passage, level, b (lines, origin): the earlier message that has most of a passage's lines, of equal ones the latest.

    Where the latest owner is the same for all lines that have one, no message has more of them and
    none later has as many; only the other passages meet every owner of their lines.
    """
    lines = passages.select("m", "conv_id", "passage", "level", F.explode("lines").alias("hash"))
    own = own.select("m", "conv_id", F.explode(F.array_distinct("own")).alias("hash")).join(lines.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    latest = _latest_owner(lines, own, scratch).where("origin is not null")
    best = latest.groupBy("m", "passage", "level", "origin").agg(F.count("*").alias("n"))
    best = scratch.table(best.groupBy("m", "passage", "level").agg(F.max(F.struct("n", "origin")).alias("b"), F.sum("n").alias("total")))
    rest = lines.join(best.where("b.n < total").select("m", "passage"), ["m", "passage"], "left_semi")
    votes = rest.join(own.withColumnRenamed("m", "origin"), ["conv_id", "hash"]).where("origin < m")
    votes = votes.groupBy("m", "passage", "level", "origin").agg(F.count("*").alias("n"))
    counted = votes.groupBy("m", "passage", "level").agg(F.max(F.struct("n", "origin")).alias("b"))
    return best.where("b.n = total").drop("total").unionByName(counted)


def link_quotations(messages: DataFrame) -> DataFrame:
    """A row for each row of messages (conv_id, turn, role, text), in place of assembled conversations.

    conv_id, turn, role; n_quoted: quoted passages; n_linked: those that an earlier message of the
    conversation has as its own: whole, as lines in a row (the latest such message counts), or else
    in part (most lines decide, then the latest message); reply_to: turn of the origin of the level-1
    passage with most such lines, ties to the latest, null without one; thread_turn: turn of the first
    message of its thread (messages that replies connect); position: place in the reply-ordered
    conversation, threads by their first message, a reply after what it answers; own_text: the text
    without quotes.  A conversation is never gathered in one task.

    Messages follow turn (null first), role, text.  A null text is empty; messages without conv_id have
    no links and are threads of their own, numbered together.  Repeated rows are separate messages;
    blank quoted lines link nothing; an empty table gives no rows.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = _sorted(rows, scratch, "conv_id", "turn", "role", "text").withColumnRenamed("_spot", "m").drop("_part")
    parsed = scratch.table(rows.select("m", "text").transform(arrow, _parsed, f"m long, n_quoted int, quotes {_PASSAGES}, own array<long>, own_text string"))
    known = rows.where("conv_id is not null").select("m", "conv_id")
    passages = parsed.where("n_quoted > 0").join(known, "m").select("m", "conv_id", F.explode("quotes").alias("q")).select("m", "conv_id", "q.*")
    passages = scratch.table(passages)
    own = parsed.join(known, "m").select("m", "conv_id", "own").join(passages.select("conv_id").distinct(), "conv_id", "left_semi")
    whole = scratch.table(_whole_passages(passages, own, scratch))
    rest = passages.join(whole.select("m", "passage"), ["m", "passage"], "left_anti")
    best = whole.unionByName(_by_lines(rest, own, scratch))
    linked = best.groupBy("m").agg(
        F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("b"))).getField("origin").alias("origin")
    )
    linked = scratch.table(linked)
    threads = components(linked.select(F.col("m").alias("a"), F.col("origin").alias("b")), scratch)
    turns = rows.select(F.col("m").alias("_m"), "turn")
    replies = linked.join(turns.withColumnRenamed("turn", "reply_to"), F.col("origin") == F.col("_m"), "left").select("m", "n_linked", "reply_to")
    roots = threads.join(turns.withColumnRenamed("turn", "_root_turn"), F.col("component_id") == F.col("_m")).select(F.col("id").alias("m"), F.col("component_id").alias("_root"), "_root_turn")
    out = (
        rows.select("m", "conv_id", "turn", "role")
        .join(parsed.select("m", "n_quoted", "own_text"), "m")
        .join(replies, "m", "left")
        .join(roots, "m", "left")
        .select(
            "m", "conv_id", "turn", "role", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), "reply_to",
            F.when(F.col("_root").isNull(), F.col("turn")).otherwise(F.col("_root_turn")).alias("thread_turn"), F.coalesce("_root", "m").alias("_root"), "own_text",
        )
    )
    out = _positions(_sorted(out, scratch, "conv_id", "_root", "m"), "conv_id")
    return out.select("conv_id", "turn", "role", "n_quoted", "n_linked", "reply_to", "thread_turn", "position", "own_text")
