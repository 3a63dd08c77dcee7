"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._scratch import Scratch
from ._ship import arrow

TABLES = 40  # at cosine 0.93 a pair shares a table's key with a chance of 0.13, and some key with 0.996
BITS = 16
SEED = 20240229


def planes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, tables * bits))


def _binary(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of bytes: the next sizes[i] bytes of rows, null where that is 0."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(sizes > 0, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, x: the bytes of the doubles of a vector that may link, null for any other."""
    for batch in batches:
        column, label = batch.column(2).cast(pa.list_(pa.float64())), batch.column(1)
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)  # a null component is not a number
        at = np.concatenate([[0], np.cumsum(length)])
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        sound = (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0) & label.is_valid().to_numpy(zero_copy_only=False)
        x = _binary(flat[np.repeat(sound, length)] + 0.0, np.where(sound, length * 8, 0))  # -0.0 becomes 0.0: equal vectors are equal bytes
        yield pa.RecordBatch.from_arrays([batch.column(0), label, x], ["vec_id", "label", "x"])


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors) for each number of dimensions in a column of bytes."""
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    flat, length = np.frombuffer(column.buffers()[2], np.uint8), np.diff(at)
    flat = flat[: len(flat) // 8 * 8].view(np.float64)
    for dims in np.unique(length).tolist():
        rows = np.flatnonzero(length == dims)
        yield rows, flat[at[rows][:, None] + np.arange(dims)]


def _signs(tables: int, bits: int, seed: int):  # noqa: ANN202
    """c, dims, unit, keys: vectors of length 1, scaled by their largest component first, and their signs' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            keys, dims, units = np.zeros((n, tables), np.int64), np.zeros(n, np.int32), [b""] * n
            for rows, x in _rows(batch.column(1)):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                d = x.shape[1]
                if d not in known:
                    known[d] = planes(d, tables, bits, seed)
                keys[rows] = (x @ known[d] >= 0).reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                dims[rows] = d
                for i, u in zip(rows.tolist(), x, strict=True):
                    units[i] = u.tobytes()
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * tables)
            short = pa.array((keys - (1 << bits - 1)).ravel().astype(np.int16))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(units, pa.binary()), pa.ListArray.from_arrays(ends, short)], ["c", "dims", "unit", "keys"])

    return run


def _near(cosine: float):  # noqa: ANN202
    """a, b, na, nb of the pairs whose unit vectors have at least that cosine, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for (rows, x), (_, y) in zip(_rows(batch.column(4)), _rows(batch.column(5)), strict=True):
                keep[rows] = np.einsum("ij,ij->i", x, y) >= cosine
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.93, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors are compared only under the same non-null label and with as many dimensions.  A vector
    that is null, empty, zero, or holds a null or non-finite component has no link; any other finite
    one has, however large or small its components are: they are scaled by the largest first.  Equal
    vectors of one label are a class with one representative and the number of its rows: copies are
    never expanded to pairs, yet each copy counts as a link.  Every pair that shares a key in some
    table is verified in double precision; a pair is looked at in the first table that it shares, so
    that it counts once.  Rows that repeat a vec_id, or have none, are separate vectors and link like
    others; component_id is the smallest vec_id that links reach and null if none of them has one,
    where the row is kept.  bits is 16 at most.  An empty table gives no rows.
    """
    if not 1 <= bits <= 16:
        raise ValueError("bits must be 1 to 16")
    scratch = Scratch(vectors.sparkSession, "vectors")
    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.table(rows.transform(arrow, _clean, f"vec_id long, label {label}, x binary"))
    classes = rows.where("x is not null").groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # a class has a number of its own: vec_id may be null, and may stand for several classes
    classes = scratch.table(scratch.table(classes).withColumn("c", F.monotonically_increasing_id()))
    keys = classes.select("c", "x").transform(arrow, _signs(tables, bits, seed), "c long, dims int, unit binary, keys array<short>")
    keyed = scratch.table(keys.join(classes.select("c", "label", "copies"), "c"))
    # a row carries the keys of the tables before its own, 2 bytes each: what tells whether a pair was met before
    spread = keyed.select("c", "label", "dims", "keys", F.posexplode("keys").alias("t", "key")).withColumn("keys", F.slice("keys", F.lit(1), F.col("t")))
    a, b = spread.alias("a"), spread.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("label", "dims", "t", "key")]
    first = ~F.exists(F.zip_with(F.col("a.keys"), F.col("b.keys"), lambda p, q: p == q), lambda v: v)
    met = a.join(b, [*same, F.col("a.c") < F.col("b.c"), first]).select(F.col("a.c").alias("a"), F.col("b.c").alias("b"))
    left, right = (keyed.select(F.col("c").alias(n), F.col("unit").alias(f"_{n}"), F.col("copies").alias(f"n{n}")) for n in "ab")
    links = met.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "_a", "_b")
    links = scratch.table(links.transform(arrow, _near(cosine), "a long, b long, na long, nb long"))

    several = links.select(F.col("a").alias("c"), F.col("nb").alias("n")).unionByName(links.select(F.col("b").alias("c"), F.col("na").alias("n")))
    several = several.groupBy("c").agg(F.sum("n").alias("others"))
    found = components(links.select("a", "b"), scratch).select(F.col("id").alias("c"), F.col("component_id").alias("root"))
    member = classes.select("c", "id").join(found, "c", "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    least = member.groupBy("root").agg(F.min("id").alias("component_id"))
    done = (
        classes.select("c", "label", "x", "copies")
        .join(several, "c", "left")
        .join(member.select("c", "root"), "c")
        .join(least, "root")
        .select("label", "x", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("found"))
    )
    out = rows.join(done, ["label", "x"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
