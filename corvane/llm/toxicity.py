"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams, skip-grams and word stems."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._ship import arrow, trim
from ._words import ALNUM, hashed_words, mix

BITS = 20  # 2^20 weights
STEM = 4  # bytes of a word that are a feature of their own
SAMPLE = 6000  # labelled rows that the model learns from, at most; the smallest hashes of all that may be used
FEATURES = 1 << 25  # distinct features of all these rows together, at most: 128 MB in the driver
UPDATES = 24_000  # examples that the model sees, whole passes over the sample
CUT = 0.3  # scores from here on are predicted toxic


def features(words: np.ndarray, stems: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature numbers: words, stems, word pairs, and pairs that skip one or two words."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, out = [row, row], [mix(words + np.uint64(1)), mix(stems + np.uint64(2))]
    for gap in (1, 2, 3):
        if len(words) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[gap:][same])
            out.append(mix(words[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + words[gap:][same] + np.uint64(2 + gap)))
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text."""
    for lo, hi, at, words, stems in hashed_words(column, ALNUM, STEM):
        row, f = features(words, stems, at)
        both = np.unique((row << BITS) | f)
        cuts = np.searchsorted(both, np.arange(hi - lo + 1) << BITS)
        f = both & ((1 << BITS) - 1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield f[a:b]


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; a weight is 0 until its gradients exceed l1."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == 1 << BITS, 0.0, self.l1)  # the last coordinate is the intercept
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: int) -> None:
        """One example: distinct features of value 1, and the intercept."""
        i = np.append(i, 1 << BITS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange((1 << BITS) + 1))
        i = np.flatnonzero(w[:-1])
        return i.astype(np.int32), w[i].astype(np.float32), float(w[-1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [f.astype(np.int32).tobytes() for f in distinct_features(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "y", "f"])


Example = tuple[np.ndarray, int]


def _examples(docs: DataFrame, labels: DataFrame, sample: int, fold: tuple[int, int] | None, most: int = FEATURES) -> list[tuple[int, Example]]:
    """(doc_id, (features, label)) of at most `sample` labelled rows outside the held-out fold, in a fixed order.

    The rows are those whose doc_id has the smallest checksums, as many as have `most` features
    together; several labels of a doc_id count as the largest.  Rows that repeat a doc_id and its text
    count once.  Features are found by tasks and come in parts of a table: the driver holds 4 bytes for
    each, 128 MB in all, and its JVM one part.
    """
    ids = F.col("doc_id").cast("string")
    usable = labels.where("doc_id is not null and toxic in (0, 1)")
    if fold:
        usable = usable.where(F.crc32(ids.cast("binary")) % fold[0] != fold[1])
    rows = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    rows = rows.orderBy(F.md5(ids.cast("binary")), "doc_id").limit(sample)  # 12 bytes a row: a proven bound for the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").select("doc_id", "y", "text")
    made = texts.transform(arrow, _extract, "doc_id long, y int, f binary").distinct()
    scratch = Scratch(docs.sparkSession, "examples")
    made = table = scratch.table(made)
    # where the sum goes over `most` is found without the features: a window over all rows is one task's
    place = lambda: F.struct(F.md5(ids.cast("binary")).alias("m"), "doc_id", F.sha2("f", 256).alias("d"))
    sizes = made.select(place().alias("at"), (F.octet_length("f") / 4).alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    last = upto.where(F.col("upto") <= most).agg(F.max("at").alias("at")).select("at.*").first()
    if last["m"] is None:
        made = made.limit(0)
    else:
        made = made.where(place() <= F.struct(F.lit(last["m"]).alias("m"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["d"]).alias("d")))
    # a part at a time, and row by row: the driver never holds the sets twice
    found = {(zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["f"])): r["y"] for r in made.select("doc_id", "y", "f").toLocalIterator()}
    scratch.drop(table)
    return [(k[1], (np.frombuffer(k[2], np.int32), found[k])) for k in sorted(found)]


def learn(examples: list[Example], model: Ftrl, updates: int = UPDATES) -> Ftrl:
    """Whole passes over the examples, each in another seeded order, until `updates` are through."""
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(-(-updates // len(examples)) if examples else 0):
        for k in rng.permutation(len(examples)).tolist():
            model.learn(examples[k][0].astype(np.int64), examples[k][1])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: tuple[int, int] | None = (4, 2), updates: int = UPDATES) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights and the intercept, from at most `sample` labelled rows outside the held-out fold; see _examples.

    Without labelled rows all scores are 0.5.
    """
    out = learn([e for _, e in _examples(docs, labels, sample, fold)], Ftrl(), updates).compact()
    trim()  # the features are gone: the driver has other stages to run
    return out


def losses(docs: DataFrame, labels: DataFrame, settings: list[dict], sample: int = SAMPLE, fold: tuple[int, int] | None = (4, 2), updates: int = UPDATES, parts: int = 3) -> list[tuple[float, float, dict]]:
    """(mean log loss, share of wrong answers at CUT, setting) of each setting, best first, by cross-validation.

    Every part is crc32(doc_id) div 4 mod `parts` of the rows outside the held-out fold, whose labels
    are never read: Ftrl's defaults come from here.
    """
    known = _examples(docs, labels, sample, fold)
    out = []
    for setting in settings:
        loss, wrong = [], []
        for part in range(parts):
            mine = [zlib.crc32(str(i).encode()) // 4 % parts == part for i, _ in known]
            model = learn([e for (_, e), m in zip(known, mine, strict=True) if not m], Ftrl(**setting), updates)
            w = model.weights(np.arange((1 << BITS) + 1))
            for (_, (f, y)), m in zip(known, mine, strict=True):
                if m:
                    p = 1 / (1 + np.exp(-np.clip(w[f].sum() + w[-1], -35, 35)))
                    loss.append(-np.log(max(1e-15, p if y else 1 - p)))
                    wrong.append((p >= CUT) != bool(y))
        out.append((float(np.mean(loss)), float(np.mean(wrong)), setting))
    return sorted(out, key=lambda x: x[:2])


def _scorer(index: np.ndarray, value: np.ndarray, intercept: float):  # noqa: ANN202
    dense = np.zeros(1 << BITS, dtype=np.float32)
    dense[index] = value

    def scored(column: pa.Array) -> np.ndarray:
        out = np.full(len(column), intercept)
        for lo, hi, at, words, stems in hashed_words(column, ALNUM, STEM):
            row, f = features(words, stems, at)
            some = np.flatnonzero(dense[f])
            both = np.unique((row[some] << BITS) | f[some])
            out[lo:hi] += np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return scored


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted of each row; a null or empty text has the intercept's score.

    Repeated rows give repeated rows, an empty table none; a null doc_id stays null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2^20 pairs: 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(*sent.value)
        for batch in batches:
            p = scored(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.transform(arrow, run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `cut`; nulls and repeated rows as in score()."""
    sent, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array(scored(batch.column(at)) < cut))

    return docs.transform(arrow, run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: tuple[int, int] = (4, 2), cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; see train and score."""
    out = score(docs, train(docs, labels, sample, fold), cut)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
