"""Language ID: TF-IDF n-gram vectors against several clustered centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ship import arrow
from ._words import LOWER, PIECE

DIMS = 1 << 13  # hashed n-grams
WIDTHS = (1, 2, 3)  # characters of an n-gram
SAMPLE = 500  # rows that the model learns from for each language, about
TOTAL = 3000  # and for all languages together, about: the driver holds 32 kB for each
CENTROIDS = 4
REJECT = 0.2  # a best cosine under this is marked as rejected
LEARNED = 2_000  # languages that a model knows at most, those with most rows: CENTROIDS x 64 kB each, 512 MB in all

_SPACE = LOWER[:128].astype(np.uint32)
_SPACE[:65] = 32  # white space, digits and punctuation are one sign
_SPACE[[*range(91, 97), *range(123, 128)]] = 32
_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of one text's characters; long texts go through in pieces.

    A-Z count as a-z; all ASCII that is no letter is one sign.
    """
    out = np.zeros(DIMS, dtype=np.int64)
    reach = max(WIDTHS) - 1
    for lo in range(0, len(text), PIECE):
        part = np.frombuffer(text[max(0, lo - reach) : lo + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        part = np.where(part < 128, _SPACE[np.minimum(part, 127)], part)
        fresh = min(lo, reach)  # the first characters only complete n-grams of the piece before
        for n in WIDTHS:
            if len(part) < n:
                continue
            h = np.zeros(len(part) - n + 1, dtype=np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + part[j : j + len(h)]
            h = (h[max(0, fresh - n + 1) :] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out += np.bincount(h >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    language: list[str]  # by centroid

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.centroids.T

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        """Unit vectors of log counts times idf; a text without n-grams is the zero vector."""
        v = np.log1p(tf) * self.idf
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; fewer centroids if there are fewer different vectors."""
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[own == j].sum(axis=0) for j in range(len(centres)) if (own == j).any()])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres


def fit(rows: list[tuple[str, np.ndarray]], centroids: int = CENTROIDS) -> Model:
    """rows: language and n-gram counts."""
    rows = [r for r in rows if r[1].any()]
    if not rows:
        return Model(np.ones(DIMS), np.zeros((0, DIMS)), [])
    tf = np.stack([c for _, c in rows]).astype(np.float32)
    model = Model(np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1, np.zeros((0, DIMS)), [])
    x, lang, rng = model.vectors(tf).astype(np.float32), np.array([a for a, _ in rows]), np.random.Generator(np.random.PCG64(5))
    parts = []
    for name in sorted(set(lang.tolist())):
        made = _cluster(x[lang == name], centroids, rng)
        parts.append(made)
        model.language += [name] * len(made)
    model.centroids = np.concatenate(parts).astype(np.float64)
    return _pure(model, x, lang)


def _pure(model: Model, x: np.ndarray, lang: np.ndarray) -> Model:
    """Without centroids that wrongly labelled rows made: most rows nearest to one must have its language.

    A language none of whose centroids passes keeps the one with the largest share.
    """
    own, name = (x @ model.centroids.T.astype(np.float32)).argmax(axis=1), np.array(model.language)
    share = np.array([(lang[own == j] == name[j]).mean() if (own == j).any() else 0.0 for j in range(len(name))])
    best = {a: max(np.flatnonzero(name == a).tolist(), key=lambda j: share[j]) for a in set(model.language)}
    keep = [j for j in range(len(name)) if share[j] > 0.5 or best[model.language[j]] == j]
    return Model(model.idf, model.centroids[keep], [model.language[j] for j in keep])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text in batch.column(2).to_pylist():
            c = counts(text or "")
            on = np.flatnonzero(c)
            made.append(np.stack([on, c[on]]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "lang", "c"])


def train(docs: DataFrame, sample: int = SAMPLE, fold: tuple[int, int] = (5, 0), centroids: int = CENTROIDS) -> Model:
    """Learns from text and non-null lang of rows outside the held-out fold.

    All such rows are counted by language; each language then gives the rows with the smallest
    checksums, about `sample` of them (a binomial number with that mean), fewer if there are many
    languages, but about one at least.  The driver holds n-gram counts of about TOTAL rows, or of a
    row for each language, and no texts.  A row that repeats counts as often as it comes.
    """
    ids = F.col("doc_id").cast("string").cast("binary")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where("lang is not null")
    rows = rows.where(F.coalesce(F.crc32(ids) % fold[0] != fold[1], F.lit(True)))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LEARNED).collect()
    if not found:
        return fit([])
    sample = min(sample, -(-TOTAL // len(found)))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in found], "lang string, share double")
    spot = F.conv(F.substring(F.md5(F.coalesce(ids, F.lit(b""))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    rows = rows.join(F.broadcast(share), "lang").where(spot < F.col("share"))  # LEARNED rows at most
    made = []
    for r in rows.select("doc_id", "lang", "text").transform(arrow, _count_rows, "doc_id long, lang string, c binary").collect():
        on, n = np.frombuffer(r["c"], np.int32).reshape(2, -1)
        c = np.zeros(DIMS, dtype=np.int32)
        c[on] = n
        made.append((r["lang"], r["doc_id"] or 0, c))
    made.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    return fit([(lang, c) for lang, _, c in made], centroids)


def identify(docs: DataFrame, model: Model, fold: tuple[int, int] = (5, 0), reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs.

    The nearest centroid's language, its cosine as the score, and whether that cosine is too small to
    trust.  A null text or one without a letter (Unicode category L) is `und` with score 0, as is every
    text if nothing was learned; any other text has a learned language.  Of centroids with equal
    cosines the first counts: languages by code point.  Texts are taken whole; a null doc_id stays null
    and is not held out; repeated rows give repeated rows, an empty table none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 64 kB for each centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if m.language else []
            for lo in range(0, len(rows), 64):
                some = rows[lo : lo + 64]
                cos = m.cosines(m.vectors(np.stack([counts(texts[i]) for i in some]).astype(np.float64)))
                best = cos.argmax(axis=1)
                for i, b, c in zip(some, best.tolist(), cos[np.arange(len(some)), best].tolist(), strict=True):
                    lang[i], score[i] = m.language[b], min(1.0, max(0.0, c))
            low = pa.array((score < reject) & np.array([x != "und" for x in lang], dtype=bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), low], ["doc_id", "lang_pred", "score", "rejected"])

    out = docs.selectExpr("cast(doc_id as long) as doc_id", "text").transform(arrow, run, "doc_id long, lang_pred string, score double, rejected boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def languages(docs: DataFrame, sample: int = SAMPLE, fold: tuple[int, int] = (5, 0), centroids: int = CENTROIDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs, learned from docs themselves; see train and identify."""
    return identify(docs, train(docs, sample, fold, centroids), fold)
