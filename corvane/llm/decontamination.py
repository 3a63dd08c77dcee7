"""Benchmark decontamination: a BM25 index of test items, block-max WAND, overlap of question and answer.

A text is cut into passages for each item by the item's own length: 128 words, or the next power of
two from twice the item's words on; one passage starts every half passage.  A stretch of at most half
a passage, so any copy that insertions have not made longer than that, lies whole in some passage.
Every passage is a query.  An item's threshold is the least BM25 score that a passage can have which
holds COVER of the item's word shingles: no such passage is missed.  Scores are divided by that
threshold, so that one limit, 1, holds for all items.  What is found is verified: the passage must
hold COVER of the item's shingles, and PART of its question's and of its answer's.  No item's result
depends on other items or on how the items are dealt to indexes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ship import arrow
from ._words import ALNUM, hashed_words, shingles

WIDTH = 5
COVER = 0.8
PART = 0.5
PASSAGE = 128
K1, B = 1.2, 0.75
BLOCK = 32  # postings under one maximum
RARE = 4  # of an item's rarest terms, this many more than may be missing are looked at first
#: Words of items in one index; more items are more indexes, each with a pass of its own.  A word takes
#: about 100 bytes in the driver and in each Python worker: 100 MB at this bound.
SHARD_WORDS = 1_000_000
_BLANK = " \t\n\v\f\r"
SENTENCE = re.compile(rf"[.!?](?=[{_BLANK}])")


@dataclass
class Part:
    width: int  # words of a shingle: WIDTH, or all words of a shorter part
    hashes: np.ndarray  # distinct shingles


@dataclass
class Item:
    item_id: int
    n_words: int
    parts: tuple[Part, Part, Part]  # the whole, the question, the answer


@dataclass
class Index:
    items: list[Item]
    terms: np.ndarray  # sorted word hashes
    starts: np.ndarray  # postings of term i are starts[i] to starts[i + 1]
    posted: np.ndarray  # item numbers, ascending in a term
    impact: np.ndarray  # BM25 part over the item's threshold
    ceiling: np.ndarray  # largest impact by term
    block_starts: np.ndarray  # blocks of term i are block_starts[i] to block_starts[i + 1]
    block_last: np.ndarray  # last item and largest impact of each block
    block_most: np.ndarray
    rare_starts: np.ndarray  # by term: items of which it is among the rarest
    rare_items: np.ndarray
    rare_need: np.ndarray  # by item: how many of these a passage must have
    length: int  # words of a passage


def halves(text: str) -> tuple[str, str]:
    """Question and answer: all sentences but the last, and the last; one sentence is all question.

    A sentence ends with . ! or ? before ASCII white space.
    """
    ends = [m.end() for m in SENTENCE.finditer(text.rstrip(_BLANK))]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def passage_words(n_words: int) -> int:
    """The words of an item's passages, from its own words alone."""
    return max(PASSAGE, 1 << (2 * n_words - 1).bit_length())


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for lo, hi, at, words in hashed_words(pa.array(texts, pa.string()), ALNUM):
        out += [words[at[i] : at[i + 1]] for i in range(hi - lo)]
    return out


def _part(words: np.ndarray) -> Part:
    return Part(min(WIDTH, len(words)), np.unique(shingles(words, WIDTH)))


def spare(n: int, cover: float) -> int:
    """How many of n shingles a copy may lack."""
    return n - least(n, cover)


def least(n: int, cover: float) -> int:
    return int(np.ceil(cover * n - 1e-9))


def build(rows: list[tuple[int, str]], cover: float = COVER) -> list[Index]:
    """An index for each passage length; items without a word take no part."""
    rows = sorted({(i, t) for i, t in rows if t})
    whole, parts = _hashes([t for _, t in rows]), [halves(t) for _, t in rows]
    by_length: dict[int, list[tuple[Item, np.ndarray]]] = {}
    for (i, _), w, q, a in zip(rows, whole, _hashes([h[0] for h in parts]), _hashes([h[1] for h in parts]), strict=True):
        if len(w):
            by_length.setdefault(passage_words(len(w)), []).append((Item(i, len(w), (_part(w), _part(q), _part(a))), w))
    return [_build(some, cover, n) for n, some in sorted(by_length.items())]


def _build(some: list[tuple[Item, np.ndarray]], cover: float, length: int) -> Index:
    items, n = [x for x, _ in some], len(some)
    sizes = np.array([len(w) for _, w in some])
    counted = [np.unique(w, return_counts=True) for _, w in some]
    terms, df = np.unique(np.concatenate([t for t, _ in counted]), return_counts=True)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    item = np.repeat(np.arange(n), [len(t) for t, _ in counted])
    term, tf = np.searchsorted(terms, np.concatenate([t for t, _ in counted])), np.concatenate([c for _, c in counted])
    part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / sizes.mean()))
    threshold, need, rare_term, rare_item, at = np.empty(n), np.empty(n, dtype=np.int64), [], [], 0
    for k, (x, (t, _)) in enumerate(zip(items, counted, strict=True)):
        lost = min(spare(len(x.parts[0].hashes), cover), len(t) - 1)  # a missing shingle can take one term with it
        threshold[k] = np.sort(part[at : at + len(t)])[: len(t) - lost].sum()
        first = term[at : at + len(t)][np.lexsort((t, df[term[at : at + len(t)]]))[: lost + RARE]]
        need[k] = len(first) - lost
        rare_term.append(first)
        rare_item.append(np.full(len(first), k))
        at += len(t)
    by_term = np.argsort(term, kind="stable")
    posted, impact = item[by_term], (part / threshold[item])[by_term]
    starts = np.searchsorted(term[by_term], np.arange(len(terms) + 1))
    blocks = -(-np.diff(starts) // BLOCK)
    block_starts = np.concatenate([[0], np.cumsum(blocks)])
    opens = np.repeat(starts[:-1] - block_starts[:-1] * BLOCK, blocks) + np.arange(block_starts[-1]) * BLOCK
    closes = np.append(opens[1:], len(posted))
    rare_term, rare_item = np.concatenate(rare_term), np.concatenate(rare_item)
    by_rare = np.argsort(rare_term, kind="stable")
    return Index(
        items, terms, starts, posted, impact, np.maximum.reduceat(impact, starts[:-1]),
        block_starts, posted[closes - 1], np.maximum.reduceat(impact, opens),
        np.searchsorted(rare_term[by_rare], np.arange(len(terms) + 1)), rare_item[by_rare], need, length,
    )


def wand(index: Index, terms: list[int], limit: float = 1.0 - 1e-9) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least `limit` for a query of distinct terms, by block-max WAND."""
    posted, starts = index.posted, index.starts
    cursors = [[int(posted[starts[t]]), int(starts[t]), int(starts[t + 1]), t] for t in terms]  # item, place, end, term
    out = []
    while cursors:
        cursors.sort()
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += index.ceiling[c[3]]
            if total >= limit:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        most, further = 0.0, None
        for c in cursors[: pivot + 1]:
            lo, hi = int(index.block_starts[c[3]]), int(index.block_starts[c[3] + 1])
            b = bisect_left(index.block_last, item, lo, hi)
            if b < hi:
                most += index.block_most[b]
                further = int(index.block_last[b]) if further is None else min(further, int(index.block_last[b]))
        if most < limit:  # no item up to the first block end can pass
            after = (item if further is None else further) + 1
            if pivot + 1 < len(cursors):
                after = max(item + 1, min(after, cursors[pivot + 1][0]))
            to_move, target = cursors[: pivot + 1], after
        elif cursors[0][0] == item:
            score = sum(index.impact[c[1]] for c in cursors[: pivot + 1])
            if score >= limit:
                out.append((item, float(score)))
            to_move, target = cursors[: pivot + 1], item + 1
        else:
            to_move, target = cursors[:pivot], item
        for c in to_move:
            if c[0] < target:
                c[1] = bisect_left(posted, target, c[1], c[2])
                c[0] = int(posted[c[1]]) if c[1] < c[2] else -1
        cursors = [c for c in cursors if c[1] < c[2]]
    return out


def passages(index: Index, words: np.ndarray) -> list[tuple[int, int]]:
    """(passage number, first word) of the passages of one text that can reach the limit.

    A passage can reach it only if, of some item's rarest terms, it has so many that not more are
    missing than a copy may lack: the first test of WAND, on all passages at once.
    """
    half = index.length // 2
    at = np.searchsorted(index.terms, words)
    at[at == len(index.terms)] = 0
    n = index.rare_starts[at + 1] - index.rare_starts[at]
    hit = np.flatnonzero((index.terms[at] == words) & (n > 0))
    if not len(hit):
        return []
    n = n[hit]
    place = np.repeat(hit, n)
    entry = np.repeat(index.rare_starts[at[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, term = index.rare_items[entry], np.repeat(at[hit], n)
    window = place // half
    window, item, term = (np.concatenate([x, y]) for x, y in ((window, window - 1), (item, item), (term, term)))
    ok = window >= 0
    # each of an item's terms counts once in a passage
    n_items = len(index.items)
    key = np.unique(((window[ok] * n_items + item[ok]) * len(index.terms) + term[ok]))
    pair, count = np.unique(key // len(index.terms), return_counts=True)
    return [(w, w * half) for w in np.unique(pair[count >= index.rare_need[pair % n_items]] // n_items).tolist()]


def search(indexes: list[Index], words: np.ndarray, cover: float = COVER) -> dict[tuple[int, int], tuple[Item, int, int, int, int]]:
    """By index and item: the item, its shingles, its question's and its answer's in the best passage, passages."""
    found: dict[tuple[int, int], tuple[Item, int, int, int, int]] = {}
    for number, index in enumerate(indexes):
        for _, lo in passages(index, words):
            part = words[lo : lo + index.length]
            own = np.unique(part)
            at = np.searchsorted(index.terms, own)
            at[at == len(index.terms)] = 0
            have: dict[int, np.ndarray] = {}
            for k, _ in wand(index, at[index.terms[at] == own].tolist()):
                x = index.items[k]
                for p in x.parts:
                    if p.width not in have:
                        have[p.width] = np.unique(shingles(part, p.width)) if 0 < p.width <= len(part) else part[:0]
                got = tuple(int(np.isin(p.hashes, have[p.width], assume_unique=True).sum()) for p in x.parts)
                if all(n >= least(len(p.hashes), c) for n, p, c in zip(got, x.parts, (cover, PART, PART), strict=True)):
                    old = found.get((number, k), (x, 0, 0, 0, 0))
                    found[number, k] = (x, *max(old[1:4], got), old[4] + 1)
    return found


SCHEMA = "doc_id long, item_id long, n_item long, n_found long, n_question long, n_answer long, n_passages long"


def _indexes(benchmark: DataFrame, cover: float, shard_words: int) -> Iterator[list[Index]]:
    """Indexes of at most about shard_words words; the driver holds one set at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * shard_words)))
    for k in range(n):
        some = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield build([(r[0], r[1]) for r in some.collect()], cover)


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each document and item that a passage holds: `cover` of its distinct shingles, PART of question and answer.

    doc_id, item_id, n_item (the item's distinct five-word shingles; the whole of a shorter item is
    one), n_found, n_question, n_answer (those of the item, of all its sentences but the last, and of
    the last, in the best passage: most of the first, then of the second, then of the third; a part
    of fewer than five words is one shingle), n_passages (how many passages hold the item).  An item
    of one sentence is all question.  Null or empty texts match nothing, nor do items without a word
    or an id; a null doc_id stays null; repeated rows of docs give repeated rows; empty tables give
    none.  Items are told apart by item_id and text.  The index is broadcast: shard_words bounds it,
    and more items than that take further passes.
    """
    spark, out = docs.sparkSession, None
    chosen = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    for indexes in _indexes(benchmark, cover, shard_words):
        sent = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for lo, hi, at, words in hashed_words(batch.column(1), ALNUM) if sent.value else ():
                    for i in range(lo, hi):
                        for x, n, q, a, p in search(sent.value, words[at[i - lo] : at[i - lo + 1]], cover).values():
                            rows.append((ids[i], x.item_id, len(x.parts[0].hashes), n, q, a, p))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        made = chosen.transform(arrow, run, SCHEMA)
        out = made if out is None else out.unionByName(made)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() has no row for; no join, no shuffle.

    Rows with a null or empty text stay, as do repeated rows; an empty benchmark keeps all.
    """
    for indexes in _indexes(benchmark, cover, shard_words):
        sent = docs.sparkSession.sparkContext.broadcast(indexes)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, hi, cuts, words in hashed_words(batch.column(at), ALNUM) if sent.value else ():
                    for i in range(lo, hi):
                        keep[i] = not search(sent.value, words[cuts[i - lo] : cuts[i - lo + 1]], cover)
                yield batch.filter(pa.array(keep))

        docs = docs.transform(arrow, run, docs.schema)
    return docs
