"""Token ids in segments: one array of ids after another, with Elias-Fano document boundaries.

File format (a Parquet table, so that Spark's commit protocol makes writes safe against lost
executors and any store that Spark reaches can hold it).  A row is a segment:

  part, segment   its place: segments follow each other in this order, documents in ascending doc_id
  before          ids in the part's earlier segments
  n_docs, n_ids   documents and ids in it
  n_null          documents without doc_id (they come first)
  first, last     the smallest and the largest doc_id
  doc_low_bits, doc_low, doc_high, doc_marks    Elias-Fano code of doc_id - first of the documents that have one
  end_low_bits, end_low, end_high, end_marks    Elias-Fano code of the documents' ends in the segment
  width, ids      bytes of an id (2 or 4, by vocabulary), the ids, little-endian

A value's high part is written in unary (a 1 for each document, a 0 for each step), its low bits are
packed.  marks has the bit place of every 256th 1 as 32-bit integers: select starts there, so that an
offset is read from a few bytes, and opening a segment builds nothing.  A document costs
2 + log2(ids / documents) bits and an eighth of a bit for marks in place of a 64-bit entry.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._ship import arrow
from ._words import mix, text_bytes

SEGMENT = 1 << 20  # ids after which a segment is closed; a longer document is a segment of its own
SAMPLE = 256  # values for each mark
RUN = 1 << 19  # bytes of text that are encoded at once
END = 0
_CODE = "{0}_low_bits int, {0}_low binary, {0}_high binary, {0}_marks binary"
SCHEMA = f"part int, segment int, before long, n_docs long, n_ids long, n_null long, first long, last long, {_CODE.format('doc')}, {_CODE.format('end')}, width int, ids binary"


# --- Elias-Fano


def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Non-decreasing, non-negative values as (low bits, packed low parts, unary high parts, marks)."""
    n = len(values)
    if not n:
        return 0, b"", b"", b""
    values = values.astype(np.uint64)
    low_bits = max(0, int(values[-1] // np.uint64(n)).bit_length() - 1)
    low = values & np.uint64((1 << low_bits) - 1)
    places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    ones = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
    ones[places] = 1
    bits = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1 if low_bits else np.zeros(0, np.uint8)
    pack = lambda x: np.packbits(x, bitorder="little").tobytes()
    return low_bits, pack(bits.ravel()), pack(ones), places[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Reads one code from its bytes: `select(i)` returns one value, `block(k)` the k-th SAMPLE values."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, marks: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.marks = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(marks, "<u4")

    def _low(self, i: int, j: int) -> np.ndarray:
        """The low parts of values i to j - 1."""
        if not self.low_bits:
            return np.zeros(j - i, np.int64)
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].reshape(j - i, self.low_bits)
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def block(self, k: int) -> np.ndarray:
        i, j = k * SAMPLE, min((k + 1) * SAMPLE, self.n)
        from_ = int(self.marks[k]) >> 3
        to = (int(self.marks[k + 1]) >> 3) + 1 if k + 1 < len(self.marks) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[from_:to], bitorder="little")) + from_ * 8
        places = places[np.searchsorted(places, int(self.marks[k])) :][: j - i]
        return (places - np.arange(i, j)) << self.low_bits | self._low(i, j)

    def values(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self.block(k) for k in range(len(self.marks)))])

    def select(self, i: int) -> int:
        """Value i, read from its mark on."""
        place = int(self.marks[i // SAMPLE])
        byte, left = place >> 3, i % SAMPLE
        ones = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (n := ones.bit_count()) <= left:
            left, byte = left - n, byte + 1
            ones = int(self.high[byte])
        for _ in range(left):
            ones &= ones - 1
        at = byte * 8 + (ones & -ones).bit_length() - 1
        return (at - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def rank(self, value: int) -> int:
        """How many values are smaller: a bisection over select."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) < value else (lo, mid)
        return lo


# --- encoding

# Classes of bytes: 0 others, 1 a-z and A-Z, 2 ASCII punctuation, 3 blanks, 4 the line feed, 5 beyond ASCII, 6 blanks by some definitions.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[128:] = 5
_CLASS[28:32] = 6
_BLANK = np.isin(_CLASS, (3, 4, 6))
# Pairs that a token may not go over: text before a blank, a letter before punctuation, a line feed before text.
_APART = np.zeros((8, 8), dtype=bool)
_APART[np.ix_((0, 1, 2, 5), (3, 4))] = _APART[np.ix_((1, 5), (2,))] = _APART[np.ix_((4,), (0, 1, 2))] = True
_APART = _APART.ravel()


def _after_wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For places after a byte beyond ASCII, what the character before may be: 1 a letter for sure, 2 a blank, 0 else."""
    one, two, three = (np.where(at >= k, data[np.maximum(at - k, 0)], 0).astype(np.int64) for k in (1, 2, 3))
    pair = three << 8 | two
    blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (pair == 0xE19A) | (pair == 0xE280) | (pair == 0xE281) | (pair == 0xE380)
    # U+00C0 to U+017F but for two signs, U+0400 to U+047F
    letter = (two == 0xC3) & (one != 0x97) & (one != 0xB7) | (two == 0xC4) | (two == 0xC5) | (two == 0xD0) | (two == 0xD1)
    return np.where(blank, 2, np.where(letter, 1, 0))


def cuts(data: np.ndarray, within_words: bool = True) -> np.ndarray:
    """Places that no token of the byte-level pattern goes over, and whose sides have the same tokens alone.

    Before a blank that follows text; after a single line feed between texts; and, within_words,
    between a letter and ASCII punctuation.  A place in doubt is left out.
    """
    kind = _CLASS[data]
    at = np.flatnonzero(_APART[(kind[:-1] << 3) | kind[1:]]) + 1
    before, now = kind[at - 1], kind[at]
    ok = np.ones(len(at), dtype=bool)
    wide = np.flatnonzero(before == 5)
    what = _after_wide(data, at[wide])
    ok[wide] = np.where(now[wide] == 2, what == 1, what != 2)
    feed = np.flatnonzero(before == 4)
    ends = np.maximum(at[feed] - 2, 0)
    ok[feed] = (at[feed] >= 2) & ~_BLANK[data[ends]] & (kind[ends] != 5)
    return at[ok if within_words else ok & (now != 2)]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1], and so on."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class _Encoder:
    """Ids of texts, piece by piece; a piece goes from one cut to the next and has the space before it.

    A piece has the same ids alone as in its text: see cuts().  The ids of pieces of up to LONGEST
    bytes are kept in a table of fixed size with one place for each value of some bits of their hash:
    a new piece takes the place of an old one, and a place is used only for exactly its piece.  A
    tokenizer with another kind of pattern, or special tokens with blanks, encodes whole texts instead.
    """

    PLACES, WIDE, WORDS = 19, 10, 3  # bits of a place, ids kept of a piece, eight bytes each that a kept piece may have
    LONGEST = 8 * WORDS

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end, self.cuttable = end, _cuttable(path)
        n = 1 << self.PLACES
        self.word = [np.zeros(n, np.uint64) for _ in range(self.WORDS)]
        self.bytes, self.size, self.ids = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros((n, self.WIDE), self.type)
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        # the signs of a space and of a line feed in byte-level vocabularies
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.feed = vocabulary.get("\u010a", -1)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many for each, where) of pieces.

        Pieces that start with a space, and have no other blank, are encoded as one text that is cut
        where an id starts with a space; those without a blank likewise, with a line feed between two.
        """
        size = ends - starts
        blanks = np.concatenate([[0], np.cumsum(_BLANK[data])])
        led = data[starts] == 32
        plain = (blanks[ends] - blanks[starts] == led) & (size > led)
        n, at, got, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [np.zeros(0, self.type)], 0
        for spaced in (True, False):
            rows = np.flatnonzero(plain & (led == spaced))
            for lo in range(0, len(rows), 2048):
                some = rows[lo : lo + 2048]
                if spaced:
                    text = data[_ragged(starts[some], size[some])]
                else:
                    text = np.insert(data[_ragged(starts[some], size[some])], np.cumsum(size[some])[:-1], 10)
                made = self.whole([text.tobytes().decode("utf-8", "replace")])[0]
                first = np.flatnonzero(self.spaced[made]) if spaced else np.append(0, np.flatnonzero(made == self.feed) + 1)
                if len(first) == len(some) and first[0] == 0:
                    at[some], n[some] = first + total, np.diff(first, append=len(made) + (not spaced)) - (not spaced)
                    got.append(made)
                    total += len(made)
                else:
                    plain[some] = False
        rest = np.flatnonzero(~plain)
        for lo in range(0, len(rest), 1024):
            some = rest[lo : lo + 1024]
            for k, made in zip(some.tolist(), self.whole([data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in some.tolist()]), strict=True):
                at[k], n[k] = total, len(made)
                got.append(made)
                total += len(made)
        return np.concatenate(got), n, at

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each) of the pieces of one run of bytes."""
        size = ends - starts
        padded = np.concatenate([data, np.zeros(8 * self.WORDS, np.uint8)])
        every = np.ndarray(len(data) + 8 * (self.WORDS - 1) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        words = [every[starts] & self.mask[np.minimum(size, 8)]]
        key = words[0] + size.astype(np.uint64)
        for k in range(1, self.WORDS):
            w = np.zeros(len(starts), np.uint64)
            more = np.flatnonzero(size > 8 * k)
            w[more] = every[starts[more] + 8 * k] & self.mask[np.minimum(size[more] - 8 * k, 8)]
            key[more] = mix(key[more]) + w[more]
            words.append(w)
        place = (mix(key) >> np.uint64(64 - self.PLACES)).astype(np.int64)
        known = self.bytes[place] == size  # never more than LONGEST
        for k in range(self.WORDS):
            known &= self.word[k][place] == words[k]
        sizes = self.size[place].astype(np.int64)
        miss = np.flatnonzero(~known)
        if len(miss):
            # equal pieces of a run are encoded once
            by = miss[np.lexsort((size[miss], key[miss]))]
            other = size[by[1:]] != size[by[:-1]]
            for w in words:
                other |= w[by[1:]] != w[by[:-1]]
            first = np.concatenate([[True], other | (size[by[1:]] > self.LONGEST)])
            of = np.empty(len(starts), np.int64)
            of[by] = np.cumsum(first) - 1
            one, of = by[first], of[miss]
            fresh, n, at = self._new(data, starts[one], ends[one])
            sizes[miss] = n[of]
        # from the table, or from what is new
        out = np.empty(int(sizes.sum()), self.type)
        begin = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(known)
        out[_ragged(begin[hit], sizes[hit])] = self.ids.ravel()[_ragged(place[hit] * self.WIDE, sizes[hit])]
        if len(miss):
            out[_ragged(begin[miss], sizes[miss])] = fresh[_ragged(at[of], sizes[miss])]
            keep = np.flatnonzero((n <= self.WIDE) & (size[one] <= self.LONGEST))
            p, some = np.unique(place[one[keep]], return_index=True)  # of several pieces for a place, one
            some = keep[some]
            one, n, at = one[some], n[some], at[some]
            for k in range(self.WORDS):
                self.word[k][p] = words[k][one]
            self.bytes[p], self.size[p] = size[one], n
            self.ids.ravel()[_ragged(p * self.WIDE, n)] = fresh[_ragged(at, n)]
        return out, sizes

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, ends by row) over runs of rows; every text's last id is `end`."""
        data, at = text_bytes(column)
        rows, lo = len(at) - 1, 0
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + RUN, side="right")) - 1)
            part, edge = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            if not self.cuttable:
                made = [np.append(x, self.type.type(self.end)) for x in self.whole([t or "" for t in column.slice(lo, hi - lo).to_pylist()])]
                yield lo, hi, np.concatenate(made), np.cumsum([len(x) for x in made])
            else:
                ids, ends = self._run(part, edge)
                yield lo, hi, ids, ends
            lo = hi

    def _run(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends by text) of the texts between edges of data."""
        texts = np.flatnonzero(np.diff(edge))
        raw = data.tobytes()
        starts = np.concatenate([cuts(data, not any(t in raw for t in self.special)), edge[texts]])
        starts.sort(kind="stable")  # two sorted runs
        starts = starts[np.append(True, starts[1:] != starts[:-1])] if len(starts) else starts
        ends = np.append(starts[1:], len(data))
        made, count, lo = [np.zeros(0, self.type)], [np.zeros(0, np.int64)], 0
        while lo < len(starts):  # a text longer than RUN goes through in parts
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + RUN, side="right")))
            a, b = int(starts[lo]), int(ends[hi - 1])
            ids, n = self._pieces(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
            made.append(ids)
            count.append(n)
            lo = hi
        ids, count = np.concatenate(made), np.concatenate(count)
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, edge[1:])]
        return np.insert(ids, upto, self.type.type(self.end)), upto + np.arange(1, len(edge))


def _cuttable(path: str) -> bool:
    """Whether a tokenizer's file names the parts that cuts() relies on."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("add_prefix_space") is False and before.get("use_regex", True)
    plain = plain and made.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    plain = plain and made.get("truncation") is None and made.get("padding") is None
    return plain and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens") or ())


def _code(name: str, values: np.ndarray) -> dict:
    return dict(zip((f"{name}_low_bits", f"{name}_low", f"{name}_high", f"{name}_marks"), ef_encode(values), strict=True))


def _segment(part: int, number: int, before: int, ids: list[int | None], ends: list[int], chunks: list[bytes], width: int) -> dict:
    have = np.array([i for i in ids if i is not None], dtype=np.int64)
    first = int(have[0]) if len(have) else 0
    away = (have.view(np.uint64) - np.uint64(first & (1 << 64) - 1)) if len(have) else have
    return {
        "part": part, "segment": number, "before": before, "n_docs": len(ids), "n_ids": ends[-1], "n_null": len(ids) - len(have), "first": first, "last": int(have[-1]) if len(have) else None,
        **_code("doc", away), **_code("end", np.array(ends, dtype=np.int64)), "width": width, "ids": b"".join(chunks),
    }


def _writer(path: str, end: int, segment: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corvane.llm import _ship

        encoder = _ship.kept.get((path, end)) or _ship.kept.setdefault((path, end), _Encoder(path, end))
        part, number = TaskContext.get().partitionId(), 0
        ids, ends, chunks, size, before = [], [], [], 0, 0
        width = encoder.type.itemsize

        def close() -> pa.RecordBatch:
            nonlocal number, ids, ends, chunks, size, before
            row = _segment(part, number, before, ids, ends, chunks, width)
            number, ids, ends, chunks, size, before = number + 1, [], [], [], 0, before + size
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, made, upto in encoder.encode(batch.column(1)):
                j = 0
                while j < hi - lo:  # whole documents, up to the one that fills the segment
                    begin = int(upto[j - 1]) if j else 0
                    stop = min(hi - lo, int(np.searchsorted(upto, begin + segment - size)) + 1)
                    ids += names[lo + j : lo + stop]
                    ends += (upto[j:stop] - begin + size).tolist()
                    chunks.append(made[begin : int(upto[stop - 1])].tobytes())
                    size, j = size + int(upto[stop - 1]) - begin, stop
                    if size >= segment:
                        yield close()
        if ids:
            yield close()

    return run


ARROW = pa.schema(
    [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))]
)


def write_tokens(docs: DataFrame, where: str, tokenizer: str, end: int = END, segment: int = SEGMENT) -> None:
    """Encodes docs (doc_id, text) in ascending doc_id order, null ids first, ties by a hash of the text, into `where`.

    Ids are those of the library's plain call with add_special_tokens=False: a special token's string
    in a text gives its id.  A null text is an empty one, and every document ends with the id `end`.
    Texts are dealt by ranges of doc_id, hash and place, so that neither null nor repeated ids are one
    task's, and sorted within.  An empty table gives an empty one.
    """
    order = ["doc_id", "_tie", "_place"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.transform(arrow, _writer(tokenizer, end, segment), SCHEMA, True).write.option("compression", "uncompressed").parquet(where)


class Segment:
    """A row of the file: document numbers are places in it, from 0."""

    def __init__(self, row: dict) -> None:
        code = lambda name, n: EliasFano(n, *(row[f"{name}_{x}"] for x in ("low_bits", "low", "high", "marks")))
        self.n_docs, self.n_null, self.first, self.last = row["n_docs"], row["n_null"], row["first"], row["last"]
        self.docs, self.ends = code("doc", row["n_docs"] - row["n_null"]), code("end", row["n_docs"])
        self.ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")

    def span(self, k: int) -> tuple[int, int]:
        """Where document k's ids are: two selects."""
        return self.ends.select(k - 1) if k else 0, self.ends.select(k)

    def find(self, doc_id: int) -> list[int]:
        """The numbers of the documents that have a doc_id."""
        k = self.docs.rank(doc_id - self.first) if self.last is not None and self.first <= doc_id <= self.last else self.docs.n
        out = []
        while k < self.docs.n and self.docs.select(k) + self.first == doc_id:
            out.append(self.n_null + k)
            k += 1
        return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            s, before = Segment(row), 0
            docs = [None] * s.n_null + (s.docs.values() + s.first).tolist()
            for k in range(len(s.ends.marks)):
                ends = s.ends.block(k)
                starts = np.concatenate([[before], ends[:-1]])
                crc = [zlib.crc32(s.ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[k * SAMPLE : k * SAMPLE + len(ends)], pa.int64()), pa.array(starts + row["before"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                before = int(ends[-1])


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a table that write_tokens made."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")).alias("base"))
    # a row of 12 bytes for each task that wrote, however many ids it wrote
    placed = segments.join(F.broadcast(base), "part").withColumn("before", F.col("base") + F.col("before"))
    return placed.transform(arrow, _reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(segments: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the asked documents: segments that can't hold one are never opened, offsets come by select.

    doc_ids is the caller's own list.  Repeated documents come back each; an id that is nowhere gives no row.
    """
    wanted = sorted({int(i) for i in doc_ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                for i in wanted:
                    for k in s.find(i):
                        a, b = s.span(k)
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([s.ids[a:b].astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    held = F.lit(False)
    if wanted:
        held = (F.col("first") <= wanted[-1]) & (F.col("last") >= wanted[0])
    return segments.where(held).transform(arrow, run, "doc_id long, ids array<long>")


def token_table(docs: DataFrame, tokenizer: str, end: int = END, segment: int = SEGMENT) -> DataFrame:
    """Writes the documents to the shared folder and reads them back; see write_tokens and read_tokens."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, where := f"{scratch.where}/ids", tokenizer, end, segment)
    return read_tokens(docs.sparkSession.read.parquet(where))
