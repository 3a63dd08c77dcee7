from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import tokens
from corvane.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, n_tokens string"


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, dtype=np.int64))
    code = tokens.EliasFano(len(values), *tokens.ef_encode(values))
    assert (code.values() == values).all()
    for i in range(0, len(values), 7):
        assert code.select(i) == values[i] and code.rank(int(values[i])) == np.searchsorted(values, values[i])


@pytest.fixture(scope="module")
def encoder():
    return tokens._Encoder(TOKENIZER, 0)


def plain(texts):
    """The library's own call, as the contract names it."""
    whole = Tokenizer.from_file(TOKENIZER)
    return [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def encoded(encoder, texts):
    out = []
    for lo, hi, ids, ends in encoder.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, ends)[: hi - lo]]
    return out


ALPHABET = ["a", "B", "b'", "'s", "don't", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u1680", ".", ",", "...", "!", "1", "23", "\u00e9", "\u00d7", "\u00f7", "\u0416", "\u0482", "\u4e2d", "\u2026", "\U0001f600", "<|endoftext|>", "<|", "|>", "endoftext"]


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=6))
@settings(max_examples=500, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(encoder, texts):
    assert encoder.cuttable and encoded(encoder, texts) == plain(texts)


def test_long_texts_and_full_tables(encoder, monkeypatch):
    """Texts beyond a run, words beyond a place, more pieces than places; the memo's state changes nothing."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abc\u00e9\u0448,."), rng.integers(1, 70)))
    texts = [" ".join(word() for _ in range(int(n))) for n in (1, 300, 0, 2000, 3)] + ["x" * 5000, " " * 400, None]
    monkeypatch.setattr(tokens, "RUN", 700)
    small = tokens._Encoder(TOKENIZER, 0)
    small.PLACES = 4
    for made in (encoder, small):
        for _ in range(2):
            assert encoded(made, texts) == plain([t or "" for t in texts])


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    made, whole, texts = tokens._Encoder(path, 0), Tokenizer.from_file(path), ["One two  three, don't", "", "\u00e9 x"]
    assert not made.cuttable
    assert encoded(made, texts) == [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_table_is_the_round_trip(spark, tmp_path):
    rows = [(5, "one two  three", "x", "y"), (None, None, None, None), (None, "n <|endoftext|> m", "x", None), (-7, "", "x", None), (3, "word " * 3000, None, "z"), (3, "alpha", None, "z"), (3, "alpha", None, "z"), (9, "\u00e9 \u00fc\n\n \u00df", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in tokens.token_table(docs, TOKENIZER, segment=1000).collect()), key=lambda r: r[1])
    texts = {}
    for i, t, *_ in rows:
        ids = np.array(plain([t or ""])[0], "<u4")
        texts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    for i, some in texts.items():
        assert sorted(r[2:] for r in got if r[0] == i) == sorted(some)
    assert tokens.token_table(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0

    tokens.write_tokens(docs, f"file://{tmp_path}/ids", TOKENIZER, segment=50)
    asked = tokens.read_documents(spark.read.parquet(f"file://{tmp_path}/ids"), [9, 3, -7, 1000]).collect()
    want = [(i, plain([t])[0]) for i, t, *_ in rows if i in (9, 3, -7)]
    assert sorted((r.doc_id, r.ids) for r in asked) == sorted(want)


def test_null_and_repeated_ids_go_to_several_tasks(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.concat(F.lit("same "), (F.col("id") % 5).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(rows, f"file://{tmp_path}/ids", TOKENIZER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(f"file://{tmp_path}/ids").groupBy("part").agg(F.sum("n_docs")).collect()
    assert len(parts) == 4 and max(r[1] for r in parts) < 2000
