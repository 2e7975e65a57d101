"""BPE and the token store against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronopanel.llm import bpe, spans, token_store
from chronopanel.llm.shared import shared_path


@pytest.fixture(scope="module")
def byte_level():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def word_level():
    t = Tokenizer.from_file(token_store.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_of_every_character_and_of_random_strings(byte_level):
    rng = random.Random(3)
    texts = ["a" + chr(c) + "1 " + chr(c) + " b" for c in [*range(0x3000), *range(0x4E00, 0xD7FF, 97), *range(0xE000, 0x20000, 91)]]
    texts += ["".join(rng.choice(" abAB'st.,\n\t1é|<>") for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcd") for _ in range(3000)), "a" * 700, "don't'll I'm '' 's", "a\n\n  b \n c"]
    vocab = bpe.vocabulary(bpe.default_vocabulary(), bpe.default_pattern())
    raw, offsets = spans.text_buffer(pa.array(texts))
    got, bounds = vocab.encode(raw, offsets)
    for k, x in enumerate(byte_level.encode_batch(texts, add_special_tokens=False)):
        assert got[bounds[k] : bounds[k + 1]].tolist() == x.ids, texts[k]
    assert bpe.decoded(vocab, got, bounds).to_pylist() == texts


def test_pairs_are_compatible_exactly_where_merging_keeps_them():
    vocab, rng = bpe.vocabulary(bpe.default_vocabulary(), bpe.default_pattern()), np.random.default_rng(5)
    known = np.array([i for i, b in enumerate(vocab.bytes) if b and i != 50256 and vocab.merged(b) == [i]])
    a, b = rng.choice(known, 3000), rng.choice(known, 3000)
    want = [vocab.merged(vocab.bytes[x] + vocab.bytes[y]) == [x, y] for x, y in zip(a, b)]
    assert vocab.compatible(a, b).tolist() == want


def test_encode_and_decode_of_odd_rows(odd_docs, odd_rows, byte_level):
    coded = bpe.encode(odd_docs)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in coded.collect()) == sorted((i or 0, ids(byte_level, t)) for i, t in odd_rows)
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(coded).collect()) == sorted((i or 0, t or "") for i, t in odd_rows)


def test_no_rows(no_docs, spark):
    assert bpe.encode(no_docs, with_text=True).collect() == []
    path = token_store.write(no_docs, shared_path(spark, "empty-store"))
    assert token_store.read(spark, path, no_docs, "doc_id").collect() == []


def test_store_of_odd_rows(odd_docs, odd_rows, spark, word_level):
    path = token_store.write(odd_docs, shared_path(spark, "odd-store"))
    want, at = [], 0
    for i, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        run = np.array([*ids(word_level, t), 2], "<u4")
        want.append((i, at, len(run), zlib.crc32(run.tobytes())))
        at += len(run)
    back = token_store.read(spark, path, odd_docs, "doc_id").withColumn("crc", F.crc32("payload"))
    assert sorted(((r.key, r.start, r.n, r.crc) for r in back.collect()), key=lambda r: r[1]) == want
    absent = spark.createDataFrame([(99,), (4,)], "doc_id bigint")
    assert sorted(r.key for r in token_store.locate(spark, path, absent, "doc_id").collect()) == [4, 4]


def test_library_encoder_cuts_nothing_apart(word_level):
    rng = random.Random(4)
    texts = ["".join(rng.choice(" abAB'st.,\n\t1éÉ|<>́") for _ in range(rng.randrange(40))) for _ in range(2000)] + ["<|startoftext|>a <|ENDOFTEXT|> b<|endoftext|>"]
    coder = token_store.LibraryEncoder(token_store.default_vocabulary())
    raw, offsets = spans.text_buffer(pa.array(texts))
    got, bounds = coder.encode(raw, offsets, 2)
    for k, t in enumerate(texts):
        assert got[bounds[k] : bounds[k + 1]].tolist() == [*ids(word_level, t), 2], t


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 4000):
        h1, h2 = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        seeds = token_store.perfect_hash(h1, h2)
        assert sorted(token_store.slots_of(h1, h2, seeds, n).tolist()) == list(range(n))
