"""Encoding against the tokenizers library, and the way back."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlane.llm.bpe import bpe_decode, bpe_roundtrip, encode_texts, load_vocabulary
from splitlane.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "", " ", "  a", "a  b   c \n\n d\t\te", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "I'll don't  we've",
    "a" * 25, "eeeeeee eeeee ee", "d\x1ce\x1df᠎g​h﻿\u0085i", "日本語テキスト 中文", "\U0001f600\U0001f601 x",
    "½ ² ٣ ৪ x1y2", "a\x00b\x1f", "\r\n\r\n  x", "____----!!!! ??", "'S 'LL 's's", "!\n !",
]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(vocabulary_path())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def test_ids_equal_the_library(vocabulary, library):
    rnd = random.Random(1)
    letters = "ab c\n'sté1² \x1c\x85 日\U0001f600!<|>\t"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode_texts(vocabulary, texts)] == expected


def test_roundtrip_of_awkward_rows(clashing, vocabulary, library):
    rows = bpe_roundtrip(clashing, vocabulary).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
        assert r.size == "mine size"


def test_table(small, vocabulary, library):
    got = bpe_roundtrip(small.select("doc_id", "text"), vocabulary).select("text", F.sha2("ids", 256).alias("sha"))
    for r in got.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4")
        assert r.sha == hashlib.sha256(ids.tobytes()).hexdigest()


def test_decoding_ids_that_are_not_text(spark, vocabulary):
    ids = [vocabulary.byte_ids[[255]].astype("<u4").tobytes(), b"", None]
    frame = spark.createDataFrame([(x,) for x in ids], "ids binary")
    assert [r[0] for r in frame.select(bpe_decode(F.col("ids"), vocabulary)).collect()] == ["�", "", None]


def test_no_documents(nothing, vocabulary):
    assert bpe_roundtrip(nothing, vocabulary).count() == 0
