"""Substring and suffix dedup against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlane.llm import repeats, suffix_dedup
from splitlane.llm.substring_dedup import substring_dedup
from splitlane.llm.suffix_dedup import multikey_order


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expected_words(rows, width):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - width + 1 if d is not None else 0):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), sha(b" ".join(kept))))
    return sorted(out, key=str)


def expected_bytes(rows, width):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = collections.Counter(w[i : i + width] for _, w in texts for i in range(len(w) - width + 1))
    out = []
    for d, w in texts:
        gone = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - width + 1):
            if times[w[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), runs, sha(kept)))
    return sorted(out, key=str)


def words_result(docs, **more):
    got = substring_dedup(docs, **more).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=str)


def bytes_result(docs, **more):
    got = suffix_dedup.suffix_dedup(docs, **more)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=str)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_words_of_awkward_rows(clashing):
    assert words_result(clashing) == expected_words(rows_of(clashing), 50)


@pytest.mark.parametrize("width, gram", [(1, 1), (3, 2), (8, 8), (20, 5)])
def test_words_of_other_widths(awkward, width, gram):
    assert words_result(awkward, width=width, gram=gram) == expected_words(rows_of(awkward), width)


def test_words_of_the_table(small):
    assert words_result(small) == expected_words(rows_of(small), 50)


def test_bytes_of_awkward_rows(clashing):
    assert bytes_result(clashing) == expected_bytes(rows_of(clashing), 200)


@pytest.mark.parametrize("width, gram", [(7, 7), (16, 4), (60, 20)])
def test_bytes_of_other_widths(awkward, width, gram):
    assert bytes_result(awkward, width=width, gram=gram) == expected_bytes(rows_of(awkward), width)


@pytest.mark.parametrize("pieces", [2, 50])
def test_bytes_with_groups_cut_into_parts(small, monkeypatch, pieces):
    monkeypatch.setattr(suffix_dedup, "BUCKET_PIECES", pieces)
    assert bytes_result(small) == expected_bytes(rows_of(small), 200)


def test_no_documents(nothing):
    assert substring_dedup(nothing).count() == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_other_columns_stay(clashing):
    row = substring_dedup(clashing).filter("doc_id = 4").first()
    assert (row.spans, row.lang, row.kept) == ("mine spans", "fr", "short")


def test_texts_looked_at_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 64)
    text = " ".join(f"t{i % 97}" for i in range(700))
    docs = spark.createDataFrame([(1, text), (2, "a " + text[300:900])], "doc_id long, text string")
    assert words_result(docs) == expected_words(rows_of(docs), 50)
    assert bytes_result(docs) == expected_bytes(rows_of(docs), 200)


def test_multikey_order():
    keys = np.random.default_rng(1).integers(0, 3, (500, 5)).astype(np.uint64)
    assert (keys[multikey_order(keys)] == np.array(sorted(map(tuple, keys)))).all()
