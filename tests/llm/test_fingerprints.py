"""Fingerprints: edits by hand, codes by a plain loop over the same rules."""

import hashlib
import re

from conftest import awkward_rows
from pyspark.sql import functions as F

from splitlane.llm.fingerprints import fingerprint_documents, lexicon


def terms_of(text):
    return {t for t in re.split(r"[^\w]+", text.lower().replace("_", " ")) if t}


def test_lexicon_is_a_band_of_document_frequencies(spark):
    texts = [f"every t{i % 2} t{i % 5} only{i} only{i}" for i in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.term for r in lexicon(docs, 0.1, 0.5).collect()}
    band = [t for t in set().union(*map(terms_of, texts)) if 2 <= sum(t in terms_of(x) for x in texts) <= 10]
    hashes = spark.createDataFrame([(t,) for t in band], "t string").select(F.xxhash64("t"))
    assert got == {r[0] for r in hashes.collect()} and len(got) == len(band) == 3


def check(docs, rows, low, high):
    got = fingerprint_documents(docs, low, high).collect()
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    ids = sorted(i for i in by_id if i is not None)
    for r in got:
        following = by_id[ids[(ids.index(r.doc_id) + 1) % len(ids)]] if r.doc_id is not None else [""]
        allowed = set()
        for text in by_id[r.doc_id]:
            half = len(text) // 2
            allowed |= {
                hashlib.sha256((text[: len(text) - half] + n[:half]).encode()).hexdigest()
                for n in following
                if len(text) == r.n_chars
            }
        assert r.edited_sha256 in allowed
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
    return got


def test_awkward_rows(clashing):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = check(clashing, rows, 0.1, 0.9)
    same = {}
    for r in got:
        same.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    # Rows (null, 5) hold equal texts, as do (1, 2) and both of 8.
    one = lambda i, n: next(iter(same[(i, n)]))
    long = len(rows[0][1])
    assert one(None, long) == one(5, long) and one(1, 0) == one(2, 0)
    assert one(1, 0) != one(3, 4) and len(same[(8, len(rows[9][1]))]) == 1


def test_table(small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    got = check(small, rows, 0.02, 0.5)
    assert sum(r.near_edited for r in got) > 3 * sum(r.near_next for r in got)


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(7, "abcd")], "doc_id long, text string")
    row = fingerprint_documents(docs).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1


def test_no_documents(nothing):
    assert fingerprint_documents(nothing).count() == 0
