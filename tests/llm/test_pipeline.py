"""The pipeline, stage by stage, against what each stage was given."""

import hashlib

import numpy as np
import pytest
from conftest import DOCS, SMALL, awkward_rows, words
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from splitlane.session import settle
from splitlane.llm.bpe import decode_ids, load_vocabulary
from splitlane.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def through(spark, docs, sf_dir=SMALL):
    """What each stage was given and what it returned, written as the check does."""
    out = []
    for name, stage in P.STAGES:
        given, docs = docs, settle(stage(spark, docs, sf_dir), name)
        out.append((name, given, docs))
    return out


def test_stages_and_registration():
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "substring_dedup", "mixing", "bpe"]
    assert entry.queries()["pipeline"] is P.run


def test_stages_on_the_table(spark, small):
    steps = {n: (a, b) for n, a, b in through(spark, small)}
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == small.columns
    given, kept = steps["language"]
    assert {r.doc_id for r in given.filter(F.col("text").rlike("[a-zA-Z]")).collect()} == {r.doc_id for r in kept.collect()}
    given, kept = steps["near_dedup"]
    assert kept.exceptAll(given).count() == 0
    assert kept.select("text").distinct().count() == kept.count() >= given.select("text").distinct().count() * 0.8
    given, kept = steps["substring_dedup"]
    seen, starts = set(), set()
    for r in kept.orderBy("doc_id").collect():
        w = r.text.split()
        starts = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        assert r.n_chars == len(r.text)
        seen |= starts
    assert given.count() == kept.count()
    given, kept = steps["mixing"]
    assert kept.select("doc_id", "text").distinct().exceptAll(given.select("doc_id", "text")).count() == 0
    given, coded = steps["bpe"]
    assert given.count() == coded.count()
    vocabulary = load_vocabulary(vocabulary_path())
    texts = {r.doc_id: r.text for r in given.collect()}
    for r in coded.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens and decode_ids(vocabulary, ids) == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_is_predicted_once_for_each_text(spark, small, capsys):
    """The stage's filter is not pushed below the prediction with a prediction of its own."""
    P.language_stage(spark, small, SMALL).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_run_gives_the_rows_of_its_stages(spark, small):
    last = through(spark, small)[-1][2]
    run = P.run(spark, SMALL)
    assert run.exceptAll(last).count() == 0 and run.count() == last.count()


def test_planted_copies_go_and_clean_documents_stay(spark):
    rows = [(i, words(1000 * i, 150), "en", "s", None) for i in range(1, 9)]
    rows += [(20, rows[0][1], "en", "s", None), (21, words(1000, 149) + " odd", "en", "s", None)]
    rows += [(30, words(70000, 40) + " " + words(2020, 60) + " " + words(80000, 40), "en", "s", None)]
    docs = spark.createDataFrame(rows, DOCS)
    steps = {n: b for n, _, b in through(spark, docs)}
    assert {r.doc_id for r in steps["language"].collect()} == {r[0] for r in rows}
    assert {r.doc_id for r in steps["near_dedup"].collect()} == {*range(1, 9), 30}
    cut = {r.doc_id: r.text for r in steps["substring_dedup"].collect()}
    assert cut[30] == words(70000, 40) + " " + words(80000, 40) and cut[2] == rows[1][1]


@pytest.mark.parametrize("case", ["awkward", "clashing", "nothing"])
def test_awkward_tables(spark, case, request):
    docs = request.getfixturevalue(case)
    steps = through(spark, docs)
    for _, given, kept in steps[:-1]:
        assert kept.columns == docs.columns
    language = steps[0][2].collect()
    if case == "nothing":
        assert steps[-1][2].count() == 0
    else:
        lettered = [r for r in awkward_rows() if any(c.isalpha() for c in r[1] or "")]
        assert 0 < len(language) <= len(lettered) and all(r.lang is not None for r in language)
    if case == "clashing":
        assert {r.kept for r in steps[3][2].collect()} == {"mine kept"}
