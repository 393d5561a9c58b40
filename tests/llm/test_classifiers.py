"""Language, toxicity and quality: held-out accuracy, planted cases, awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, awkward_rows
from pyspark.sql import functions as F

from splitlane.llm import language, queries
from splitlane.llm.language import fit_temperature, identify_language
from splitlane.llm.arrays import text_buffers
from splitlane.llm.quality import descending60, importance_resample, ngram_buckets, ngram_model
from splitlane.llm.toxicity import rate_toxicity

LABELS = "doc_id long, quality int, toxic int"


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# --- language --------------------------------------------------------------------------------


def test_held_out_languages(small, spark):
    got = queries.QUERIES["op8_language_id"](spark, SMALL).join(small.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in got if remainder(r.doc_id, 4) == 2}
    assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_awkward_rows(clashing):
    rows = identify_language(clashing).collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and r.ids == "mine ids"
        assert r.lang_pred in ("und", "en", "fr") and r.held_out == (remainder(r.doc_id, 4) == 2 and r.doc_id is not None)


def test_no_documents_and_no_languages(nothing, small):
    assert identify_language(nothing).count() == 0
    unnamed = small.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in identify_language(unnamed).collect()} == {("und", 0.0)}


def test_predictions_do_not_see_the_other_columns(small):
    model = language.fit_language_model(small)
    plain = small.select("doc_id", language.predict_language(F.col("text"), model).alias("p"))
    other = small.select("doc_id", F.lit("xx").alias("lang"), "text").select(
        "doc_id", language.predict_language(F.col("text"), model).alias("p")
    )
    assert plain.exceptAll(other).count() == 0


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 400)
    logits = 8 * (np.eye(3)[np.where(rng.random(400) < 0.7, labels, rng.integers(0, 3, 400))])
    assert fit_temperature(logits, labels) > 1.5


# --- toxicity --------------------------------------------------------------------------------


def planted(spark, n=600):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(200)]
    texts, marks = [], []
    for i in range(n):
        body = list(rng.choice(words, rng.integers(20, 60)))
        bad = i % 4 == 0
        if bad:
            for w in rng.choice(["gnarf", "blorp", "snit"], 3):
                body.insert(int(rng.integers(0, len(body))), w if i % 8 else w.replace("o", "0").upper() + "!!")
        texts.append((i, " ".join(body)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)


def test_held_out_toxicity(spark):
    docs, labels = planted(spark)
    rows = rate_toxicity(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in rows if remainder(r.doc_id, 5) == 0}
    assert np.mean([r.predicted == r.toxic for r in out]) >= 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_of_awkward_rows(spark, clashing, nothing):
    docs, labels = planted(spark, 200)
    more = clashing.select("doc_id", "text").unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100))
    messy = labels.withColumn("doc_id", F.col("doc_id") + 100).unionByName(
        spark.createDataFrame([(None, 1, 1), (1, 1, None), (8, None, 1), (8, 0, 0), (10**9, 1, 1)], LABELS)
    )
    assert rate_toxicity(more, messy).count() == 200 + len(awkward_rows())
    assert rate_toxicity(nothing, labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in rate_toxicity(clashing, none).collect()} == {0.0}


# --- quality ---------------------------------------------------------------------------------


def test_quality_of_the_table(spark, small, labels):
    rows = importance_resample(small, labels).join(labels, "doc_id").collect()
    kept = lambda q: np.mean([r.kept for r in rows if r.quality == q])
    assert kept(1) >= 0.95 and kept(1) - kept(0) >= 0.3


def test_quality_keeps_the_top(small, labels):
    rows = importance_resample(small, labels, keep=0.3).collect()
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    n = int(len(rows) * 0.3)
    assert {r.gumbel_key for r in rows if r.kept} == set(keys[:n])
    again = importance_resample(small.repartition(7), labels, keep=0.3).filter("kept").select("doc_id")
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in rows if r.kept}


def test_weights_equal_a_plain_sum(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None), (4, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    rows = {r.doc_id: r.log_weight for r in importance_resample(docs, labels, keep=1.0).collect()}
    ratio = ngram_model(docs.filter("doc_id = 1")) - ngram_model(docs)
    for doc_id, text in ((1, "a b a"), (2, "c"), (3, ""), (4, "a b")):
        _, buckets = ngram_buckets(*text_buffers(pa.array([text])))
        assert len(buckets) == max(0, 2 * len(text.split()) - 1)
        assert abs(rows[doc_id] - ratio[buckets].sum()) < 1e-9


def test_quality_of_awkward_rows(spark, clashing, nothing, labels):
    assert importance_resample(clashing, labels).count() == len(awkward_rows())
    assert importance_resample(nothing, labels).count() == 0
    rows = importance_resample(clashing, spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept and r.log_weight == 0 for r in rows)


def test_descending_numbers_keep_the_order():
    values = np.array([1e300, 5.0, 1.5, 1e-300, 0.0, -1e-300, -2.0, -1e300])
    got = descending60(values)
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() < 1 << 60
