"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net penalties, then one
temperature is fitted on learning documents kept apart. Document frequencies cover all
learning documents; only the fit itself uses a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from splitlane.llm import arrays as A
from splitlane.llm.tables import id_order, id_remainder, in_small_batches
from splitlane.session import settle

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1000  # documents of each language that the fit may use
MOST_LANGUAGES = 256  # bounds the model; more are refused
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
SCALE = 30.0  # of the features, which sum to about the mean inverse frequency
CALIBRATION_SHARE = 5
UNDETERMINED = "und"
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def ngram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram of the lower-case texts, and how many each text has."""
    lowered = [t.lower() for t in texts]
    letters = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(t) for t in lowered], np.int64)
    end = np.cumsum(size)
    for n in ORDERS:
        count = np.maximum(size - n + 1, 0)
        mixed = np.zeros(max(len(letters) - n + 1, 0), np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x100000001B3) + letters[k : k + len(mixed)] + np.uint64(n)
        mixed *= A.MIX_1
        buckets = (mixed >> np.uint64(48)).astype(np.int32)
        if len(texts) > 1 and n > 1:
            inside = np.ones(len(letters), bool)
            for k in range(1, n):  # n-grams that reach into the next text
                at = end[size >= k] - k
                inside[at] = False
            buckets = buckets[inside[: len(buckets)]]
        yield buckets, count


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BUCKETS, np.int64)
    docs = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            here = np.zeros(BUCKETS, bool)
            for buckets, _ in ngram_buckets([text or ""]):
                here[buckets] = True
            seen += here
            docs += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["bucket", "docs"]
    )


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Of every bucket, over all texts; BUCKETS numbers, however many texts there are."""
    counts = texts.mapInArrow(_frequency_rows, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    table = counts.toArrow()
    bucket, docs = table["bucket"].to_numpy(), table["docs"].to_numpy()
    found = np.zeros(BUCKETS)
    found[bucket[bucket >= 0]] = docs[bucket >= 0]
    total = docs[bucket < 0].sum() if (bucket < 0).any() else 0
    return np.log((1 + total) / (1 + found)) + 1


def _feature_rows(idf: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for text in batch.column(0).to_pylist():
                parts = [b for b, _ in ngram_buckets([text])]
                at, times = np.unique(np.concatenate(parts), return_counts=True)
                index.append(at.astype(np.int32).tobytes())
                value.append((SCALE * idf[at] * times / max(times.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(index, pa.binary()), pa.array(value, pa.binary()), batch.column(1), batch.column(2)],
                ["at", "x", "lang", "calibrate"],
            )

    return rows


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights of BUCKETS features and one constant, for each class."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zs, ns = z[at], n[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[y] -= 1
            g = np.outer(x, error)
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squares
    return weights(np.arange(BUCKETS + 1))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least mean log loss."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    return float(min(np.geomspace(0.2, 5, 80), key=loss))


def _fit_rows(languages: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn, apart = [], []
        for batch in batches:
            for r in batch.to_pylist():
                row = np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), languages.index(r["lang"])
                (apart if r["calibrate"] else learn).append(row)
        learn = learn or apart
        # Rows reach the task in any order; the fit must not depend on it.
        learn.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
        w = fit_ftrl(learn, len(languages))
        logits = np.array([x @ w[at] + w[-1] for at, x, _ in apart]).reshape(len(apart), len(languages))
        w = w / fit_temperature(logits, np.array([y for *_, y in apart], np.int64))
        used = np.flatnonzero((w != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(w[used]), pa.list_(pa.float64()))], ["at", "w"])

    return rows


@dataclass(frozen=True)
class LanguageModel:
    """Weights include the inverse frequencies, the scale and the temperature."""

    languages: list[str]
    weights: np.ndarray
    constant: np.ndarray


def fit_language_model(docs: DataFrame) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of ``docs`` (with doc_id); null in any of the three is left out.

    All documents count for the document frequencies; PER_LANGUAGE of each language, first
    in the order of the md5 of their ids, take part in the fit.
    """
    known = in_small_batches(docs).select("doc_id", "text", "lang").dropna()
    by = Window.partitionBy("lang").orderBy(id_order(F.col("doc_id")), "doc_id")
    chosen = settle(
        known.select("doc_id", "lang").withColumn("k", F.row_number().over(by)).filter(F.col("k") <= PER_LANGUAGE),
        "chosen",
    )
    languages = sorted(r.lang for r in chosen.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    idf = inverse_frequencies(known.select("text"))
    # At most PER_LANGUAGE * MOST_LANGUAGES ids.
    sample = known.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    apart = F.crc32(F.concat(F.lit("apart"), F.col("doc_id").cast("string")).cast("binary")) % CALIBRATION_SHARE == 0
    features = settle(
        sample.select("text", "lang", apart.alias("calibrate")).mapInArrow(
            _feature_rows(idf), "at binary, x binary, lang string, calibrate boolean"
        ),
        "features",
    )
    table = features.repartition(1).mapInArrow(_fit_rows(languages), "at long, w array<double>").toArrow()
    w = np.zeros((BUCKETS + 1, len(languages)))
    w[table["at"].to_numpy()] = np.array(table["w"].to_pylist()).reshape(-1, len(languages))
    return LanguageModel(languages, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1])


def predict_language(text: Column, model: LanguageModel) -> Column:
    """A struct of ``lang`` and ``score``, the probability of that language.

    Texts that are null, empty or without a letter, and all texts if nothing was
    learned, are ``und`` with score 0. Equal probabilities go to the first language in
    code point order.
    """
    languages, constant = model.languages, model.constant
    weights = np.ascontiguousarray(model.weights.T)

    @F.arrow_udf(RESULT)
    def predict(column: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[np.ndarray] = []
        for part in A.slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
            texts = part.column(0).to_pylist()
            total = np.zeros((len(texts), len(languages)))
            number = np.zeros(len(texts), np.int64)
            for buckets, count in ngram_buckets(texts):
                number += count
                filled = np.flatnonzero(count)
                starts = (np.cumsum(count) - count)[filled]
                for c in range(len(languages)):
                    if len(filled):
                        total[filled, c] += np.add.reduceat(weights[c][buckets], starts, dtype=np.float64)
            p = _softmax(total / np.maximum(number, 1)[:, None] + constant)
            best = p.argmax(axis=1)
            langs += [languages[b] for b in best]
            scores.append(p[np.arange(len(texts)), best])
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], ["lang", "score"]
        )

    blank = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    if not languages:
        return blank
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    # A filter on the result would otherwise be pushed below it with a second prediction of every
    # text, and each task would keep two Python workers.
    predict = predict.asNondeterministic()
    return F.when(lettered, predict(F.coalesce(text, F.lit("")))).otherwise(blank)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 4) == 2, F.lit(False))


def identify_language(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score, learned from its own rows that aren't held out.

    Rows without a doc_id are neither learned from nor held out.
    """
    plain = docs.drop("held_out", "lang_pred", "score")
    model = fit_language_model(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    return (
        plain.withColumn("_lang", predict_language(F.col("text"), model))
        .withColumn("held_out", held_out(F.col("doc_id")))
        .select(*plain.columns, "held_out", F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))
    )
