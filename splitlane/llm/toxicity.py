"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The labelled sample is cut in three by a hash of the id: one part gives the lexicon of
words and word beginnings that mark label 1, one the trees, one the calibration. So the
trees see densities of a lexicon made from other documents, as they will when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.llm import arrays as A
from splitlane.llm.tables import id_order, id_remainder, in_small_batches
from splitlane.session import settle

SAMPLE = 20_000  # labelled documents that the fit may use
LEXICON = 4096  # entries of each lexicon at most
MIN_DOCS = 4
MIN_RATIO = 8.0
STEMS = (4, 6)  # lengths, in letters, of the word beginnings that have lexicons too
# Words of the second person in the languages of the test tables.
SECOND_PERSON = ("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
                 "euch euer ihr usted ustedes tus os vosotros").split()
# Letters often written as the sign before them.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
NEAR = 5  # words
KINDS = ("words", *(f"stem{n}" for n in STEMS), "disguised")
FEATURES = (
    *(f"{k}_{what}" for k in KINDS for what in ("density", "hits", "strength")),
    "second_person", "second_person_near", "capitals", "capital_words", "exclamations", "questions",
    "other_signs", "digits", "disguised_words", "repeated_letters", "log_words",
)


@dataclass(frozen=True)
class Lexicon:
    """For words, word beginnings and undisguised words: entry to strength (log odds)."""

    entries: dict[str, dict[str, float]]


def _words(text: str) -> list[str]:
    return text.translate(_BREAKS).split()


# Everything in ASCII that isn't a letter, a digit or a sign used in disguises ends a word.
_BREAKS = {c: " " for c in range(128) if not (chr(c).isalnum() or chr(c) in "@$!*'")}


def _plain(word: str) -> str:
    """A word without what may hide it: look-alike signs, stars and repeated letters."""
    return word.rstrip("!").translate(DISGUISES).replace("*", "")


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of one text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    lower = text.lower()
    words = _words(lower)
    n = max(len(words), 1)
    out: list[float] = []
    strange = [w for w in words if not w.isalpha()]
    clean = [w.strip("!'*$@") for w in words]
    by_kind = {"words": clean, **{f"stem{k}": [w[:k] for w in clean if len(w) >= k] for k in STEMS}}
    by_kind["disguised"] = [_plain(w) for w in strange]
    for kind in KINDS:
        known = lexicon.entries.get("words" if kind == "disguised" else kind, {})
        found = [known[w] for w in by_kind[kind] if w in known] if known else []
        out += [len(found) / n, float(np.log1p(len(found))), max(found, default=0.0)]
    known = lexicon.entries.get("words", {})
    marked = [i for i, w in enumerate(clean) if w in known] if known else []
    persons = [i for i, w in enumerate(clean) if w in _PERSONS]
    near = 0
    if marked and persons:
        at = np.searchsorted(persons, marked)
        p = np.array([-(1 << 40), *persons, 1 << 40])
        near = int((np.minimum(marked - p[at], p[at + 1] - marked) <= NEAR).sum())
    size = len(text)
    upper = sum(map(text.count, _CAPITALS))
    signs = sum(map(text.count, "#%&*"))
    out += [
        len(persons) / n,
        near / n,
        upper / size,
        0.0 if not upper else sum(1 for w in text.split() if len(w) > 1 and w.isupper()) / n,
        text.count("!") / size,
        text.count("?") / size,
        signs / size,
        sum(map(text.count, "0123456789")) / size,
        len(strange) / n,
        sum(1 for c in "aeiou!?" if c * 3 in lower) / 7.0,
        float(np.log1p(len(words))),
    ]
    return out


_PERSONS = frozenset(SECOND_PERSON)
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÇÑÍÓ"


def _feature_rows(lexicon: Lexicon):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = [text_features(t or "", lexicon) for t in batch.column(at).to_pylist()]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(values, pa.list_(pa.float64()))],
                [*(batch.schema.names[i] for i in rest), "f"],
            )

    return rows


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w.strip("!'*$@") for w in _words((text or "").lower())}
            pairs = [("words", w) for w in words if w]
            pairs += [(f"stem{k}", s) for k in STEMS for s in {w[:k] for w in words if len(w) >= k}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string()),
                 pa.array([toxic] * len(pairs), pa.int32())],
                ["kind", "entry", "toxic"],
            )


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Entries in at least MIN_DOCS texts of label 1 and, by share, MIN_RATIO times as often there."""
    total = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(1, 0) + 1.0, total.get(0, 0) + 1.0
    counts = (
        sample.select("text", "toxic")
        .mapInArrow(_entry_rows, "kind string, entry string, toxic int")
        .groupBy("kind", "entry")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    )
    odds = (F.col("bad") + 0.5) / bad / ((F.col("good") + 0.5) / good)
    entries: dict[str, dict[str, float]] = {}
    for kind in KINDS[:-1]:
        best = (
            counts.filter((F.col("kind") == kind) & (F.col("bad") >= MIN_DOCS) & (odds >= MIN_RATIO))
            .select("entry", F.log(odds).alias("strength"), "bad")
            .orderBy(F.desc(F.col("strength") * F.log1p("bad")), "entry")
            .limit(LEXICON)
        )
        entries[kind] = {r.entry: r.strength for r in best.collect()}
    return Lexicon(entries)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: object | None
    steps: list[tuple[float, float]]  # raw score and calibrated probability, both ascending
    base: float


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from at most ``sample`` labelled documents, first in the order of the md5 of their ids.

    Rows with a null doc_id or label are left out; a document labelled twice has the larger label.
    With one label only, every text gets that label's share.
    """
    in_small_batches(docs)
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = settle(known.orderBy(id_order(F.col("doc_id")), "doc_id").limit(sample), "chosen")
    part = F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % 10
    rows = settle(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", part.alias("part")),
        "labelled",
    )  # the broadcast holds ``sample`` rows at most
    share = rows.agg(F.avg("toxic"), F.min("toxic"), F.max("toxic")).first()
    if share[0] is None or share[1] == share[2]:
        return ToxicityModel(Lexicon({}), None, [], float(share[0] or 0.0))
    lexicon = learn_lexicon(rows.filter("part < 4"))
    schema = "toxic int, part long, f array<double>"
    features = settle(
        rows.select("text", "toxic", F.col("part").cast("long").alias("part")).mapInArrow(_feature_rows(lexicon), schema),
        "features",
    ).select("part", F.col("toxic").cast("double").alias("toxic"), array_to_vector("f").alias("f"))
    trees = GBTClassifier(
        featuresCol="f", labelCol="toxic", maxIter=30, maxDepth=4, stepSize=0.2, seed=11, maxBins=32
    ).fit(features.filter("part between 4 and 7"))
    scored = trees.transform(features.filter("part >= 8")).select(
        vector_to_array("rawPrediction")[1].alias("raw"), "toxic"
    )
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(scored)
    steps = list(zip(isotonic.boundaries.toArray().tolist(), isotonic.predictions.toArray().tolist()))
    return ToxicityModel(lexicon, trees, steps, float(share[0]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score, between 0 and 1, of every row; null text is empty."""
    if model.trees is None:
        return docs.select("doc_id", F.lit(model.base).alias("score"))
    rows = docs.select("doc_id", "text").mapInArrow(
        _feature_rows(model.lexicon), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f array<double>"
    )
    scored = model.trees.transform(rows.select("doc_id", array_to_vector("f").alias("f")))
    return scored.select("doc_id", _calibrated(vector_to_array("rawPrediction")[1], model.steps).alias("score"))


def _calibrated(raw: Column, steps: list[tuple[float, float]]) -> Column:
    """The isotonic curve, and a little of the raw score, so that order is kept on its flat parts."""
    xs, ys = F.array(*[F.lit(x) for x, _ in steps]), F.array(*[F.lit(y) for _, y in steps])
    at = F.size(F.filter(xs, lambda x: x <= raw))
    low, high = F.greatest(at, F.lit(1)), F.least(at + 1, F.lit(len(steps)))
    x0, x1, y0, y1 = (F.element_at(a, i) for a, i in ((xs, low), (xs, high), (ys, low), (ys, high)))
    inner = F.when(x1 > x0, y0 + (y1 - y0) * F.least(F.greatest((raw - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))).otherwise(y0)
    return inner * 0.98 + 0.02 / (1 + F.exp(-2 * raw))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 5) == 0, F.lit(False))


def rate_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, learned from labels not held out.

    Null and empty texts have all features 0 and get the score of that point. Ties at 0.5 are 1.
    Repeated rows get equal scores.
    """
    model = fit_toxicity(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0), sample)
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
