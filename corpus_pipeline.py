"""From raw documents to token ids: five stages, each an operator of splitlane.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns that they were given. Rows are whole documents throughout; nulls, empty tables and
repeated rows are treated as the operators say.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.llm.bpe import bpe_roundtrip, load_vocabulary
from splitlane.llm.language import UNDETERMINED, fit_language_model, predict_language
from splitlane.llm.mixing import mix_sources, mixing_plan, sized
from splitlane.llm.near_dedup import near_dedup
from splitlane.llm.queries import vocabulary_path
from splitlane.llm.substring_dedup import substring_dedup
from splitlane.llm.tables import DOCUMENT_COLUMNS, read_table
from splitlane.session import settle

LEAST_SURE = 0.4  # documents whose language is less likely than this are rejected

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; a null ``lang`` is filled in.

    Documents without a letter go, and those of no likely language. If no document names
    its language, nothing can be learned, and only those without a letter go.
    """
    model = fit_language_model(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = docs.withColumn("_lang", predict_language(F.col("text"), model))
    kept = told.filter((F.col("_lang.lang") != UNDETERMINED) & (F.col("_lang.score") >= LEAST_SURE))
    return kept.withColumn("lang", F.coalesce("lang", "_lang.lang")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates; of equal rows with its id, one."""
    firsts = near_dedup(docs).filter("is_first").drop("class_id", "is_first")
    times = firsts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("doc_id", "_twice")
    marked = firsts.join(times, F.col("doc_id").eqNullSafe(F.col("_twice")), "left")
    single = marked.filter("_n is null").select(*docs.columns)
    return single.unionByName(marked.filter("_n is not null").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; texts that lose nothing stay as they are."""
    cut = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    counted = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long"))
        counted = counted.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return counted.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until the sources have their target weights."""
    rows = sized(docs)
    mixed = mix_sources(rows, mixing_plan(rows.select("doc_id", "source", "size"))).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit numbers) of every document, and a digest of their text."""
    coded = bpe_roundtrip(docs.select("doc_id", "lang", "source", "text"), load_vocabulary(vocabulary_path()))
    return coded.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _with_extras(stage: Stage) -> Stage:
    """Carries columns that ``documents`` hasn't past the stage, whatever their names."""

    @functools.wraps(stage)
    def carried(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = [c for c in docs.columns if c not in DOCUMENT_COLUMNS]
        if not extra:
            return stage(spark, docs, sf_dir)
        own = [c for c in docs.columns if c in DOCUMENT_COLUMNS]
        out = stage(spark, docs.select(*own, F.struct(*extra).alias("_extra")), sf_dir)
        return out.select(*[F.col("_extra").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns])

    return carried


STAGES: list[tuple[str, Stage]] = [
    ("language", _with_extras(language_stage)),
    ("near_dedup", _with_extras(near_dedup_stage)),
    ("substring_dedup", _with_extras(substring_dedup_stage)),
    ("mixing", _with_extras(mixing_stage)),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
