"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitlane.llm.bpe import bpe_roundtrip, load_vocabulary
from splitlane.llm.fingerprints import fingerprint_documents
from splitlane.llm.language import identify_language
from splitlane.llm.mixing import mix_sources, mixing_plan, sized
from splitlane.llm.near_dedup import near_dedup
from splitlane.llm.periodic import best_run, periodic_runs
from splitlane.llm.neighbours import nearest_neighbours
from splitlane.llm.quality import importance_resample
from splitlane.llm.sharding import shard_documents
from splitlane.llm.substring_dedup import substring_dedup
from splitlane.llm.suffix_dedup import suffix_dedup
from splitlane.llm.tables import WORD, read_table
from splitlane.llm.toxicity import rate_toxicity
from splitlane.llm.trie import conversation_trie
from splitlane.session import settle

VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(work: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[work.__name__] = work
    return work


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = substring_dedup(read_table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_dedup(read_table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe_roundtrip(docs, load_vocabulary(vocabulary_path()))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    rows = settle(sized(docs).drop("text"), "rows")
    mixed = mix_sources(rows, mixing_plan(rows))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    found = identify_language(read_table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return rate_toxicity(docs, read_table(spark, sf, "labels"))


@query
def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf, "documents").select("doc_id", "text"))


@query
def op2_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf, "embeddings"), every=100)


@query
def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup(read_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "class_id")


@query
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return importance_resample(docs, read_table(spark, sf, "labels"))


def planted_periods(doc_id: Column, text: Column) -> Column:
    """The text of op11: in one document of ten, from a word a on, the words repeat with period p.

    h = unsigned crc32 of the decimal doc_id, g = h div 10; if h mod 10 = 0 and the text has
    n > 0 words, word i >= a becomes word a + (i - a) mod p, with a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). Words are joined by one space; null text is empty.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)
    n = F.size(words).cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # Words a .. a + p - 1, repeated to fill the place of words a .. n - 1. The word list
    # is used whole a few times, never once per word.
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    filled = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    moved = F.concat(F.slice(words, 1, a.cast("int")), filled)
    planted = (h % 10 == 0) & (n > 0)
    return F.array_join(F.when(planted, moved).otherwise(words), " ")


@query
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = periodic_runs(docs.withColumn("text", planted_periods(F.col("doc_id"), F.col("text"))))
    best = best_run(F.col("runs"))
    listed = F.transform(
        F.col("runs"), lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return shard_documents(docs, 40, "bytes")


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of op13's conversations, ordered by ``seq``, and every conv_id.

    Turns are ordered by turn (null first), ties by role, then text; null role or text
    is empty. Conversation c takes the first h turns of conversation c - c mod 100 (all
    if fewer, none if absent), then its own turns after its first h; h is the unsigned
    crc32 of the decimal c, mod 6.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ordered = turns.withColumn("pos", F.row_number().over(by_turn) - 1)
    ids = (
        turns.select("conv_id")
        .distinct()
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    )
    own = ordered.join(ids.select("conv_id", "h"), "conv_id").filter(F.col("pos") >= F.col("h"))
    lent = ordered.filter(F.col("pos") < 6).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    borrowed = ids.join(lent, "base").filter(F.col("pos") < F.col("h"))
    rebuilt = own.select("conv_id", (F.col("pos") + 6).alias("seq"), "role", "text").unionByName(
        borrowed.select("conv_id", F.col("pos").alias("seq"), "role", "text")
    )
    return rebuilt, ids.select("conv_id")


@query
def op13_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns, ids = rebuilt_conversations(read_table(spark, sf, "conversations"))
    nodes = conversation_trie(turns, ids, order="seq")
    return nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.sha2("ends", 256).alias("ends_sha256"),
    )
