"""Reading the tables and small pieces shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD = r"[^\x20\x09-\x0D]+"


# Rows of one Arrow batch. Texts are long: at Spark's 10,000 rows a batch, its copies in the
# executor and its Python workers take hundreds of MB.
BATCH_ROWS = 1_000


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs`` itself; from now on its session hands texts to Python BATCH_ROWS at a time, or fewer if so set."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return docs


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_order(doc_id: Column) -> Column:
    """A stable pseudo-random order of ids, for bounded samples."""
    return F.md5(doc_id.cast("string").cast("binary"))
