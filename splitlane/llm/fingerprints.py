"""Document fingerprints by I-Match, with DataFrame functions only.

A lexicon keeps the terms within a band of document frequency. A document's distinct
lexicon terms are sorted, cut down by each of several randomised sub-lexicons, and each
rest is hashed. Sub-lexicons of several rates are used, so that short and long documents
both have some that a local edit leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlane.llm.tables import text_key
from splitlane.operators.lookup import fits_broadcast, lookup_join
from splitlane.session import settle

# Shares of all documents; each bounds the size of the lexicon: no more terms can reach the
# lower share than a document has distinct terms on average, divided by that share.
LOW, HIGH = 0.002, 0.2
# (rate, number): so many sub-lexicons that each keep one in ``rate`` terms (a power of two).
SUBLEXICONS = ((1, 1), (4, 1), (16, 6), (64, 10), (256, 16))
CODES = sum(number for _, number in SUBLEXICONS)
EMPTY = "-" * 8
NO_ID = -(1 << 63)  # stands for a null id between the joins


def distinct_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, each once."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Hashes of the terms that at least ``low`` and at most ``high`` of the documents hold."""
    terms = docs.select(F.explode(distinct_terms(F.col("text"))).alias("term")).filter("term != ''")
    counts = terms.select(F.xxhash64("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return settle(
        counts.crossJoin(F.broadcast(total))  # one row
        .filter((F.col("docs") >= F.col("total") * low) & (F.col("docs") <= F.col("total") * high))
        .select("term"),
        "lexicon",
    )


def _slot(term: Column, rate: int) -> Column:
    return F.xxhash64(term, F.lit(rate)).bitwiseAND(F.lit(rate - 1))


def _below(rate: int, number: int):
    return lambda term: _slot(term, rate) < number


def _equal(rate: int, k: int):
    return lambda term: _slot(term, rate) == k


def _code(terms: Column) -> Column:
    code = F.substring(F.lpad(F.lower(F.hex(F.xxhash64(terms))), 16, "0"), 1, 8)
    return F.when(F.size(terms) > 0, code).otherwise(F.lit(EMPTY))


def with_fingerprint(rows: DataFrame, terms: str, text_hash: str, name: str) -> DataFrame:
    """``rows`` with the codes of all sub-lexicons, made from a sorted array of distinct terms.

    Terms of sub-lexicons of one rate are picked first, so that each is then looked for
    among few. A text without any lexicon term is known by its own hash.
    """
    picked = rows.withColumns(
        {
            f"_{rate}": F.filter(F.col(terms), _below(rate, number))
            for rate, number in SUBLEXICONS
        }
    )
    codes = F.concat(
        *[
            _code(F.filter(F.col(f"_{rate}"), _equal(rate, k)))
            for rate, number in SUBLEXICONS
            for k in range(number)
        ]
    )
    known = F.when(F.size(terms) > 0, codes).otherwise(F.concat(F.lit("="), F.col(text_hash)))
    return picked.withColumn(name, known).drop(*[f"_{rate}" for rate, _ in SUBLEXICONS])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal codes among those that either fingerprint has; 1 for equal fingerprints."""
    cut = lambda c, k: F.substring(c, 8 * k + 1, 8)
    both = [(cut(a, k), cut(b, k)) for k in range(CODES)]
    same = sum(((x == y) & (x != EMPTY)).cast("int") for x, y in both)
    used = sum(((x != EMPTY) | (y != EMPTY)).cast("int") for x, y in both)
    hashed = a.startswith("=") | b.startswith("=")
    return F.when(a == b, 1.0).when(hashed, 0.0).otherwise(F.coalesce(same / used, F.lit(0.0)))


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, need: the next larger id (after the last, the first), half the longest text of doc_id.

    Only ids are sorted, in ranges; the first id of each range, one per task, links the ranges.
    """
    spark = docs.sparkSession
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg((F.max(F.char_length("text")) / 2).cast("int").alias("need"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(ids.repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id()), "ids")
    heads = ranged.groupBy("range").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("range")  # one row per range
    heads = heads.select(
        "range",
        F.coalesce(F.lead("head").over(order), F.min("head").over(Window.partitionBy())).alias("after"),
    )
    inside = Window.partitionBy("range").orderBy("doc_id")
    return settle(
        ranged.withColumn("next_id", F.lead("doc_id").over(inside))
        .join(F.broadcast(heads), "range")
        .select("doc_id", F.coalesce("next_id", "after").alias("next_id"), "need"),
        "next",
    )


def with_edits(docs: DataFrame, following: DataFrame) -> DataFrame:
    """doc_id, tkey, text, edited: the second half of each text replaced from the next document's start."""
    # Both joins read the same rows by the same key, so that the texts are shuffled once.
    heads = (
        docs.join(following.withColumnsRenamed({"doc_id": "prev_id", "next_id": "doc_id"}), "doc_id")
        .select("prev_id", "tkey", F.left("text", F.col("need")).alias("head"))
        .groupBy("prev_id")
        .agg(F.min_by("head", "tkey").alias("head"))
    )
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left(F.coalesce("head", F.lit("")), half))
    return docs.join(heads.withColumnRenamed("prev_id", "doc_id"), "doc_id", "left").select(
        "doc_id", "tkey", "text", edited.alias("edited")
    )


def fingerprint_documents(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null text is empty. Of rows sharing a doc_id, the one whose text has the smallest hash is
    the next document for the id before. Rows without a doc_id have no next document: their
    edited text is its first half, their near_next 0. Equal texts have equal fingerprints,
    whether or not they hold lexicon terms.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A key that is never null keeps rows without an id in the joins, and their order of rows.
    keyed = texts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    following = next_ids(texts)
    known = lexicon(texts, low, high)
    small = fits_broadcast(known)
    rows = with_edits(keyed, following)
    # Each row has one term 0, which the lexicon is given too: it counts equal rows, and
    # keeps texts without any lexicon term in the groups.
    entry = lambda side: lambda t: F.struct(F.lit(side).alias("side"), F.xxhash64(t).alias("term"))
    entries = F.concat(
        F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("term"))),
        F.transform(distinct_terms(F.col("text")), entry(0)),
        F.transform(distinct_terms(F.col("edited")), entry(1)),
    )
    marked = known.unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("term")))
    terms = rows.select(
        "doc_id",
        "tkey",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
        F.sha2("edited", 256).alias("edited_sha256"),
        entries.alias("entries"),
    )
    # Exploded in a step of its own: what stands beside explode() is worked out for every term.
    own = ["doc_id", "tkey"]
    once = ["n_chars", "text_sha256", "edited_sha256"]  # carried by the row of term 0 alone
    terms = terms.select(*own, *once, F.explode("entries").alias("e")).select(
        *own, "e.side", "e.term", *[F.when(F.col("e.term") == 0, F.col(c)).alias(c) for c in once]
    )
    term_set = lambda side: F.sort_array(
        F.array_remove(F.collect_set(F.when(F.col("side") == side, F.col("term"))), 0)
    )
    sets = lookup_join(terms, marked, "term", "inner", small=small).groupBy(*own).agg(
        term_set(0).alias("terms"),
        term_set(1).alias("edited_terms"),
        F.count_if(F.col("term") == 0).alias("copies"),
        *[F.max(c).alias(c) for c in once],
    )
    sets = with_fingerprint(sets, "terms", "text_sha256", "fingerprint")
    sets = with_fingerprint(sets, "edited_terms", "edited_sha256", "edited_fingerprint")
    prints = settle(
        sets.select(*own, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "copies"), "prints"
    )
    nexts = (
        prints.groupBy("doc_id")
        .agg(F.min_by("fingerprint", "tkey").alias("next_fingerprint"))
        .join(following.select(F.col("doc_id").alias("prev_id"), F.col("next_id").alias("doc_id")), "doc_id")
        .select(F.col("prev_id").alias("doc_id"), "next_fingerprint")
    )
    return (
        prints.join(nexts, "doc_id", "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"),
        )
    )
