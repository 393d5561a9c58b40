"""Joining many rows to a lookup table without trusting that it is small."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when it is measured to be within both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Facts of one key that one task joins; a key with more is dealt over several tasks.
HOT_ROWS = 100_000
# Rows of either side that one task of a shuffled join takes, about.
TASK_ROWS = 250_000


def fits_broadcast(
    lookup: DataFrame, max_rows: int | None = None, max_bytes: int | None = None
) -> bool:
    """Measure a table (one aggregate job) against the broadcast bounds."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("bigint")
    rows, total = lookup.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= (max_rows or BROADCAST_ROWS) and total <= (max_bytes or BROADCAST_BYTES)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, settled before, dealt by ``keys`` into tasks of about TASK_ROWS rows, one per core at least."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(tasks, -(-rows.count() // TASK_ROWS)), *keys)


def _hot_keys(facts: DataFrame, keys: list[str]) -> tuple[int, DataFrame | None]:
    """How many facts there are, and the keys of more than HOT_ROWS of them with their ``_salts``.

    One aggregate; of the keys, only the hot ones come to the driver, one per HOT_ROWS facts at most.
    """
    counted = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_facts"))
    salts = F.ceil(F.col("_facts") / F.lit(HOT_ROWS)).cast("int").alias("_salts")
    hot = F.collect_list(F.when(F.col("_facts") > HOT_ROWS, F.struct(*keys, salts)))
    total, found = counted.agg(F.coalesce(F.sum("_facts"), F.lit(0)), hot).first()
    if not found:
        return total, None
    shape = counted.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], salts).schema
    return total, facts.sparkSession.createDataFrame([tuple(r) for r in found], shape)


def _salts_of(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Add ``_salts``: over how many tasks the row's key is dealt. Null keys may be hot as well."""
    if hot is None:
        return df.withColumn("_salts", F.lit(1))
    same = reduce(and_, [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])
    known = df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])
    return known.withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def _spreadable(df: DataFrame) -> list[str]:
    """Columns a hash can be taken of."""
    return [f.name for f in df.schema if not _has_map(f.dataType)]


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return False


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str] | str,
    how: str = "left",
    small: bool | None = None,
    where: Column | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on equal keys, and ``where`` on top.

    A lookup measured as small is broadcast: no shuffle, and a hot key costs
    nothing extra. A bigger one is joined by a shuffle of both sides into as many tasks
    as their rows ask for; never by a broadcast that a planner's guess chose. A key of
    more than HOT_ROWS facts is dealt over several salts, and its lookup rows alone are
    copied once per salt, so that even a key holding a third of all facts is spread.
    ``small`` passes on a measurement already made, ``counted`` a frame with the keys of
    the facts that is cheaper to read than they are.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(lookup) if small is None else small:
        return _join(facts, F.broadcast(lookup), keys, how, where)
    total, hot = _hot_keys(facts if counted is None else counted, keys)
    spark = facts.sparkSession
    rows = max(total, lookup.count())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    spread = F.xxhash64(*_spreadable(facts))
    salted = _salts_of(facts.withColumn("_spread", spread), keys, hot).withColumn(
        "_salt", F.pmod("_spread", "_salts").cast("int")
    )
    copies = _salts_of(lookup, keys, hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    salted_keys = [*keys, "_salt"]
    sides = [df.repartition(tasks, *salted_keys) for df in (salted.drop("_spread", "_salts"), copies.drop("_salts"))]
    return _join(sides[0], sides[1].hint("merge"), salted_keys, how, where).drop("_salt")


def _join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], how: str, where: Column | None
) -> DataFrame:
    if where is None:
        return facts.join(lookup, keys, how)
    renamed = lookup.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    condition = reduce(and_, [F.col(k) == F.col(f"_of_{k}") for k in keys], where)
    return facts.join(renamed, condition, how).drop(*[f"_of_{k}" for k in keys])
