"""Experiment tables derived from the given test tables.

``events`` rows become starts and finishes of two apps; ``customer`` rows become
the apps of a large registry, and ``orders`` rows the commands sent to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.functions.bodies import encode_finish
from splitlane.functions.ids import pad_id
from splitlane.operators.filters import finishes_of, starts_of
from splitlane.schema import (
    FINISH,
    LOADING,
    NO_DATA,
    PREDICTED,
    PREDICTING,
    RANDOM,
    REGISTRY,
    START,
    SUSPENDED,
    TRAINING,
)

IP_BASE = 167772160
RANGE_SPAN = 1200
SECOND_APP_EPOCH = 1705000000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session's time zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86400000
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return day + minutes * 60000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")


def _typed(events: DataFrame) -> DataFrame:
    """Events that are starts or finishes; the filter is on the stored column, so it is pushed down."""
    kind_of = F.when(F.col("event_type") == "purchase", F.lit(FINISH)).otherwise(F.lit(START))
    kept = events.where(F.col("event_type").isin("view", "click", "purchase"))
    return kept.withColumn("etype", kind_of)


def plain_events(events: DataFrame) -> DataFrame:
    """The event columns that need no other table. Works on streams as well."""
    k = F.col("k")
    return (
        _typed(events)
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .select(
            "event_id",
            pad_id((F.col("user_id") % 2).cast("string")).alias("app_id"),
            wall_ms(F.col("ts")).alias("ts_ms"),
            F.concat(
                F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")
            ).alias("session"),
            "etype",
            pad_id((k % 3).cast("string")).alias("variation"),
            F.when(k % 5 == 0, F.lit(PREDICTED)).otherwise(F.lit(RANDOM)).alias("kind"),
            (F.lit(IP_BASE) + F.col("user_id") * 256 + k).alias("ip_num"),
            F.date_format("ts", "dd").alias("day"),
            "user_id",
            "k",
        )
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_events(table(spark, sf_dir, "events"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a visitor."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
        )
    )


def identity_of(**values: Column) -> Column:
    """A map of the values that are not null."""
    pairs = reduce(lambda acc, kv: [*acc, F.lit(kv[0]), kv[1]], values.items(), [])
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the visitor's identity."""
    segment = F.when(F.col("k") % 7 != 0, F.col("segment"))
    return (
        event_rows(spark, sf_dir)
        .join(people(spark, sf_dir), "user_id", "left")
        .withColumn("segment", segment)
        .withColumn(
            "identity",
            identity_of(segment=F.col("segment"), nation=F.col("nation"), day=F.col("day")),
        )
    )


def start_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts_of(ab(spark, sf_dir))


def finish_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finishes_of(event_rows(spark, sf_dir)).select("event_id", "app_id", "ts_ms", "session")


def two_apps(spark: SparkSession) -> DataFrame:
    """Config of the two apps the events belong to."""
    number = F.col("id")
    variation = lambda i: F.struct(
        pad_id(F.lit(str(i))).alias("id"), F.lit(f"value {i}").alias("value")
    )
    descriptor = lambda name, flag: F.struct(
        F.lit(name).alias("name"), F.lit(flag).alias("categorical")
    )
    return spark.range(2).select(
        pad_id(number.cast("string")).alias("app_id"),
        F.when(number == 0, F.lit(NO_DATA)).otherwise(F.lit(PREDICTING)).alias("run_state"),
        F.when(number == 1, F.lit(SECOND_APP_EPOCH)).cast("bigint").alias("predicting_from"),
        F.array(variation(0), variation(1)).alias("variations"),
        F.array(
            descriptor("segment", True), descriptor("nation", True), descriptor("day", False)
        ).alias("descriptors"),
        F.lit(None).cast("string").alias("model_path"),
        F.lit(None).cast("string").alias("model_type"),
    )


def many_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of one app per customer, in every state, some repeating a variation id."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    state = F.get(
        F.array(*[F.lit(s) for s in (NO_DATA, PREDICTING, TRAINING, SUSPENDED, LOADING)]),
        (key % 5).cast("int"),
    )
    option = lambda number, text: F.struct(
        pad_id(number.cast("string")).alias("id"), F.lit(text).alias("value")
    )
    descriptor = lambda name, flag: F.struct(F.lit(name).alias("name"), flag.alias("categorical"))
    return table(spark, sf_dir, "customer").select(
        pad_id(key.cast("string")).alias("app_id"),
        state.alias("run_state"),
        F.when(key % 5 == 1, F.lit(SECOND_APP_EPOCH) + key).alias("predicting_from"),
        F.array(
            option(nation, "first"), option(nation + 1, "second"), option(nation + key % 3, "third")
        ).alias("variations"),
        F.array(
            descriptor("segment", F.lit(True)), descriptor("nation", key % 2 == 0)
        ).alias("descriptors"),
        F.when(key % 10 == 1, F.concat(F.lit("models/"), key.cast("string"))).alias("model_path"),
        F.when(key % 10 == 1, F.lit("tree_regressor")).alias("model_type"),
    ).select(*REGISTRY.names)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One command per order to the app of its customer."""
    names = ("reload", "start", "stop", "status", "config", "predict", "store", "dump", "train")
    command = F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 9).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("command_id"),
        pad_id(F.col("o_custkey").cast("string")).alias("app_id"),
        command.alias("command"),
    )


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of addresses per nation; every seventh lacks its city's name."""
    number = F.col("n_nationkey").cast("bigint")
    first = F.lit(IP_BASE) + number * RANGE_SPAN
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            first.alias("ip_from"),
            (first + (RANGE_SPAN - 1)).alias("ip_to"),
            F.when(number % 7 != 0, F.col("n_name")).alias("city"),
            F.col("r_name").alias("country"),
        )
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as the request it came in by; some bodies lack fields or are no JSON."""
    fault = F.col("k") % 11
    start = F.to_json(
        F.struct(
            F.when(fault != 1, F.col("session")).alias("session"),
            F.when(fault != 3, F.col("ts_ms")).alias("timestamp"),
            F.when(fault != 4, F.col("identity")).alias("identity"),
            F.when(fault != 2, (F.col("k") % 3).cast("string")).alias("variation"),
        )
    )
    body = (
        F.when(fault == 0, F.lit('{"session": broken'))
        .when(F.col("etype") == START, start)
        .when(fault == 1, F.lit("{}"))
        .otherwise(encode_finish(F.col("session"), F.col("ts_ms")))
    )
    return ab(spark, sf_dir).select(
        "event_id",
        "app_id",
        F.col("etype").alias("route"),
        F.when(F.col("k") % 4 != 0, F.col("ip_num")).alias("ip_num"),
        (F.col("ts_ms") + 250).alias("server_ts"),
        body.alias("body"),
    )


def config_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config each customer's app was created by; some are incomplete or no JSON."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    option = lambda number, text: F.struct(
        number.cast("string").alias("id"), text.alias("value")
    )
    whole = F.to_json(
        F.struct(
            F.when(
                key % 9 != 2,
                F.array(
                    option(nation, F.lit("first")),
                    option(nation + 1, F.when(key % 9 != 3, F.lit("second"))),
                ),
            ).alias("variations"),
            F.when(
                key % 9 != 1,
                F.array(F.struct(F.lit("segment").alias("name"), (key % 2 == 0).alias("categorical"))),
            ).alias("descriptors"),
        )
    )
    return table(spark, sf_dir, "customer").select(
        pad_id(key.cast("string")).alias("app_id"),
        F.when(key % 9 == 0, F.lit("[broken")).otherwise(whole).alias("body"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a visit to the app of its customer that was shown some variation."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        pad_id(F.col("o_custkey").cast("string")).alias("app_id"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("s"), F.col("o_custkey").cast("string")))
        .alias("session"),
        pad_id((F.col("o_orderkey") % 27).cast("string")).alias("variation"),
    )


def create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create request per order; about a third name an app that exists already."""
    shift = (F.col("o_orderkey") % 3) * 1000000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        pad_id((F.col("o_custkey") + shift).cast("string")).alias("app_id"),
        F.array(
            F.struct(
                pad_id(F.col("o_orderkey").cast("string")).alias("id"),
                F.col("o_orderstatus").alias("value"),
            )
        ).alias("variations"),
        F.array(
            F.struct(
                F.col("o_orderpriority").alias("name"),
                (F.col("o_orderkey") % 2 == 0).alias("categorical"),
            )
        ).alias("descriptors"),
    )


def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per order: to the state of its customer's app, to its model, or to both."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        pad_id((F.col("o_custkey") * 2).cast("string")).alias("app_id"),
        F.when(key % 3 != 0, F.when(key % 2 == 0, F.lit(TRAINING)).otherwise(F.lit(NO_DATA))).alias(
            "run_state"
        ),
        F.when(key % 4 == 0, F.concat(F.lit("models/"), key.cast("string"))).alias("model_path"),
    )
