"""The app registry as a table: create, update, commands, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.operators.lookup import lookup_join
from splitlane.operators.running import max_before
from splitlane.schema import LOADING, NO_DATA, PREDICTING, REGISTRY, SUSPENDED, TRAINING
from splitlane.sinks.tables import write_registry
from splitlane.sources.tables import read_registry

MUTABLE = ("run_state", "predicting_from", "variations", "descriptors", "model_path", "model_type")


def registry_lookup(registry: DataFrame, app_id: str) -> DataFrame:
    """The record of one app."""
    return registry.where(F.col("app_id") == app_id).limit(1)


def registry_create(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """The registry with new records added; an id already taken keeps its record.

    Of several requests for one new id the first (lowest ``request_id``) counts.
    """
    first = (
        requests.groupBy("app_id")
        .agg(F.min_by(F.struct("variations", "descriptors"), "request_id").alias("c"))
        .join(registry, "app_id", "left_anti")
    )
    nothing = lambda name: F.lit(None).cast(REGISTRY[name].dataType).alias(name)
    return registry.select(*REGISTRY.names).unionByName(
        first.select(
            "app_id",
            F.lit(NO_DATA).alias("run_state"),
            nothing("predicting_from"),
            "c.variations",
            "c.descriptors",
            nothing("model_path"),
            nothing("model_type"),
        )
    )


def registry_update(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the fields a change gives (non-null) on its app; unknown apps are not added.

    With several changes to one app, the last (highest ``seq``) value of each
    field holds. Changes are combined per app before the join.
    """
    fields = [f for f in MUTABLE if f in changes.columns]
    last = changes.groupBy("app_id").agg(
        *[
            F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}")
            for f in fields
        ]
    )
    joined = registry.join(last, "app_id", "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.col(f"_{f}"), F.col(f)))
    return keep_epoch(joined).select(*registry.columns)


def keep_epoch(registry: DataFrame) -> DataFrame:
    """An epoch belongs to a predicting app, or to one in training that was predicting."""
    held = F.col("run_state").isin(PREDICTING, TRAINING)
    return registry.withColumn("predicting_from", F.when(held, F.col("predicting_from")))


def update_where(df: DataFrame, predicate: Column, **values: Column) -> DataFrame:
    """Set columns on the rows matching ``predicate``."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.withColumns(
        {name: F.when(hit, new).otherwise(F.col(name)) for name, new in values.items()}
    )


def command_accepted(command: Column, state: Column) -> Column:
    """Whether an app in a run state takes a command."""
    loading, suspended = state == LOADING, state == SUSPENDED
    return (
        F.when(command == "reload", F.lit(True))
        .when(command == "start", suspended)
        .when(command.isin("stop", "status", "config"), ~loading)
        .when(command.isin("predict", "store", "dump"), ~(loading | suspended))
        .when(command == "train", ~(loading | suspended | (state == TRAINING)))
        .otherwise(F.lit(False))
    )


def command_result(command: Column, state: Column) -> Column:
    """Run state after an accepted command."""
    return (
        F.when(command == "start", F.lit(NO_DATA))
        .when(command == "stop", F.lit(SUSPENDED))
        .otherwise(state)
    )


def apply_commands(registry: DataFrame, commands: DataFrame) -> DataFrame:
    """Each command judged in order of ``command_id`` against its app's state at that point.

    Only start and stop change a state, so the state before a command follows
    from the recorded one and the last start and stop before it. Refused
    commands change nothing; commands to unknown apps are refused, with null states.
    """
    command = F.col("command")
    order = F.col("command_id")
    history = max_before(
        commands,
        ["app_id"],
        "command_id",
        _start=F.when(command == "start", order),
        _stop=F.when(command == "stop", order),
    )
    apps = registry.select("app_id", F.col("run_state").alias("_recorded"))
    recorded, start, stop = F.col("_recorded"), F.col("_start"), F.col("_stop")
    before = (
        F.when(recorded.isNull() | (recorded == LOADING), recorded)
        .when(stop.isNotNull(), F.when(start > stop, F.lit(NO_DATA)).otherwise(F.lit(SUSPENDED)))
        .when(start.isNotNull() & (recorded == SUSPENDED), F.lit(NO_DATA))
        .otherwise(recorded)
    )
    state = F.col("run_state")
    return (
        lookup_join(history, apps, "app_id")
        .withColumn("run_state", before)
        .withColumn("accepted", F.coalesce(command_accepted(command, state), F.lit(False)))
        .withColumn(
            "new_state", F.when(F.col("accepted"), command_result(command, state)).otherwise(state)
        )
        .drop("_start", "_stop", "_recorded")
    )


def state_changes(judged: DataFrame) -> DataFrame:
    """The state each app ends in, as changes for ``registry_update``."""
    return (
        judged.where("accepted")
        .groupBy("app_id")
        .agg(
            F.max_by("new_state", "command_id").alias("run_state"),
            F.max("command_id").alias("seq"),
        )
    )


def command_job(spark: SparkSession, registry_path: str, commands: DataFrame) -> int:
    """Judge commands against the stored registry and write its next version; returns its number."""
    stored = read_registry(spark, registry_path)
    changes = state_changes(apply_commands(stored, commands))
    return write_registry(registry_update(stored, changes), registry_path)


def recover_registry(registry: DataFrame) -> DataFrame:
    """Interrupted trainings fall back to collecting data."""
    stuck = F.col("run_state") == TRAINING
    return keep_epoch(update_where(registry, stuck, run_state=F.lit(NO_DATA)))
