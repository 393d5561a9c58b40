"""JSON bodies: decoding requests, encoding events, configs and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.functions.identity import empty_identity
from splitlane.functions.ids import pad_id
from splitlane.schema import (
    DESCRIPTORS,
    FINISH,
    IDENTITY,
    PREDICTING,
    RANDOM,
    START,
    VARIATIONS,
)

_CORRUPT = "_corrupt"

# Any JSON number may stand as a timestamp; the fraction is cut off.
EVENT_BODY = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("timestamp", T.DecimalType(38, 6)),
        T.StructField("identity", IDENTITY),
        T.StructField("variation", T.StringType()),
        T.StructField(_CORRUPT, T.StringType()),
    ]
)

CONFIG_BODY = T.StructType(
    [
        T.StructField("variations", VARIATIONS),
        T.StructField("descriptors", DESCRIPTORS),
        T.StructField(_CORRUPT, T.StringType()),
    ]
)


def _parse(body: Column, schema: T.StructType) -> Column:
    return F.from_json(
        body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )


def _timestamp(event: Column) -> Column:
    return F.coalesce(event["timestamp"].cast("bigint"), F.lit(0).cast("bigint"))


def parse_events(df: DataFrame, body: str = "body") -> DataFrame:
    """Add the parsed body once, as ``event``, for the decoders below."""
    return df.withColumn("event", _parse(F.col(body), EVENT_BODY))


def start_fault(event: Column) -> Column:
    """Why a body is no start event; null when it is one."""
    return (
        F.when(event.isNull() | event[_CORRUPT].isNotNull(), F.lit("malformed"))
        .when(event["session"].isNull(), F.lit("no session"))
        .when(event["variation"].isNull(), F.lit("no variation"))
    )


def body_fault(event: Column) -> Column:
    """Why a body is no predict or finish event: only when it is not JSON at all."""
    return F.when(event.isNull() | event[_CORRUPT].isNotNull(), F.lit("malformed"))


def start_columns(event: Column) -> dict[str, Column]:
    """Columns of a start event; its kind is always the sampled one."""
    return {
        "session": event["session"],
        "ts_ms": _timestamp(event),
        "identity": F.coalesce(event["identity"], empty_identity()),
        "variation": pad_id(event["variation"]),
        "kind": F.lit(RANDOM),
    }


def predict_columns(event: Column) -> dict[str, Column]:
    return {
        "session": F.coalesce(event["session"], F.lit("")),
        "ts_ms": _timestamp(event),
        "identity": F.coalesce(event["identity"], empty_identity()),
    }


def finish_columns(event: Column) -> dict[str, Column]:
    return {
        "session": F.coalesce(event["session"], F.lit("")),
        "ts_ms": _timestamp(event),
    }


def _variation_complete(v: Column) -> Column:
    return v["id"].isNotNull() & v["value"].isNotNull()


def _descriptor_complete(d: Column) -> Column:
    return d["name"].isNotNull() & d["categorical"].isNotNull()


def decode_config(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``variations``, ``descriptors`` and ``fault``; a config never brings a model."""
    parsed = df.withColumn("config", _parse(F.col(body), CONFIG_BODY))
    config = F.col("config")
    variations, descriptors = config["variations"], config["descriptors"]
    fault = (
        F.when(config.isNull() | config[_CORRUPT].isNotNull(), F.lit("malformed"))
        .when(variations.isNull() | ~F.forall(variations, _variation_complete), F.lit("no variations"))
        .when(descriptors.isNull() | ~F.forall(descriptors, _descriptor_complete), F.lit("no descriptors"))
    )
    padded = F.transform(
        variations, lambda v: F.struct(pad_id(v["id"]).alias("id"), v["value"].alias("value"))
    )
    return parsed.select(
        *[c for c in df.columns],
        padded.alias("variations"),
        descriptors.alias("descriptors"),
        fault.alias("fault"),
    )


def encode_start(session: Column, ts_ms: Column, identity: Column, variation: Column) -> Column:
    """JSON of a start event; the kind stays internal."""
    return F.to_json(
        F.struct(
            F.lit(START).alias("type"),
            session.alias("session"),
            ts_ms.alias("timestamp"),
            identity.alias("identity"),
            variation.alias("variation"),
        )
    )


def encode_predict(session: Column, ts_ms: Column, identity: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("predict").alias("type"),
            session.alias("session"),
            ts_ms.alias("timestamp"),
            identity.alias("identity"),
        )
    )


def encode_finish(session: Column, ts_ms: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit(FINISH).alias("type"), session.alias("session"), ts_ms.alias("timestamp")
        )
    )


def encode_config(variations: Column, descriptors: Column) -> Column:
    """JSON of an app config, without its model."""
    return F.to_json(
        F.struct(
            F.transform(
                variations, lambda v: F.struct(v["value"].alias("value"), v["id"].alias("id"))
            ).alias("variations"),
            descriptors.alias("descriptors"),
        )
    )


def state_text(run_state: Column, predicting_from: Column) -> Column:
    """Text of a run state in a status reply; the predicting state names its epoch."""
    return F.when(
        run_state == PREDICTING,
        # Fixed format.
        F.concat(F.lit("Predicting({ Epoch: #"), predicting_from.cast("string"), F.lit(" })")),
    ).otherwise(run_state)


def encode_status(state: Column, starts: Column, finishes: Column) -> Column:
    """JSON of an app status."""
    counts = F.struct(starts.alias("start"), finishes.alias("finish"))
    return F.to_json(
        F.struct(state.alias("runState"), F.struct(counts.alias("all")).alias("events"))
    )


def encode_decision(variation: Column, value: Column, predicted: Column) -> Column:
    """JSON reply to a predict request."""
    return F.to_json(
        F.struct(
            F.struct(value.alias("value"), variation.alias("id")).alias("variation"),
            predicted.alias("predicted"),
        )
    )
