"""Table schemas and the fixed values of the experiment model."""

from __future__ import annotations

from pyspark.sql import types as T

# Their meaning to callers depends on these exact numbers and texts.
ID_WIDTH = 24
MIN_FINISHES = 20
MIN_STARTS = 50
TRAIN_SHARE = 0.7
JITTER = 0.01
MISSING_TEXT = "None"
UNKNOWN_PLACE = "<unknown>"
UNKNOWN_IP = "0.0.0.0"
START = "start"
FINISH = "finish"
PREDICT = "predict"
PREDICTED = "Predicted"
RANDOM = "Random"
LOADING = "Loading"
NO_DATA = "NoData"
PREDICTING = "Predicting"
TRAINING = "Training"
SUSPENDED = "Suspended"
RUN_STATES = (LOADING, NO_DATA, PREDICTING, TRAINING, SUSPENDED)

IDENTITY = T.MapType(T.StringType(), T.StringType())

VARIATIONS = T.ArrayType(
    T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())])
)

DESCRIPTORS = T.ArrayType(
    T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("categorical", T.BooleanType())]
    )
)

START_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("app_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("session", T.StringType()),
        T.StructField("identity", IDENTITY),
        T.StructField("variation", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)

FINISH_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("app_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("session", T.StringType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("run_state", T.StringType()),
        T.StructField("predicting_from", T.LongType()),
        T.StructField("variations", VARIATIONS),
        T.StructField("descriptors", DESCRIPTORS),
        T.StructField("model_path", T.StringType()),
        T.StructField("model_type", T.StringType()),
    ]
)

TRAIN_METRICS = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("trained_at", T.LongType()),
        T.StructField("sample_size", T.LongType()),
        T.StructField("error", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("baseline_error", T.DoubleType()),
    ]
)

GEO_RANGES = T.StructType(
    [
        T.StructField("ip_from", T.LongType()),
        T.StructField("ip_to", T.LongType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

# One request as it arrives: the route it came in by, its JSON body, the caller's address.
REQUESTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("app_id", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("ip_num", T.LongType()),
        T.StructField("server_ts", T.LongType()),
        T.StructField("body", T.StringType()),
    ]
)
