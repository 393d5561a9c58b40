"""The registered queries: every operator on the given tables.

Each takes a session and the folder of the tables and returns a DataFrame of
plain columns (maps and arrays as text or as one column per position).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.functions import bodies as B
from splitlane.functions import scores as S
from splitlane.functions.hashing import draw_unit, feature_hash
from splitlane.functions.identity import (
    enrich_identity,
    identity_text,
    merge_identity,
    project_identity,
)
from splitlane.functions.ids import pad_id
from splitlane.operators import assign, counts, evaluate, features, filters, latest, registry, sessions
from splitlane.operators.geo import geo_range_join
from splitlane.operators.lookup import dealt
from splitlane.operators.trees import (
    FOREST_CLASSIFIER,
    FOREST_REGRESSOR,
    TREE_CLASSIFIER,
    TREE_REGRESSOR,
    TreeSpec,
    load_model,
    save_model,
    score_rows,
)
from splitlane.plans import predict, train
from splitlane.plans import views as V
from splitlane.schema import FINISH, PREDICT, PREDICTED, PREDICTING, REQUESTS, START, START_EVENTS, SUSPENDED
from splitlane.session import scratch_path, settle
from splitlane.sinks import manifest
from splitlane.sinks import tables as sinks
from splitlane.sources import tables as sources
from splitlane.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

APP_0 = "0" * 24
APP_1 = "0" * 23 + "1"
APP_2 = "0" * 23 + "2"
APP_3 = "0" * 23 + "3"
LATEST = 500
NOW_MS = 1707000000000
SEEN_UNTIL = 1704153600000


def query(work: Query) -> Query:
    QUERIES[work.__name__.rstrip("_")] = work
    return work


def _start_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "event_id",
        "app_id",
        "ts_ms",
        "session",
        identity_text(F.col("identity")).alias("identity"),
        "variation",
        "kind",
        *more,
    )


def _positions(width: int = 4) -> list[Column]:
    return [F.get("features", F.lit(i)).alias(f"f{i}") for i in range(width)]


def _registry_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "app_id",
        "run_state",
        "predicting_from",
        B.encode_config(F.col("variations"), F.col("descriptors")).alias("config"),
        "model_path",
        "model_type",
    )


# --- scans, sources, decoding, encoding ------------------------------------------------------


@query
def scan_start(spark: SparkSession, sf: str) -> DataFrame:
    return _start_columns(filters.filter_equal(V.start_events(spark, sf), app_id=APP_1, kind="Random"))


@query
def scan_finish(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_equal(V.finish_events(spark, sf), app_id=APP_0)


@query
def registry_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _registry_columns(registry.registry_lookup(V.many_apps(spark, sf), "11".zfill(24)))


@query
def scan_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    checked = sources.scan_tolerant(V.bodies(spark, sf))
    return checked.select("event_id", "app_id", "route", "fault")


@query
def decode_start_json(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = sources.decode_starts(filters.filter_equal(V.bodies(spark, sf), route=START))
    return _start_columns(good)


@query
def decode_predict_json(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = sources.decode_predicts(V.bodies(spark, sf))
    return good.select(
        "event_id", "app_id", "ts_ms", "session", identity_text(F.col("identity")).alias("identity")
    )


@query
def decode_finish_json(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = sources.decode_finishes(filters.filter_equal(V.bodies(spark, sf), route=FINISH))
    return good.select("event_id", "app_id", "ts_ms", "session")


@query
def decode_config_json(spark: SparkSession, sf: str) -> DataFrame:
    decoded = B.decode_config(V.config_bodies(spark, sf))
    return decoded.select(
        "app_id",
        "fault",
        F.when(
            F.col("fault").isNull(), B.encode_config(F.col("variations"), F.col("descriptors"))
        ).alias("config"),
    )


@query
def encode_json(spark: SparkSession, sf: str) -> DataFrame:
    ts, session = F.col("ts_ms"), F.col("session")
    start = B.encode_start(session, ts, F.col("identity"), F.col("variation"))
    body = F.when(F.col("etype") == START, start).otherwise(B.encode_finish(session, ts))
    return V.ab(spark, sf).select("event_id", body.alias("body"))


@query
def encode_config_json(spark: SparkSession, sf: str) -> DataFrame:
    return V.many_apps(spark, sf).select(
        "app_id", B.encode_config(F.col("variations"), F.col("descriptors")).alias("body")
    )


@query
def encode_status_json(spark: SparkSession, sf: str) -> DataFrame:
    status = counts.app_status(V.event_rows(spark, sf), V.two_apps(spark))
    state = B.state_text(F.col("run_state"), F.col("predicting_from"))
    return status.select(
        "app_id", B.encode_status(state, F.col("n_start"), F.col("n_finish")).alias("body")
    )


@query
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    events = V.event_rows(spark, sf).select("event_id", "app_id", "etype", "session")
    parts = [
        filters.filter_app(filters.starts_of(events), APP_0),
        filters.filter_app(filters.starts_of(events), APP_1),
        filters.finishes_of(events),
    ]
    return filters.union_sources(parts)


# --- sinks and table updates -----------------------------------------------------------------


@query
def append_start(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "starts")
    sinks.append_starts(V.start_events(spark, sf), path)
    return _start_columns(sources.scan_starts(spark, path))


# Batches the start events are published in by ``append_start_compacted``.
BATCHES = 8


@query
def append_start_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The start events published in batches through a manifest, one batch twice, then packed."""
    root = scratch_path(spark, "starts")
    events = V.start_events(spark, sf).select(*START_EVENTS.names)
    part = F.pmod(F.xxhash64("event_id"), F.lit(BATCHES))
    for number in [*range(BATCHES), BATCHES // 2]:
        manifest.publish_batch(events.where(part == number), root, number)
    manifest.compact(spark, root, START_EVENTS)
    return _start_columns(manifest.read_events(spark, root, START_EVENTS))


@query
def append_finish(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "finishes")
    sinks.append_finishes(V.finish_events(spark, sf), path)
    return sources.scan_finishes(spark, path).select("event_id", "app_id", "ts_ms", "session")


@query
def registry_create(spark: SparkSession, sf: str) -> DataFrame:
    made = registry.registry_create(V.many_apps(spark, sf), V.create_requests(spark, sf))
    return _registry_columns(made)


@query
def registry_update(spark: SparkSession, sf: str) -> DataFrame:
    changed = registry.registry_update(V.many_apps(spark, sf), V.registry_changes(spark, sf))
    return _registry_columns(changed)


@query
def update_where(spark: SparkSession, sf: str) -> DataFrame:
    late = F.col("predicting_from") > V.SECOND_APP_EPOCH + 100
    changed = registry.update_where(
        V.many_apps(spark, sf), late, run_state=F.lit(SUSPENDED), model_path=F.lit("retired")
    )
    return _registry_columns(changed)


@query
def dump_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The samples of both apps, each dumped to files of its own and read back."""
    names = ["segment", "nation", "day"]
    schema = ", ".join(f"{n} string" for n in [*names, "variation", "result"])
    sample = settle(sessions.session_sample(V.ab(spark, sf)), "sample")
    parts = []
    for app_id in (APP_0, APP_1):
        path = sinks.dump_sample(filters.filter_app(sample, app_id), names, scratch_path(spark, "dump"))
        dumped = spark.read.schema(schema).option("header", True).csv(path).na.fill("")
        parts.append(dumped.withColumn("app_id", F.lit(app_id)))
    return filters.union_sources(parts)


# --- projections, filters, scalar functions --------------------------------------------------


@query
def filter_app(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_app(V.event_rows(spark, sf), APP_1).select("event_id", "app_id", "etype")


@query
def filter_since(spark: SparkSession, sf: str) -> DataFrame:
    recent = filters.filter_since(V.event_rows(spark, sf), V.SECOND_APP_EPOCH)
    return recent.select("event_id", "app_id", "ts_ms")


@query
def split_by_type(spark: SparkSession, sf: str) -> DataFrame:
    starts, finishes = filters.split_by_type(V.event_rows(spark, sf).select("event_id", "etype"))
    return starts.withColumn("part", F.lit(0)).unionByName(finishes.withColumn("part", F.lit(1)))


@query
def filter_known_variation(spark: SparkSession, sf: str) -> DataFrame:
    configured = features.config_join(V.visits(spark, sf), V.many_apps(spark, sf))
    return filters.filter_known_variation(configured).select("event_id", "app_id", "variation")


@query
def pad_id_(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("c_custkey").cast("string")
    long_text = F.concat("c_name", "c_mktsegment")
    return V.table(spark, sf, "customer").select(
        "c_custkey", pad_id(number).alias("short_id"), pad_id(long_text).alias("long_id")
    )


@query
def stamp_server_ts(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.event_rows(spark, sf).select("event_id", "ts_ms")
    return filters.stamp_server_time(rows, NOW_MS)


@query
def identity_merge(spark: SparkSession, sf: str) -> DataFrame:
    added = V.identity_of(nation=F.concat(F.lit("near "), F.col("nation")), k=F.col("k").cast("string"))
    merged = merge_identity(F.col("identity"), added)
    return V.ab(spark, sf).select("event_id", identity_text(merged).alias("identity"))


def _addressed(spark: SparkSession, sf: str) -> DataFrame:
    """Events, some without an address."""
    known = F.when(F.col("k") % 4 != 0, F.col("ip_num"))
    return V.ab(spark, sf).withColumn("ip_num", known)


@query
def identity_enrich(spark: SparkSession, sf: str) -> DataFrame:
    placed = geo_range_join(_addressed(spark, sf), V.geo_ranges(spark, sf))
    identity = enrich_identity(
        F.col("identity"), F.col("ts_ms"), F.col("ip_num"), F.col("city"), F.col("country")
    )
    return placed.select("event_id", identity_text(identity).alias("identity"))


@query
def geo_range_join_(spark: SparkSession, sf: str) -> DataFrame:
    events = V.event_rows(spark, sf).select("event_id", "ip_num")
    return geo_range_join(events, V.geo_ranges(spark, sf))


@query
def identity_project(spark: SparkSession, sf: str) -> DataFrame:
    return V.ab(spark, sf).select(
        "event_id", *project_identity(F.col("identity"), ["segment", "nation", "absent"])
    )


@query
def feature_hash_(spark: SparkSession, sf: str) -> DataFrame:
    return V.ab(spark, sf).select(
        "event_id",
        feature_hash(F.col("segment")).alias("segment_hash"),
        feature_hash(F.col("nation")).alias("nation_hash"),
        feature_hash(F.col("session")).alias("session_hash"),
    )


def _supports(spark: SparkSession, sf: str) -> DataFrame:
    """Supports as a table of its own, as operators reading them more than once expect."""
    return settle(features.infer_supports(_vectors(spark, sf)), "supports")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_vector(sessions.session_sample(V.ab(spark, sf)), V.two_apps(spark))


@query
def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("app_id", "session", *_positions(), "label")


@query
def to_feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    starts = V.start_events(spark, sf).withColumn("goal", F.lit(False))
    vectors = features.feature_vector(starts, V.two_apps(spark))
    checked = features.to_feature_frame(vectors, V.two_apps(spark))
    return checked.select("event_id", *_positions(), F.size("features").alias("width"))


@query
def variation_index(spark: SparkSession, sf: str) -> DataFrame:
    configured = features.config_join(V.visits(spark, sf), V.many_apps(spark, sf))
    return features.variation_index(configured).select("event_id", "variation_idx")


@query
def categorical_positions(spark: SparkSession, sf: str) -> DataFrame:
    return features.categorical_positions(V.many_apps(spark, sf))


@query
def deduce_kind(spark: SparkSession, sf: str) -> DataFrame:
    modelled = F.col("k") % 5 == 0
    return V.event_rows(spark, sf).select("event_id", S.event_kind(modelled).alias("kind"))


@query
def round_prediction(spark: SparkSession, sf: str) -> DataFrame:
    score = F.floor("value") / 2 - 5
    return V.table(spark, sf, "events").select(
        "event_id", S.round_half_up(score).alias("predicted")
    )


# --- joins -----------------------------------------------------------------------------------


@query
def session_pair_join(spark: SparkSession, sf: str) -> DataFrame:
    starts, finishes = filters.split_by_type(V.event_rows(spark, sf))
    paired = sessions.session_pair_join(starts, finishes)
    return paired.select("app_id", "session", "event_id", "variation", "goal")


@query
def config_join(spark: SparkSession, sf: str) -> DataFrame:
    configured = features.config_join(V.visits(spark, sf), V.many_apps(spark, sf), "left")
    return configured.select(
        "event_id",
        "app_id",
        B.encode_config(F.col("variations"), F.col("descriptors")).alias("config"),
    )


@query
def expand_variations(spark: SparkSession, sf: str) -> DataFrame:
    configured = features.config_join(V.visits(spark, sf), V.many_apps(spark, sf))
    return assign.expand_variations(configured).select(
        "event_id", "variation_idx", F.col("option.id").alias("option_id")
    )


# --- aggregates ------------------------------------------------------------------------------


@query
def count_events(spark: SparkSession, sf: str) -> DataFrame:
    return counts.count_events(V.event_rows(spark, sf), "app_id", "etype")


@query
def app_status(spark: SparkSession, sf: str) -> DataFrame:
    status = counts.app_status(V.event_rows(spark, sf), V.two_apps(spark), V.SECOND_APP_EPOCH)
    return status.select("app_id", "run_state", "n_start", "n_finish")


def _sample_columns(sample: DataFrame) -> DataFrame:
    return sample.select(
        "app_id",
        "session",
        "event_id",
        identity_text(F.col("identity")).alias("identity"),
        "variation",
        "n_start",
        "goal",
    )


@query
def session_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample_columns(sessions.session_sample(V.ab(spark, sf)))


@query
def labelled_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample as training takes it: all starts and finishes, paired."""
    return _sample_columns(train.labelled_sample(V.ab(spark, sf)))


@query
def retrain_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return counts.retrain_eligible(V.event_rows(spark, sf), V.two_apps(spark)).select(
        "app_id", "run_state", "epoch", "n_start", "n_finish"
    )


@query
def infer_supports(spark: SparkSession, sf: str) -> DataFrame:
    return features.infer_supports(_vectors(spark, sf))


@query
def support_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return features.support_sizes(features.infer_supports(_vectors(spark, sf)))


@query
def explanatory_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.explanatory_features(features.infer_supports(_vectors(spark, sf)))


@query
def evaluate_binary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.evaluate_binary(
        V.table(spark, sf, "labels"), F.col("quality"), F.col("toxic").cast("double")
    )


@query
def evaluate_baseline(spark: SparkSession, sf: str) -> DataFrame:
    sample = sessions.session_sample(V.event_rows(spark, sf))
    return evaluate.evaluate_baseline(sample, F.col("goal").cast("int"), "app_id")


# --- ranking, sets ---------------------------------------------------------------------------


@query
def latest_start(spark: SparkSession, sf: str) -> DataFrame:
    starts = filters.starts_of(V.event_rows(spark, sf))
    return latest.latest_start(starts).select("app_id", "session", "event_id", "variation", "kind")


@query
def latest_n(spark: SparkSession, sf: str) -> DataFrame:
    events = V.event_rows(spark, sf).select("event_id", "app_id", "etype", "session")
    return latest.latest_n(events, LATEST)


def _scored_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Visits expanded into variations, with scores drawn from five values so that some tie."""
    configured = features.config_join(V.visits(spark, sf), V.many_apps(spark, sf))
    score = F.floor(draw_unit(F.col("event_id"), F.col("variation_idx")) * 5) / 5
    return assign.expand_variations(configured).withColumn("score", score)


@query
def argmax_variation(spark: SparkSession, sf: str) -> DataFrame:
    return assign.argmax_variation(_scored_visits(spark, sf), "event_id", "app_id")


@query
def union_events(spark: SparkSession, sf: str) -> DataFrame:
    starts = filters.starts_of(V.event_rows(spark, sf)).select("event_id", "app_id", "session", "variation")
    return filters.union_events(starts, V.finish_events(spark, sf).drop("ts_ms"))


@query
def merge_supports(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    converted = features.infer_supports(vectors.where("label = 1"))
    others = features.infer_supports(vectors.where("label = 0"))
    return features.merge_supports(converted, others)


# --- draws -----------------------------------------------------------------------------------


@query
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    sample = sessions.session_sample(V.event_rows(spark, sf)).select("app_id", "session", "goal")
    first, second = evaluate.train_test_split(sample)
    return first.withColumn("train", F.lit(True)).unionByName(second.withColumn("train", F.lit(False)))


@query
def random_assign(spark: SparkSession, sf: str) -> DataFrame:
    configured = features.config_join(V.visits(spark, sf), V.many_apps(spark, sf))
    return assign.random_assign(configured.drop("variation")).select(
        "event_id", "variation_idx", "variation", "value", "kind"
    )


@query
def score_jitter(spark: SparkSession, sf: str) -> DataFrame:
    nudged = assign.score_jitter(_scored_visits(spark, sf), "app_id", "event_id")
    return nudged.select("event_id", "variation_idx", F.round("score", 9).alias("score"))


@query
def unseen_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions coded by the categories of the first day's events alone."""
    known = filters.starts_of(V.ab(spark, sf)).where(F.col("ts_ms") < SEEN_UNTIL)
    apps = V.two_apps(spark)
    vectors = features.feature_vector(known.withColumn("goal", F.lit(False)), apps)
    seen = settle(features.infer_supports(vectors), "supports")
    codes = settle(features.category_mapping(seen, features.categorical_positions(apps)), "codes")
    coded = features.encode_unseen(_vectors(spark, sf), codes, 4, "app_id", "session")
    return coded.select("app_id", "session", *_positions())


# --- features, training, scoring -------------------------------------------------------------


@query
def category_mapping(spark: SparkSession, sf: str) -> DataFrame:
    positions = features.categorical_positions(V.two_apps(spark))
    return features.category_mapping(_supports(spark, sf), positions)


@query
def remap_sample(spark: SparkSession, sf: str) -> DataFrame:
    coded, _ = train.code_sample(settle(_vectors(spark, sf), "features"), V.two_apps(spark))
    return coded.select("app_id", "session", *_positions(), "label")


def _length_hash(value: Column) -> Column:
    return F.coalesce(F.char_length(value), F.lit(-1)).cast("double")


@query
def prepare_sample_own_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The sample with the length of a value as its feature number."""
    prepared = train.prepare_sample(V.ab(spark, sf), V.two_apps(spark), hash_fn=_length_hash)
    return prepared.sample.select("app_id", "session", *_positions(), "label", "train")


@query
def prepare_sample(spark: SparkSession, sf: str) -> DataFrame:
    prepared = train.prepare_sample(V.ab(spark, sf), V.two_apps(spark))
    return prepared.sample.select("app_id", "session", *_positions(), "label", "train")


def _app_ids(apps: DataFrame) -> list[str]:
    return [r.app_id for r in apps.select("app_id").toLocalIterator()]


def _fitted(spec: TreeSpec, spark: SparkSession, sf: str) -> DataFrame:
    """Each app's sessions scored by a model fitted on its training sessions, summed up by part.

    A leaf gives the mean label of its training rows, so over the training part a single
    tree's scores sum up to the labels. A forest's trees see other rows each: its sum is
    near that of the labels.
    """
    apps = V.two_apps(spark)
    prepared = train.prepare_sample(V.ab(spark, sf), apps)
    parts = []
    for done in train.train_apps(prepared, _app_ids(apps), spec):
        parts.append(score_rows(done.model, prepared.sample.where(F.col("app_id") == done.app_id)))
    total, labels = F.sum("score"), F.sum("label")
    near = F.abs(total - labels) <= 3 * F.sqrt(F.count(F.lit(1)))
    return (
        filters.union_sources(parts)
        .groupBy("app_id", "train")
        .agg(
            F.count(F.lit(1)).alias("n"),
            labels.alias("label_sum"),
            total.alias("_total"),
            F.bool_and(F.col("score").between(0.0, 1.0)).alias("in_range"),
            F.when(F.first("train"), near).alias("near"),
        )
        .select(
            "app_id",
            "train",
            "n",
            "label_sum",
            "in_range",
            "near",
            *(
                [F.when(F.col("train"), F.round("_total", 6)).alias("score_sum")]
                if spec.model_type.startswith("tree")
                else []
            ),
        )
    )


QUERIES["fit_dt_regressor"] = partial(_fitted, TREE_REGRESSOR)
QUERIES["fit_rf_regressor"] = partial(_fitted, FOREST_REGRESSOR)
QUERIES["fit_dt_classifier"] = partial(_fitted, TREE_CLASSIFIER)
QUERIES["fit_rf_classifier"] = partial(_fitted, FOREST_CLASSIFIER)


@query
def train_and_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """The reports, with their rates held against the test sessions scored once more."""
    apps = V.two_apps(spark)
    prepared = train.prepare_sample(V.ab(spark, sf), apps)
    reports, again = [], []
    for app_id in _app_ids(apps):
        done = train.train_app(prepared, app_id)
        reports.append(done.report)
        mine = prepared.sample.where((F.col("app_id") == app_id) & ~F.col("train"))
        again.append(score_rows(done.model, mine))
    said, right = F.col("score") >= 0.5, F.col("label") == 1
    share = lambda part, whole: F.coalesce(
        F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0)), F.lit(float("nan"))
    )
    rates = filters.union_sources(again).groupBy("app_id").agg(
        share(said != right, F.lit(True)).alias("_error"),
        share(said & right, said).alias("_precision"),
        share(said & right, right).alias("_recall"),
    )
    holds = [
        (F.col(c) == F.col(f"_{c}")) | (F.isnan(c) & F.isnan(f"_{c}")) for c in ("error", "precision", "recall")
    ]
    return filters.union_sources(reports).join(rates, "app_id").select(
        "app_id",
        "trained_at",
        "sample_size",
        F.round("baseline_error", 9).alias("baseline_error"),
        (holds[0] & holds[1] & holds[2]).alias("rates_hold"),
    )


@query
def train_report(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics table after one training of each app; its exact columns only."""
    apps = V.two_apps(spark)
    path = scratch_path(spark, "metrics")
    for trained in train.train_and_evaluate(V.ab(spark, sf), apps, _app_ids(apps)):
        sinks.append_metrics(trained.report, path)
    return spark.read.parquet(path).select(
        "app_id", "sample_size", F.round("baseline_error", 9).alias("baseline_error")
    )


@query
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions scored by a model and by the same model read back, and how many differ."""
    apps = V.two_apps(spark)
    prepared = train.prepare_sample(V.ab(spark, sf), apps)
    parts = []
    for app_id in _app_ids(apps):
        done = train.train_app(prepared, app_id)
        path = scratch_path(spark, "model")
        save_model(done.model, prepared.mapping.where(F.col("app_id") == app_id), path)
        again, _ = load_model(spark, path, done.spec.model_type)
        rows = prepared.sample.where(F.col("app_id") == app_id)
        both = score_rows(again, score_rows(done.model, rows).withColumnRenamed("score", "before"))
        parts.append(both)
    return (
        filters.union_sources(parts)
        .groupBy("app_id")
        .agg(
            F.count(F.lit(1)).alias("n_scored"),
            F.count_if(F.col("before") != F.col("score")).alias("n_different"),
        )
    )


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a predict request."""
    return V.ab(spark, sf).select("event_id", "app_id", "session", "ts_ms", "ip_num", "identity")


def _trained_registry(
    spark: SparkSession, sf: str, spec: TreeSpec = TREE_REGRESSOR, app_ids: tuple[str, ...] = (APP_1,)
) -> tuple[DataFrame, predict.ModelLoader]:
    """The two apps, those named predicting with a model fitted for them, and a loader of the models."""
    apps = V.two_apps(spark)
    prepared = train.prepare_sample(V.ab(spark, sf), apps)
    fitted = {a: (train.train_app(prepared, a, spec).model, prepared.mapping.where(F.col("app_id") == a)) for a in app_ids}

    def loader(path: str, kind: str) -> tuple[Model, DataFrame]:
        return fitted[path]

    modelled = registry.update_where(
        apps,
        F.col("app_id").isin(*app_ids),
        run_state=F.lit(PREDICTING),
        model_path=F.col("app_id"),
        model_type=F.lit(spec.model_type),
    )
    return modelled, loader


def _scored_both_ways(spark: SparkSession, sf: str, apps: DataFrame, loader: predict.ModelLoader) -> DataFrame:
    """Requests of the modelled apps with ``scores``, and ``singly``: the same from one row per variation."""
    scoring = list(predict.modelled_apps(apps))
    loaded = {a.app_id: loader(a.model_path, a.model_type) for a in scoring}
    models = {app_id: model for app_id, (model, _) in loaded.items()}
    codes = settle(filters.union_sources([mapping for _, mapping in loaded.values()]), "codes")
    # Dealt by request: the files hold too many rows each to be scored, and all sums and joins are by request.
    configured = dealt(settle(features.config_join(_requests(spark, sf), apps), "configured"), "event_id")
    options = predict.variation_codes(codes, scoring)
    parts = []
    for app, scored in zip(scoring, predict.score_apps(configured, scoring, models, codes)):
        mine = predict.coded_identity(configured.where(F.col("app_id") == app.app_id), codes, app.n_descriptors)
        rows = mine.select(
            "event_id", "features", F.posexplode(F.array(*[o.cast("double") for o in options[app.app_id]])).alias("i", "code")
        ).select("event_id", "i", F.concat("features", F.array("code")).alias("features"))
        singly = (
            score_rows(models[app.app_id], rows)
            .groupBy("event_id")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "score"))), lambda x: x["score"]).alias("singly"))
        )
        parts.append(scored.join(singly, "event_id"))
    return filters.union_sources(parts)


def _option_scores(spark: SparkSession, sf: str, spec: TreeSpec) -> DataFrame:
    """How many scores each request of either app has, and whether they are what single rows get."""
    both = _scored_both_ways(spark, sf, *_trained_registry(spark, sf, spec, (APP_0, APP_1)))
    return both.select(
        "event_id",
        "app_id",
        F.size("scores").alias("n_scores"),
        F.forall("scores", lambda s: s.between(0.0, 1.0)).alias("in_range"),
        (F.col("scores") == F.col("singly")).alias("agree"),
    )


def _held_against_scores(spark: SparkSession, sf: str, apps: DataFrame, loader: predict.ModelLoader, decided: DataFrame) -> DataFrame:
    """``decided`` with ``drawn``, the variation of a random decision, and ``best``.

    ``best`` tells of a predicted one whether it has the highest score of all variations,
    jitter included, worked out from one row per variation; of a random one it is null.
    """
    scored = _scored_both_ways(spark, sf, apps, loader).select(
        "event_id", "app_id", "variations", F.posexplode("singly").alias("variation_idx", "score")
    )
    top = assign.argmax_variation(assign.score_jitter(scored, "app_id", "event_id"), "event_id", "app_id").select(
        "event_id", "variation_idx"
    )
    right = top.join(scored, ["event_id", "variation_idx"]).select(
        "event_id", F.get("variations", F.col("variation_idx"))["id"].alias("_right")
    )
    random = F.col("kind") != PREDICTED
    return decided.join(right, "event_id", "left").select(
        *decided.columns,
        F.when(random, F.col("variation")).alias("drawn"),
        F.when(~random, F.col("variation") == F.col("_right")).alias("best"),
    )


@query
def score_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _option_scores(spark, sf, TREE_REGRESSOR)


@query
def score_classification(spark: SparkSession, sf: str) -> DataFrame:
    return _option_scores(spark, sf, TREE_CLASSIFIER)


@query
def choose_variation(spark: SparkSession, sf: str) -> DataFrame:
    apps, loader = _trained_registry(spark, sf)
    decided = settle(predict.choose_variation(_requests(spark, sf), apps, loader), "decided")
    return _replies_held(spark, sf, apps, loader, decided)


def _replies_held(spark: SparkSession, sf: str, apps: DataFrame, loader: predict.ModelLoader, decided: DataFrame) -> DataFrame:
    held = _held_against_scores(spark, sf, apps, loader, decided.select("event_id", "variation", "kind"))
    return predict.replies(decided).join(held.select("event_id", "drawn", "best"), "event_id").select(
        "event_id",
        "app_id",
        "predicted",
        "drawn",
        "best",
        F.when(F.col("drawn").isNotNull(), F.col("value")).alias("value"),
    )


def _saved_registry(
    spark: SparkSession, sf: str, spec: TreeSpec = TREE_REGRESSOR, app_ids: tuple[str, ...] = (APP_1,)
) -> tuple[DataFrame, predict.ModelLoader]:
    """As ``_trained_registry``, with each model saved in a folder of its own, as training leaves it."""
    apps, loader = _trained_registry(spark, sf, spec, app_ids)
    folders = {app: scratch_path(spark, "model") for app in app_ids}
    for app, folder in folders.items():
        save_model(*loader(app, spec.model_type), folder)
    owners = {folder: app for app, folder in folders.items()}
    paths = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    saved = registry.update_where(apps, F.col("app_id").isin(*app_ids), model_path=F.element_at(paths, F.col("app_id")))
    return saved, lambda path, kind: loader(owners[path], kind)


@query
def choose_variation_as_data(spark: SparkSession, sf: str) -> DataFrame:
    """``choose_variation`` with the model read as a node table; held against Spark ML's scores."""
    apps, loader = _saved_registry(spark, sf)
    decided = settle(predict.choose_variation(_requests(spark, sf), apps, as_data=True), "decided")
    return _replies_held(spark, sf, apps, loader, decided)


def decide_and_log(spark: SparkSession, sf: str, apps: DataFrame, loader: predict.ModelLoader) -> DataFrame:
    """The logged decisions of all requests."""
    path = scratch_path(spark, "decided")
    enriched = predict.enrich_requests(_requests(spark, sf), V.geo_ranges(spark, sf))
    predict.predict_and_log(
        enriched, apps, lambda rows, _: sinks.append_starts(rows, path), F.lit(NOW_MS), loader
    )
    return sources.scan_starts(spark, path)


@query
def predict_and_log(spark: SparkSession, sf: str) -> DataFrame:
    apps, loader = _trained_registry(spark, sf)
    return _logged_held(spark, sf, apps, loader, decide_and_log(spark, sf, apps, loader))


def _logged_held(spark: SparkSession, sf: str, apps: DataFrame, loader: predict.ModelLoader, logged: DataFrame) -> DataFrame:
    held = _held_against_scores(spark, sf, apps, loader, logged.select("event_id", "variation", "kind"))
    return logged.join(held.select("event_id", "drawn", "best"), "event_id").select(
        "event_id",
        "app_id",
        "ts_ms",
        "session",
        identity_text(F.col("identity")).alias("identity"),
        "kind",
        "drawn",
        "best",
    )


@query
def predict_and_log_as_data(spark: SparkSession, sf: str) -> DataFrame:
    """``predict_and_log`` deciding by node tables in one plan (no loader); held against Spark ML's scores."""
    apps, loader = _saved_registry(spark, sf)
    return _logged_held(spark, sf, apps, loader, decide_and_log(spark, sf, apps, None))


# --- registry state --------------------------------------------------------------------------


@query
def apply_commands(spark: SparkSession, sf: str) -> DataFrame:
    return registry.apply_commands(V.many_apps(spark, sf), V.commands(spark, sf))


@query
def command_job(spark: SparkSession, sf: str) -> DataFrame:
    """The registry version written after all commands were judged."""
    path = scratch_path(spark, "commands")
    sinks.write_registry(V.many_apps(spark, sf), path)
    registry.command_job(spark, path, V.commands(spark, sf))
    return _registry_columns(sources.read_registry(spark, path))


@query
def recover_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _registry_columns(registry.recover_registry(V.many_apps(spark, sf)))


def _retrained(spark: SparkSession, events: DataFrame, path: str) -> list[str]:
    return train.retrain_cycle(
        events, f"{path}/registry", f"{path}/models", f"{path}/metrics", now_ms=NOW_MS
    )


def _registry_outcome(spark: SparkSession, path: str) -> DataFrame:
    return sources.read_registry(spark, f"{path}/registry").select(
        "app_id",
        "run_state",
        "predicting_from",
        "model_type",
        F.col("model_path").isNotNull().alias("has_model"),
    )


@query
def retrain_cycle(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cycle")
    sinks.write_registry(V.two_apps(spark), f"{path}/registry")
    _retrained(spark, V.ab(spark, sf), path)
    return _registry_outcome(spark, path)


# --- streams ---------------------------------------------------------------------------------


def _request_files(spark: SparkSession, requests: DataFrame, path: str) -> DataFrame:
    """Requests written as JSON lines, then read as a stream."""
    requests.select(*REQUESTS.names).write.json(f"{path}/requests")
    return jobs.request_stream(spark, f"{path}/requests")


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Stored events, and what was turned away and why; some requests go to a suspended app, to
    one that doesn't exist, or by a route that doesn't."""
    path = scratch_path(spark, "ingest")
    suspended = V.two_apps(spark).where(F.col("app_id") == APP_0).withColumns(
        {"app_id": F.lit(APP_3), "run_state": F.lit(SUSPENDED)}
    )
    sinks.write_registry(V.two_apps(spark).unionByName(suspended), f"{path}/registry")
    number = F.col("event_id")
    elsewhere = F.when(number % 83 == 0, F.lit(APP_3)).when(number % 89 == 0, F.lit(APP_2))
    requests = V.bodies(spark, sf).withColumns(
        {
            "app_id": F.coalesce(elsewhere, F.col("app_id")),
            "route": F.when(number % 97 == 0, F.lit("visit")).otherwise(F.col("route")),
        }
    )
    stream = _request_files(spark, requests, path)
    jobs.stream_ingest(
        stream, V.geo_ranges(spark, sf), f"{path}/out", f"{path}/state", once=True, registry_path=f"{path}/registry"
    ).awaitTermination()
    starts = _start_columns(sources.scan_starts(spark, f"{path}/out/starts"))
    finishes = sources.scan_finishes(spark, f"{path}/out/finishes").select(
        "event_id", "app_id", "ts_ms", "session"
    )
    away = spark.read.schema(T.StructType([*REQUESTS.fields, T.StructField("fault", T.StringType())])).parquet(
        f"{path}/out/quarantine"
    )
    stored = filters.union_events(starts, finishes).withColumn("fault", F.lit(None).cast("string"))
    return stored.unionByName(
        away.select("event_id", "app_id", F.col("route").alias("etype"), "fault"), allowMissingColumns=True
    )


@query
def refused_requests(spark: SparkSession, sf: str) -> DataFrame:
    return predict.refused_requests(V.visits(spark, sf), V.many_apps(spark, sf))


@query
def stream_session_sample(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sessions")
    source = V.table(spark, sf, "events")
    # As a pattern, the path may be one file as well as a folder of files.
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parque[t]")
    jobs.stream_session_sample(
        V.plain_events(stream), f"{path}/out", f"{path}/state", once=True
    ).awaitTermination()
    return jobs.read_session_sample(spark, f"{path}/out").select(
        "app_id", "session", "event_id", "variation", "n_start", "goal"
    )


def _predict_stream(spark: SparkSession, sf: str, path: str, after=None) -> None:
    body = B.encode_predict(F.col("session"), F.col("ts_ms"), F.col("identity"))
    requests = V.ab(spark, sf).select(
        "event_id",
        "app_id",
        F.lit(PREDICT).alias("route"),
        "ip_num",
        (F.col("ts_ms") + 250).alias("server_ts"),
        body.alias("body"),
    )
    stream = _request_files(spark, requests, path)
    jobs.stream_predict(
        stream,
        V.geo_ranges(spark, sf),
        f"{path}/registry",
        f"{path}/out",
        f"{path}/state",
        once=True,
        after_batch=after,
    ).awaitTermination()


@query
def stream_predict(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predict")
    sinks.write_registry(V.two_apps(spark), f"{path}/registry")
    _predict_stream(spark, sf, path)
    return _start_columns(sources.scan_starts(spark, f"{path}/out/starts"))


@query
def stream_retrain_trigger(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "trigger")
    sinks.write_registry(V.two_apps(spark), f"{path}/registry")

    def retrain() -> list[str]:
        """From the decisions logged so far, and the finishes of the table."""
        logged = sources.scan_starts(spark, f"{path}/out/starts").select(*START_EVENTS.names)
        starts = logged.withColumn("etype", F.lit(START))
        finishes = V.ab(spark, sf).where(F.col("etype") == FINISH).select(*starts.columns)
        return _retrained(spark, starts.unionByName(finishes), path)

    trigger = jobs.retrain_trigger(retrain, background=True)
    _predict_stream(spark, sf, path, trigger)
    trigger.wait()
    return _registry_outcome(spark, path)
