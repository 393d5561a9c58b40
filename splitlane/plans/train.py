"""Training: sample, features, codes, split, fit, evaluation, and the retrain cycle."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.functions.hashing import feature_hash
from splitlane.operators.counts import retrain_eligible
from splitlane.operators.evaluate import evaluate_binary, in_training
from splitlane.operators.features import (
    categorical_positions,
    category_mapping,
    feature_vector,
    infer_supports,
    remap_sample,
    to_feature_frame,
)
from splitlane.operators.latest import latest_n
from splitlane.operators.lookup import lookup_join
from splitlane.operators.registry import registry_update
from splitlane.operators.sessions import session_sample
from splitlane.operators.trees import TREE_REGRESSOR, TreeSpec, fit_tree, forest_size, save_model, score_rows
from splitlane.schema import NO_DATA, PREDICTING, TRAIN_METRICS, TRAINING
from splitlane.session import settle
from splitlane.sinks.tables import append_metrics, write_registry
from splitlane.sources.tables import read_registry

PARALLEL_FITS = 4
# Rows times trees that one task of a fit passes through at each level, at least, when the
# rows are dealt out. There are never more tasks than cores: each sends sums for all nodes.
TASK_VISITS = 50_000

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Prepared:
    """The coded samples of all apps, and what they were coded by."""

    sample: DataFrame
    mapping: DataFrame
    registry: DataFrame

    def names(self, app_id: str) -> list[str]:
        """Feature names of one app: its descriptors, then the variation."""
        row = self.registry.where(F.col("app_id") == app_id).select("descriptors.name").first()
        return [*row[0], "variation"]

    def arities(self, app_id: str) -> dict[int, int]:
        """Category counts of one app's coded features: one number per descriptor at most."""
        rows = self.mapping.where(F.col("app_id") == app_id).select("pos", "arity").distinct()
        return {r.pos: r.arity for r in rows.collect()}


def labelled_sample(events: DataFrame, n: int | None = None) -> DataFrame:
    """The labelled sessions of every app; with ``n``, from its latest starts and finishes only."""
    return session_sample(latest_n(events, n))


def feature_width(registry: DataFrame) -> int:
    """Widest feature row of any app."""
    return registry.agg(F.max(F.size("descriptors"))).first()[0] + 1


def code_sample(features: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code the categories of feature rows; returns coded rows and the codes.

    Supports come from the whole sample, before any split. ``features`` is read
    twice; settle it first when it is dear to compute.
    """
    checked = to_feature_frame(features, registry)
    supports = settle(infer_supports(checked), "supports")
    mapping = settle(category_mapping(supports, categorical_positions(registry)), "codes")
    return remap_sample(checked, mapping, feature_width(registry)), mapping


def prepare_sample(
    events: DataFrame,
    registry: DataFrame,
    n: int | None = None,
    kinds: tuple[str, ...] | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
) -> Prepared:
    """Sample, featurize and code all apps at once; one folder per app for the fits to read.

    Rows are brought together by app and a large app is split again by size.
    """
    sample = session_sample(latest_n(events, n), kinds)
    features = settle(feature_vector(sample, registry, hash_fn), "features")
    coded, mapping = code_sample(features, registry)
    placed = coded.withColumn("train", in_training()).hint("rebalance", "app_id")
    return Prepared(settle(placed, "coded", ("app_id",)), mapping, registry)


def dealt_for_fit(train: DataFrame, n_rows: int, spec: TreeSpec) -> DataFrame:
    """``train`` dealt over the cores by session; as it is where the fit is little work.

    Rows are few bytes, so a whole app often lies in one file, which one task would read
    at every level of every tree. Sorted, so that a forest draws the same bags again.
    """
    visits = n_rows * forest_size(spec, n_rows)
    tasks = min(visits // TASK_VISITS, train.sparkSession.sparkContext.defaultParallelism)
    return train.repartition(tasks, "session").sortWithinPartitions("session") if tasks > 1 else train


@dataclass(frozen=True)
class Trained:
    """A fitted app; ``held`` is its test part."""

    app_id: str
    model: Model
    spec: TreeSpec
    held: DataFrame
    sample_size: int
    trained_at: int

    @cached_property
    def report(self) -> DataFrame:
        """Its metrics row; the test part is scored only where it is asked for."""
        return training_report(score_rows(self.model, self.held), self.sample_size, self.trained_at)


def train_app(
    prepared: Prepared,
    app_id: str,
    spec: TreeSpec = TREE_REGRESSOR,
    estimator: Estimator | None = None,
    trained_at: int = 0,
) -> Trained:
    """Fit one app's model on its whole training part and report on its test part."""
    rows = prepared.sample.where(F.col("app_id") == app_id)
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("train")).first()
    model = fit_tree(
        dealt_for_fit(rows.where("train"), sizes[1], spec),
        prepared.arities(app_id),
        prepared.names(app_id),
        spec,
        sizes[1],
        estimator,
    )
    return Trained(app_id, model, spec, rows.where(~F.col("train")), sizes[0], trained_at)


def training_report(scored: DataFrame, sample_size: int, trained_at: int) -> DataFrame:
    """One metrics row per app; predicting 0 everywhere errs on every positive."""
    measured = evaluate_binary(scored, F.col("label"), F.col("score"), "app_id")
    positives = (F.col("tp") + F.col("fn")).cast("double")
    return measured.select(
        "app_id",
        F.lit(trained_at).cast("bigint").alias("trained_at"),
        F.lit(sample_size).cast("bigint").alias("sample_size"),
        "error",
        "precision",
        "recall",
        (positives / F.col("n").cast("double")).alias("baseline_error"),
    )


def train_apps(prepared: Prepared, app_ids: list[str], spec: TreeSpec, parallel: int = PARALLEL_FITS) -> list[Trained]:
    """Fit the given apps, a few at a time, in their order."""
    spark = prepared.sample.sparkSession
    return list(_in_parallel(spark, lambda app: train_app(prepared, app, spec), app_ids, parallel))


def train_and_evaluate(
    events: DataFrame,
    registry: DataFrame,
    app_ids: list[str],
    spec: TreeSpec = TREE_REGRESSOR,
    n: int | None = None,
    parallel: int = PARALLEL_FITS,
) -> list[Trained]:
    """Prepare once, then fit the given apps, a few at a time."""
    return train_apps(prepare_sample(events, registry, n), app_ids, spec, parallel)


def _in_parallel(spark: SparkSession, work, items, parallel: int):
    """Run Spark jobs side by side so that small fits do not leave the cluster idle."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        yield from pool.map(inheritable_thread_target(spark)(work), items)


def retrain_cycle(
    events: DataFrame,
    registry_path: str,
    models_path: str,
    metrics_path: str,
    spec: TreeSpec = TREE_REGRESSOR,
    n: int | None = None,
    parallel: int = PARALLEL_FITS,
    now_ms: int | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
    estimator: Estimator | None = None,
    failures_path: str | None = None,
) -> list[str]:
    """Retrain every eligible app; returns the ids tried.

    Why a training failed is appended to ``failures_path``, if given.

    Apps go to Training first, then to Predicting with their model, or to
    NoData when training failed. Model and state are written together, so no
    reader sees one without the other. Only the ids of eligible apps and one
    outcome per app come to the driver.
    """
    spark = events.sparkSession
    registry = read_registry(spark, registry_path)
    eligible = settle(retrain_eligible(events, registry).select("app_id"), "eligible")
    ids = [r.app_id for r in eligible.toLocalIterator()]
    if not ids:
        return []
    started = now_ms if now_ms is not None else int(time.time() * 1000)
    marks = eligible.select("app_id", F.lit(TRAINING).alias("run_state"), F.lit(0).alias("seq"))
    write_registry(registry_update(registry, marks), registry_path)

    outcomes: list[tuple[str, str | None, tuple | None]] = []
    reasons: list[tuple[str, int, str]] = []
    try:
        chosen = lookup_join(events, eligible, "app_id", "inner")
        prepared = prepare_sample(chosen, registry, n, hash_fn=hash_fn)

        def one(app_id: str) -> tuple[str, str | None, tuple | None]:
            path = f"{models_path}/app_id={app_id}/trained_at={started}"
            try:
                done = train_app(prepared, app_id, spec, estimator, started)
                codes = prepared.mapping.where(F.col("app_id") == app_id)
                save_model(done.model, codes, path)
                return app_id, path, done.report.select(*TRAIN_METRICS.names).first()
            except Exception as error:  # one app's failure must not stop the others
                log.warning("training of app %s failed: %s", app_id, error)
                reasons.append((app_id, started, f"{type(error).__name__}: {error}"[:2000]))
                return app_id, None, None

        outcomes = list(_in_parallel(spark, one, ids, parallel))
    finally:
        tried = {app for app, _, _ in outcomes}
        outcomes += [(app, None, None) for app in ids if app not in tried]
        finished = int(time.time() * 1000) if now_ms is None else now_ms
        results = [
            (app, PREDICTING, finished, path, spec.model_type, 1)
            if path
            else (app, NO_DATA, None, None, None, 1)
            for app, path, _ in outcomes
        ]
        changes = spark.createDataFrame(
            results,
            "app_id string, run_state string, predicting_from bigint, "
            "model_path string, model_type string, seq int",
        )
        write_registry(
            registry_update(read_registry(spark, registry_path), changes), registry_path
        )
    if reasons and failures_path:
        failed = spark.createDataFrame(reasons, "app_id string, failed_at bigint, reason string")
        failed.write.mode("append").parquet(failures_path)
    # One append for all apps: parallel appends to one folder would undo each other.
    reports = [report for _, _, report in outcomes if report is not None]
    if reports:
        append_metrics(spark.createDataFrame(reports, TRAIN_METRICS), metrics_path)
    return ids
