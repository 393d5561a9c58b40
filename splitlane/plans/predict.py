"""Deciding: which variation each visitor gets, and logging the decision as a start event."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.ml import Model, Transformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.functions.hashing import draw_below, feature_hash
from splitlane.functions.identity import enrich_identity
from splitlane.operators.assign import chosen, pick_best, random_assign
from splitlane.operators.features import CategoryCoder, identity_features
from splitlane.operators.filters import union_sources
from splitlane.operators.forests import TREE_KINDS, forest_score, node_tables, qualified
from splitlane.operators.geo import PlaceIndex, geo_range_join
from splitlane.operators.lookup import TASK_ROWS, lookup_join
from splitlane.operators.trees import class_positions, load_model, score_options
from splitlane.schema import NO_DATA, PREDICTED, PREDICTING, TRAINING
from splitlane.session import settle
from splitlane.sinks.tables import by_app

# Modelled apps decided by one plan: bounds the size of a plan, not what is read or how.
APPS_PER_PLAN = 16
# Requests of one app that share one copy of its trees, about.
BATCH_ROWS = 1_000


@dataclass(frozen=True)
class AppModel:
    """An app that decides by score: where its model is and how wide its config is."""

    app_id: str
    model_path: str
    model_type: str
    n_descriptors: int
    n_variations: int


ModelLoader = Callable[[str, str], tuple[Model, DataFrame]]


def enrich_requests(requests: DataFrame, ranges: DataFrame | PlaceIndex) -> DataFrame:
    """Add client time, place and address to each request's identity."""
    placed = geo_range_join(requests, ranges)
    identity = enrich_identity(
        F.col("identity"), F.col("ts_ms"), F.col("ip_num"), F.col("city"), F.col("country")
    )
    return placed.withColumn("identity", identity).drop("city", "country")


def uses_model() -> Column:
    """Whether an app's state and model make it decide by score.

    An app in training goes on as before it, so it scores if it was predicting.
    """
    state = F.col("run_state")
    active = (state == PREDICTING) | ((state == TRAINING) & F.col("predicting_from").isNotNull())
    return active & F.col("model_path").isNotNull()


def answers() -> Column:
    """Whether an app answers requests at all."""
    return F.col("run_state").isin(NO_DATA, PREDICTING, TRAINING)


def _code_columns(codes: dict[int, int], arity: int, pos: int, count: int) -> list[Column]:
    """Code of each variation of one app: a literal, or a drawn seen code for an unseen one."""
    if not codes:
        return [F.lit(float(i)) for i in range(count)]
    keys = [F.col("app_id"), F.col("event_id"), F.lit(pos)]
    return [
        F.lit(float(codes[i])) if i in codes else draw_below(F.lit(arity), *keys, F.lit(i))
        for i in range(count)
    ]


def variation_codes(mapping: DataFrame, apps: list[AppModel]) -> dict[str, list[Column]]:
    """Code columns of the variations of the given apps, from one row per variation."""
    places = {a.app_id: a.n_descriptors for a in apps}
    wanted = F.struct("app_id", "pos").isin(
        [F.struct(F.lit(app_id), F.lit(pos)) for app_id, pos in places.items()]
    )
    seen: dict[str, dict[int, int]] = {a: {} for a in places}
    arities: dict[str, int] = {a: 0 for a in places}
    for r in mapping.where(wanted).select("app_id", "raw", "code", "arity").collect():
        seen[r.app_id][int(r.raw)] = r.code
        arities[r.app_id] = r.arity
    return {
        a.app_id: _code_columns(seen[a.app_id], arities[a.app_id], a.n_descriptors, a.n_variations)
        for a in apps
    }


def coded_identity(
    requests: DataFrame,
    mapping: DataFrame,
    descriptors: int,
    extractor: Transformer | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
) -> DataFrame:
    """Coded identity features of configured requests; unseen values become a seen code.

    Another ``extractor`` may turn the hashed ``features`` into the model's.
    """
    hashed = requests.withColumn(
        "features", identity_features(F.col("identity"), F.col("descriptors"), hash_fn)
    )
    coder = extractor or CategoryCoder(mapping, descriptors, ("app_id", "event_id"))
    return coder.transform(hashed)


def score_apps(
    requests: DataFrame,
    apps: list[AppModel],
    models: dict[str, Model],
    mapping: DataFrame,
    extractor: Transformer | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
) -> list[DataFrame]:
    """Per app, its configured requests with ``scores``, one per variation.

    Identities of all the apps are coded together; then each app's model is
    applied to its own rows. Works for regressors and, by the chance of
    conversion, for classifiers.
    """
    width = max(a.n_descriptors for a in apps)
    coded = coded_identity(requests, mapping, width, extractor, hash_fn)
    options = variation_codes(mapping, apps)
    return [
        score_options(
            models[a.app_id], coded.where(F.col("app_id") == a.app_id), options[a.app_id]
        ).drop("features")
        for a in apps
    ]


def classify_app(
    requests: DataFrame, model: Model, mapping: DataFrame, descriptors: int
) -> DataFrame:
    """Decide by the predicted class as a variation position (identity-only classifier)."""
    rows = class_positions(model, coded_identity(requests, mapping, descriptors))
    return rows.select(
        *[c for c in rows.columns if c != "features"], *chosen(F.col("variation_idx"), F.lit(True))
    )


def modelled_apps(apps: DataFrame) -> Iterator[AppModel]:
    """Config sizes and model place of each app that scores, one at a time."""
    rows = apps.where(uses_model()).select(
        "app_id",
        "model_path",
        "model_type",
        F.size("descriptors").alias("n_descriptors"),
        F.size("variations").alias("n_variations"),
    )
    return (AppModel(*r) for r in rows.toLocalIterator())


def _decide_scored(
    configured: DataFrame,
    apps: list[AppModel],
    loader: ModelLoader,
    extractor: Transformer | None,
    hash_fn: Callable[[Column], Column],
) -> DataFrame:
    """Decisions of a few apps' requests by their models."""
    loaded = {a.app_id: loader(a.model_path, a.model_type) for a in apps}
    own = [
        mapping.where(F.col("app_id") == app_id).select("app_id", "pos", "raw", "code", "arity")
        for app_id, (_, mapping) in loaded.items()
    ]
    models = {app_id: model for app_id, (model, _) in loaded.items()}
    requests = configured.where(F.col("app_id").isin(list(loaded)))
    scored = score_apps(requests, apps, models, union_sources(own), extractor, hash_fn)
    return union_sources([_decision_columns(pick_best(s)) for s in scored])


def _decision_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "app_id", "session", "ts_ms", "identity", "variation_idx", "variation",
        "value", "kind",
    )


def own_mappings(spark: SparkSession, apps: list[AppModel]) -> DataFrame:
    """The category codes saved beside each app's model, all read in one scan."""
    owners = spark.createDataFrame(
        [(a.app_id, qualified(spark, a.model_path)) for a in apps], "app_id string, _folder string"
    )
    codes = spark.read.parquet(*[f"{a.model_path}/mapping" for a in apps]).withColumn(
        "_folder", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/mapping/[^/]+$", 1)
    )
    return codes.join(F.broadcast(owners), ["app_id", "_folder"]).select("app_id", "pos", "raw", "code", "arity")


def option_codes(mapping: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per app (app_id, n_descriptors): the codes of its variations by position, and their arity."""
    seen = mapping.join(sizes, "app_id").where(F.col("pos") == F.col("n_descriptors"))
    return seen.groupBy("app_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("raw").cast("int"), F.col("code").cast("double")))).alias(
            "_codes"
        ),
        F.max("arity").alias("_arity"),
    )


def _option(i: Column) -> Column:
    """The code of variation ``i``: as seen in training, else a seen code drawn per request."""
    drawn = draw_below(F.col("_arity"), F.col("app_id"), F.col("event_id"), F.col("n_descriptors"), i)
    return F.when(F.coalesce(F.size("_codes"), F.lit(0)) <= 0, i.cast("double")).otherwise(
        F.coalesce(F.try_element_at(F.col("_codes"), i), drawn.cast("double"))
    )


def _in_batches(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """One row per batch of about BATCH_ROWS rows of an app: app_id, ``_batch`` and its ``_rows``.

    ``counted`` has as many rows per app and is cheaper to read.
    """
    spark = rows.sparkSession
    batches = F.ceil(F.count(F.lit(1)) / F.lit(BATCH_ROWS)).alias("_batches")
    known = lookup_join(rows, counted.groupBy("app_id").agg(batches), "app_id", "inner", counted=counted)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // TASK_ROWS))
    drawn = F.pmod(F.xxhash64("event_id", "session", "ts_ms"), F.col("_batches"))
    return (
        known.select("app_id", drawn.alias("_batch"), F.struct(*rows.columns).alias("_row"))
        .repartition(tasks, "app_id", "_batch")
        .groupBy("app_id", "_batch")
        .agg(F.collect_list("_row").alias("_rows"))
    )


def scored_as_data(
    configured: DataFrame,
    apps: list[AppModel],
    extractor: Transformer | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
) -> DataFrame:
    """Configured requests of all modelled ``apps`` with ``scores``, their trees read as data.

    Models, codes and configs of every app are each read in one scan and joined to the
    requests on app_id; the number of apps changes the size of those tables, not the plan.
    A join's row holds a copy of its app's trees, which grow with the training rows, so
    requests are joined in batches, not one by one.
    """
    spark = configured.sparkSession
    mapping = own_mappings(spark, apps)
    sizes = spark.createDataFrame([(a.app_id, a.n_descriptors) for a in apps], "app_id string, n_descriptors int")
    models = settle(
        node_tables(spark, [(a.app_id, a.model_path, a.model_type) for a in apps])
        .join(sizes, "app_id")
        .drop("model_type"),
        "models",
    )
    options = option_codes(mapping, sizes).join(sizes, "app_id", "right")
    coded = coded_identity(configured, mapping, max(a.n_descriptors for a in apps), extractor, hash_fn)
    offered = lookup_join(coded, options, "app_id", "inner", counted=configured)
    asked = F.transform(
        F.sequence(F.lit(0), F.size("variations") - 1), lambda i: F.concat("features", F.array(_option(i)))
    )
    # Read twice, to count and to deal them: written once.
    ready = settle(offered.withColumn("_asked", asked).drop("_codes", "_arity", "n_descriptors"), "asked")
    batches = lookup_join(
        _in_batches(ready, ready), models.select("app_id", "trees", "steps"), "app_id", "inner", counted=ready
    )
    scored = F.transform(
        "_rows",
        lambda r: F.struct(
            *[r[c].alias(c) for c in coded.columns],
            F.transform(r["_asked"], lambda x: forest_score(F.col("trees"), x, F.col("steps"))).alias("scores"),
        ),
    )
    return batches.select(F.inline(scored))


def decide_as_data(
    configured: DataFrame,
    apps: list[AppModel],
    extractor: Transformer | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
) -> DataFrame:
    """Decisions of the requests of all modelled ``apps`` in one plan: the best of ``scored_as_data``."""
    return _decision_columns(pick_best(scored_as_data(configured, apps, extractor, hash_fn)))


def decision_plans(
    requests: DataFrame,
    registry: DataFrame,
    loader: ModelLoader | None = None,
    extractor: Transformer | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
    as_data: bool | None = None,
) -> Iterator[DataFrame]:
    """Decisions of all requests, as one plan of random choices and plans of scored apps.

    The requests are read once and laid out by app, whatever the number of apps. Tree
    models saved by ``save_model`` are scored as data, all apps in one plan; that is the
    way unless a ``loader`` is given or a model is of another kind (``as_data`` None), or
    as ``as_data`` says. Otherwise each plan decides a few apps, loading their models.
    What gives no decision is in refused_requests().
    """
    spark = requests.sparkSession
    own_loader = loader is not None
    loader = loader or (lambda path, kind: load_model(spark, path, kind))
    apps = registry.where(answers())
    config = apps.select("app_id", "variations", "descriptors", uses_model().alias("_scores"))
    configured = lookup_join(requests, config, "app_id", "inner").where(F.size("variations") > 0)
    folders = ("_scores", "app_id")
    laid_out = settle(by_app(configured, folders), "requests", folders)
    yield _decision_columns(random_assign(laid_out.where(~F.col("_scores"))))
    modelled = modelled_apps(apps)
    if as_data is None or as_data:
        every = list(modelled)
        if as_data is None:
            as_data = not own_loader and all(a.model_type in TREE_KINDS for a in every)
        modelled = iter(every)
        if as_data:
            if every:
                yield decide_as_data(laid_out.where("_scores"), every, extractor, hash_fn)
            return
    while batch := list(islice(modelled, APPS_PER_PLAN)):
        yield _decide_scored(laid_out.where("_scores"), batch, loader, extractor, hash_fn)


def refused_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """event_id, app_id, reason of the requests that get no decision."""
    state = registry.select("app_id", F.col("run_state").alias("_state"), F.size("variations").alias("_options"))
    reason = (
        F.when(F.col("_state").isNull(), F.lit("unknown app"))
        .when(~F.col("_state").isin(NO_DATA, PREDICTING, TRAINING), F.concat(F.lit("app is "), "_state"))
        .when(F.coalesce(F.col("_options"), F.lit(0)) < 1, F.lit("no variations"))
    )
    judged = lookup_join(requests.select("event_id", "app_id"), state, "app_id")
    return judged.select("event_id", "app_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def choose_variation(
    requests: DataFrame,
    registry: DataFrame,
    loader: ModelLoader | None = None,
    extractor: Transformer | None = None,
    hash_fn: Callable[[Column], Column] = feature_hash,
    as_data: bool | None = None,
) -> DataFrame:
    """Decisions of all requests as one DataFrame (two plans when models are read as data)."""
    plans = decision_plans(requests, registry, loader, extractor, hash_fn, as_data)
    whole = next(plans)
    for plan in plans:
        whole = whole.unionByName(plan)
    return whole


def decisions_as_starts(decisions: DataFrame, server_ts: Column) -> DataFrame:
    """A decision is stored as the start event of its session."""
    return decisions.select(
        "event_id",
        "app_id",
        server_ts.cast("bigint").alias("ts_ms"),
        "session",
        "identity",
        "variation",
        "kind",
    )


def replies(decisions: DataFrame) -> DataFrame:
    """What the caller is told."""
    return decisions.select(
        "event_id",
        "app_id",
        "variation",
        "value",
        (F.col("kind") == PREDICTED).alias("predicted"),
    )


def predict_and_log(
    requests: DataFrame,
    registry: DataFrame,
    write: Callable[[DataFrame, int], None],
    server_ts: Column,
    loader: ModelLoader | None = None,
    as_data: bool | None = None,
) -> None:
    """Decide all requests and hand the start events to ``write``, plan by plan."""
    for number, plan in enumerate(decision_plans(requests, registry, loader, as_data=as_data)):
        write(decisions_as_starts(plan, server_ts), number)
