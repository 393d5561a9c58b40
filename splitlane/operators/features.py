"""Configs attached to rows, feature vectors, categories and their dense codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.hashing import draw_below, feature_hash
from splitlane.functions.identity import identity_value
from splitlane.functions.scores import variation_position
from splitlane.operators.lookup import fits_broadcast, lookup_join

RANK_SPAN = 65536


def config_join(df: DataFrame, registry: DataFrame, how: str = "inner") -> DataFrame:
    """Attach each row's app config: its variations and descriptors, in order."""
    return lookup_join(df, registry.select("app_id", "variations", "descriptors"), "app_id", how)


def variation_index(configured: DataFrame) -> DataFrame:
    """Add the config position of the row's variation, null when unknown."""
    return configured.withColumn(
        "variation_idx", variation_position(F.col("variations"), F.col("variation"))
    )


def identity_features(
    identity: Column, descriptors: Column, hash_fn: Callable[[Column], Column] = feature_hash
) -> Column:
    """Hashed identity values in descriptor order."""
    return F.transform(descriptors, lambda d: hash_fn(identity_value(identity, d["name"])))


def feature_vector(
    sample: DataFrame,
    registry: DataFrame,
    hash_fn: Callable[[Column], Column] = feature_hash,
) -> DataFrame:
    """``features`` (hashed descriptors, then the variation's position) and ``label``.

    Rows of an unknown variation are left out, as in training.
    """
    known = variation_index(config_join(sample, registry)).where(F.col("variation_idx").isNotNull())
    features = F.concat(
        identity_features(F.col("identity"), F.col("descriptors"), hash_fn),
        F.array(F.col("variation_idx").cast("double")),
    )
    return known.select(
        "app_id",
        "session",
        "event_id",
        features.alias("features"),
        F.col("goal").cast("int").cast("double").alias("label"),
    )


def to_feature_frame(features: DataFrame, registry: DataFrame) -> DataFrame:
    """Feature rows checked to be as wide as their app's config says."""
    widths = registry.select("app_id", (F.size("descriptors") + 1).alias("_width"))
    checked = lookup_join(features, widths, "app_id", "inner")
    same = F.size("features") == F.col("_width")
    return checked.withColumn(
        "features",
        F.when(same, F.col("features")).otherwise(F.raise_error(F.lit("feature rows differ in width"))),
    ).drop("_width")


def categorical_positions(registry: DataFrame) -> DataFrame:
    """Positions holding categories: the flagged descriptors and the variation."""
    flagged = F.filter(
        F.transform(F.col("descriptors"), lambda d, i: F.when(d["categorical"], i)),
        lambda i: i.isNotNull(),
    )
    both = F.concat(flagged, F.array(F.size("descriptors")))
    return registry.select("app_id", F.explode(both).alias("pos"))


def infer_supports(features: DataFrame) -> DataFrame:
    """Distinct values of every feature, in long form.

    Long, because a feature such as an address has no bound on its values.
    """
    return features.select("app_id", F.posexplode("features").alias("pos", "raw")).distinct()


def support_sizes(supports: DataFrame) -> DataFrame:
    return supports.groupBy("app_id", "pos").agg(F.count(F.lit(1)).alias("arity"))


def explanatory_features(supports: DataFrame) -> DataFrame:
    """Features with more than one value."""
    return support_sizes(supports).where(F.col("arity") > 1)


def merge_supports(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two support tables."""
    return left.unionByName(right).distinct()


def category_mapping(supports: DataFrame, categorical: DataFrame) -> DataFrame:
    """Dense codes ``0..arity-1``, by value, for features both categorical and explanatory.

    Feature values are 32-bit hashes, so they fall into at most 65,536 spans of
    65,536 values. Codes are ranks inside the span plus the number of values in
    lower spans: no window ever holds a whole feature. ``supports`` is read
    several times; settle it first when it is dear to compute.
    """
    mapped = explanatory_features(supports).join(categorical, ["app_id", "pos"], "left_semi")
    values = lookup_join(supports, mapped, ["app_id", "pos"], "inner").withColumn(
        "_span", F.floor(F.col("raw") / F.lit(RANK_SPAN))
    )
    feature = ["app_id", "pos"]
    below = Window.partitionBy(*feature).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        values.groupBy(*feature, "_span")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*feature, "_span", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*feature, "_span").orderBy("raw"))
    return (
        values.join(offsets, [*feature, "_span"])
        .withColumn("code", (F.col("_offset") + inside - 1).cast("int"))
        .select(*feature, "raw", "code", "arity")
    )


def remap_sample(features: DataFrame, mapping: DataFrame, width: int) -> DataFrame:
    """Replace mapped values by their codes; others stay raw.

    One lookup per position on the row as it is: nothing is exploded and, with
    a mapping of measured size, nothing is shuffled.
    """
    return _encode(features, mapping, width, lambda pos: F.lit(None).cast("double"))


def encode_unseen(
    features: DataFrame,
    mapping: DataFrame,
    width: int,
    *keys: str,
) -> DataFrame:
    """As ``remap_sample``; a value never seen becomes a seen code drawn by ``keys``."""
    arities = (
        mapping.select("app_id", "pos", "arity")
        .distinct()
        .groupBy("app_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "arity"))).alias("_arities"))
    )
    sized = lookup_join(features, arities, "app_id")

    def fallback(pos: int) -> Column:
        arity = F.try_element_at(F.col("_arities"), F.lit(pos))
        return draw_below(arity, *[F.col(k) for k in keys], F.lit(pos)).cast("double")

    return _encode(sized, mapping, width, fallback).drop("_arities")


class CategoryCoder(Transformer):
    """``encode_unseen`` as an ML transformer, for pipelines; any other may take its place."""

    def __init__(self, mapping: DataFrame, width: int, keys: tuple[str, ...]) -> None:
        super().__init__()
        self.mapping, self.width, self.keys = mapping, width, keys

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encode_unseen(dataset, self.mapping, self.width, *self.keys)


def _encode(
    features: DataFrame, mapping: DataFrame, width: int, fallback: Callable[[int], Column]
) -> DataFrame:
    small = fits_broadcast(mapping)
    rows = features
    for pos in range(width):
        codes = mapping.where(F.col("pos") == pos).select(
            "app_id", F.col("raw").alias("_raw"), F.col("code").cast("double").alias(f"_code{pos}")
        )
        raw = F.get("features", F.lit(pos))
        rows = lookup_join(
            rows.withColumn("_raw", raw),
            codes,
            ["app_id", "_raw"],
            small=small,
            counted=features.withColumn("_raw", raw),
        ).drop("_raw")
    coded = F.array(
        *[
            F.coalesce(F.col(f"_code{p}"), fallback(p), F.get("features", F.lit(p)))
            for p in range(width)
        ]
    )
    return rows.withColumn("features", F.slice(coded, F.lit(1), F.size("features"))).drop(
        *[f"_code{p}" for p in range(width)]
    )
