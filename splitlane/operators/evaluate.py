"""Train/test split and evaluation of 0/1 predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.hashing import draw_unit
from splitlane.functions.scores import round_half_up
from splitlane.schema import TRAIN_SHARE


def in_training(share: float = TRAIN_SHARE, *keys: str) -> Column:
    """Whether a row belongs to the training part: the same answer on every retry."""
    return draw_unit(*[F.col(k) for k in (keys or ("app_id", "session"))]) < share


def train_test_split(
    df: DataFrame, share: float = TRAIN_SHARE, seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split by session; with ``seed``, split by Spark's own sampler instead."""
    if seed is not None:
        train, test = df.randomSplit([share, 1 - share], seed)
        return train, test
    return df.where(in_training(share)), df.where(~in_training(share))


def _ratio(part: Column, whole: Column) -> Column:
    """Quotient of counts; 0 of 0 is NaN."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    )


def evaluate_binary(df: DataFrame, label: Column, score: Column, *by: str) -> DataFrame:
    """Confusion counts, error, precision and recall, per group in one aggregate."""
    predicted = round_half_up(score)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((label == 1) & (predicted == 1)).alias("tp"),
        F.count_if((label == 0) & (predicted == 1)).alias("fp"),
        F.count_if((label == 1) & (predicted == 0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        "n",
        "tp",
        "fp",
        "fn",
        _ratio(fp + fn, F.col("n")).alias("error"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    )


def evaluate_baseline(df: DataFrame, label: Column, *by: str) -> DataFrame:
    """Evaluation of predicting 0 everywhere: the error is the share of positives."""
    return evaluate_binary(df, label, F.lit(0.0), *by)
