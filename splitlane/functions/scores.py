"""Scores, classes and variation positions, all computed inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitlane.functions.hashing import draw_below, draw_unit
from splitlane.schema import JITTER, PREDICTED, RANDOM


def round_half_up(score: Column) -> Column:
    """Nearest whole number, halves upwards (so -0.5 gives 0)."""
    return F.floor(score + F.lit(0.5)).cast("double")


def jitter(*parts: Column, width: float = JITTER) -> Column:
    """A uniform offset in ``[-width, width)`` decided by the given parts."""
    return (draw_unit(*parts) * 2 - 1) * F.lit(width)


def event_kind(modelled: Column) -> Column:
    return F.when(modelled, F.lit(PREDICTED)).otherwise(F.lit(RANDOM))


def variation_position(variations: Column, variation: Column) -> Column:
    """Config position of a variation id; the last one of a repeated id; null when unknown."""
    ids = F.reverse(F.transform(variations, lambda v: v["id"]))
    found = F.array_position(ids, variation)
    return F.when(found > 0, F.size(ids) - found.cast("int"))


def visitor_key(session: Column, event_id: Column) -> Column:
    """Session of a request; a request without one stands for itself."""
    return F.coalesce(F.nullif(session, F.lit("")), event_id.cast("string"))


def random_position(count: Column, *parts: Column) -> Column:
    """Uniform position among ``count`` variations, sticky for the given parts."""
    return draw_below(count, *parts).cast("int")


def best_position(scores: Column) -> Column:
    """Position of the highest score in an array; the first one of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
