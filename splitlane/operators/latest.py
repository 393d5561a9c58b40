"""Latest rows: of a session, and the latest N of an app and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlane.operators.lookup import fits_broadcast, lookup_join
from splitlane.session import settle

FINE_SPAN = 1 << 16
COARSE_SPAN = 1 << 32


# Sorts compare the first bytes of the first key before anything else. Padded app
# ids all begin alike, so the session goes first.
SESSION_KEYS = ("session", "app_id")
PAYLOAD = ("event_id", "ts_ms", "identity", "variation", "kind")


def latest_start(starts: DataFrame, payload: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """The start of highest ``event_id`` per session, with the ``payload`` columns it has.

    An aggregate, not a window: each task first reduces its own rows, so a
    session holding a third of the events sends one row per task.
    """
    columns = [c for c in payload if c in starts.columns]
    return (
        starts.groupBy(*SESSION_KEYS)
        .agg(F.max_by(F.struct(*columns), F.col("event_id")).alias("latest"))
        .select("app_id", "session", "latest.*")
    )


def _cut(histogram: DataFrame, keys: list[str], bucket: str, n: int) -> DataFrame:
    """Per group, the lowest bucket still needed to have its latest ``n`` rows."""
    newer = Window.partitionBy(*keys).orderBy(F.col(bucket).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    needed = histogram.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
    return needed.where(F.col("_newer") < n).groupBy(*keys).agg(F.min(bucket).alias("_from"))


def _id_histogram(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows per group and narrow bucket of ids; counts are combined before the shuffle."""
    fine = F.floor(F.col(order) / F.lit(FINE_SPAN))
    counted = events.groupBy(*keys, fine.alias("_fine")).agg(F.count(F.lit(1)).alias("_rows"))
    return settle(counted, "id-histogram")


def _cut_in_two_steps(histogram: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Cut by wide buckets first, then by narrow ones from the wide bucket of that cut on.

    No window then holds more than the number of wide buckets, or ``n`` plus the
    narrow buckets of one wide one.
    """
    coarse = F.floor(F.col("_fine") / F.lit(COARSE_SPAN // FINE_SPAN))
    wide = histogram.groupBy(*keys, coarse.alias("_coarse")).agg(F.sum("_rows").alias("_rows"))
    start = _cut(wide, keys, "_coarse", n).select(
        *keys, (F.col("_from") * (COARSE_SPAN // FINE_SPAN)).alias("_start")
    )
    near = lookup_join(histogram, start, keys, "inner").where(F.col("_fine") >= F.col("_start"))
    return _cut(near.drop("_start"), keys, "_fine", n)


def latest_n(
    events: DataFrame,
    n: int | None = None,
    keys: tuple[str, ...] = ("app_id", "etype"),
    order: str = "event_id",
) -> DataFrame:
    """The latest ``n`` rows per app and type, exactly; ``None`` keeps all.

    A histogram of ids (which reads the keys and the id alone) gives each group
    a cutoff at or below its n-th latest id. Rows older than the cutoff are
    dropped where they are read, those older than every cutoff even before: the
    scan skips them by their statistics. What is left per group is below ``n`` plus one
    narrow bucket of ids, so the final ranking is bounded however large the
    group was.
    """
    if n is None:
        return events
    names = list(keys)
    histogram = _id_histogram(events, names, order)
    small = fits_broadcast(histogram)
    cuts = _cut(histogram, names, "_fine", n) if small else _cut_in_two_steps(histogram, names, n)
    cutoffs = cuts.select(*names, (F.col("_from") * FINE_SPAN).cast("bigint").alias("_cutoff"))
    # The lowest cutoff, as a plain filter, reaches the scan and skips whole row groups.
    oldest = cutoffs.agg(F.min("_cutoff")).first()[0]
    young = events if oldest is None else events.where(F.col(order) >= oldest)
    # A small histogram has no more groups than rows, so its cutoffs need no second measuring.
    recent = lookup_join(young, cutoffs, names, "inner", small=True if small else None)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.col(order).desc()))
    return (
        recent.where(F.col(order) >= F.col("_cutoff"))
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= n)
        .drop("_rank", "_cutoff")
    )
