"""Place of an address: a range join on blocks of addresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.operators.lookup import fits_broadcast, lookup_join
from splitlane.schema import UNKNOWN_PLACE
from splitlane.session import settle

STEP = 4
# An address registry has some millions of ranges, and every executor can hold them.
RANGE_ROWS = 4_000_000
RANGE_BYTES = 256 * 1024 * 1024


def _block_bits(low: Column, high: Column) -> Column:
    """Bits of the smallest block size (in steps) that is at least as wide as the range."""
    width = F.length(F.bin(high - low))
    needed = F.when(high == low, F.lit(0)).otherwise(width)
    return (F.ceil(needed / STEP) * STEP).cast("int")


@dataclass(frozen=True)
class PlaceIndex:
    """Ranges listed by block, one table per block size, and whether they may be broadcast."""

    blocks: dict[int, DataFrame]
    small: bool


def place_index(ranges: DataFrame, keep: bool = True) -> PlaceIndex:
    """Measure and list ranges; with ``keep`` the listings are written, for use in many batches."""
    listed = ranges.select(
        "ip_from",
        "ip_to",
        F.coalesce("city", F.lit(UNKNOWN_PLACE)).alias("_city"),
        F.coalesce("country", F.lit(UNKNOWN_PLACE)).alias("_country"),
        _block_bits(F.col("ip_from"), F.col("ip_to")).alias("_bits"),
    )
    # A range is listed twice at most; that is what is measured, as it is what is sent.
    both = listed.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    small = fits_broadcast(both, RANGE_ROWS, RANGE_BYTES)
    blocks = {}
    for bits in sorted(r[0] for r in listed.select("_bits").distinct().collect()):
        first, last = F.shiftright("ip_from", bits), F.shiftright("ip_to", bits)
        found = F.struct((F.col("ip_to") - F.col("ip_from")).alias("width"), "ip_from", "ip_to", "_city", "_country")
        table = (
            listed.where(F.col("_bits") == bits)
            .select(F.explode(F.sequence(first, last)).alias("_block"), found.alias("r"))
            .groupBy("_block")
            .agg(F.collect_list("r").alias(f"_ranges{bits}"))
        )
        blocks[bits] = settle(table, "places") if keep else table
    return PlaceIndex(blocks, small)


def geo_range_join(events: DataFrame, ranges: DataFrame | PlaceIndex, ip: str = "ip_num") -> DataFrame:
    """Add ``city`` and ``country`` of the range holding the address.

    Each range is listed under the blocks it touches of a size just above its own, at
    most two of them, and an address looks into its block of each size in use. As a block
    holds ranges wider than a sixteenth of it only, an address meets at most 17 disjoint
    ranges per size, however dense or wide they are. The ranges of a block are one row, so
    an event stays one row also where ranges overlap: the narrowest that holds the address
    counts, of equally wide ones the lowest. An address of no range, or a name the range
    lacks, becomes the fixed unknown text; without an address both stay null.
    """
    index = ranges if isinstance(ranges, PlaceIndex) else place_index(ranges, keep=False)
    placed = events
    for bits, blocks in index.blocks.items():
        block = F.shiftright(F.col(ip), bits)
        placed = lookup_join(
            placed.withColumn("_block", block),
            blocks,
            "_block",
            small=index.small,
            counted=events.withColumn("_block", block),
        ).drop("_block")
    holding = [
        F.array_min(F.filter(f"_ranges{bits}", lambda r: F.col(ip).between(r["ip_from"], r["ip_to"])))
        for bits in index.blocks
    ]
    best = F.array_min(F.array_compact(F.array(*holding))) if holding else None

    def place(name: str) -> Column:
        known = F.lit(UNKNOWN_PLACE) if best is None else F.coalesce(F.col(f"_best._{name}"), F.lit(UNKNOWN_PLACE))
        return F.when(F.col(ip).isNotNull(), known).alias(name)

    if best is not None:
        placed = placed.withColumn("_best", best)
    return placed.select(*events.columns, place("city"), place("country"))
