"""Identifiers and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitlane.schema import ID_WIDTH


def pad_id(value: Column, width: int = ID_WIDTH) -> Column:
    """Left-pad with zeros; ids already long enough stay whole (``lpad`` would cut them)."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def ip_text(number: Column) -> Column:
    """Dotted text of an IPv4 number."""
    octets = [F.shiftright(number, shift).bitwiseAND(F.lit(255)) for shift in (24, 16, 8, 0)]
    return F.when(number.isNotNull(), F.concat_ws(".", *[o.cast("string") for o in octets]))


def ip_number(text: Column) -> Column:
    """Number of a dotted IPv4 text; null when it is not one."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("bigint"))
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    folded = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    return F.when(valid, folded)
