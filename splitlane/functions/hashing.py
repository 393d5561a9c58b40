"""Hashes: the JVM text hash used for features, and md5 draws that survive task retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitlane.schema import MISSING_TEXT

_WORD = 0xFFFFFFFF
_SPAN = 4294967296


def text_hash(value: Column) -> Column:
    """The JVM hash of a text as a signed 32-bit number in a ``bigint``.

    Built-in expressions only, linear in the text's length. The hash counts
    UTF-16 units, so a character outside the basic plane adds its two surrogates.
    """

    def add(hash_: Column, unit: Column) -> Column:
        return hash_ * 31 + unit

    def step(hash_: Column, point: Column) -> Column:
        above = point - 0x10000
        high = F.shiftright(above, 10) + 0xD800
        low = above.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        wide = point > 0xFFFF
        return F.when(wide, add(add(hash_, high), low)).otherwise(add(hash_, point)).bitwiseAND(
            F.lit(_WORD)
        )

    points = F.transform(F.split(value, ""), F.ascii)
    unsigned = F.aggregate(points, F.lit(0).cast("bigint"), step)
    # Bits 0 to 31 read as a signed number.
    half = _SPAN // 2
    return (unsigned + half).bitwiseAND(F.lit(_WORD)) - half


def feature_hash(value: Column) -> Column:
    """Feature number of an identity value; a missing one hashes as a fixed text."""
    return text_hash(F.coalesce(value, F.lit(MISSING_TEXT))).cast("double")


def draw(*parts: Column) -> Column:
    """A number in ``[0, 2**32)`` decided by the given parts alone."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_unit(*parts: Column) -> Column:
    """A uniform number in ``[0, 1)`` decided by the given parts alone."""
    return draw(*parts) / F.lit(float(_SPAN))


def draw_below(count: Column, *parts: Column) -> Column:
    """A whole number in ``[0, count)`` decided by the given parts alone; null when count is 0."""
    return F.when(count > 0, F.pmod(draw(*parts), F.when(count > 0, count)))
