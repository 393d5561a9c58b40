"""Identity maps: merge, enrich, project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitlane.functions.ids import ip_text
from splitlane.schema import UNKNOWN_IP, UNKNOWN_PLACE


def empty_identity() -> Column:
    return F.create_map().cast("map<string,string>")


def merge_identity(left: Column, right: Column) -> Column:
    """Union of two maps; the right value wins on a shared key."""
    kept = F.map_filter(left, lambda key, _: ~F.map_contains_key(right, key))
    return F.map_concat(kept, right)


def enrich_identity(
    identity: Column, client_ts: Column, ip_num: Column, city: Column, country: Column
) -> Column:
    """Add the client time and, when the caller's address is known, its place and text."""
    stamp = client_ts.cast("string")
    known = F.create_map(
        F.lit("userTs"), stamp,
        F.lit("city"), F.coalesce(city, F.lit(UNKNOWN_PLACE)),
        F.lit("country"), F.coalesce(country, F.lit(UNKNOWN_PLACE)),
        F.lit("ip"), ip_text(ip_num),
    )
    unknown = F.create_map(F.lit("userTs"), stamp, F.lit("ip"), F.lit(UNKNOWN_IP))
    return merge_identity(identity, F.when(ip_num.isNotNull(), known).otherwise(unknown))


def identity_value(identity: Column, name: Column | str) -> Column:
    """Value of one key, null when absent."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.try_element_at(identity, key)


def project_identity(identity: Column, names: list[str]) -> list[Column]:
    """One column per descriptor name; a missing value is the empty text."""
    return [F.coalesce(identity_value(identity, n), F.lit("")).alias(n) for n in names]


def identity_text(identity: Column) -> Column:
    """Sorted ``key=value`` text, for comparing maps across engines."""
    entries = F.transform(
        F.array_sort(F.map_entries(identity)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(entries, ";")
