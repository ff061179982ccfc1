"""Metadata maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may differ between a request and its replay.
VARIANT_KEYS = ("block_number", "review_reason", "reject_reason", "approved_by", "rejected_by")


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries; the right value wins."""
    l, r = F.coalesce(left, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.coalesce(right, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_concat(F.map_filter(l, lambda k, _: ~F.map_contains_key(r, k)), r)


def canonical(metadata: Column) -> Column:
    """Entries without the variant keys, sorted by key: equal for maps that count as equal."""
    return F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, _: ~k.isin(*VARIANT_KEYS))))


def same(left: Column, right: Column) -> Column:
    return F.to_json(canonical(left)).eqNullSafe(F.to_json(canonical(right)))
