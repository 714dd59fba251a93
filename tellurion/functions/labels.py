"""Label maps: canonical keys, lookups and rebuilding. A missing label and an empty one are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(labels: Column | str, name: str) -> Column:
    return F.coalesce(F.element_at(labels, F.lit(name)), F.lit(""))


def key(labels: Column | str) -> Column:
    """One string for equal label sets; maps themselves neither group nor join."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(labels, lambda _, v: v != "")))))


def from_key(key_: Column | str) -> Column:
    return F.from_json(key_, "map<string,string>")


def only(labels: Column | str, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(names) & (v != "")) if names else F.map_filter(labels, lambda k, v: F.lit(False))


def without(labels: Column | str, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(names) & (v != "")) if names else F.map_filter(labels, lambda k, v: v != "")


def put(labels: Column | str, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(labels, lambda k, _: k != name), F.create_map(F.lit(name), value))
