"""Ordered map and set values: helpers over MAP and sorted, distinct ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_get(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def map_set(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_delete(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_len(m: Column) -> Column:
    return F.size(m)


def map_entries(m: Column) -> Column:
    """Entries in key order."""
    return F.array_sort(F.map_entries(m))


def map_prefix(m: Column, prefix: str) -> Column:
    return map_entries(F.map_filter(m, lambda k, _: F.startswith(k, F.lit(prefix))))


def map_lower_bound(m: Column, key: Column) -> Column:
    return map_entries(F.map_filter(m, lambda k, _: k >= key))


def map_equal_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))


def map_equal(a: Column, b: Column) -> Column:
    return map_entries(a) == map_entries(b)


def map_update(m: Column, other: Column) -> Column:
    """m with other's entries, which win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k)), other)


def map_json(m: Column) -> Column:
    """A list of {k, v} in key order."""
    return F.to_json(F.transform(map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))


def map_from_json(text: Column, value: str) -> Column:
    return F.map_from_entries(F.from_json(text, f"array<struct<k: string, v: {value}>>"))


def new_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def set_add(s: Column, value: Column) -> Column:
    return F.array_sort(F.array_union(s, F.array(value)))


def set_delete(s: Column, value: Column) -> Column:
    return F.array_remove(s, value)


def set_has(s: Column, value: Column) -> Column:
    return F.array_contains(s, value)


def set_len(s: Column) -> Column:
    return F.size(s)


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def set_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def set_equal(a: Column, b: Column) -> Column:
    return new_set(a) == new_set(b)


def set_json(s: Column) -> Column:
    return F.to_json(new_set(s))


def set_from_json(text: Column) -> Column:
    return new_set(F.from_json(text, "array<string>"))
