"""Constant lookups as a single expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(mapping: Mapping, key: Column, default: Column | None = None) -> Column:
    """``mapping[key]`` with the mapping as a constant, NULL (or ``default``) if absent.

    The key is referenced once, so nested lookups do not multiply the plan the way a
    CASE per entry would.
    """
    entries = [F.lit(x) for pair in mapping.items() if pair[1] is not None for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, default)
