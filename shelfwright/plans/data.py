"""Queries of the core training-data operators for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested, packed
from ..util import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: nested.found(table(s, d, "catalog_raw")),
        "p1_authors": lambda s, d: nested.flat_table(table(s, d, "catalog_raw"), "author"),
        "p1_series": lambda s, d: nested.flat_table(table(s, d, "catalog_raw"), "series"),
        "p1_objects": lambda s, d: nested.object_store(table(s, d, "catalog_raw")),
        "p1_bridge": lambda s, d: nested.bridge(table(s, d, "catalog_raw")),
        "p1_chapters": lambda s, d: nested.flat_table(table(s, d, "catalog_raw"), "chapter"),
        "p3_found": lambda s, d: packed.found(table(s, d, "books"), table(s, d, "genre_ref")),
    }
