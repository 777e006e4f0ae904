"""Queries of the text-corpus operators for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..util import table
from . import canon, entities, garble, leaks, packing, script, subjects, variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: script.found(table(s, d, "books")),
        "p2_forms": lambda s, d: script.found(table(s, d, "books"), forms=True),
        "p4_found": lambda s, d: canon.found(table(s, d, "books"), table(s, d, "library_entries"), table(s, d, "author_ref")),
        "p4_unmatched": lambda s, d: canon.unmatched(table(s, d, "books"), table(s, d, "library_entries"), table(s, d, "author_ref")),
        "p5_found": lambda s, d: entities.found(table(s, d, "library_entries")),
        "p5_confidence": lambda s, d: entities.found(table(s, d, "library_entries"), confidence=True),
        "p5_matched_copies": lambda s, d: entities.matched(table(s, d, "library_entries"))[0],
        "p6_found": lambda s, d: variants.found(table(s, d, "books"), table(s, d, "author_aliases")),
        "p6_people": lambda s, d: variants.people(variants.spellings(table(s, d, "books"), table(s, d, "author_aliases"))),
        "p7_found": lambda s, d: garble.found(table(s, d, "books")),
        "p7_restored": lambda s, d: garble.found(table(s, d, "books"), restored=True),
        "p8_packs": lambda s, d: packing.packs(table(s, d, "documents"), table(s, d, "pack_sizes")),
        "p8_utilisation": lambda s, d: packing.utilisation(table(s, d, "documents"), table(s, d, "pack_sizes")),
        "p9_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_clean_documents": lambda s, d: leaks.clean_documents(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "n_chars"),
        "p10_found": lambda s, d: subjects.found(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "eval_items")),
        "p10_composition": lambda s, d: subjects.composition(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "eval_items")),
    }


def oracle_sql() -> dict[str, str]:
    """None: these operators are tested against brute force, exact round trips and held-out labels."""
    return {}
