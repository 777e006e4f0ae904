r"""Several values packed in one field, as one row per value with its position.

The string is split on the quote character: odd pieces are literals, even pieces have their delimiters replaced by a mark. An
array fold puts the pieces together again, and the result is split at the marks. Inside even pieces the entries of a reference
list, name suffixes and surname-first names are shielded before delimiters are looked for. All of it is Spark SQL expressions.

Defined results: null or blank fields and fields with one value give no rows from `found`; blank values are not counted; a value
that repeats is a row each time; an unclosed quote mark is ordinary text from there on; very long values are treated whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reference entries with a delimiter of their own, at most: each is a pattern in the plan.
MAX_ENTRIES = 500
MARK = "\u0001"
#: What can stand between values. Each has a private-use stand-in that shields it where it belongs to a value.
DELIMITERS = (",", ";", "/", "|", "&", "+", "·", "\t", "\n", "、", " and ", " with ")
SHIELD = {d: chr(0xE000 + i) for i, d in enumerate(DELIMITERS)}
QUOTE, GLUE = "\ue010", "\ue011"  # a lone quote mark; put after a shielded word
DELIMS = r";/|&+·,\t\n、"
#: A delimiter outside quotes; a comma may be followed by "and". "&" and "+" inside a word ("R&B") are not one.
BREAK = r"(?i)\s*[;/|·,\t\n、]\s*(?:(?:and|&)\s+)?|\s+[&+]\s+|\s+(?:and|with)\s+"
SUFFIX = r"(?i),(\s*(?:Jr|Sr|II|III|IV|Ph\.?\s?D|M\.?D|MBE|OBE|Esq)\b\.?)"
WORD = rf"[^\s{DELIMS}{MARK}\"]+"


def _shield_entry(entry: str) -> tuple[str, str]:
    """A pattern that finds a reference entry in any letter case, and its replacement with shielded delimiters."""
    parts = re.split(r"([,;/|&+·\t、]|\band\b|\bwith\b)", entry)
    pattern, to = "", ""
    for i, p in enumerate(parts):
        if i % 2 == 0:
            pattern += "(" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", p) + ")"
            to += f"${i + 1}"
        else:
            key = p if p in SHIELD else f" {p.lower()} "
            pattern += "(" + re.sub(r"([|+])", r"\\\1", p) + ")"
            to += SHIELD[key] if key == p else f"${i + 1}" + GLUE
    return rf"(?i)(?<![\p{{L}}\p{{N}}]){pattern}(?![\p{{L}}\p{{N}}])", to


def _shielded(piece: Column, first: Column, entries: list[str], names: bool) -> Column:
    for e in sorted(entries, key=len, reverse=True):
        if re.search(r"[,;/|&+·\t、]|\band\b|\bwith\b", e):
            piece = F.regexp_replace(piece, *_shield_entry(e))
    if names:
        piece = F.regexp_replace(piece, SUFFIX, SHIELD[","] + "$1")
        pair = rf"({WORD}),(\s*{WORD}(?:\s+\p{{L}}\.)*)(?=\s*(?:[{DELIMS}]|$|\s(?:and|with)\s))"
        start, later = rf"(^\s*|[{DELIMS}]\s*|\s(?:and|with)\s+)", rf"([{DELIMS}]\s*|\s(?:and|with)\s+)"
        to = "$1$2" + SHIELD[","] + "$3"
        piece = F.when(first, F.regexp_replace(piece, start + pair, to)).otherwise(F.regexp_replace(piece, later + pair, to))
    return piece


def split_packed(value: Column, entries: list[str] = (), names: bool = False) -> Column:
    """array<string> of the values packed in a string, in order, blanks and enclosing quotes removed.

    entries: values of a fixed reference list that are never split. names: keep suffixes and surname-first names whole.
    """
    space = r"(?U)^\s+|\s+$"
    text = F.regexp_replace(value, space, "")
    as_list = text.startswith("[") & text.endswith("]")
    text = F.when(as_list, F.replace(F.substring(text, 2, F.length(text) - 2), F.lit('\\"'), F.lit('""'))).otherwise(text)
    pieces = F.split(text, '"')
    even = F.size(pieces) % 2 == 0  # an unclosed quote: its mark is text

    def one(piece: Column, i: Column) -> Column:
        outside = _shielded(piece, i == 0, list(entries), names)
        return F.when(i % 2 == 1, piece).otherwise(F.regexp_replace(outside, BREAK, MARK))

    pieces = F.when(even, F.concat(F.slice(pieces, 1, F.size(pieces) - 2), F.array(F.concat(F.element_at(pieces, -2), F.lit(QUOTE), F.element_at(pieces, -1))))).otherwise(pieces)
    joined = F.aggregate(
        F.transform(pieces, one), F.lit(None).cast("string"),
        lambda acc, p: F.when(acc.isNull(), p).otherwise(F.concat(acc, F.lit('"'), p)),
    )

    def clean(item: Column) -> Column:
        item = F.regexp_replace(item, space, "")
        enclosed = (F.length(item) > 1) & item.startswith('"') & item.endswith('"')
        item = F.when(enclosed, F.replace(F.substring(item, 2, F.length(item) - 2), F.lit('""'), F.lit('"'))).otherwise(item)
        for d, s in SHIELD.items():
            item = F.replace(item, F.lit(s), F.lit(d))
        item = F.replace(F.replace(item, F.lit(QUOTE), F.lit('"')), F.lit(GLUE), F.lit(""))
        return F.regexp_replace(item, space, "")

    # literals keep their own delimiters; the marks stand only where an even piece had one
    return F.filter(F.transform(F.split(joined, MARK), clean), lambda x: F.length(x) > 0)


def explode_packed(df: DataFrame, key: str, field: str, entries: list[str] = (), names: bool = False) -> DataFrame:
    """key, field (its name), pos, item, n (values in the field) for every value packed in `field`."""
    items = split_packed(F.col(field), entries, names)
    rows = df.select(F.col(key).alias(key), items.alias("_items")).where("size(_items) > 0")
    return rows.select(key, F.lit(field).alias("field"), F.size("_items").alias("n"), F.posexplode("_items").alias("pos", "item")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))


def found(books: DataFrame, genres: DataFrame) -> DataFrame:
    """book_hash, field, pos, item of every value of a narrator or genre field that packs two or more.

    genres: the reference list, of a checked size (those of its entries that hold delimiters become patterns).
    """
    own = genres.select("genre").where(F.col("genre").rlike(r"[,;/|&+·\t、]|\band\b|\bwith\b")).distinct()  # the others are never split
    names = sorted(r[0] for r in own.limit(MAX_ENTRIES + 1).collect())
    if len(names) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} reference entries with delimiters")
    both = explode_packed(books, "book_hash", "parsed_narrator", names=True).unionByName(explode_packed(books, "book_hash", "parsed_genre", entries=names))
    return both.where("n > 1").select("book_hash", "field", "pos", "item").distinct()
