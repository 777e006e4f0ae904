"""Text that looks alike but has other characters, in one consistent form.

Every character has a set of scripts it can stand in ("resolved" through the look-alike table: the Cyrillic letter that looks like
"a" can stand in Cyrillic and, as a look-alike, in Latin). The sets are intersected over each token and then over its part of the
value. A token whose own scripts don't agree is a mixed-script confusable; a token that is wholly of another script than the rest
but could be written in it is a whole-script confusable. Both are spelled in the consistent script. Width, style and joined forms
are unfolded, accents composed, spaces made ordinary, invisible characters dropped unless the writing of the language needs them.

Defined results: null stays null; empty stays empty; values that are damaged by a wrong encoding are left to `garble`; text of
several scripts that doesn't look alike ("Дорога в Linz") keeps its scripts; repeated values have equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import cut, spread
from . import garble

# Letters that look like a Latin letter (Unicode's confusables, base letters only).
CYRILLIC = dict(zip("асдеһіјӏорѕԛԝхуѵАВСЕНІЈКМОРЅТХУѴԌҮԚԜ", "acdehijlopsqwxyvABCEHIJKMOPSTXYVGYQW"))
CYRILLIC.pop("д", None)
GREEK = dict(zip("αινορυγκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "aivopuykxABEZHIKMNOPTYXcj"))
ARMENIAN = dict(zip("օսհոցՕՍԼ", "ouhngOUL"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏏᏙᏚᏞᏟᏢᏦᏧ", "DRTiAJEWMHGZbVSLCPKd"))
COPTIC = dict(zip("ⲞⲟⲢⲣⲤⲥⲬⲔⲘⲚⲎ", "OoPpCcXKMNH"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
OTHER_LATIN = dict(zip("ıɑɡʏ", "iagy"))
LOOKS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Coptic": COPTIC, "Lisu": LISU}
#: Scripts whose writing needs joiners between letters.
JOINING = ("ARABIC", "SYRIAC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "GUJARATI", "GURMUKHI", "ORIYA", "KHMER", "MYANMAR", "MONGOLIAN", "MANDAIC")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff]")
#: Decomposition tags of variants of width, style or joined letters.
VARIANT_TAGS = ("<wide>", "<narrow>", "<font>", "<circle>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")


@lru_cache(maxsize=8192)
def _unfolded(c: str) -> str:
    """A character without variant of width, style or joining, and spaces as the ordinary one."""
    cat = unicodedata.category(c)
    if cat == "Zs" or c in "\t\n\r\v\f\x85  ":
        return " "
    if cat == "Cc":
        return ""
    if 0x1CCD6 <= ord(c) <= 0x1CCEF:
        return chr(65 + ord(c) - 0x1CCD6)
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in VARIANT_TAGS or tag == "<compat>" and (cat[0] == "L" or cat == "Nl"):
        return "".join(_unfolded(x) if x != c else x for x in unicodedata.normalize("NFKC", c))
    return c


@lru_cache(maxsize=8192)
def _script(c: str) -> str | None:
    """Script of a letter by its Unicode name; None for other characters."""
    if unicodedata.category(c)[0] != "L":
        return None
    name = unicodedata.name(c, "")
    return name.split(" ")[0].split("-")[0].title() if name else "Unknown"


@lru_cache(maxsize=8192)
def _resolved(c: str) -> frozenset[str] | None:
    """Scripts in which a letter can stand, look-alikes included."""
    s = _script(c)
    if s is None:
        return None
    if s == "Latin":
        return frozenset({s, *(k for k, m in LOOKS.items() if c in m.values())})
    if s in LOOKS and c in LOOKS[s]:
        return frozenset({s, "Latin", *(k for k, m in LOOKS.items() if LOOKS[s][c] in m.values())})
    return frozenset({s})


def _respelled(c: str, to: str) -> str:
    s = _script(c)
    if s is None or s == to:
        return OTHER_LATIN.get(c, c) if to == "Latin" else c
    latin = c if s == "Latin" else LOOKS.get(s, {}).get(c)
    if latin is None:
        return c
    return latin if to == "Latin" else next((k for k, v in LOOKS[to].items() if v == latin), c)


@lru_cache(maxsize=20_000)
def _spell(part: str) -> str:
    """The look-alikes of one part of a value (decomposed), in the script that its tokens agree on."""
    tokens = re.split(r"([^\ẁ-ͯ]+)", part)
    known = []
    for t in tokens:
        sets = [r for r in map(_resolved, t) if r]
        known.append(frozenset.intersection(*sets) if sets else None)
    votes: Counter = Counter()
    for t in tokens:  # letters that can stand in one script only say which script the part is in
        votes.update(s for r in map(_resolved, t) if r and len(r) == 1 for s in r if s in ("Latin", *LOOKS))
    counts = Counter(s for s in map(_script, part) if s)
    main = max(votes, key=lambda s: (votes[s], counts[s], s == "Latin")) if votes else max(("Latin", *LOOKS), key=lambda s: (counts[s], s == "Latin"))
    out = []
    for t, can in zip(tokens, known):
        scripts = {s for s in map(_script, t) if s}
        if not scripts & {"Latin", *LOOKS} or scripts == {main}:
            out.append("".join(_respelled(c, "Latin") for c in t) if scripts == {"Latin"} else t)
            continue
        own = Counter(s for r in map(_resolved, t) if r and len(r) == 1 for s in r)
        if can and main in can:
            to = main
        elif own:
            to = max(own, key=lambda s: (own[s], s == main))
        else:
            to = main
        out.append("".join(_respelled(c, to) for c in t) if to in ("Latin", *LOOKS) else t)
    return "".join(out)


@lru_cache(maxsize=8192)
def _joins(c: str) -> bool:
    return unicodedata.name(c, "").startswith(JOINING)


def _visible(text: str) -> str:
    """Without invisible characters, but for joiners between letters whose writing needs them."""
    if not INVISIBLE.search(text):
        return text
    kept = [c for c in text if c in "‌‍" or not INVISIBLE.match(c)]
    return "".join(c for i, c in enumerate(kept) if c not in "‌‍" or 0 < i < len(kept) - 1 and _joins(kept[i - 1]) and _joins(kept[i + 1]))


def consistent(value: str | None) -> str | None:
    """The one consistent form of a value. Slashes and brackets part it: each part has its own script."""
    if value is None or value.isascii() and value.isprintable():
        return value
    text = "".join(map(_unfolded, _visible(value)))
    parts = re.split(r"([/\\()\[\]|]+)", unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", "".join(_spell(p) if i % 2 == 0 else p for i, p in enumerate(parts)))


def labelled(values: DataFrame) -> DataFrame:
    """value, consistent of every distinct value (column `value`) that isn't in the consistent form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.assign(consistent=[consistent(v) for v in pdf["value"]])
            yield out[out["value"] != out["consistent"]]

    odd = values.select("value").where(F.col("value").rlike(r"[^\x20-\x7E]")).distinct()
    return spread(odd, "value").mapInPandas(run, "value string, consistent string")


def found(books: DataFrame, forms: bool = False) -> DataFrame:
    """book_hash, field of every value of parsed_title, parsed_series or source_path not in the consistent form.

    Values of parsed_title that the encoding operator finds damaged are left out.
    """
    rows = garble.book_values(books, ("parsed_title", "parsed_series", "source_path"))
    odd = cut(labelled(rows))  # read twice
    titles = odd.join(garble.book_values(books, ("parsed_title",)).select("value").distinct(), "value", "left_semi")
    damaged = garble.labelled(titles, garble.fit(garble.book_values(books))).where(F.col("label") != garble.CLEAN).select("value", F.lit("parsed_title").alias("field"))
    cols = ["book_hash", "field", *(["value", "consistent"] if forms else [])]
    return rows.join(odd, "value").join(damaged, ["value", "field"], "left_anti").select(*cols).distinct()
