"""Text damaged by a wrong character encoding: find it and restore it.

A multinomial classifier over hashed byte bigrams names the encoding chain a value went through, or none. It is trained here: values of
the corpus are garbled through every chain, and the bigrams of the outcomes are counted by chain. Only bigrams with a byte beyond ASCII or a
question mark are features; the rest are the same before and after. A value's log odds against being clean are summed over its bigrams.
The likeliest chain is inverted, and the result has to decode strictly and hold no characters that text doesn't have; a chain that fails
this is passed over for the next likely one. Chains that lose characters need their mark in the value. A restored value is classified
again until it is clean, so that repeated damage is undone. Where a value is damaged in parts only, the parts that decode are restored.

Training is the only bounded step: at most `TRAIN_VALUES` distinct values with a character beyond ASCII or a question mark, the first by
hash. Every value is classified.

Defined results: null, empty and pure ASCII values without a question mark are clean; values that can't be restored have a null
`restored`; very long values are read whole; repeated values have equal results; extra columns are kept apart by the callers; without
values to train on nothing is called damaged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import spread

#: Values that the classifier is trained on, at most; cells of the hashed bigrams (a power of two).
TRAIN_VALUES, CELLS = 20_000, 1 << 14
#: Share of damaged values expected among those with characters beyond ASCII; odds against being clean that call a value damaged.
EXPECTED, ODDS = 0.05, 10.0
#: Part of each chain's bigram distribution that is taken from the average of all.
SMOOTH = 0.02
CLEAN, LOST_MARK, LOST_QUESTION = "clean", "lost_to_replacement_mark", "lost_to_question_mark"
#: Chains of encodings: (name, encoding the text was written in, encoding it was read in, times).
CHAINS = (
    *((f"utf8_as_{c}", "utf-8", c, 1) for c in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "cp866", "koi8_r")),
    ("utf8_as_cp1252_twice", "utf-8", "cp1252", 2),
    ("cp1252_as_cp850", "cp1252", "cp850", 1),
    *((f"{a}_as_{b}", a, b, 1) for a, b in (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("shift_jis", "cp1252"), ("gb18030", "cp1252"), ("euc_kr", "cp1252"))),
)
LABELS = (CLEAN, *(c[0] for c in CHAINS), LOST_MARK, LOST_QUESTION)
#: cp1252 leaves five bytes open; they are read as control characters.
_OPEN = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)}
_OPEN_BACK = {ord(c): b for b, c in _OPEN.items()}


def _read_as(raw: bytes, enc: str) -> str:
    return raw.decode("latin_1").translate(_OPEN) if enc == "cp1252" else raw.decode(enc)


def _bytes_of(text: str, enc: str) -> bytes:
    return text.translate(_OPEN_BACK).encode("latin_1") if enc == "cp1252" and not set(map(ord, text)) - set(_OPEN_BACK) else text.encode(enc)


def damage(text: str, chain: tuple) -> str:
    """The text as it looks after a chain. Raises UnicodeError where the chain can't carry it."""
    for _ in range(chain[3]):
        text = _read_as(text.encode(chain[1]), chain[2])
    return text


def invert(text: str, chain: tuple) -> str | None:
    """The text before a chain, or None if it doesn't decode strictly."""
    try:
        for _ in range(chain[3]):
            text = _bytes_of(text, chain[2]).decode(chain[1])
    except UnicodeError:
        return None
    return text


def invert_parts(text: str, chain: tuple) -> str | None:
    """The text with those runs of characters beyond ASCII inverted that decode strictly; None if there are none."""
    if chain[1] != "utf-8" or text.isascii():
        return None
    done = re.sub(r"[^\x00-\x7f]+", lambda m: invert(m[0], chain) or m[0], text)
    return done if done != text else None


def cells(text: str) -> np.ndarray:
    """Hashed byte bigrams of a text (framed by control bytes) that have a byte beyond ASCII or a question mark."""
    raw = np.frombuffer(b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.uint32)
    a, b = raw[:-1], raw[1:]
    told = (a * 256 + b)[(a > 127) | (b > 127) | (a == 63) | (b == 63)]
    return ((told * np.uint32(2654435761)) >> np.uint32(33 - CELLS.bit_length())).astype(np.int64)


def _doubtful(v: str) -> bool:
    """Kept out of the clean training values: a chain inverts it, or it has symbols that text rarely has."""
    if "�" in v or re.search(r"(^|\s)\?|\?\w", v) or any(unicodedata.category(c) in ("Cc", "Co", "So", "Sm", "Sc", "Sk") for c in v if ord(c) > 126):
        return True
    return not v.isascii() and any(c[1] == "utf-8" and invert(v, c) is not None for c in CHAINS)


_OTHER_SCRIPT = re.compile(r"[^\W\d_a-zA-ZÀ-ɏ]{2}")


def _garbled(v: str, chain: tuple) -> str | None:
    """A clean value after a chain, None where the chain doesn't change it or can't carry it. Chains from encodings of other scripts take
    values with two neighbouring letters of it: a single one is a borrowed look-alike rather than that script."""
    if chain[1] not in ("utf-8", "cp1252") and not _OTHER_SCRIPT.search(v):
        return None
    try:
        bad = damage(v, chain)
    except UnicodeError:
        return None
    return bad if bad != v and "�" not in bad else None


def train(values: list[str]) -> np.ndarray:
    """Log likelihoods (CELLS, labels) of bigrams from values, the doubtful left out and the rest garbled through every chain."""
    clean = sorted(v for v in set(values) if not _doubtful(v))
    wide = [v for v in clean if not v.isascii()]
    lost = lambda mark: ["".join(c if c.isascii() else mark for c in v) for v in wide]
    n = np.zeros((CELLS, len(LABELS)))
    for k, texts in enumerate([clean, *([g for v in wide if (g := _garbled(v, c))] for c in CHAINS), lost("�"), lost("?")]):
        if texts:  # the bigram of two frames is plain ASCII
            n[:, k] = np.bincount(cells("\x03\x02".join(texts)), minlength=CELLS)
    total = n.sum(0)
    usual = (n / np.maximum(total, 1)).sum(1) + 1e-3
    w = np.log((1 - SMOOTH) * n / np.maximum(total, 1) + SMOOTH * (usual / usual.sum())[:, None])
    w[:, total == 0] = -1e3 if total[0] else 0.0  # chains that nothing could be trained for
    return w.astype(np.float32)


PRIOR = np.log(np.array([1 - EXPECTED] + [EXPECTED / (len(LABELS) - 1)] * (len(LABELS) - 1)))


def _verified(v: str, label: str) -> tuple[bool, str | None]:
    """Whether a label is possible for a value, and what its inversion gives."""
    if label == LOST_MARK:
        return "�" in v, None
    if label == LOST_QUESTION:
        return "?" in v, None
    chain = CHAINS[LABELS.index(label) - 1]
    before = invert(v, chain)
    if before is None:
        before = invert_parts(v, chain)
    ok = before is not None and before != v and not any(unicodedata.category(c) in ("Cc", "Co", "Cn") for c in before)
    return ok and (chain[1] in ("utf-8", "cp1252") or bool(_OTHER_SCRIPT.search(before))), before


def classify(values: list[str], w: np.ndarray) -> list[tuple[str, str | None]]:
    """(label, restored) of each value; restored is the value itself where it is clean, None where characters are lost."""
    out: list[tuple[str, str | None]] = []
    for v in values:
        at = cells(v)
        score = PRIOR + w[at].sum(0)
        best: tuple[str, str | None] = (CLEAN, v)
        for k in np.argsort(-score, kind="stable") if len(at) else ():
            if score[k] < score[0] + np.log(ODDS):
                break
            ok, before = _verified(v, LABELS[k])
            if ok:
                best = (LABELS[k], before)
                break
        if best[0] != CLEAN and best[1] is not None and not best[1].isascii():  # damaged more than once; every turn shortens it
            after = classify([best[1]], w)[0] if len(best[1]) < len(v) else (CLEAN, None)
            if after[0] != CLEAN and after[1] is not None:
                best = (best[0], after[1])
        out.append(best)
    return out


def suspect(value: Column) -> Column:
    """Values that can be damaged at all: with a character beyond ASCII, or a question mark."""
    return value.rlike(r"[^\x00-\x7F]|\?")


def fit(values: DataFrame, bound: int = TRAIN_VALUES) -> np.ndarray:
    """Train on a bounded sample of the distinct values in column `value`: the first `bound` by hash of those that can be damaged."""
    first = values.select("value").where(suspect(F.col("value"))).distinct().orderBy(F.xxhash64("value"), "value").limit(bound)
    return train([r["value"] for r in first.collect()])


def labelled(values: DataFrame, w: np.ndarray) -> DataFrame:
    """value, label, restored of every distinct suspect value in column `value`; values that aren't there are clean."""
    weights = values.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = classify(list(pdf["value"]), weights.value)
            yield pd.DataFrame({"value": pdf["value"], "label": [a for a, _ in got], "restored": [b for _, b in got]})

    return spread(values.select("value").where(suspect(F.col("value"))).distinct(), "value").mapInPandas(run, "value string, label string, restored string")


def book_values(books: DataFrame, fields: tuple[str, ...] = ("parsed_title", "parsed_author")) -> DataFrame:
    """book_hash, field, value of the given fields, one row per distinct book, field and value."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])  # one read for all fields
    return books.select("book_hash", F.inline(each)).where("value is not null and book_hash is not null")


def found(books: DataFrame, restored: bool = False) -> DataFrame:
    """book_hash, field of every damaged value of parsed_title and parsed_author (and value, label, restored on demand)."""
    rows = book_values(books)
    hits = labelled(rows, fit(rows)).where(F.col("label") != CLEAN)
    cols = ["book_hash", "field", *(["value", "label", "restored"] if restored else [])]
    return rows.join(hits, "value").select(*cols).distinct()

