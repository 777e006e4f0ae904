"""Free-entered names mapped to the entries of a reference list, unmatched values reported.

Values are deduplicated and normalised (encoding damage undone, noise and roles removed). Every entry of the reference list stands in an
inverted index of character n-grams, in each form in which a name is usually typed: in full, with short forms, with initials, with the
beginning of the given name. A value's candidates are the entries that share n-grams with it, scored by the cosine of n-gram vectors
weighted by rarity; an entry counts by its best form. The best entry is accepted if its cosine is above `THRESHOLD` and leads the next
entry's by `LEAD`. An exact check of the name's parts may then refuse it (another given name, another middle initial, "Jr."); it can't
put another entry in its place.

The reference list goes to every task in blocks of at most `BLOCK` entries, one after the other; values are never gathered.

Defined results: blank and null values are no cases; values that name nobody or an unknown name get 0; "Jr." is another person;
equal values have equal results; when two entries fit alike, none is accepted; an empty reference list gives 0 for every value.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import blank, spread
from . import garble
from .names import NICKNAMES, Name, fold, near, parse, same_given, slips

#: Least cosine of the best entry; its least lead over the next entry; reference entries that are searched at once.
THRESHOLD, LEAD, BLOCK = 0.4, 0.005, 20_000
SHORT: dict[str, list[str]] = defaultdict(list)
for _short, _full in NICKNAMES.items():
    SHORT[_full].append(_short)


def grams(word: str) -> list[str]:
    """n-grams of a framed word: pairs and triples; of longer words also pairs around a letter and pairs in either order
    and the letters of the word (for slips)."""
    t = f"^{word}$"
    out = [t[i : i + 2] for i in range(len(t) - 1)] + [t[i : i + 3] for i in range(len(t) - 2)]
    if len(word) > 3:
        out += [f"{t[i]}_{t[i + 2]}" for i in range(len(t) - 2)] + ["~" + "".join(sorted(t[i : i + 2])) for i in range(1, len(t) - 2)]
        out += ["#" + "".join(sorted(word))]
    return out


def entry_words(name: str) -> tuple[str, ...]:
    return tuple(w for w in (x.strip(".") for x in fold(name).replace(".", " ").split()) if w)


def typed_forms(words: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The forms in which an entry's name is usually typed, as words."""
    given, middle, surname = words[0], [w[0] for w in words[1:-1]], words[-1]
    if len(words) == 1:
        return [words]
    out = {(given[:k], surname) for k in (1, 3, 4)} | {(given[0] + surname,)}
    out |= {(x, *m, surname) for x in (given, given[0], *SHORT[given]) for m in ([], middle)}
    return sorted(out | ({(given[0] + "".join(middle), surname)} if middle else set()))


class Reference:
    """Inverted n-gram index of a block of reference entries. rarity: n-gram -> entries that have it, of `size` entries in all."""

    def __init__(self, rows: list[tuple[int, str]], rarity: dict[str, int] | None = None, size: int | None = None) -> None:
        self.rows = [(i, n, w) for i, n in sorted(rows) if n and (w := entry_words(n))]
        forms = [(k, Counter(g for w in f for g in grams(w))) for k, (_, _, words) in enumerate(self.rows) for f in typed_forms(words)]
        if rarity is None:
            rarity = Counter(g for k, g in {(k, g) for k, c in forms for g in c})
        size = size or len(self.rows)
        self.idf = {g: math.log(1 + size / n) for g, n in rarity.items()}
        self.unseen = math.log(1 + size)
        self.owner = np.array([k for k, _ in forms], np.int64)
        index: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for f, (_, c) in enumerate(forms):
            weights = {g: math.sqrt(n) * self.idf[g] for g, n in c.items()}
            norm = math.sqrt(sum(x * x for x in weights.values())) or 1
            for g, x in weights.items():
                index[g][0].append(f), index[g][1].append(x / norm)
        self.index = {g: (np.array(f, np.int32), np.array(x, np.float32)) for g, (f, x) in index.items()}

    def scores(self, words: tuple[str, ...]) -> np.ndarray:
        """Cosine of a value's words with every entry, by the entry's best form."""
        own = {g: math.sqrt(n) * self.idf.get(g, self.unseen) for g, n in Counter(g for w in words for g in grams(w)).items()}
        size = math.sqrt(sum(x * x for x in own.values())) or 1
        hits = [(self.index[g], x / size) for g, x in own.items() if g in self.index]
        best = np.zeros(len(self.rows))
        if hits:
            each = np.bincount(np.concatenate([f for (f, _), _ in hits]), np.concatenate([y * x for (_, y), x in hits]), len(self.owner))
            np.maximum.at(best, self.owner, each)
        return best

    def fits(self, name: Name, e: int) -> float:
        """How well the parts of a name say an entry: 0 not at all, up to 3 in full."""
        ref = self.rows[e][2]
        given, middle, surname = ref[0], ref[1:-1], ref[-1]
        words = list(name.words)
        if name.junior or not words or len(words) > 4:
            return 0
        if len(words) == 1:  # an initial written in one with the surname
            w = words[0]
            return 1.5 if len(w) > 4 and w[0] == given[0] and near(w[1:], surname, slips(len(surname))) else 0
        best = 0.0
        for k, w in enumerate(words):
            if len(w) < 3 or not near(w, surname, slips(min(len(w), len(surname)))):
                continue
            others = words[:k] + words[k + 1 :]
            if k not in (0, len(words) - 1):
                continue
            exact = 1.0 if w == surname else 0.5
            if len(others) == 1 and len(others[0]) == 2 and middle and others[0][0] == given[0] and others[0][1] == middle[0][0]:
                how = 1.5  # initials in one
            elif len(others) == 1 and len(others[0]) == 2 and not middle and others[0][0] == given[0]:
                how = 1.2
            else:
                how, other = same_given(others[0], given), others[1:]
                if how and middle and other and len(other[0]) == 1 and other[0] != middle[0][0]:
                    how = 0  # another middle initial
                if how and any(len(o) > 2 for o in other):
                    how = 0
            if how:
                best = max(best, how - 1 + exact + (0.2 if middle and len(others) > 1 else 0))
        return best

    def best(self, value: str) -> tuple[float, int, bool, float]:
        """(cosine, id) of the best entry, whether the exact check lets it pass, and the next entry's cosine."""
        name = parse(value)
        if name.kind != "person" or not self.rows:
            return 0.0, 0, False, 0.0
        score = self.scores(name.words)
        e = int(np.argmax(score))
        top, score[e] = float(score[e]), 0.0
        return top, self.rows[e][0], self.fits(name, e) > 0, float(score.max())

    def meant(self, value: str) -> int:
        """Id of the entry that a value means, 0 for none."""
        return accepted(*self.best(value))


def accepted(top: float, entry: int, passes: bool, second: float) -> int:
    return entry if passes and top >= THRESHOLD and top - second >= LEAD else 0


def references(ref: DataFrame, block: int = BLOCK) -> Iterator[Reference]:
    """The reference list in blocks of about `block` entries on the driver; n-grams are counted over all entries."""
    own = ref.select(F.col("author_id").cast("bigint").alias("author_id"), "name").where("author_id is not null and trim(name) <> ''").distinct()
    size = own.count()
    if size <= block:
        yield Reference([(r["author_id"], r["name"]) for r in own.collect()])
        return

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"gram": [g for n in pdf["name"] if (w := entry_words(n)) for g in {g for f in typed_forms(w) for x in f for g in grams(x)}]})

    rarity = {r["gram"]: r["n"] for r in own.mapInPandas(told, "gram string").groupBy("gram").agg(F.count("*").alias("n")).collect()}
    count = -(-size // block)
    for b in range(count):
        yield Reference([(r["author_id"], r["name"]) for r in own.where(F.pmod(F.xxhash64("author_id"), F.lit(count)) == b).collect()], rarity, size)


def mapped(values: DataFrame, ref: DataFrame, block: int = BLOCK) -> DataFrame:
    """value, author_id (0: none), cosine, lead of every distinct value. values: value, restored (null: as it is)."""
    spark, own, out = values.sparkSession, spread(values.select("value", "restored"), "value"), None
    for part in references(ref, block):
        index = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [index.value.best(r if isinstance(r, str) else v) for v, r in zip(pdf["value"], pdf["restored"])]
                yield pd.concat([pdf[["value"]].reset_index(drop=True), pd.DataFrame(rows, columns=["top", "entry", "passes", "second"])], axis=1)

        one = own.mapInPandas(run, "value string, top double, entry bigint, passes boolean, second double")
        out = one if out is None else out.unionByName(one)
    # of several blocks, the best entry of all and the next of all
    best = out.groupBy("value").agg(F.max(F.struct("top", "entry", "passes")).alias("b"), F.sort_array(F.flatten(F.collect_list(F.array("top", "second"))), asc=False)[1].alias("second"))
    lead = F.col("b.top") - F.col("second")
    entry = F.when(F.col("b.passes") & (F.col("b.top") >= THRESHOLD) & (lead >= LEAD), F.col("b.entry")).otherwise(F.lit(0).cast("bigint"))
    return best.select("value", entry.alias("author_id"), F.col("b.top").alias("cosine"), lead.alias("lead"))


def found(books: DataFrame, entries: DataFrame, ref: DataFrame) -> DataFrame:
    """tab, row_key, author_id of every row with a name in books.parsed_author or library_entries.norm_author."""
    b = books.select(F.lit("books").alias("tab"), F.col("book_hash").alias("row_key"), F.col("parsed_author").alias("value"))
    e = entries.select(F.lit("library_entries").alias("tab"), F.col("entry_id").cast("string").alias("row_key"), F.col("norm_author").alias("value"))
    rows = b.unionByName(e).where(~blank(F.col("value")) & F.col("row_key").isNotNull())
    own = garble.book_values(books)
    damaged = garble.labelled(own.where("field = 'parsed_author'"), garble.fit(own)).where((F.col("label") != garble.CLEAN) & F.col("restored").isNotNull())
    values = rows.select("value").distinct().join(damaged.select("value", "restored"), "value", "left")
    # one value can hold a third of the rows: the values' side has one row each, so the hot side may be split
    return rows.join(mapped(values, ref).select("value", "author_id"), "value").select("tab", "row_key", "author_id").distinct()


def unmatched(books: DataFrame, entries: DataFrame, ref: DataFrame) -> DataFrame:
    """tab, rows: rows whose value means no entry of the reference list."""
    return found(books, entries, ref).where("author_id = 0").groupBy("tab").agg(F.count("*").alias("rows"))
