"""Variant spellings of names: which spellings name the same person or organisation.

Spellings are parsed into surname and given parts. Surnames (an organisation counts as one), and the given names of one surname, are joined
within a radius of a true edit metric (unrestricted Damerau-Levenshtein): a tree of pivots parts the metric space into balls, a name within
the radius of a boundary stands on both sides (triangle inequality), and each cell is joined exactly by itself. A rare surname goes to the
commonest one it is within the radius of. Among the spellings of one surname, given names are then grouped by those pairs, short forms and
initials, which gives the people; a spelling that would do for two people is linked to neither.

The pivots come from a sample of names (`SAMPLE`, more where cells would hold more than about `CELL` names); all names are assigned, and the
join is exact whatever the pivots. Spellings that read alike (the same parts and surname) are one row for all that follows the parsing, so
that a surname with very many spellings is no large group: what is grouped is the distinct given parts of one surname.

Defined results: blank, null, damaged values and values that name nobody have no pairs; equal strings are one spelling; "Jr." is
another person; a spelling that is alone has no pair.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import blank, clustered, cut, spread
from . import garble
from .names import NICKNAMES, ORG_WORDS, distance, means, near, parse

#: Names from which pivots are taken, at least; of the sample in a leaf of the tree, at most; names in a cell, about; edit radius.
SAMPLE, LEAF, CELL, RADIUS = 4000, 60, 3000, 1
#: A word is known as a given name if it stands before more than this share of the surnames that the commonest one does (and three at least).
KNOWN = 0.05


# pivots

def grow(names: list[str], leaf: int = LEAF, depth: int = 40) -> tuple | None:
    """A tree of balls (pivot, radius, inside, outside) over a sample of names; None is a leaf."""
    if len(names) <= leaf or depth == 0:
        return None
    best = None
    for pivot in (names[0], names[len(names) // 2], names[-1]):
        far = sorted(distance(pivot, n) for n in names)
        count = Counter(far)
        for cut_at in {far[len(far) // 4], far[len(far) // 3], far[len(far) // 2]}:
            inside = sum(d <= cut_at for d in far)
            copies = count[cut_at]  # what stands on both sides for radius 1
            if 0 < inside < len(names):
                cost = max(inside, len(names) - inside) + copies
                if best is None or cost < best[0]:
                    best = (cost, pivot, cut_at)
    if best is None:
        return None
    _, pivot, mid = best
    inside, outside = [n for n in names if distance(pivot, n) <= mid], [n for n in names if distance(pivot, n) > mid]
    return pivot, mid, grow(inside, leaf, depth - 1), grow(outside, leaf, depth - 1)


def cells(name: str, tree: tuple | None, radius: int = RADIUS, path: str = "c") -> list[str]:
    """Cells of a name: two names within the radius have one in common. A pair in and out of a ball (<= mid < ) lies within the
    radius of its boundary by the triangle inequality, so names there stand on the inner and the outer side."""
    if tree is None:
        return [path]
    pivot, mid, inside, outside = tree
    d = distance(pivot, name)
    out = cells(name, inside, radius, path + "0") if d <= mid else []
    if d > mid - radius:
        out = out + cells(name, outside, radius, path + "1")
    return out


def _shorter(name: str, radius: int) -> set[str]:
    """The name and all that is left of it without up to `radius` letters: names within the radius share a member."""
    out = level = {name}
    for _ in range(radius):
        level = {n[:i] + n[i + 1 :] for n in level for i in range(len(n))}
        out = out | level
    return out


def join_cell(names: list[str], radius: int = RADIUS) -> list[tuple[str, str]]:
    """All pairs (a < b) of a cell within the radius, exactly."""
    buckets: dict[str, list[str]] = defaultdict(list)
    for n in names:
        for s in _shorter(n, radius):
            buckets[s].append(n)
    pairs = {(a, b) if a < b else (b, a) for own in buckets.values() if len(own) > 1 for i, a in enumerate(own) for b in own[i + 1 :]}
    return sorted(p for p in pairs if distance(*p) <= radius)


def radius_join(names: DataFrame, sample: int = SAMPLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """a, b, d (their distance) of all pairs (a < b) of distinct values in column `name` within the edit radius."""
    own = names.select("name").where("name is not null and name <> ''").distinct()
    take = max(sample, -(-own.count() * LEAF // cell))
    tree = grow([r["name"] for r in own.orderBy(F.xxhash64("name"), "name").limit(take).collect()])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, n) for n in pdf["name"] for c in cells(n, tree, radius)]
            yield pd.DataFrame(rows, columns=["cell", "name"])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(a, b, distance(a, b)) for a, b in join_cell(list(pdf["name"]), radius)], columns=["a", "b", "d"])

    return clustered(spread(own, "name").mapInPandas(assign, "cell string, name string"), "cell").groupBy("cell").applyInPandas(within, "a string, b string, d int").distinct()


# people

def _order(words: tuple[str, ...], last: int, given: frozenset[str]) -> tuple[tuple[str, ...], str]:
    """(given parts, surname) of a person's words. `given`: words known as given names."""
    if not words:
        return (), ""
    if last:
        return words[last:], " ".join(words[:last])
    known = [w in given or NICKNAMES.get(w) in given or w in NICKNAMES for w in words]
    initial = [len(w) <= 2 for w in words]
    if len(words) > 1 and not (known[0] or initial[0]) and (known[-1] or initial[-1] or initial[1]):
        return words[1:], words[0]
    if len(words) > 1 and not known[0] and not initial[0] and not known[-1]:  # a slip in the given name, wherever it stands
        like = [any(near(w, g) for g in given if abs(len(g) - len(w)) < 2) for w in (words[0], words[-1])]
        if like[1] and not like[0]:
            return words[1:], words[0]
    return words[:-1], words[-1]


def _founders(words: str) -> str:
    """What tells an organisation: its words but for those of its kind and their short forms."""
    own = [w for w in words.split(" ") if w not in ORG_WORDS]
    return "&" + "".join([w for w in own if len(w) > 4] or own)


def _people(pdf: pd.DataFrame, given: frozenset[str]) -> pd.DataFrame:
    """row, person of the readings of one surname. pdf: row, parts, junior, n, center, near (given names within the radius of
    the first one's full form)."""
    center = pdf["center"].iloc[0]
    rows = [(i, tuple(p.split(" ")) if p else (), bool(j), n) for i, p, j, n in zip(pdf["row"], pdf["parts"], pdf["junior"], pdf["n"])]
    full, near_to = Counter(), defaultdict(set)
    for (_, p, _, n), others in zip(rows, pdf["near"]):
        if p and len(p[0]) > 2:
            name = NICKNAMES.get(p[0], p[0])
            full[name] += n
            near_to[name].update(others if others is not None else ())
    heads: list[str] = []  # distinct given names, the surest first
    says: dict[str, str | None] = {}
    for name in sorted(full, key=lambda g: (g not in given, -full[g], g)):
        like = [h for h in heads if (h in near_to[name] or name in near_to[h] or means(name, h) >= 2) and not (name in given and len(name) > 3)]
        if like:
            says[name] = like[0] if len(like) == 1 or means(name, like[0]) > 2 else None
        else:
            heads.append(name)
            says[name] = name
    second: dict[str, set] = defaultdict(set)
    for _, p, j, _ in rows:
        if len(p) > 1 and len(p[0]) > 2 and len(p[1]) == 1 and (h := says.get(NICKNAMES.get(p[0], p[0]))):
            second[h].add(p[1])
    juniors = {(says.get(NICKNAMES.get(p[0], p[0])) if p and len(p[0]) > 2 else None) for _, p, j, _ in rows if j}
    out = []
    for i, p, junior, _ in rows:
        if not p:
            who = ""
        elif len(p[0]) > 2:
            who = says.get(NICKNAMES.get(p[0], p[0]))
        else:
            letters = p[0] if len(p[0]) == 2 else p[0] + (p[1][0] if len(p) > 1 else "")
            can = [h for h in heads if h[0] == letters[0] or letters[0] == "?"]
            if len(letters) > 1 and len(can) > 1:
                exact = [h for h in can if letters[1] in second[h]]
                can = exact or [h for h in can if not second[h]]
            if junior:
                can = [h for h in can if h in juniors] or can
            who = can[0] if len(can) == 1 else None if can else letters[0]
        if who is not None:
            out.append((i, f"{center}|{who}|{'jr' if junior else ''}"))
    return pd.DataFrame(out, columns=["row", "person"])


def spellings(books: DataFrame, aliases: DataFrame) -> DataFrame:
    """spelling, n (rows) of all filled author values of both tables that aren't damaged."""
    own = garble.book_values(books)
    cols = [books.select(F.col("parsed_author").alias("value")), aliases.select(F.col("variant").alias("value")), aliases.select(F.col("canonical").alias("value"))]
    rows = cols[0].unionByName(cols[1]).unionByName(cols[2]).where(~blank(F.col("value"))).groupBy("value").agg(F.count("*").alias("n"))
    damaged = garble.labelled(rows, garble.fit(own)).where(F.col("label") != garble.CLEAN).select("value")
    return rows.join(damaged, "value", "left_anti").select(F.col("value").alias("spelling"), "n")


def people(values: DataFrame) -> DataFrame:
    """spelling, person (a key) of every spelling that names somebody. values: spelling, n."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [parse(s) for s in pdf["spelling"]]
            yield pd.DataFrame({"spelling": pdf["spelling"], "n": pdf["n"], "kind": [x.kind for x in names], "words": [" ".join(x.words) for x in names], "last": [x.last for x in names], "junior": [x.junior for x in names]})

    parsed = spread(values, "spelling").mapInPandas(read, "spelling string, n bigint, kind string, words string, last int, junior boolean").where("kind <> 'nobody' and words <> ''")
    parsed = cut(parsed)
    # given names: words that stand first before many different words
    first = parsed.where("kind = 'person' and last = 0").select(F.split("words", " ").alias("w")).where("size(w) = 2 and length(w[0]) > 2")
    after = parsed.where("kind = 'person' and last = 1").select(F.split("words", " ").alias("w")).where("size(w) = 2 and length(w[1]) > 2").select(F.array(F.col("w")[1], F.col("w")[0]).alias("w"))
    before = cut(first.unionByName(after).groupBy(F.col("w")[0].alias("g")).agg(F.countDistinct(F.col("w")[1]).alias("k")).where("k > 3"))
    most = before.agg(F.max("k").alias("k")).first()["k"] or 0
    known: dict[str, int] = {}
    for r in before.where(F.col("k") > max(3, most * KNOWN)).orderBy(F.desc("k"), "g").collect():  # so many fit below the commonest only in small number
        if not any(k > 5 * r["k"] and near(r["g"], g) for g, k in known.items()):  # a word that is a slip of a far commoner one is no name of its own
            known[r["g"]] = r["k"]
    given = frozenset(known)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [((), _founders(w)) if k == "org" else _order(tuple(w.split(" ")), last, given) for k, w, last in zip(pdf["kind"], pdf["words"], pdf["last"])]
            yield pd.DataFrame({"spelling": pdf["spelling"], "n": pdf["n"], "kind": pdf["kind"], "junior": pdf["junior"], "parts": [" ".join(p) for p, _ in rows], "surname": [s for _, s in rows]})

    read_names = cut(parsed.mapInPandas(split, "spelling string, n bigint, kind string, junior boolean, parts string, surname string").where("surname <> ''"))
    size = read_names.groupBy("surname").agg(F.sum("n").alias("size"))
    pairs = cut(radius_join(size.select(F.col("surname").alias("name"))))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = both.join(size.select(F.col("surname").alias("b"), F.col("size").alias("other")), "b").groupBy("a").agg(F.max(F.struct("other", "b")).alias("top"))
    center = size.join(lead.withColumnRenamed("a", "surname"), "surname", "left").select(
        "surname", F.when(F.struct("size", "surname") < F.struct(F.col("top.other").alias("size"), F.col("top.b").alias("surname")), F.col("top.b")).otherwise(F.col("surname")).alias("center"))
    # a slip of a slip ends at the commonest too
    up = center.select(F.col("surname").alias("center"), F.col("center").alias("above"))
    center = center.join(up, "center").select("surname", F.col("above").alias("center"))
    placed = cut(read_names.join(center, "surname").select("center", "spelling", "n", "parts", "junior", F.xxhash64("center", "parts", "junior").alias("row")))
    reading = placed.groupBy("row", "center", "parts", "junior").agg(F.sum("n").alias("n"))
    # given names of one surname within the radius: slips of each other
    nick = F.create_map(*[F.lit(x) for kv in sorted(NICKNAMES.items()) for x in kv])
    word = F.split("parts", " ")[0]
    word = F.coalesce(nick[word], word)
    names_ = reading.select("center", word.alias("g")).where("length(g) > 2").distinct()
    close = radius_join(names_.select(F.col("g").alias("name")), radius=2).where(F.least(F.length("a"), F.length("b")) >= 3)
    slip = F.when(F.greatest(F.length("a"), F.length("b")) < 4, 0).when(F.greatest(F.length("a"), F.length("b")) < 9, 1).otherwise(2)
    close = cut(close.where(F.col("d") <= slip).select("a", "b"))
    both_ways = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = names_.join(both_ways.withColumnRenamed("a", "g"), "g").join(names_.select("center", F.col("g").alias("b")), ["center", "b"])
    near_ = pairs.groupBy("center", "g").agg(F.sort_array(F.collect_set("b")).alias("near"))
    rows = reading.withColumn("g", word).join(near_, ["center", "g"], "left").drop("g")
    who = clustered(rows, "center").groupBy("center").applyInPandas(lambda pdf: _people(pdf, given), "row bigint, person string")
    return placed.select("row", "spelling").join(who, "row").select("spelling", "person")


def found(books: DataFrame, aliases: DataFrame) -> DataFrame:
    """spelling_a, spelling_b (a < b) of every two spellings of one person or organisation."""
    who = people(spellings(books, aliases))
    a, b = who.select("person", F.col("spelling").alias("spelling_a")), who.select("person", F.col("spelling").alias("spelling_b"))
    return a.join(b, "person").where("spelling_a < spelling_b").select("spelling_a", "spelling_b").distinct()
