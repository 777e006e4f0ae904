"""Fixed-capacity packs filled with documents by their token counts, by pattern packing with non-negative least squares.

The lengths of all documents make a histogram (as long as the capacity at most). Patterns are few different lengths that fill the
capacity exactly. How often each is repeated is fitted to the histogram by non-negative least squares, rounded down, and what is
left of the histogram (a number of documents that depends on the capacity, not on the corpus) is packed by best fit decreasing. The
plan, of a size bounded by the capacity, goes to every task; a document finds its pack from its length and its rank in that length.

Defined results: a document over the capacity is cut into pieces of the capacity and a rest, others are never cut; null and empty
texts have no tokens and stand in pack 0; documents that repeat are packed each; a null, zero or negative capacity gives no packs.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..util import cut, spread, width

#: File of a public tokenizer; a bare name is looked up among the installed ones.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Different lengths that third members of patterns are taken from (evenly over all lengths present). What no pattern takes is packed by best fit.
THIRDS = 24
#: Kinds of packs at most (each document stands once in each).
MAX_KINDS = 100


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    file = path if "/" in path else public_tokenizers.path(path)
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n})

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    return spread(docs, "doc_id").mapInPandas(run, "doc_id bigint, n_tokens int")


def patterns(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Patterns ((length, times), ...) of lengths with have[length] > 0 that fill the capacity exactly."""
    lengths = np.flatnonzero(have)
    out = {((capacity, 1),)} if have[capacity] else set()
    for a in lengths:
        for k in range(1, capacity // a + 1):
            rest = capacity - k * a
            if rest == 0:
                out.add(((int(a), k),))
            elif rest < len(have) and have[rest] and rest != a:
                out.add(tuple(sorted(((int(a), k), (int(rest), 1)), reverse=True)))
    some = lengths[np.linspace(0, len(lengths) - 1, min(THIRDS, len(lengths))).astype(int)] if len(lengths) else lengths
    for c in sorted({int(x) for x in some}):
        left = capacity - c
        for a in lengths[lengths <= left]:
            for k in {1, 2, left // int(a)}:
                rest = left - k * int(a)
                if 0 < rest < len(have) and have[rest]:
                    out.add(tuple(sorted(Counter([*[int(a)] * k, c, rest]).items(), reverse=True)))
    return sorted(out, reverse=True)


def fit_counts(pats: list[tuple[tuple[int, int], ...]], have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: times of each pattern, so that they use up the histogram. Long lengths weigh more."""
    row = np.array([length for p in pats for length, _ in p])
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    weight = 0.1 + np.arange(len(have)) / len(have)
    value = np.array([k for p in pats for _, k in p], float) * weight[row]
    norm = np.sqrt(np.bincount(col, value * value, len(pats)))
    value, target, n = value / norm[col], have * weight, len(have)
    forward = lambda x: np.bincount(row, value * x[col], n)
    back = lambda y: np.bincount(col, value * y[row], len(pats))
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm(back(forward(v)))
    x = z = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):  # accelerated projected gradient
        new = np.maximum(0, z - 0.9 * step * back(forward(z) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x / norm


def best_fit(have: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing on a histogram: (pattern, times). Packs of equal content are kept together."""
    packs: Counter = Counter()  # (room, content) -> number
    rooms: dict[int, set] = {}

    def put(room: int, content: tuple, n: int) -> None:
        packs[room, content] += n
        rooms.setdefault(room, set()).add(content)

    for length in np.flatnonzero(have)[::-1]:
        n, length = int(have[length]), int(length)
        while n > 0:
            fit = min((r for r in rooms if r >= length and rooms[r]), default=None)
            if fit is None:
                each = min(n, capacity // length)
                many, rest = divmod(n, each)
                put(capacity - each * length, ((length, each),), many)
                n = rest
                continue
            content = max(rooms[fit])
            number = packs.pop((fit, content))
            rooms[fit].discard(content)
            each = min(fit // length, max(1, n // number))
            used = min(number, n // each)
            if number > used:
                put(fit, content, number - used)
            put(fit - each * length, tuple(sorted((Counter(dict(content)) + Counter({length: each})).items(), reverse=True)), used)
            n -= used * each
    return sorted(((content, n) for (_, content), n in packs.items()), reverse=True)


def plan(have: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(pattern, number of packs) that hold every item of the histogram once. have[length] is a number of items."""
    left, out = have.astype(np.int64).copy(), []
    left[0] = 0
    for _ in range(3):  # rounding leaves parts of each pattern; they are fitted again
        pats = patterns(left, capacity)
        if not pats:
            break
        for p, x in sorted(zip(pats, fit_counts(pats, left)), key=lambda y: -y[1]):
            times = min(int(x), *(int(left[length]) // k for length, k in p))
            if times > 0:
                out.append((p, times))
                for length, k in p:
                    left[length] -= k * times
    return out + best_fit(left, capacity)


def _slots(plans: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of ranges, items of the length a pack has, first pack of the range."""
    parts: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    first = 0
    for p, times in plans:
        for length, k in p:
            parts.setdefault(length, []).append((used[length], k, first))
            used[length] += k * times
        first += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in parts.items()}


def pieces(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """pack_kind, capacity, doc_id, piece, from_token, n_tokens: documents, cut only where they exceed the capacity."""
    kinds = sizes.select("pack_kind", F.col("capacity_tokens").cast("int").alias("capacity")).where("pack_kind is not null and capacity_tokens > 0").distinct().orderBy("pack_kind", "capacity").limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of packs")
    each = F.array(*[F.struct(F.lit(k["pack_kind"]).alias("pack_kind"), F.lit(k["capacity"]).alias("capacity")) for k in kinds])
    if not kinds:
        each = F.array().cast("array<struct<pack_kind:string,capacity:int>>")
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    rows = counts.select("*", F.inline(each)).select("*", F.explode(F.sequence(F.lit(1), n)).alias("piece"))
    begin = ((F.col("piece") - 1) * F.col("capacity")).cast("int")
    return rows.select("pack_kind", "capacity", "doc_id", "piece", begin.alias("from_token"), F.least("capacity", F.col("n_tokens") - begin).cast("int").alias("n_tokens"))


def packs(documents: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack_kind, pack_id, doc_id, piece, from_token, n_tokens: the pack of every document or piece.

    sizes: pack_kind, capacity_tokens, a fixed table of a few rows. Token counts are written once to the shared folder.
    """
    spark = documents.sparkSession
    items = pieces(cut(token_counts(documents, tokenizer)), sizes)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * width(spark))))
    counted = items.groupBy("pack_kind", "capacity", "n_tokens", "part").agg(F.count("*").alias("n"))
    histogram = counted.groupBy("pack_kind", "capacity", "n_tokens").agg(F.sum("n").alias("n")).collect()  # a row for each length up to the capacity
    tables = {}
    for kind in sorted({r["pack_kind"] for r in histogram}):
        own = [r for r in histogram if r["pack_kind"] == kind]
        have = np.zeros(own[0]["capacity"] + 1, np.int64)
        for r in own:
            have[r["n_tokens"]] = r["n"]
        tables[kind] = _slots(plan(have, own[0]["capacity"]))

    # ranks within a length, split over parts so that a hot length is not one task
    w = Window.partitionBy("pack_kind", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("pack_kind", "n_tokens", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    own = Window.partitionBy("pack_kind", "n_tokens", "part").orderBy("doc_id", "piece")
    ranked = items.withColumn("rank", F.row_number().over(own) - 1).join(before, ["pack_kind", "n_tokens", "part"])
    ranked = ranked.select("pack_kind", "doc_id", "piece", "from_token", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pack = np.zeros(len(pdf), np.int64)
            for (kind, length), at in pdf.groupby(["pack_kind", "n_tokens"]).indices.items():
                if length > 0:
                    start, each, first = tables[kind][length]
                    rank = pdf["rank"].to_numpy()[at]
                    i = np.searchsorted(start, rank, "right") - 1
                    pack[at] = first[i] + (rank - start[i]) // each[i]
            yield pdf.drop(columns="rank").assign(pack_id=pack)[["pack_kind", "pack_id", "doc_id", "piece", "from_token", "n_tokens"]]

    return ranked.mapInPandas(run, "pack_kind string, pack_id bigint, doc_id bigint, piece int, from_token int, n_tokens int")


def utilisation(documents: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack_kind, packs, least_packs (what the tokens would fill without any loss), tokens, unused (room left), share_used of every kind of pack."""
    caps = sizes.select("pack_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    filled = packs(documents, sizes, tokenizer).groupBy("pack_kind", "pack_id").agg(F.sum("n_tokens").alias("tokens"))
    by_kind = filled.groupBy("pack_kind").agg(F.count("*").alias("packs"), F.sum("tokens").alias("tokens"))
    room = F.col("packs") * F.col("capacity")
    return by_kind.join(F.broadcast(caps), "pack_kind").select("pack_kind", "packs", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_packs"), "tokens", (room - F.col("tokens")).alias("unused"), (F.col("tokens") / room).alias("share_used"))
