"""Evaluation passages leaking into training documents, by suffix arrays of the documents.

Documents are cut into shards of bounded size (in words). A shard's words are numbered by the vocabulary of the evaluation items and its
suffix array is built by prefix doubling. Every suffix of every item is binary-searched in it, which gives the places that agree with it in
`SEED` words or more; each is followed to its end, so that what comes out is the longest verbatim match there and its location.

A match of `RUN` words that holds a name of its item is a leak. The other pairs of a document and an item go on if their longest matches can
belong to a changed passage: they cover more than one seed, and the document has one of the item's names or a verbatim run. An exact check
aligns them word by word around the matches: letter slips and single other or added words are small changes, other text may stand between
whole sentences, but a passage with other names is no leak.

Items are read in blocks of at most `BLOCK_WORDS` words, each of which goes to every task in turn; documents are never gathered. Sentences
and words that many items share are counted over all items first.

Defined results: null and empty texts have no leaks; items shorter than the least run have none; sentences that many items share
(lead-ins) don't count; copies of a document are reported each; whole texts are searched, of any length; an empty set of items leaks nowhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import spread

#: Words in a row that make a leak; words that a verbatim match has at least.
RUN, SEED = 12, 3
#: Words by which suffixes are ordered, at most.
DEPTH = 16
#: Words of the items that are searched for at once (more are searched in several rounds), words of a shard of documents.
BLOCK_WORDS, SHARD_WORDS = 500_000, 1_000_000
#: A sentence in more than this share of the items (and in three at least) is a lead-in; a word in more than this share is no name.
SHARED, COMMON = 0.05, 0.02
#: Share of a run's words that may be other words.
OTHER = 0.14
_WORD = re.compile(r"[^\W_]+(?:['’‑-][^\W_]+)*")
_MARKS, _INNER = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff\ufe20-\ufe2f​‌‍­]"), re.compile("['’‑-]")
_LAYOUT = re.compile(r"\[\d{1,2}:\d{2}(?::\d{2})?\]")


def words(text: str) -> list[str]:
    """Words in lower case without accents, marks inside words and time stamps."""
    flat = _LAYOUT.sub(" ", text)
    if not flat.isascii():
        flat = _MARKS.sub("", unicodedata.normalize("NFKD", flat))
    return [w if w.isalnum() else _INNER.sub("", w) for w in _WORD.findall(flat.lower())]


@lru_cache(maxsize=100_000)
def _slips(word: str) -> frozenset[str]:
    """The word and what is left of it without one letter; two words within one slip share a member."""
    return frozenset({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 3 else {word})


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+", text.strip())


class Items:
    """A block of the evaluation set, ready for search: words without lead-ins, sentence ends, names, slips.

    leads: sentences (their words joined) that many items share; common: words of many items. By default counted over the block.
    """

    def __init__(self, items: list[tuple[int, str]], leads: set[str] | None = None, common: set[str] | None = None) -> None:
        sentences = {i: _sentences(t) for i, t in items if t and t.strip()}
        if leads is None:
            often = Counter(s for own in sentences.values() for s in {" ".join(words(x)) for x in own})
            leads = {s for s, n in often.items() if n > max(2, SHARED * len(sentences))}
        self.ids, self.words, self.ends = [], [], []
        for i, own in sorted(sentences.items()):
            w, ends = [], set()
            for s in own:
                if (part := words(s)) and " ".join(part) not in leads:
                    w += part
                    ends.add(len(w))
            if len(w) >= RUN:
                self.ids.append(i), self.words.append(w), self.ends.append(ends)
        self.number = {w: k for k, w in enumerate(sorted({x for w in self.words for x in w}), 1)}
        if common is None:
            count = Counter(x for w in self.words for x in set(w))
            common = {w for w, n in count.items() if n > max(2, COMMON * len(self.ids))}
        self.rare = [np.array([x not in common for x in w]) for w in self.words]
        self.near: list[dict[str, list[int]]] = []
        self.known: list[dict[str, list[int]]] = [{} for _ in self.words]
        named = defaultdict(set)  # what slips of a name leave -> (item, letters)
        for k, w in enumerate(self.words):
            near = defaultdict(list)
            for j, x in enumerate(w):
                for s in _slips(x):
                    near[s].append(j)
                    if self.rare[k][j]:
                        named[s].add((k, len(x)))
            self.near.append(dict(near))
        self.named = dict(named)
        numbers = [np.array([self.number[x] for x in w], np.int64) for w in self.words]
        self.flat = np.concatenate([x for n in numbers for x in (n, [0])]) if numbers else np.zeros(0, np.int64)
        self.owner = np.concatenate([np.full(len(n) + 1, k) for k, n in enumerate(numbers)]) if numbers else np.zeros(0, int)
        self.place = np.concatenate([np.arange(len(n) + 1) for n in numbers]) if numbers else np.zeros(0, int)
        self.name_at = np.concatenate([x for r in self.rare for x in (r, [False])]) if numbers else np.zeros(0, bool)

    def owners(self, word: str) -> list[int]:
        """Items that have the word, but for a slip, as a name."""
        return sorted({k for s in _slips(word) for k, n in self.named.get(s, ()) if abs(n - len(word)) < 2}) if len(word) > 1 else []

    def places(self, k: int, word: str) -> list[int]:
        """Where an item has a word, but for a slip (remembered for words that come again)."""
        known = self.known[k]
        if word not in known:
            if len(known) > 5000:
                known.clear()
            item, near = self.words[k], self.near[k]
            known[word] = sorted({j for s in _slips(word) for j in near.get(s, ()) if abs(len(item[j]) - len(word)) < 2})
        return known[word]


def suffix_array(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffixes of `flat` that begin at `starts`, in order of their words: by prefix doubling, until all differ or `DEPTH` words are told
    apart. Searches are for fewer words; matches are followed to their end in the text."""
    r, d = np.unique(flat, return_inverse=True)[1].astype(np.int64), 1
    while d < min(DEPTH, len(r)) and r[starts].size and len(np.unique(r[starts])) < len(starts):
        after = np.concatenate([r[d:] + 1, np.zeros(d, np.int64)])
        r, d = np.unique(r * (len(r) + 2) + after, return_inverse=True)[1].astype(np.int64), 2 * d
    return starts[np.argsort(r[starts], kind="stable")]


def _bound(flat: np.ndarray, order: np.ndarray, asked: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search in a suffix array: first place whose suffix isn't before (upper: is behind) the asked words, a row each."""
    lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(order), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        before, equal = np.zeros(len(asked), bool), np.ones(len(asked), bool)
        for k in range(asked.shape[1]):
            w = flat[at + k]
            before |= equal & (w < asked[:, k])
            equal &= w == asked[:, k]
        right = (before | equal if upper else before) & open_
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def longest_matches(docs: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in docs, place in items, words) of all verbatim matches of SEED words or more that can't be made longer on either side.

    docs: numbers of words; what no item has, and ends of documents, have numbers of their own.
    """
    vocabulary = len(items.number)
    flat = np.concatenate([docs, np.full(SEED, -1)])  # a suffix at the end is shorter than what is asked
    order = suffix_array(docs, np.flatnonzero(docs <= vocabulary))
    size = len(items.flat) - SEED + 1
    real = np.flatnonzero(np.all([items.flat[k : k + size] > 0 for k in range(SEED)], axis=0)) if size > 0 else np.zeros(0, int)
    if not len(order) or not len(real):
        return (np.zeros(0, np.int64),) * 3
    asked, number = np.unique(items.flat[real[:, None] + np.arange(SEED)], axis=0, return_inverse=True)
    lo, hi = _bound(flat, order, asked, False)[number.ravel()], _bound(flat, order, asked, True)[number.ravel()]
    n = hi - lo
    p = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    q = np.repeat(real, n)
    first = (p == 0) | (q == 0) | (docs[p - 1] != items.flat[q - 1])
    p, q = p[first], q[first]
    length, open_ = np.full(len(p), SEED), np.arange(len(p))
    while len(open_):
        i, j = p[open_] + length[open_], q[open_] + length[open_]
        open_ = open_[(i < len(docs)) & (docs[np.minimum(i, len(docs) - 1)] == items.flat[j]) & (items.flat[j] > 0)]
        length[open_] += 1
    return p, q, length


def _resumes(same: np.ndarray, rare: np.ndarray, i: int, j: int, step: int) -> bool:
    """Whether item and document agree again right after another name, going on from a stretch's end."""
    n, m = same.shape
    for _ in range(2):
        if not (0 <= i < n and 0 <= j < m):
            return False
        if rare[j] and not same[i, j] and any(0 <= i + s < n and 0 <= j + s < m and same[i + s, j + s] for s in (step, 2 * step)):
            return True
        i, j = i + step, j + step
    return False


def _same(doc: list[str], k: int, items: Items) -> np.ndarray:
    """Which words of a window are which words of an item, but for a slip."""
    same = np.zeros((len(doc), len(items.words[k])), bool)
    for i, w in enumerate(doc):
        if at := items.places(k, w):
            same[i, at] = True
    return same


def _aligned(same: np.ndarray, k: int, items: Items) -> list[tuple[int, int, int, int]]:
    """Aligned stretches of an item in a window of words: (item from, item to, doc from, doc to), by repeated local alignment."""
    n, m = same.shape
    out, rows = [], np.where(same, 1.0, -1.2)
    used = np.zeros(n, bool)
    while True:  # each turn uses up a word at least
        best = np.zeros((n + 1, m + 1))
        step = np.zeros((n + 1, m + 1), np.int8)
        for i in range(1, n + 1):
            if used[i - 1]:
                continue
            diagonal, down = best[i - 1, :-1] + rows[i - 1], best[i - 1, 1:] - 0.5
            row = np.maximum(np.maximum(diagonal, down), 0)
            kind = np.where(row == 0, 0, np.where(diagonal >= down, 1, 2)).astype(np.int8)
            skip = row[:-1] - 1.2  # one word of the item left out
            better = skip > row[1:]
            row[1:][better], kind[1:][better] = skip[better], 3
            best[i, 1:], step[i, 1:] = row, kind
        i, j = np.unravel_index(np.argmax(best), best.shape)
        if best[i, j] < SEED:
            break
        to = (j, i)
        hit, wrong_rare, right_rare, other = 0, 0, 0, 0
        while i > 0 and j > 0 and step[i, j] > 0:
            kind = step[i, j]
            if kind == 1:
                ok = same[i - 1, j - 1]
                hit, other = hit + ok, other + (not ok)
                if items.rare[k][j - 1]:
                    right_rare, wrong_rare = right_rare + ok, wrong_rare + (not ok)
                i, j = i - 1, j - 1
            elif kind == 2:
                i -= 1
            else:
                other, j = other + 1, j - 1
        used[i : to[1]] = True
        length = to[0] - j
        # a run without any name of the item has to be unchanged, and not go on beyond another name
        nameless = right_rare == 0 and (other > 0 or _resumes(same, items.rare[k], i - 1, j - 1, -1) or _resumes(same, items.rare[k], to[1], to[0], 1))
        if not nameless and wrong_rare <= right_rare * 0.34 and other <= OTHER * length:
            out.append((j, to[0], i, to[1]))
    return out


def _longest(stretches: list[tuple[int, int, int, int]], ends: set[int]) -> int:
    """Most item words in a row; stretches join where one ends with a sentence and another begins with the next."""
    best, run = 0, {}
    for a, b, i, j in sorted(stretches):
        n = b - a
        for (end, place), had in list(run.items()):
            if end == a and a in ends and place <= i:
                n = max(n, had + b - a)
        run[b, j] = max(run.get((b, j), 0), n)
        best = max(best, n)
    return best


def search(ids: list[int], texts: list[str | None], items: Items) -> list[tuple[int, int, int]]:
    """(doc id, item id, words of the longest run) of the documents of one shard."""
    found: list[tuple[int, int, int]] = []
    own = [words(t) if t else [] for t in texts]
    sizes = np.array([len(w) + 1 for w in own])
    if not len(own) or not items.ids:
        return found
    begin = np.cumsum(sizes) - sizes
    code, kinds = pd.factorize(np.array([x for w in own for x in (*w, "")], object))
    flat = np.array([items.number.get(x, 0) for x in kinds], np.int64)[code]
    flat[flat == 0] = len(items.number) + 1 + np.arange((flat == 0).sum())  # words that no item has match nothing
    p, q, length = longest_matches(flat, items)
    if not len(p):
        return found
    n_items = len(items.ids)
    pair = (np.searchsorted(begin, p, "right") - 1) * n_items + items.owner[q]
    names = np.concatenate([[0], np.cumsum(items.name_at)])
    sure = (length >= RUN) & (names[q + length] > names[q])
    best: dict[int, int] = {}
    for k, n in zip(pair[sure].tolist(), length[sure].tolist()):
        best[k] = max(best.get(k, 0), n)
    # of the rest, pairs whose matches cover more than one seed and have a name of the item in the document, or a verbatim run
    keys, number = np.unique(pair, return_inverse=True)
    covered = np.bincount(number, length)
    runs = np.bincount(number, length >= RUN) > 0
    known = [items.owners(x) for x in kinds]
    has = np.array([bool(x) for x in known])
    at = np.flatnonzero(has[code])
    named = {int(d) * n_items + k for d, c in zip(np.searchsorted(begin, at, "right") - 1, code[at]) for k in known[c]}
    going = {k for k, c, r in zip(keys.tolist(), covered.tolist(), runs.tolist()) if k not in best and c > SEED and (r or k in named)}
    some = np.flatnonzero(np.isin(pair, np.fromiter(going, np.int64, len(going))))
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in some:
        places[int(pair[i])].append((int(p[i]), int(length[i])))
    for key, hits in sorted(places.items()):
        d, k = divmod(key, n_items)
        n = _checked(own[d], sorted((x - int(begin[d]), x - int(begin[d]) + m) for x, m in hits), k, items)
        if n >= RUN:
            best[key] = n
    return [(ids[key // n_items], items.ids[key % n_items], int(n)) for key, n in sorted(best.items())]


def _checked(doc: list[str], hits: list[tuple[int, int]], k: int, items: Items) -> int:
    """Most words in a row that a document has of an item, small changes forgiven. hits: (from, to) of longest matches.

    What belongs to a match stands no farther from it than the item is long, so the document is read in windows of that margin.
    """
    margin, windows = len(items.words[k]), []
    for a, b in hits:
        if windows and a - margin <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], min(len(doc), b + margin))
        else:
            windows.append([max(0, a - margin), min(len(doc), b + margin)])
    seen = [_same(doc[a:b], k, items) for a, b in windows]
    # a run needs most of its words somewhere in the windows
    there = np.cumsum(np.concatenate([[0], np.any([x.any(0) for x in seen], axis=0)]))
    if (there[RUN:] - there[:-RUN]).max() < RUN - int(OTHER * RUN):
        return 0
    stretches = [(a, b, i + lo, j + lo) for (lo, _), x in zip(windows, seen) for a, b, i, j in _aligned(x, k, items)]
    return _longest(stretches, items.ends[k])


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The evaluation set in blocks of about `block_words` words on the driver. items: item_id, text.

    Lead-ins and words that are no names are counted over all items in Spark; only those of more than a share of all items are collected,
    which bounds their number by the length of an item.
    """
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and trim(text) <> ''").distinct()

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["item_id"], pdf["text"]):
                parts = [words(s) for s in _sentences(t)]
                rows += [(i, True, " ".join(p)) for p in parts if p] + [(i, False, w) for p in parts for w in p]
            yield pd.DataFrame(rows, columns=["item_id", "whole", "said"])

    size = own.agg(F.countDistinct("item_id").alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("words")).first()
    n = size["n"]
    many = F.col("n") > F.when(F.col("whole"), max(2, SHARED * n)).otherwise(max(2, COMMON * n))
    often = own.mapInPandas(told, "item_id bigint, whole boolean, said string").groupBy("whole", "said").agg(F.countDistinct("item_id").alias("n")).where(many).collect() if n else []
    leads, common = {r["said"] for r in often if r["whole"]}, {r["said"] for r in often if not r["whole"]}
    count = max(1, -(-(size["words"] or 0) // block_words))
    for b in range(count):
        block = own if count == 1 else own.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b)
        yield Items([(r["item_id"], r["text"]) for r in block.collect()], leads, common)


def leaks(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_words (longest run of item words) of every document with a passage of an item."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    docs, out = spread(docs, "doc_id"), None
    for block in blocks(items, block_words):
        ready = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], ready=ready) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                shard = (pdf["text"].str.len().cumsum() // (6 * SHARD_WORDS)).to_numpy()  # about six letters a word
                for s in np.unique(shard):
                    part = pdf[shard == s]
                    yield pd.DataFrame(search(list(part["doc_id"]), list(part["text"]), ready.value), columns=["doc_id", "item_id", "n_words"])

        hits = docs.mapInPandas(run, "doc_id bigint, item_id bigint, n_words int")
        out = hits if out is None else out.unionByName(hits)
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every leak."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that leak an item; documents without id are kept."""
    return documents.join(found(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
