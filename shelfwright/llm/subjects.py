"""Subjects of documents by classifier chains over term, source and structure features.

Term features: every term gets a weight for each subject, by how much oftener its sentences are of that subject. Whose subject a
sentence is of, one of its document's labels or none, is found together with the weights by expectation-maximisation. Structure features: in how many sentences of the document each subject is, how many sentences there are, the kind of text.
Source features: hashed source and language. On these a chain of logistic classifiers is trained, each seeing the labels before it,
so that co-occurrence is modelled. Each is calibrated on held-out labels; the best label combination is found by beam search.

Only training is bounded: at most `TRAIN_DOCS` labelled documents, the first by hash (parameter). Every document is classified.

Defined results: null and empty texts have no subject; without labels nothing has; labels of unknown documents or null subjects are
left out; documents that repeat are classified alike; whole texts are read, of any length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import spread
from . import leaks

TRAIN_DOCS = 12_000
BEAM, SOURCES = 8, 8
#: Held-out rows that the uncalibrated score counts for in the calibration.
BELIEF = 2.0
#: Counts that pull a term's weight to the average; log odds that the terms of a sentence have to reach.
SMOOTH, NO_SUBJECT = 2.0, 1.4
#: Divergences from the average, as shares of the greatest possible, between which a term's weight grows from none to full.
DULL = (0.2, 0.44)
NONE = ""
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|\n+")
_LEAD = re.compile(r"^\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|\[\w+\]|[-*>•#]+|\d+[.)]|\w+:)\s*(?=\S)")
_TERM = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def sentences(text: str) -> list[str]:
    """Sentences of a text: parts that close with a mark, without list marks and time stamps. Lines without one are titles."""
    out = []
    for s in _SPLIT.split(text):
        s = _LEAD.sub("", s or "").strip()
        if re.search(r"[.!?…][\"'”’)]*$", s):
            out.append(s)
    return out or ([text.strip()] if text.strip() else [])


def terms(sentence: str) -> tuple[str, ...]:
    """Terms of a sentence: words in lower case; capitalised words after the first are names and left out where two follow each other."""
    flat = re.sub(r"(?<=\w )([A-ZÀ-Þ][\w’'-]+)(?: [A-ZÀ-Þ][\w’'-]+)+", " ", sentence)
    return tuple(w.lower() for w in _TERM.findall(flat) if len(w) > 2)


class Model:
    """Term weights, chain and calibration."""

    def __init__(self, subjects: list[str]) -> None:
        self.subjects = subjects
        self.weights: dict[str, np.ndarray] = {}
        self.base = np.zeros(len(subjects) + 1)
        self.passages: set[tuple[str, ...]] = set()

    # terms
    def fit_terms(self, docs: list[tuple[list[tuple[str, ...]], set[str]]], rounds: int = 5) -> None:
        k = len(self.subjects) + 1
        rows: dict[tuple, int] = defaultdict(int)
        for own, labels in docs:
            key = frozenset(labels)
            for s in own:
                if s:
                    rows[s, key] += 1
        vocab = {t: i for i, t in enumerate(sorted({t for s, _ in rows for t in s}))}
        at = {s: i for i, s in enumerate(self.subjects)}
        pairs, count = list(rows), np.array(list(rows.values()), float)
        can = np.zeros((len(pairs), k))
        for r, (_, labels) in enumerate(pairs):
            can[r, [at[x] for x in labels if x in at]] = 1
        can[:, -1] = 1
        row = np.concatenate([np.full(len(set(s)), r) for r, (s, _) in enumerate(pairs)])
        col = np.concatenate([[vocab[t] for t in sorted(set(s))] for s, _ in pairs])
        # a term speaks for a subject as far as sentences with it are of that subject more often than sentences are;
        # what all subjects have in common speaks for none of them, in whatever language it is
        post, most = can[:, :-1] / can[:, :-1].sum(1, keepdims=True).clip(1), np.log(max(k - 1, 2))
        for n in range(rounds):
            mass = np.zeros((len(vocab), k - 1))
            np.add.at(mass, col, post[row] * count[row, None])
            usual = (mass.sum(0) + 1) / (mass.sum() + k - 1)
            p = (mass + SMOOTH * usual) / (mass.sum(1, keepdims=True) + SMOOTH)
            lift = np.log(p / usual)
            # terms that differ little from the average (divergence in nats) are of no subject
            sharp = (((p * lift).sum(1, keepdims=True) / most - DULL[0]) / (DULL[1] - DULL[0])).clip(0, 1)
            lift = lift.clip(-3, 4) * sharp
            z = np.zeros((len(pairs), k))
            np.add.at(z[:, :-1], row, lift[col])
            z[:, -1] = NO_SUBJECT
            z[can == 0] = -np.inf
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            post = z[:, :-1]
        self.weights = {t: np.append(lift[i], 0.0) for t, i in vocab.items()}
        self.base = np.append(np.zeros(k - 1), NO_SUBJECT)

    def posterior(self, s: tuple[str, ...]) -> np.ndarray:
        z = self.base + sum(self.weights[t] for t in set(s) if t in self.weights)
        p = np.exp(z - z.max())
        return p / p.sum()

    # features
    def features(self, own: list[tuple[str, ...]], source: str | None, kind: str | None, lang: str | None, post) -> np.ndarray:
        n = len(own)
        p = np.array([post(s) for s in own]) if own else np.zeros((0, len(self.subjects) + 1))
        sure = (p[:, :-1] > 0.5).sum(0) if n else np.zeros(len(self.subjects))
        short = float(n <= 3)
        most = p[:, :-1].max(0) if n else sure
        total = p[:, :-1].sum(0) if n else sure
        shared = np.zeros(2 * SOURCES + 2)
        shared[zlib.crc32((source or "").encode()) % SOURCES] = 1
        shared[SOURCES + zlib.crc32(f"{kind}|{lang}".encode()) % SOURCES] = 1
        shared[-2:] = short, np.log1p(n) / 5
        own_part = np.stack([sure >= 1, sure >= 2, sure >= 3, short * (sure >= 1), most, np.minimum(total, 3), total / max(n, 1)], 1).astype(float)
        return np.hstack([own_part, np.tile(shared * 0.2, (len(self.subjects), 1))])

    # chain
    def fit_chain(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
        self.chain, self.scale, self.after = [], [], []
        for k in range(len(self.subjects)):
            a = np.hstack([x[:, k], y[:, :k] * 0.5, np.ones((len(x), 1))])
            w = _logistic(a[~held], y[~held, k])
            self.chain.append(w)
            self.after.append((0.5 * w[x.shape[2] : -1]).tolist())
            z = a[held] @ w
            self.scale.append(_logistic(np.stack([z, np.ones(len(z))], 1), y[held, k], ridge=BELIEF / max(held.sum(), 1), start=np.array([1.0, 0.0])))

    def decode(self, x: np.ndarray) -> list[str]:
        """The likeliest combination of labels of a document's features, by beam search along the chain."""
        n = x.shape[1]
        beam: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for k, (w, after, scale) in enumerate(zip(self.chain, self.after, self.scale)):
            own, (a, b), grown = float(x[k] @ w[:n] + w[-1]), scale.tolist(), []
            for score, on in beam:
                z = own
                for j in on:
                    z += after[j]
                z = a * z + b
                e = math.log1p(math.exp(-abs(z)))  # log odds to log probabilities of yes and no
                grown += [(score + z - e, (*on, k)), (score - e, on)] if z < 0 else [(score - e, (*on, k)), (score - z - e, on)]
            grown.sort(reverse=True)
            beam = grown[:BEAM]
        return [self.subjects[k] for k in beam[0][1]]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to `start` (zero if not given); without rows it is the start."""
    start = np.zeros(x.shape[1]) if start is None else start
    w = start.copy()
    for _ in range(25 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _parse(text: str | None, passages: set[str] | None) -> list[tuple[str, ...]]:
    """Term bags of the sentences of a text, those of evaluation passages left out."""
    return [terms(s) for s in sentences(text or "") if not (passages and _of_passage(s, passages))]


def _of_passage(sentence: str, passages: set[str]) -> bool:
    """Whether a sentence is from an evaluation item: many of its three-word sequences stand in the items."""
    w = leaks.words(sentence)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hits = sum(g in passages for g in grams)
    return bool(grams) and hits >= max(2, 0.3 * len(grams))


def _passages(items: DataFrame) -> set[str]:
    """Three-word sequences of the evaluation items, lead-ins left out."""
    return {" ".join(w[i : i + 3]) for block in leaks.blocks(items) for w in block.words for i in range(len(w) - 2)}


def fit(documents: DataFrame, labels: DataFrame, items: DataFrame | None = None, bound: int = TRAIN_DOCS) -> tuple[Model, set[str] | None]:
    """Train on at most `bound` labelled documents, the first by hash of their id."""
    passages = _passages(items) if items is not None else None
    marked = labels.where("subject is not null and trim(subject) <> '' and doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "kind", "lang").where("text is not null and text <> ''")
    first = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    terms_of = documents.sparkSession.sparkContext.broadcast(passages)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [[" ".join(t) for t in _parse(text, terms_of.value)] for text in pdf["text"]]
            yield pdf.drop(columns="text").assign(bags=own)

    # texts are read where they are; the driver gets the terms of their sentences
    bare = texts.join(first, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "source", "kind", "lang", "subjects")
    rows = spread(bare, "doc_id").mapInPandas(read, "doc_id bigint, source string, kind string, lang string, subjects array<string>, bags array<string>").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    order = Counter(s for r in rows for s in r["subjects"])
    model = Model(sorted(order, key=lambda s: (-order[s], s)))
    if not rows:
        return model, passages
    bags = [[tuple(s.split(" ")) if s else () for s in r["bags"]] for r in rows]
    model.fit_terms([(b, set(r["subjects"])) for b, r in zip(bags, rows)])
    post = lru_cache(maxsize=200_000)(model.posterior)
    x, y = [], []
    for n, (b, r) in enumerate(zip(bags, rows)):
        x.append(model.features(b, r["source"], r["kind"], r["lang"], post))
        y.append([float(s in r["subjects"]) for s in model.subjects])
        if n % 3 == 0:  # what is left of a document without its subjects has none
            rest = [s for s in b if post(s)[-1] > 0.5]
            x.append(model.features(rest, r["source"], r["kind"], r["lang"], post))
            y.append([0.0] * len(model.subjects))
    model.fit_chain(np.array(x), np.array(y), np.arange(len(x)) % 5 == 4)
    return model, passages


def classify(documents: DataFrame, model: Model, passages: set[str] | None) -> DataFrame:
    """doc_id, subject of every document, one row per subject."""

    sent = documents.sparkSession.sparkContext.broadcast((model, passages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, passages = sent.value
        post = lru_cache(maxsize=50_000)(model.posterior)
        parse = lru_cache(maxsize=50_000)(lambda s: None if passages and _of_passage(s, passages) else terms(s))
        for pdf in batches:
            out = []
            for d, text, source, kind, lang in zip(pdf["doc_id"], pdf["text"], pdf["source"], pdf["kind"], pdf["lang"]):
                own = [t for t in map(parse, sentences(text)) if t is not None]
                if own:
                    out += [(d, s) for s in model.decode(model.features(own, source, kind, lang, post))]
            yield pd.DataFrame(out, columns=["doc_id", "subject"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "kind", "lang").where("doc_id is not null and text is not null and text <> ''")
    if not model.subjects:
        return docs.select("doc_id", F.lit("").alias("subject")).where("false")
    return spread(docs, "doc_id").mapInPandas(run, "doc_id bigint, subject string")


def found(documents: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, subject of every document."""
    return classify(documents, *fit(documents, labels, items)).distinct()


def composition(documents: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """subject, documents (their number) of the corpus."""
    return found(documents, labels, items).groupBy("subject").agg(F.count("*").alias("documents"))
