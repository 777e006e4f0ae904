"""Deeply nested JSON records as related flat tables, by Merkle subtree identities.

Every object of a record (the record itself, its authors, its series, its chapters at any depth) is brought to a canonical form
and hashed bottom-up: an object's hash covers its own filled fields and the hashes of its children with their ordinals. So equal
subtrees have equal hashes wherever they stand. Each payload is read once, into nodes that are written to the shared folder.
`object_store` keeps each distinct object once, with its fields and whether it holds anything; `bridge` keeps every occurrence as
a row (record, parent node, child node, ordinal). All flat tables and `found` are the bridge joined to the store by identity.

Defined results: a null, empty or unreadable payload has no rows; an entry that is null, blank or without filled field keeps its
number but isn't filled (it is in the bridge, not in the flat tables); repeated rows of one record id are separate records with equal
nodes (distinct in the flat tables); extra columns are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import spread, stored

#: Fields of a book that hold children, and the kind of child.
CHILD_FIELDS = {"authors": "author", "seriesPrimary": "series", "chapters": "chapter"}
CHAPTER_FIELDS = ("title", "lengthMs", "startOffsetMs", "startOffsetSec")
WRAPPER_FIELDS = ("chapters", "isAccurate", "runtimeLengthMs", "brandIntroDurationMs", "brandOutroDurationMs")

NODES = "record_id bigint, child string, parent_path string, node_path string, ordinal int, parent_hash binary, object_hash binary, filled boolean, fields string"
#: The kind of the node that a record itself is.
RECORD = "record"


def _digest(kind: str, fields: dict, children: list[bytes]) -> bytes:
    """Identity of a canonical object; children are hashes in order."""
    text = json.dumps([kind, fields], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass") + b"".join(children), digest_size=16).digest()


def _filled(v) -> bool:
    if v is None:
        return False
    if isinstance(v, str):
        return bool(v.strip())
    if isinstance(v, (list, dict)):
        return any(map(_filled, v.values() if isinstance(v, dict) else v))
    return True


def _opened(v):
    """A string that holds a JSON list or object is replaced by it."""
    while isinstance(v, str) and v.strip()[:1] in ("[", "{", '"'):
        try:
            v = json.loads(v)
        except ValueError:
            break
    return v


def _book(v) -> dict | None:
    """The object that holds the book, under any wrapping objects or lists (breadth first)."""
    level = [v]
    while level:
        below = []
        for x in map(_opened, level):
            if isinstance(x, dict):
                if any(k in x for k in CHILD_FIELDS):
                    return x
                below += [y for y in x.values() if isinstance(y, (dict, list, str))]
            elif isinstance(x, list):
                below += [y for y in x if isinstance(y, (dict, list))]
        level = [y for y in below if not isinstance(y, str) or y.strip()[:1] in ("[", "{")]
    return None


def _entries(kind: str, v) -> list:
    """The entries of a child field as a list, whatever form it is given in."""
    v = _opened(v)
    if kind == "chapter" and isinstance(v, dict) and not any(_filled(v.get(f)) for f in CHAPTER_FIELDS) and any(f in v for f in WRAPPER_FIELDS):
        return _entries(kind, v.get("chapters"))
    if isinstance(v, list):
        return v
    return [] if v is None else [v]


class _Walk:
    """Collects the nodes of one record, children before parents."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []  # kind, parent path, path, ordinal, hash, filled, fields
        self.hashes: dict[tuple[str, str], bytes] = {}

    def entry(self, kind: str, v, parent: str, ordinal: int) -> bytes:
        v, path = _opened(v), f"{parent}.{ordinal}" if parent else str(ordinal)
        if isinstance(v, list):
            v = {"entries": v}
        own = v if isinstance(v, dict) else {} if v is None else {"title" if kind == "chapter" else "name": v}
        fields = {k: x for k, x in own.items() if _filled(x) and not (kind == "chapter" and k == "chapters")}
        inner = _entries(kind, own.get("chapters")) if kind == "chapter" and "chapters" in own else []
        h = _digest(kind, fields, [self.entry(kind, x, path, i) for i, x in enumerate(inner, 1)])
        self.nodes.append((kind, parent, path, ordinal, h, bool(fields) or any(map(_filled, inner)), fields))
        self.hashes[kind, path] = h
        return h

    def book(self, v: dict) -> None:
        below = [self.entry(kind, x, "", i) for field, kind in CHILD_FIELDS.items() for i, x in enumerate(_entries(kind, v.get(field)), 1)]
        fields = {k: x for k, x in v.items() if k not in CHILD_FIELDS and _filled(x)}
        self.root = _digest(RECORD, fields, below)
        self.nodes.append((RECORD, "", "", 0, self.root, True, fields))


def _walk(payload: str | None) -> _Walk | None:
    try:
        v = _book(json.loads(payload))
    except (ValueError, TypeError, RecursionError):
        return None
    if v is None:
        return None
    w = _Walk()
    w.book(v)
    return w


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in NODES.split(", ")]
    for pdf in batches:
        rows, seen = [], set()  # the fields of an object leave a batch once
        for rid, payload in zip(pdf["record_id"], pdf["payload"]):
            if (w := _walk(payload)) is not None:
                for kind, parent, path, n, h, full, fields in w.nodes:
                    above = None if kind == RECORD else w.hashes[kind, parent] if parent else w.root
                    rows.append((rid, kind, parent or None, path or None, n, above, h, full, None if h in seen else json.dumps(fields, sort_keys=True, ensure_ascii=False)))
                    seen.add(h)
        yield pd.DataFrame(rows, columns=names)


def _text(v) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def _product(v) -> dict | None:
    """The outermost object with an asin and a title, under any wrapping objects or lists (breadth first)."""
    level = [v]
    while level:
        opened = [_opened(x) for x in level]
        for x in opened:
            if isinstance(x, dict) and x.get("asin") is not None and x.get("title") is not None:
                return x
        level = [y for x in opened for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) if isinstance(y, (dict, list)) or isinstance(y, str) and y.strip()[:1] in ("[", "{")]
    return None


def _names(v) -> list[str]:
    """Names of authors given as objects, strings or lists of either."""
    v = _opened(v)
    if isinstance(v, list):
        return [n for x in v for n in _names(x)]
    name = v.get("name") if isinstance(v, dict) else v
    return [] if name is None else [_text(name)]


def products(raw: DataFrame) -> DataFrame:
    """record_id, asin, title, authors (names) of every record with an asin and a title, in whatever form it is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, payload in zip(pdf["record_id"], pdf["payload"]):
                try:
                    v = json.loads(payload)
                except (ValueError, TypeError, RecursionError):
                    continue
                book = _book(v) or {}
                own = book if book.get("asin") is not None and book.get("title") is not None else _product(v)
                if own is not None:
                    rows.append((rid, _text(own["asin"]), _text(own["title"]), [n for x in _entries("author", (book or own).get("authors")) for n in _names(x)]))
            yield pd.DataFrame(rows, columns=["record_id", "asin", "title", "authors"])

    return _source(raw).mapInPandas(run, "record_id bigint, asin string, title string, authors array<string>")


def _source(raw: DataFrame) -> DataFrame:
    return spread(raw.select(F.col("record_id").cast("bigint").alias("record_id"), F.col("payload")).where("record_id is not null and payload is not null"), "record_id")


def nodes(raw: DataFrame) -> DataFrame:
    """Every object of every record, read once and written to the shared folder. raw: record_id, payload."""
    return stored(_source(raw).mapInPandas(_nodes, NODES))


def _hex(column: str):
    return F.lower(F.hex(column)).alias(column)


def _bridge(own: DataFrame) -> DataFrame:
    return own.where(F.col("child") != RECORD).select("record_id", "child", "parent_path", "node_path", "ordinal", "parent_hash", "object_hash").distinct()


def _store(own: DataFrame) -> DataFrame:
    return own.groupBy("object_hash").agg(F.min("child").alias("child"), F.max("fields").alias("fields"), F.bool_or("filled").alias("filled"))


def bridge(raw: DataFrame) -> DataFrame:
    """One row per occurrence of an object below its parent: the parent-child links with ordinals."""
    return _bridge(nodes(raw)).select("record_id", "child", "parent_path", "node_path", "ordinal", _hex("parent_hash"), _hex("object_hash"))


def object_store(raw: DataFrame) -> DataFrame:
    """Each distinct object once: object_hash, child (its kind), fields (canonical JSON of its own filled fields), filled."""
    return _store(nodes(raw)).select(_hex("object_hash"), "child", "fields", "filled")


def found(raw: DataFrame) -> DataFrame:
    """record_id, child, node_path of every filled entry: occurrences of objects that hold anything.

    A very frequent object is a hot key of the join; adaptive skew handling splits the bridge side, the store side has one row.
    """
    own = nodes(raw)
    full = _store(own).where("filled").select("object_hash")
    return _bridge(own).join(full, "object_hash").select("record_id", "child", "node_path")


def flat_table(raw: DataFrame, child: str) -> DataFrame:
    """The flat table of one kind of child. Rows point to their record, their parent node and parent object."""
    own = nodes(raw)
    out = _bridge(own).where(F.col("child") == child).drop("child").join(_store(own).where(F.col("filled") & (F.col("child") == child)).drop("child", "filled"), "object_hash")
    if child == "chapter":
        f = F.from_json("fields", "title string, lengthMs bigint, startOffsetMs bigint, startOffsetSec bigint")
        cols = [f["title"].alias("title"), f["lengthMs"].alias("length_ms"), f["startOffsetMs"].alias("start_ms")]
    elif child == "series":
        f = F.from_json("fields", "name string, position string")
        cols = [f["name"].alias("name"), f["position"].alias("position")]
    else:
        f = F.from_json("fields", "name string, asin string")
        cols = [f["name"].alias("name"), f["asin"].alias("asin")]
    return out.select("record_id", "node_path", "parent_path", "ordinal", _hex("parent_hash"), _hex("object_hash"), *cols)
