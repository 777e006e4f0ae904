"""Plans for putting books into a library: destinations, names, folders that are reused, and what is done with each book.

Plans are rows; nothing is moved. Batches have an order (a sequence column): what an earlier row registers is seen by later rows. That is
computed in rounds over all rows at once, not row by row: ties in the sequence go to the lowest name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..util import cut
from . import catalog as C
from . import library as L


def series_without(series: Column, override: Column) -> Column:
    """A series without the author told by the user at its start and the marks after it; unchanged where nothing else is left."""
    rest = F.regexp_replace(F.substring(series, F.length(override) + 1, F.length(series)), r"^[:_ \-]+", "")
    starts = (F.coalesce(override, F.lit("")) != "") & F.startswith(F.lower(series), F.lower(override))
    return F.when(F.coalesce(starts, F.lit(False)) & (rest != ""), rest).otherwise(series)


def registered(files: DataFrame, index: DataFrame) -> DataFrame:
    """The files whose (dir, name) the index has. Both: dir, name; other columns of files pass through."""
    return files.join(index.select("dir", "name").distinct(), ["dir", "name"], "left_semi")


def renamed(files: DataFrame, names: DataFrame) -> DataFrame:
    """The files (dir, name and more) with `dest_name`: the new name that the map (dir, name, to) has, else the name as it is."""
    one = names.groupBy("dir", "name").agg(F.min("to").alias("_to"))
    return files.join(one, ["dir", "name"], "left").withColumn("dest_name", F.coalesce("_to", "name")).drop("_to")


def first_in_batch(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows with `repeated`: whether an earlier row of the batch has the key. Null keys never repeat. (order has no ties within a key.)"""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, key, "left").withColumn("repeated", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def reuse_in_order(wanted: DataFrame, folders: DataFrame, rounds: int = 50) -> DataFrame:
    """parent, desired, result: the folder for each wanted folder, where folders made for earlier rows of the batch can be reused as well.

    wanted: parent, desired, seq; folders: parent, actual. Folders that stand already go first (`folder_reuse`). Of the rest, a row makes
    its folder unless an earlier row that compares equal or near makes one; then it uses that one (the earliest). Which rows make folders
    is settled in rounds, each over all undecided rows; the rows left undecided after `rounds` raise an error.
    """
    one = wanted.where("parent is not null and desired is not null").groupBy("parent", "desired").agg(F.min("seq").alias("seq"))
    there = L.folder_reuse(one, folders)
    have = folders.select("parent", F.col("actual").alias("result")).distinct()
    kept = there.join(have, ["parent", "result"], "left_semi")
    rest = cut(one.join(kept.select("parent", "desired"), ["parent", "desired"], "left_anti"))
    pair = L.near_folders(rest.select("parent", "desired"), rest.select("parent", F.col("desired").alias("actual")))
    order = rest.select("parent", F.col("desired").alias("actual"), F.col("seq").alias("before"))
    links = pair.where("desired <> actual").join(rest, ["parent", "desired"]).join(order, ["parent", "actual"])
    links = cut(links.where(F.struct("before", "actual") < F.struct(F.col("seq").alias("before"), F.col("desired").alias("actual"))).select("parent", "desired", "actual", "before"))
    undecided, makers = rest.select("parent", "desired"), rest.select("parent", "desired").where("false")
    for _ in range(rounds):
        waits = links.join(undecided.withColumnRenamed("desired", "actual"), ["parent", "actual"], "left_semi").select("parent", "desired").distinct()
        fixed = links.join(makers.withColumnRenamed("desired", "actual"), ["parent", "actual"], "left_semi").select("parent", "desired").distinct()
        new = undecided.join(fixed, ["parent", "desired"], "left_anti").join(waits, ["parent", "desired"], "left_anti")
        makers = cut(makers.unionByName(new))
        undecided = cut(undecided.join(fixed, ["parent", "desired"], "left_anti").join(makers, ["parent", "desired"], "left_anti"))
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError(f"folders undecided after {rounds} rounds")
    used = links.join(makers.withColumnRenamed("desired", "actual"), ["parent", "actual"], "left_semi").groupBy("parent", "desired").agg(F.min_by("actual", F.struct("before", "actual")).alias("result"))
    made = rest.select("parent", "desired").join(makers, ["parent", "desired"], "left_anti").join(used, ["parent", "desired"])
    return kept.select("parent", "desired", "result").unionByName(makers.withColumn("result", F.col("desired"))).unionByName(made)


def reused_destination(rows: DataFrame, folders: DataFrame, dest: str = "dest", depth: int = 4) -> DataFrame:
    """The rows (seq and more) with the folders of `dest` replaced, from the top down, by those to use in the library (`reuse_in_order`).

    folders: parent, actual. A destination has `depth` folders at most; those of earlier rows are reused like those that stand already.
    """
    out = rows.withColumns({"_parts": F.split(dest, "/"), "_at": F.lit("")})
    for k in range(depth):
        own = F.when(F.size("_parts") > k, F.try_element_at("_parts", F.lit(k + 1)))
        wanted = out.select(F.col("_at").alias("parent"), own.alias("desired"), "seq").where("desired is not null")
        used = reuse_in_order(wanted, folders).select(F.col("parent").alias("_at"), F.col("desired").alias("_own"), F.col("result").alias("_used"))
        out = out.withColumn("_own", own).join(used, ["_at", "_own"], "left")
        out = out.withColumn("_at", F.when(F.col("_own").isNull(), F.col("_at")).otherwise(F.concat_ws("/", F.nullif("_at", F.lit("")), F.coalesce("_used", "_own")))).drop("_own", "_used")
        out = cut(out)
    return out.withColumn(dest, F.col("_at")).drop("_parts", "_at")


def organize_plan(books: DataFrame, index: DataFrame, override: str | None = None, reorganize: bool = False, folders: DataFrame | None = None) -> DataFrame:
    """book, dest, name, action: where a book goes and what is done. With `folders` (parent, actual: the library's) near ones are reused.

    books: book, seq, source_dir, source_name (its file), author, title, series, position; index: dir, name (files of the library).
    action: no_file, repeated (an earlier row of the batch has the same folder and file name), exists, or copy; when reorganizing instead
    ok or rename where the folder is right already, else move, and repeats count like the rest.
    """
    told = F.lit(override) if override else F.lit(None).cast("string")
    series = series_without(F.coalesce("series", F.lit("")), told)
    author = told if override else F.coalesce("author", F.lit(""))
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    suffix = F.regexp_extract("source_name", r"(?s)^.+(\.[^.]+)$", 1)
    stem = F.regexp_replace("source_name", r"(?s)^(.+)\.[^.]+$", "$1")
    rows = books.withColumns({"_dest": C.destination(author, series, e("title"), e("position")), "_name": F.concat(C.file_name(F.when(T.trim(e("title")) != "", T.trim(e("title"))).otherwise(F.regexp_replace(stem, r"^\d{4}\s*-\s*", "")), series, e("position"), ""), suffix)})
    if folders is not None:
        rows = reused_destination(rows, folders, "_dest")
    key = F.when(F.col("source_name").isNotNull(), F.concat_ws("/", P.name_of(F.col("source_dir")), stem))
    rows = first_in_batch(rows.withColumn("_key", key), "_key", "seq")
    have = index.select(F.col("dir").alias("_dest"), F.col("name").alias("_name")).distinct().withColumn("_exists", F.lit(True))
    rows = rows.join(have, ["_dest", "_name"], "left")
    if reorganize:
        placed = F.col("source_dir") == F.col("_dest")
        action = F.when(placed & (F.col("source_name") == F.col("_name")), "ok").when(placed, "rename").otherwise("move")
    else:
        action = F.when(F.col("repeated"), "repeated").when(F.col("_exists"), "exists").otherwise("copy")
    return rows.select("book", F.col("_dest").alias("dest"), F.col("_name").alias("name"), F.when(F.col("source_name").isNull(), "no_file").otherwise(action).alias("action"))


def retag_plan(books: DataFrame, index: DataFrame) -> DataFrame:
    """book, dest, name, tags (a map): books whose destination holds a finished file already: it gets new tags and the rest is skipped.

    books: book, author, title, series, position, narrator, year; index: dir, name. Books without a title have no destination. Of several
    files the lowest name counts.
    """
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = books.where(e("title") != "").withColumn("dest", C.destination(e("author"), e("series"), e("title"), e("position")))
    file = index.where(P.has_suffix(F.col("name"), "m4b")).groupBy(F.col("dir").alias("dest")).agg(F.min("name").alias("name"))
    pairs = {"artist": e("author"), "album_artist": e("author"), "album": C.album(e("title"), e("series"), e("position")), "title": e("title"), "genre": F.lit("Audiobook"), "media_type": F.lit("2")}
    some = {"composer": e("narrator"), "date": e("year"), "show": e("series"), "grouping": e("series")}
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    tags = F.map_from_entries(F.array_compact(F.array(*[entry(k, v) for k, v in pairs.items()], *[F.when(v != "", entry(k, v)) for k, v in some.items()])))
    return rows.join(file, "dest").select("book", "dest", "name", tags.alias("tags"))


def companion_files(books: DataFrame) -> DataFrame:
    """book, name, text: the text files that go beside a book: its description and its narrator, where they are filled."""
    each = F.array(F.struct(F.lit("desc.txt").alias("name"), F.col("description").alias("text")), F.struct(F.lit("reader.txt").alias("name"), F.col("narrator").alias("text")))
    return books.select("book", F.inline(each)).where(T.trim(F.coalesce("text", F.lit(""))) != "")
