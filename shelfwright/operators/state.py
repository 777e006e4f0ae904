"""Processing state of items as tables: creation, updates, stage log, retries, queues, chapters, integrity.

Nothing is changed in place: every operator returns the new rows. Side effects of the reference workflow (moves, deletes, touches)
are rows of a plan. Keys are joined or aggregated; a hot key is never gathered into a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import domains as D
from ..functions import text as T


def stage_rows(books: DataFrame) -> DataFrame:
    """book_hash, stage, ord, status: the eight stages of every book, those before its mode's already completed. books: book_hash, mode."""
    done = F.when(F.col("mode") == "convert", F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, D.STAGES[:3])))
    stages = F.posexplode(F.array(*map(F.lit, D.STAGES)))
    rows = books.select("book_hash", "mode", stages.alias("ord", "stage"))
    return rows.select("book_hash", "stage", "ord", F.when(F.array_contains(done, F.col("stage")), "completed").otherwise("pending").alias("status"))


def next_stage(stages: DataFrame, books: DataFrame) -> DataFrame:
    """book_hash, next: the first stage of a book's mode that isn't completed, null when all are. stages: book_hash, stage, status."""
    orders = [F.struct(F.lit(m).alias("mode"), F.lit(s).alias("stage"), F.lit(i).alias("ord")) for m, own in D.MODE_STAGES.items() for i, s in enumerate(own)]
    wanted = books.select("book_hash", "mode", F.inline(F.array(*orders)).alias("m", "stage", "ord")).where("m = mode").select("book_hash", "stage", "ord")
    both = wanted.join(stages.select("book_hash", "stage", "status"), ["book_hash", "stage"], "left")
    return both.groupBy("book_hash").agg(F.min(F.when(~F.col("status").eqNullSafe("completed"), F.struct("ord", "stage"))).alias("n")).select("book_hash", F.col("n.stage").alias("next"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns (all other columns break ties)."""
    rest = [c for c in rows.columns if c not in key]
    by = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*key).agg(F.max(F.struct(*by)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upserted(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of base with those of the same key replaced by the changes, and the new ones added."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def updated(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Base with the non-null `fields` of the changes put in; other columns of the changes are left out."""
    c = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return base.join(c, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def without(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def retry_state(failures: DataFrame, most: int = D.MAX_RETRIES) -> DataFrame:
    """item, failures, last_error, state: failed after a permanent error or too many failures, else retry.

    failures: item, ts, code, message.
    """
    permanent = T.exit_category(F.col("code")) == "permanent"
    out = failures.groupBy("item").agg(F.count("*").alias("failures"), F.max_by("message", F.struct("ts", "message")).alias("last_error"), F.bool_or(permanent).alias("_p"))
    return out.select("item", "failures", "last_error", F.when(F.col("_p") | (F.col("failures") >= most), "failed").otherwise("retry").alias("state"))


def stable_folders(files: DataFrame, now: Column, quiet: int = D.STABLE_SECONDS) -> DataFrame:
    """parent, newest: folders whose newest file is at least `quiet` seconds old. files: parent, mtime; now: a time, the same for all rows."""
    old = lambda t: F.unix_timestamp(t.cast("timestamp"))
    out = files.groupBy("parent").agg(F.max("mtime").alias("newest"), F.max(now).alias("_now")).where(F.col("newest").isNotNull())
    return out.where(old(F.col("_now")) - old(F.col("newest")) >= quiet).select("parent", "newest")


def queue_paths(triggers: DataFrame) -> DataFrame:
    """trigger_id, pos, path of the non-blank paths packed in book_paths."""
    paths = F.filter(F.transform(F.split("book_paths", r"\|"), lambda p: T.trim(p)), lambda p: p != "")
    return triggers.select("trigger_id", F.posexplode(paths).alias("pos", "path"))


def chapters(files: DataFrame) -> DataFrame:
    """book, pos, start_ms, end_ms: chapters of books of several files; each file's milliseconds are truncated, then summed.

    files: book, pos, duration_s. The running sum is per book; a book's files are bounded by nature.
    """
    w = Window.partitionBy("book")
    ms = F.floor(F.col("duration_s") * 1000).cast("bigint")
    run = F.sum("ms").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = files.withColumn("ms", ms).withColumns({"end_ms": run, "n": F.count("*").over(w)})
    return rows.where("n > 1").select("book", "pos", (F.col("end_ms") - F.col("ms")).alias("start_ms"), "end_ms")


def chapter_text(rows: DataFrame) -> DataFrame:
    """book, text: chapter metadata of a book as text. rows: book, pos, title, start_ms, end_ms."""
    one = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), F.col("title"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))), lambda x: x["t"])
    return rows.groupBy("book").agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(sorted_, "\n")).alias("text"))


def within_tolerance(actual: Column, expected: Column, percent: float = D.CHAPTER_TOLERANCE) -> Column:
    """Whether two durations differ by at most a share; an unknown or zero expectation counts as wholly different."""
    off = F.when(F.coalesce(expected, F.lit(0)) == 0, F.lit(100.0)).otherwise(F.abs(actual - expected) / expected * 100)
    return off <= percent


def integrity(size: Column, parses: Column, duration: Column, codec: Column, container: Column, bitrate: Column) -> Column:
    """Number of the first failed check of an encoded file, 0 if none: empty, unreadable, no length, codec, container, size."""
    want = F.floor(bitrate * F.floor(duration) / 8)
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, 1).when(~F.coalesce(parses, F.lit(False)), 2).when(F.coalesce(duration, F.lit(0.0)) <= 0, 3).when(~codec.eqNullSafe("aac"), 4)
        .when(~F.coalesce(container.rlike("mov|mp4"), F.lit(False)), 5).when(bitrate.isNotNull() & ((size < F.floor(want * 90 / 100)) | (size > F.floor(want * 110 / 100))), 6).otherwise(0)
    )


def target_bitrate(bps: Column, most: int = D.MAX_BITRATE) -> Column:
    return F.when(bps.isNull(), F.lit(most)).otherwise(F.least(F.floor(bps / 1000), F.lit(most))).cast("int")


def move_plan(files: DataFrame) -> DataFrame:
    """source, dest, action: skip where a file of the same size stands at the destination, else move. files: source, dest, size, dest_size."""
    return files.select("source", "dest", F.when(F.col("source") == F.col("dest"), "in_place").when(F.col("dest_size") == F.col("size"), "skip").otherwise("move").alias("action"))


def nested_books(books: DataFrame, stages: DataFrame) -> DataFrame:
    """book_hash, metadata (map of filled fields), stages (map of stage to status): books and their stages as nested records."""
    fields = [c for c in books.columns if c != "book_hash"]
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    flat = books.select("book_hash", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))).alias("metadata"))
    one = stages.groupBy("book_hash", "stage").agg(F.max("status").alias("status"))  # a stage that is logged twice stands once
    own = one.groupBy("book_hash").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "status")))).alias("stages"))
    return flat.join(own, "book_hash", "left")
