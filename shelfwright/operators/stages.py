"""The stages of items as tables: status changes, updates, which stages run, which are stale, and checks before and after a run.

Every operator returns new rows. Where several changes meet one key the last by time counts (on ties the greatest), whatever their order
in the table. Keys that are null meet nothing. Extra columns of the inputs are left out unless a docstring says that they pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import paths as P

#: Stages that the simple level leaves out; files in a work folder without which a completed stage is stale.
NOT_SIMPLE = ("organize", "archive")
ARTIFACTS = {"validate": "audio_files.txt", "concat": "files.txt"}


def set_stage(stages: DataFrame, changes: DataFrame) -> DataFrame:
    """stages (book_hash, stage, status, completed_at) after changes (book_hash, stage, status, ts): completed_at is the time of a change
    to completed, and null after any other. Changes of unknown stages are left out."""
    last = changes.where("book_hash is not null and stage is not null").groupBy("book_hash", "stage").agg(F.max(F.struct("ts", "status")).alias("c"))
    after = F.when(F.col("c").isNull(), F.col("completed_at")).when(F.col("c.status") == "completed", F.col("c.ts"))
    return stages.join(last, ["book_hash", "stage"], "left").select("book_hash", "stage", F.coalesce("c.status", "status").alias("status"), after.alias("completed_at"))


def nested_update(base: DataFrame, changes: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(base with the nested values put in, changes without a row to change).

    changes: key, metadata (map of field to value), one row for each key. Only fields that base has are put in, also null values; a row
    that gets one has `updated_at` = now. Changes of keys that base lacks come back for the caller to report as errors.
    """
    fields = [f for f in base.columns if f not in (key, "updated_at")]
    rows = base.join(changes.select(key, F.col("metadata").alias("_m")), key, "left")
    has = lambda f: F.coalesce(F.map_contains_key("_m", F.lit(f)), F.lit(False))
    some = F.lit(False)
    for f in fields:
        some = some | has(f)
    new = {f: F.when(has(f), F.col("_m")[f].cast(base.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    if "updated_at" in base.columns:
        new["updated_at"] = F.when(some, now).otherwise(F.col("updated_at"))
    return rows.select(key, *[new[f].alias(f) for f in base.columns if f != key]).select(*base.columns), changes.join(base.select(key), key, "left_anti")


def listed(books: DataFrame, status: str | None = None, mode: str | None = None) -> DataFrame:
    """book_hash, source_path, mode, status of the books of a status and a mode, as far as they are given ('' counts as not given)."""
    for name, value in (("status", status), ("mode", mode)):
        if value:
            books = books.where(F.col(name) == value)
    return books.select("book_hash", "source_path", "mode", "status")


def effective_mode(mode: Column, has_m4b: Column, has_convertible: Column) -> Column:
    """Folders to organize that hold audio to convert, but no finished book, are converted."""
    return F.when((mode == "organize") & ~has_m4b & has_convertible, F.lit("convert")).otherwise(mode)


def stages_of(mode: Column, level: Column) -> Column:
    """The stages of a mode in order; the simple level has no stages that move files. Unknown modes have none."""
    every = F.array().cast("array<string>")
    for m, own in D.MODE_STAGES.items():
        every = F.when(mode == m, F.array(*map(F.lit, own))).otherwise(every)
    return F.when(level == "simple", F.array_except(every, F.array(*map(F.lit, NOT_SIMPLE)))).otherwise(every)


def run_plan(books: DataFrame, stages: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """book_hash, ord, stage, action: what a run does with each stage of a book: skip what is completed (unless forced), run the rest.

    books: book_hash, mode, level; stages: book_hash, stage, status (one row each); files: book_hash, path.
    """
    audio = files.groupBy("book_hash").agg(F.bool_or(P.has_suffix(F.col("path"), "m4b")).alias("m4b"), F.bool_or(P.has_suffix(F.col("path"), *D.CONVERTIBLE)).alias("other"))
    rows = books.select("book_hash", "mode", "level").join(audio, "book_hash", "left")
    mode = effective_mode(F.col("mode"), F.coalesce("m4b", F.lit(False)), F.coalesce("other", F.lit(False)))
    rows = rows.select("book_hash", F.posexplode(stages_of(mode, F.col("level"))).alias("ord", "stage"))
    if force:
        return rows.select("book_hash", "ord", "stage", F.lit("run").alias("action"))
    both = rows.join(stages.select("book_hash", "stage", "status"), ["book_hash", "stage"], "left")
    done = F.col("status").eqNullSafe("completed")
    return both.select("book_hash", "ord", "stage", F.when(done, "skip").otherwise("run").alias("action"))


def stale(stages: DataFrame, artifacts: DataFrame, existing: DataFrame) -> DataFrame:
    """book_hash, stage, stale of the completed stages: whether what a stage made is gone.

    stages: book_hash, stage, status, output_file (of the book's conversion); artifacts: book_hash, name (of files in the work folder);
    existing: path. A conversion without output is stale, tagging of no output isn't.
    """
    done = stages.where("status = 'completed'").select("book_hash", "stage", "output_file")
    names = F.create_map(*[F.lit(x) for kv in ARTIFACTS.items() for x in kv])
    have = artifacts.select("book_hash", F.col("name").alias("_name")).distinct().withColumn("_made", F.lit(True))
    there = existing.select(F.col("path").alias("output_file")).distinct().withColumn("_there", F.lit(True))
    rows = done.withColumn("_name", names[F.col("stage")]).join(have, ["book_hash", "_name"], "left").join(there, "output_file", "left")
    named = F.coalesce("output_file", F.lit("")) != ""
    gone = F.when(F.col("stage").isin(*ARTIFACTS), F.col("_made").isNull()).when(F.col("stage") == "convert", F.col("_there").isNull()).when(F.col("stage") == "metadata", named & F.col("_there").isNull())
    return rows.select("book_hash", "stage", F.coalesce(gone, F.lit(False)).alias("stale"))


def headroom(files: DataFrame, free: Column, times: int = 3) -> DataFrame:
    """item, needed, ok: whether the free room holds `times` the size of an item's files. files: item, size."""
    out = files.groupBy("item").agg((F.sum(F.coalesce("size", F.lit(0))) * times).alias("needed"))
    return out.select("item", "needed", (F.col("needed") <= free).alias("ok"))


def output_failure(size: Column, codec: Column, container: Column, chapters: Column, files: Column) -> Column:
    """Why the output of a conversion is refused: missing, empty, codec, container or chapters; null where it is good.

    size is null where there is no output. Chapters are counted only where several files were joined.
    """
    return (
        F.when(size.isNull(), "missing").when(size == 0, "empty").when(~codec.eqNullSafe("aac"), "codec")
        .when(~F.coalesce(container.rlike("mov|mp4"), F.lit(False)), "container").when((files > 1) & ~chapters.eqNullSafe(files), "chapters")
    )


def batch_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    """completed, failed, total of the outcomes (column status), by the given columns."""
    s = F.col("status")
    return outcomes.groupBy(*by).agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count("*").alias("total"))
