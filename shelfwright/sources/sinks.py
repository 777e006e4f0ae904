"""Sinks: reports, plans and triggers written by Spark writers. Plans describe effects; nothing here moves or deletes a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITY = ("critical", "warning", "info")


def severity_rank() -> Column:
    return F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings by check, then critical, warning, info, then the rest."""
    return findings.orderBy("check", severity_rank(), "path")


def text_report(findings: DataFrame) -> DataFrame:
    """value: one line of plain text per finding."""
    return ordered_findings(findings).select(F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "path", F.lit(": "), "message").alias("value"))


def diff_report(missing: DataFrame) -> DataFrame:
    """value: one Markdown line per missing book, by author and title. missing: author, title, path."""
    rows = missing.orderBy(F.lower("author"), F.lower("title"), "path")
    return rows.select(F.concat(F.lit("- "), F.coalesce("author", F.lit("")), F.lit(" - "), F.coalesce("title", F.lit("")), F.lit(" (`"), "path", F.lit("`)")).alias("value"))


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with `rank` from 1 in a global order: sorted by range partitions, then numbered with the sizes of the partitions before.

    Equal rows in the order get different ranks in no set order. No task sees more than a partition; what is broadcast is a row for each.
    """
    rows = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "_part").withColumn("rank", place).drop("_m", "_part", "_before")


def markdown(findings: DataFrame) -> DataFrame:
    """value: one Markdown line per finding, for `write.text`."""
    return ordered_findings(findings).select(F.concat(F.lit("- **"), "severity", F.lit("** `"), "path", F.lit("`: "), "message").alias("value"))


def json_report(findings: DataFrame, root: str) -> DataFrame:
    """value: the summary of a report as one JSON object; the findings themselves are written by `findings.write.json`."""
    s = F.col("severity")
    out = findings.agg(F.count("*").alias("total_issues"), *(F.count_if(s == x).alias(x) for x in SEVERITY))
    return out.select(F.to_json(F.struct(F.lit(root).alias("library_root"), F.struct("total_issues", *SEVERITY).alias("summary"))).alias("value"))


def fix_plan(findings: DataFrame, existing: DataFrame, dry_run: bool = True) -> DataFrame:
    """path, action of fixable findings: what a repair does, or would do; files that are gone are skipped. existing: path."""
    rows = findings.where("fixable").select("path", "fix_action").distinct().join(existing.select("path", F.lit(True).alias("there")), "path", "left")
    label = F.concat(F.lit("would " if dry_run else ""), F.col("fix_action"))
    return rows.select("path", F.when(F.col("there"), label).otherwise("missing").alias("action"))


def quarantine_plan(failed: DataFrame, existing: DataFrame) -> DataFrame:
    """source, dest of failed items: names that are taken get a counter. failed: source, name; existing: name."""
    taken = existing.groupBy("name").agg(F.count("*").alias("taken"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("source")) - 1
    rows = failed.join(taken, "name", "left").withColumn("n", n + F.coalesce("taken", F.lit(0)))
    return rows.select("source", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string"))).alias("dest"))


def archive_plan(originals: DataFrame, archived: DataFrame) -> DataFrame:
    """path, action: delete originals whose copy has the same size, copy the others. Both: path, size."""
    both = originals.join(archived.select("path", F.col("size").alias("there")), "path", "left")
    return both.select("path", F.when(F.col("there") == F.col("size"), "delete").otherwise("copy").alias("action"))


def concat_list(files: DataFrame) -> DataFrame:
    """book, text: the list of a book's files for joining, quotes escaped. files: book, pos, path."""
    line = F.concat(F.lit("file '"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"])
    return files.groupBy("book").agg(F.array_join(listed, "\n").alias("text"))


def write_triggers(triggers: DataFrame, folder: str) -> None:
    """Queue files of triggers, one JSON object a line."""
    triggers.write.mode("append").json(folder)
