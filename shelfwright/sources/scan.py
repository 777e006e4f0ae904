"""Sources: file trees, probe output, logs, lists, markers, queue files, server listings and cached catalog records as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import paths as P
from ..functions import text as T

PROBE = "format struct<tags:map<string,string>,duration:string,bit_rate:string,format_name:string>, streams array<struct<codec_name:string,channels:int,sample_rate:string>>, chapters array<struct<id:bigint>>"


def file_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (relative), size, mtime of all files below a root; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    base = F.lit(root.rstrip("/") + "/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.select(F.substring(plain, F.length(base) + 1, F.lit(1 << 20)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def index_tables(files: DataFrame, path: str = "path") -> dict[str, DataFrame]:
    """Lookup frames of a tree: folders (parent, norm, actual), files (dir, name), authors (surname, author). Equal forms: the greatest name stays."""
    p = P.parts(F.col(path))
    steps = files.select(F.explode(F.sequence(F.lit(1), F.size(p) - 1)).alias("i"), p.alias("p")).where("i >= 1 and i < size(p)")
    folders = steps.select(F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), "/").alias("parent"), F.element_at("p", F.col("i")).alias("actual")).distinct()
    return {
        "folders": folders.withColumn("norm", T.compare_folder(F.col("actual"))).groupBy("parent", "norm").agg(F.max("actual").alias("actual")),
        "files": files.select(P.parent_of(F.col(path)).alias("dir"), P.name_of(F.col(path)).alias("name")).distinct(),
        "authors": folders.where("parent = ''").select(T.surname_first(F.col("actual")).alias("surname"), F.col("actual").alias("author")).where("surname <> ''"),
    }


def probe_fields(probes: DataFrame, json: str = "json") -> DataFrame:
    """The frame with tags (lower-case keys), duration_s, bitrate, codec, channels, sample_rate, container and n_chapters of probe
    output. Output that can't be read gives null tags and no chapters."""
    p = F.from_json(F.col(json), PROBE)
    first = F.try_element_at(F.col("_p.streams"), F.lit(1))
    keys = F.transform_keys(F.col("_p.format.tags"), lambda k, _: F.lower(k))
    return probes.withColumn("_p", p).withColumns({
        "tags": F.when(F.col("_p.format").isNotNull(), F.coalesce(keys, F.create_map().cast("map<string,string>"))), "duration_s": F.col("_p.format.duration").try_cast("double"), "bitrate": F.col("_p.format.bit_rate").try_cast("bigint"),
        "codec": first["codec_name"], "channels": first["channels"], "sample_rate": first["sample_rate"].try_cast("int"), "container": F.col("_p.format.format_name"),
        "n_chapters": F.when(F.size("_p.chapters") >= 0, F.size("_p.chapters")).otherwise(0),
    }).drop("_p")


def valid_audio(code: Column, codec: Column) -> Column:
    """Whether a probe ended well and found a codec."""
    return (code == 0) & F.coalesce(codec != "", F.lit(False))


def untagged(items: DataFrame, tags: str = "tags") -> DataFrame:
    """Items whose artist tag is blank."""
    return items.where(T.trim(F.coalesce(F.col(tags)["artist"], F.lit(""))) == "")


def path_list(spark: SparkSession, file: str) -> DataFrame:
    """path of every non-blank line."""
    return spark.read.text(file).select(T.trim(F.col("value")).alias("path")).where("path <> ''")


def log_destinations(spark: SparkSession, file: str) -> DataFrame:
    """path of every line "-> path" of a log."""
    return destinations(spark.read.text(file))


def destinations(lines: DataFrame) -> DataFrame:
    """path of every line "-> path". lines: value."""
    return lines.select(F.regexp_extract("value", r"^\s+->\s+(.+)$", 1).alias("path")).where("path <> ''")


def env_settings(lines: DataFrame) -> DataFrame:
    """key, value of lines KEY=value of a settings file; comments, other lines and values with "${" are skipped, quotes around values taken
    off. lines: value. Of a key that stands twice the greatest value counts, as rows have no order."""
    line = T.trim(F.col("value"))
    key = T.trim(F.regexp_extract(line, r"^(?:export\s+)?([^=]+)=", 1))
    value = F.regexp_replace(T.trim(F.regexp_extract(line, r"(?s)^[^=]+=(.*)$", 1)), "^[\"']+|[\"']+$", "")
    rows = lines.where(~line.startswith("#") & ~line.contains("${")).select(key.alias("key"), value.alias("value")).where("key <> ''")
    return rows.groupBy("key").agg(F.max("value").alias("value"))


def markers(files: DataFrame, name: str, path: str = "path", content: str = "content") -> DataFrame:
    """dir, value of marker files; an ASIN marker counts only in the form of one."""
    value = T.trim(F.col(content).cast("string"))
    rows = files.where(P.name_of(F.col(path)) == name).select(P.parent_of(F.col(path)).alias("dir"), value.alias("value"))
    return rows.withColumn("value", F.upper("value")).where(F.col("value").rlike(P.ASIN)) if name == ".asin" else rows


def queue_files(spark: SparkSession, folder: str) -> DataFrame:
    """Trigger files of a folder as a batch."""
    from ..streaming.queue import TRIGGER

    return spark.read.schema(TRIGGER).json(folder)


def server_items(listings: DataFrame, json: str = "json") -> DataFrame:
    """rating_key, title, parent_title, grandparent_title, stale of the items of a media server's listing."""
    p = F.from_json(F.col(json), "MediaContainer struct<Metadata:array<struct<ratingKey:string,title:string,parentTitle:string,grandparentTitle:string>>>")
    rows = listings.select(F.explode(p["MediaContainer"]["Metadata"]).alias("m"))
    none = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit("")) == ""
    return rows.select(F.col("m.ratingKey").alias("rating_key"), F.col("m.title").alias("title"), F.col("m.parentTitle").alias("parent_title"), F.col("m.grandparentTitle").alias("grandparent_title"), (none("parentTitle") & none("grandparentTitle")).alias("stale"))


def cached_records(primary: DataFrame, fallback: DataFrame, now: Column, days: int = D.CACHE_DAYS) -> DataFrame:
    """asin, provider, payload: the freshest readable record of an id, from the first provider that has one within the time limit.

    Both: asin, fetched_at, payload.
    """
    def fresh(df: DataFrame, rank: int, provider: str) -> DataFrame:
        good = df.where(F.try_parse_json("payload").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("fetched_at") < days * 86400))
        return good.groupBy("asin").agg(F.max_by("payload", F.struct("fetched_at", "payload")).alias("payload")).select("asin", F.lit(rank).alias("rank"), F.lit(provider).alias("provider"), "payload")

    both = fresh(primary, 0, "primary").unionByName(fresh(fallback, 1, "fallback"))
    return both.groupBy("asin").agg(F.min_by(F.struct("provider", "payload"), "rank").alias("r")).select("asin", "r.provider", "r.payload")


def is_jpeg(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == "FFD8FF"
