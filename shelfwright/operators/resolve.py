"""What a book is: its files, its catalog record, its id and its chapters, from several sources of different trust.

Sources are joined by key and one row is chosen by an order that the docstrings state; ties go to the lowest path, place or id. Missing
sources count as blank. Nothing is fetched: catalog records, validations and replies come in as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import domains as D
from ..functions import paths as P
from ..functions import text as T
from . import catalog as C
from . import library as L
from .state import within_tolerance

FIELDS = ("title", "series", "position")
#: Sizes of cover pictures, the best first (fixed values of the catalog's records).
COVERS = ("2400", "1000", "700", "500")


def audio_file(files: DataFrame) -> DataFrame:
    """book, path: the file that stands for a book: its largest finished file, else its first audio file. files: book, path, size."""
    p = F.col("path")
    order = F.struct(F.when(P.has_suffix(p, "m4b"), 0).otherwise(1).alias("k"), F.when(P.has_suffix(p, "m4b"), -F.coalesce("size", F.lit(0))).otherwise(0).alias("s"), P.order_key(p).alias("o"))
    return files.where(P.has_suffix(p, *D.AUDIO)).groupBy("book").agg(F.min_by("path", order).alias("path"))


def source_file(books: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """book, path: the output of tagging, else of conversion, if it exists, else the book's own file; books without any are left out.

    books: book, tagged, converted (paths or null); files: book, path, size; existing: path.
    """
    there = existing.select("path").distinct()
    out = books.select("book", F.posexplode(F.array("tagged", "converted")).alias("rank", "path")).where("path <> ''").join(there, "path", "left_semi")
    own = audio_file(files).join(books.select("book"), "book", "left_semi").select("book", F.lit(2).alias("rank"), "path")
    return out.select("book", "rank", "path").unionByName(own).groupBy("book").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def title_of_files(files: DataFrame) -> DataFrame:
    """book, title: the name of a book's first audio file, without hash and year; '' where it is a generic word or a number."""
    p = F.col("path")
    first = files.where(P.has_suffix(p, *D.AUDIO)).groupBy("book").agg(F.min_by("path", P.order_key(p)).alias("path"))
    name = T.chain(T.strip_hash(P.stem_of(F.col("path"))), [(r"^\d{4}\s*-\s*", ""), T.TRIM])
    return first.select("book", F.when(F.lower(name).isin(*D.GENERIC_NAMES) | name.rlike(r"^\d+$"), "").otherwise(name).alias("title"))


def first_results(candidates: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` candidates of each book by place: as many as a search of the catalog gives. candidates: book, place and more."""
    rank = F.row_number().over(Window.partitionBy("book").orderBy("place", "asin"))
    return candidates.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def best_candidate(books: DataFrame, candidates: DataFrame, least: float = D.CATALOG_SCORE) -> DataFrame:
    """book, candidate (a struct), score: the best catalog record of a book by likeness of title and place, if it scores `least`.

    books: book, title; candidates: book, place, asin, title, authors (array) and more. Of records with one id the first by place counts.
    """
    one = L.first_of_key(candidates.where("asin is not null"), ["book", "asin"], [F.col("place")])
    hint = books.select("book", F.col("title").alias("_hint"))
    scored = C.scored(one.join(hint, "book"), F.col("_hint"), F.lit(""), F.col("place"), ["book"]).drop("_hint")
    every = F.struct(*[c for c in scored.columns if c not in ("book", "score")])
    best = scored.groupBy("book").agg(F.max_by(F.struct(every.alias("candidate"), "score"), F.struct("score", -F.col("place"))).alias("b"))
    return best.where(F.col("b.score") >= least).select("book", "b.candidate", "b.score")


def resolved(books: DataFrame, tags: DataFrame, candidates: DataFrame, authors: DataFrame | None = None, aliases: DataFrame | None = None, replies: DataFrame | None = None) -> DataFrame:
    """book, author, title, series, position, asin, narrator, conflict: a book's metadata from its path, its tags and the catalog.

    books: book, stem, author, title, series, position (read from the path); tags: book, tag_author, tag_title; candidates: as for
    `best_candidate`, with series, position and narrator. The tag's title replaces one that is only the file's name. The author is the
    catalog's, else the tag's, else the path's; the catalog fills title, series and position only where the path has none, and only with
    an author of its own. A reply of a language model (replies: book, author, title, series, position; null or '' where it says nothing)
    comes before all: what it says counts, and what it leaves open is read from the path. The author is then brought to the library's spelling (authors: author; aliases: variant, canonical).
    """
    e = lambda c: F.coalesce(c, F.lit(""))
    rows = books.join(tags.select("book", "tag_author", "tag_title"), "book", "left")
    better = (F.length(e(F.col("tag_title"))) > 3) & (e(F.col("title")) == e(F.col("stem")))
    rows = rows.withColumn("title", F.when(better, F.col("tag_title")).otherwise(e(F.col("title"))))
    rows = rows.join(best_candidate(rows.select("book", "title"), candidates).drop("score"), "book", "left")
    who = e(F.array_join("candidate.authors", ", "))
    author = F.when(who != "", who).when(e(F.col("tag_author")) != "", F.col("tag_author")).otherwise(e(F.col("author")))
    filled = {f: F.when((who != "") & (e(F.col(f)) == ""), e(F.col(f"candidate.{f}"))).otherwise(e(F.col(f))) for f in FIELDS}
    if replies is not None:
        said = replies.select("book", *[F.nullif(T.trim(F.col(f)), F.lit("")).alias(f"_{f}") for f in ("author", *FIELDS)])
        rows = rows.join(said, "book", "left")
        some = F.coalesce(*[F.col(f"_{f}") for f in ("author", *FIELDS)]).isNotNull()
        author = F.when(some, F.coalesce("_author", e(F.col("author")))).otherwise(author)
        filled = {f: F.when(some, F.coalesce(F.col(f"_{f}"), e(F.col(f)))).otherwise(v) for f, v in filled.items()}
    conflict = C.conflicting(F.col("author"), F.col("tag_author"), F.nullif(who, F.lit("")))
    out = rows.select("book", author.alias("author"), *[v.alias(f) for f, v in filled.items()], e(F.col("candidate.asin")).alias("asin"), e(F.col("candidate.narrator")).alias("narrator"), conflict.alias("conflict"))
    if authors is None:
        return out
    own = L.match_authors(out.select(F.col("author").alias("desired")), authors, aliases)
    return out.join(own.withColumnRenamed("desired", "author"), "author", "left").select("book", F.coalesce("result", "author").alias("author"), *FIELDS, "asin", "narrator", "conflict")


def chosen_number(reply: Column, n: Column) -> Column:
    """Which of n candidates a reply names: its first digit from 0 to 5; null where there is none, it is 0 or too great."""
    pick = F.nullif(F.regexp_extract(reply, "[0-5]", 0), F.lit("")).cast("int")
    return F.when((pick > 0) & (pick <= n), pick)


def discovered_ids(items: DataFrame, known: DataFrame) -> DataFrame:
    """item, asin, source of the items whose catalog id is found: told by the user, by a marker file, by the folder's name, by a search.

    items: item, override, marker, folder (its name), searched; known: asin, state (valid, invalid or unreachable; others count as
    invalid). An id has to have the form of one and be valid. Where the service couldn't be reached, the user's id counts at its place and,
    if nothing else is valid, the marker's and the folder's after all.
    """
    told = F.upper(F.regexp_replace("override", r"\s", ""))
    sources = [("cli_override", told), ("manual", F.upper(T.trim(F.col("marker")))), ("folder_regex", P.asin_of_folder(F.col("folder"))), ("audible_search", F.col("searched"))]
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("source"), v.alias("asin")) for i, (n, v) in enumerate(sources)])
    rows = items.select("item", F.inline(each)).where(F.col("asin").rlike(P.ASIN)).join(known.select("asin", "state"), "asin", "left")
    lost = F.col("state") == "unreachable"
    rank = F.when((F.col("state") == "valid") | (lost & (F.col("rank") == 0)), F.col("rank")).when(lost & F.col("rank").isin(1, 2), F.col("rank") + 10)
    # the folder's id counts unvalidated when any source of the item met an unreachable service
    rows = rows.withColumn("use", rank)
    some = rows.groupBy("item").agg(F.bool_or(F.coalesce(lost & (F.col("rank") > 0), F.lit(False))).alias("lost"))
    rows = rows.join(some, "item").withColumn("use", F.when(F.col("use").isNull() & F.col("lost") & F.col("rank").isin(1, 2), F.col("rank") + 10).otherwise(F.col("use")))
    best = rows.where("use is not null").groupBy("item").agg(F.min(F.struct("use", "asin", "source")).alias("b"))
    return best.select("item", "b.asin", "b.source")


def chapter_import(books: DataFrame, records: DataFrame, percent: float = D.CHAPTER_TOLERANCE) -> DataFrame:
    """book, provider, action: whether a catalog's chapters replace those at the file boundaries.

    books: book, asin, duration_s; records: asin, rank (of the provider), provider, runtime_ms, n_chapters. The first provider with
    chapters counts. action: import, mismatch (lengths differ by more than `percent`), no_runtime or none.
    """
    best = records.where("n_chapters > 0").groupBy("asin").agg(F.min_by(F.struct("provider", "runtime_ms"), F.struct("rank", "provider", "runtime_ms")).alias("r"))
    rows = books.join(best, "asin", "left")
    near = within_tolerance(F.col("duration_s"), F.col("r.runtime_ms") / 1000, percent)
    action = F.when(F.col("r").isNull(), "none").when(F.col("r.runtime_ms").isNull(), "no_runtime").when(F.coalesce(near, F.lit(False)), "import").otherwise("mismatch")
    return rows.select("book", F.col("r.provider").alias("provider"), action.alias("action"))


# The fields of a catalog response, and of the normal form below.
PRODUCT = (
    "product struct<asin:string,title:string,subtitle:string,authors:array<struct<asin:string,name:string>>,narrators:array<struct<name:string>>,series:array<struct<title:string,sequence:string>>,"
    "category_ladders:array<struct<ladder:array<struct<name:string>>>>,publisher_summary:string,release_date:string,product_images:map<string,string>,copyright:string,publisher_name:string,isbn:string,language:string,"
    "is_adult_product:boolean,format_type:string,runtime_length_min:int,content_metadata:struct<chapter_info:struct<is_accurate:boolean,runtime_length_ms:bigint,brandIntroDurationMs:bigint,brandOutroDurationMs:bigint,"
    "chapters:array<struct<length_ms:bigint,start_offset_ms:bigint,start_offset_sec:bigint,title:string>>>>>"
)


def normalized_products(responses: DataFrame, key: str, json: str = "json", region: str = "com") -> DataFrame:
    """key, record (JSON): a catalog response's product in the normal nested form; responses without a product are left out."""
    p = lambda c: F.col(f"p.{c}")
    rows = responses.select(key, F.from_json(F.col(json), PRODUCT)["product"].alias("p")).where("p is not null")
    ladders = F.filter(F.transform(F.coalesce(p("category_ladders"), F.array()), lambda x: x["ladder"]), lambda x: x.isNotNull())
    names = F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform(ladders, lambda x: F.transform(x, lambda g: g["name"]))))), lambda n: F.struct(n.alias("name")))
    first = lambda a: F.try_element_at(a, F.lit(1))
    primary, series, info = first(F.filter(p("authors"), lambda a: F.coalesce(a["asin"], F.lit("")) != "")), first(p("series")), p("content_metadata.chapter_info")
    chapters = F.transform(info["chapters"], lambda c: F.struct(c["length_ms"].alias("lengthMs"), c["start_offset_ms"].alias("startOffsetMs"), c["start_offset_sec"].alias("startOffsetSec"), c["title"].alias("title")))
    record = F.struct(
        p("asin").alias("asin"), p("title").alias("title"), p("subtitle").alias("subtitle"), F.coalesce(p("authors"), F.array()).alias("authors"), F.coalesce(p("narrators"), F.array()).alias("narrators"),
        F.when(series.isNotNull(), F.struct(series["title"].alias("name"), series["sequence"].alias("position"))).alias("seriesPrimary"), names.alias("genres"),
        F.coalesce(F.array_join(F.transform(first(ladders), lambda g: g["name"]), " / "), F.lit("")).alias("genrePath"), p("publisher_summary").alias("description"), p("publisher_summary").alias("summary"), p("release_date").alias("releaseDate"),
        F.coalesce(*[p("product_images")[s] for s in COVERS]).alias("image"), p("copyright").alias("copyright"), p("publisher_name").alias("publisher"), p("isbn").alias("isbn"), p("language").alias("language"),
        F.coalesce(p("is_adult_product"), F.lit(False)).alias("isAdult"), p("format_type").alias("format"), p("runtime_length_min").alias("runtimeMin"), F.concat(F.lit(f"https://www.audible.{region}/pd/"), p("asin")).alias("audibleUrl"),
        F.when(primary.isNotNull(), F.struct(primary["asin"].alias("asin"), primary["name"].alias("name"))).alias("primaryAuthor"),
        F.when(info.isNotNull(), F.struct(
            F.coalesce(info["is_accurate"], F.lit(True)).alias("isAccurate"), info["runtime_length_ms"].alias("runtimeLengthMs"), info["brandIntroDurationMs"].alias("brandIntroDurationMs"),
            info["brandOutroDurationMs"].alias("brandOutroDurationMs"), F.coalesce(chapters, F.array()).alias("chapters"),
        )).alias("chapters"),
    )
    return rows.select(key, F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
