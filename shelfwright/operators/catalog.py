"""Catalog records: products as flat rows, scoring of candidates, merge of sources, tags and destinations.

Everything is a projection over nested columns; arrays are read with higher-order functions and never exploded for a scalar result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import domains as D
from ..functions import similarity as S
from ..functions import text as T

PRODUCT = (
    "asin string, title string, subtitle string, authors array<struct<name:string>>, narrators array<struct<name:string>>, series array<struct<title:string,sequence:string>>, release_date string, "
    "product_images map<string,string>, publisher_summary string, publisher_name string, copyright string, language string, category_ladders array<struct<ladder:array<struct<name:string>>>>"
)


def best_series(series: Column) -> Column:
    """The series with the lowest number, the first on ties; numbers that can't be read count as 999."""
    ranked = F.transform(series, lambda s, i: F.struct(F.coalesce(s["sequence"].try_cast("double"), F.lit(999.0)).alias("k"), i.alias("i"), s.alias("s")))
    return F.array_min(F.transform(ranked, lambda r: F.struct(r["k"].alias("k"), r["i"].alias("i"))))["i"]


def genre(ladders: Column) -> Column:
    """Names of the first ladder joined by slashes."""
    first = F.try_element_at(ladders, F.lit(1))["ladder"]
    return F.coalesce(F.array_join(F.filter(F.transform(first, lambda g: F.coalesce(g["name"], F.lit(""))), lambda n: n != ""), "/"), F.lit(""))


def flat_products(responses: DataFrame, json: str = "json") -> DataFrame:
    """One flat row per product of search responses ({"products": [...]}), in their order (pos), with '' for what is missing."""
    parsed = F.from_json(F.col(json), f"products array<struct<{PRODUCT.replace(' array', ':array').replace(' string', ':string').replace(' map', ':map')}>>")
    rows = responses.select("*", F.posexplode(parsed["products"]).alias("pos", "p"))
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = lambda c: F.coalesce(F.filter(F.transform(F.col(c), lambda a: F.coalesce(a["name"], F.lit(""))), lambda n: n != ""), F.array().cast("array<string>"))
    at = best_series(F.col("p.series"))
    best = F.try_element_at(F.col("p.series"), (at + 1).cast("int"))
    return rows.select(
        "pos", s("p.asin").alias("asin"), s("p.title").alias("title"), s("p.subtitle").alias("subtitle"), names("p.authors").alias("authors"), F.array_join(names("p.authors"), ", ").alias("author_str"),
        F.array_join(names("p.narrators"), ", ").alias("narrator_str"), F.coalesce(best["title"], F.lit("")).alias("series"), F.coalesce(best["sequence"], F.lit("")).alias("position"),
        T.year_of(s("p.release_date")).alias("year"), T.strip_html(s("p.publisher_summary")).alias("description"), s("p.publisher_name").alias("publisher"), s("p.copyright").alias("copyright"),
        s("p.language").alias("language"), genre(F.col("p.category_ladders")).alias("genre"), F.coalesce(F.col("p.product_images")["500"], F.lit("")).alias("cover_url"),
    )


def scored(candidates: DataFrame, hint: Column, author: Column, order: Column, group: list[str]) -> DataFrame:
    """The candidates with score: 60 % title, 30 % best author, up to 10 for an early place. candidates: title, authors (array)."""
    title = S.token_sort_ratio(F.lower(hint), F.lower(F.col("title"))) * 0.6
    each = candidates.withColumn("_a", F.array_join("authors", "\u0001"))
    # one vectorised pass over all authors of a candidate
    @F.pandas_udf("double")
    def most(h: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([max((S.partial_of(x.lower(), y.lower()) for y in z.split("\u0001") if y), default=0.0) if isinstance(x, str) and x and isinstance(z, str) else 0.0 for x, z in zip(h, a)])

    place = F.greatest(F.lit(10) - 2 * (F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1), F.lit(0))
    return each.withColumn("score", title + most(author, F.col("_a")) * 0.3 + place).drop("_a")


def merged(path: Column, tag: Column, catalog: Column, field: str) -> Column:
    """Best source of a field: catalog author first, other catalog fields only where the path has none; then tag, then path."""
    full = lambda c: F.nullif(T.trim(c[field]), F.lit(""))
    if field == "author":
        return F.coalesce(full(catalog), full(tag), full(path), F.lit(""))
    return F.coalesce(full(path), full(catalog), F.lit(""))


def conflicting(*authors: Column) -> Column:
    """Whether sources name other than exactly one author, placeholders left out."""
    names = F.transform(F.array(*authors), lambda a: F.lower(T.trim(F.coalesce(a, F.lit("")))))
    return F.size(F.array_distinct(F.filter(names, lambda a: ~a.isin(*D.CONFLICT_PLACEHOLDERS)))) != 1


def album(title: Column, series: Column, position: Column) -> Column:
    return F.when((series != "") & (position != ""), F.concat(series, F.lit(", Book "), position)).when(series != "", series).otherwise(title)


def sort_album(title: Column, series: Column, position: Column) -> Column:
    return F.when((series != "") & (position != ""), F.concat(series, F.lit(" "), position, F.lit(" - "), title)).when(series != "", F.concat(series, F.lit(" - "), title)).otherwise(title)


def tag_map(**c: Column) -> Column:
    """Map of the tags to write; c: author, title, series, position, narrator, year, asin, description, copyright, publisher, genre."""
    c = {k: F.coalesce(v, F.lit("")) for k, v in c.items()}
    series, pos = c["series"], c["position"]
    pairs = {
        "artist": F.when(c["narrator"] != "", F.concat(c["author"], F.lit(", "), c["narrator"])).otherwise(c["author"]), "album_artist": c["author"], "album": album(c["title"], series, pos), "title": c["title"],
        "genre": F.when(c["genre"] != "", c["genre"]).otherwise(F.lit("Audiobook")), "media_type": F.lit("2"), "sort_album": sort_album(c["title"], series, pos), "pgap": F.lit("1"),
    }
    optional = {
        "composer": c["narrator"], "date": c["year"], "ASIN": c["asin"], "comment": c["description"], "description": c["description"], "copyright": c["copyright"], "publisher": c["publisher"], "show": series,
        "grouping": F.when(pos != "", F.concat(series, F.lit(", Book #"), pos)).otherwise(series), "SHOWMOVEMENT": F.lit("1"), "MOVEMENTNAME": series, "MOVEMENT": pos,
    }
    when = {"grouping": series != "", "SHOWMOVEMENT": series != "", "MOVEMENT": (series != "") & (pos != "")}
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]
    entries += [F.when(when.get(k, v != "") & (F.lit(True) if k not in ("grouping",) else series != ""), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in optional.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def destination(author: Column, series: Column, title: Column, position: Column) -> Column:
    """Path of a book in the library: author/series/Book N - title and its shorter forms; a year without series is an edition."""
    clean = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(T.sanitize(c))
    a, s0, pos = clean(author), clean(series), F.coalesce(position, F.lit(""))
    t = F.when(F.coalesce(title, F.lit("")) == "", F.lit("Unknown")).otherwise(T.sanitize(title))
    s = F.when(F.lower(s0) == F.lower(t), F.lit("")).otherwise(s0)
    year = pos.rlike(r"^\d{4}$")
    folder = F.when((s != "") & (pos != "") & ~year, F.concat(F.lit("Book "), pos, F.lit(" - "), t)).otherwise(t)
    top = F.when(a != "", a).otherwise(F.lit("_unsorted"))
    return F.concat_ws("/", top, F.nullif(s, F.lit("")), folder, F.when(year & (s == ""), pos))


def file_name(title: Column, series: Column, position: Column, suffix: str = ".m4b") -> Column:
    """File name of a book: its title without the series before a delimiter and without a volume mark, which is put in front."""
    stem = T.sanitize(title)
    q = F.regexp_replace(T.sanitize(series), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    pattern = F.concat(F.lit("(?i)^"), q, F.lit(r"\s*(?:[:_,\-]+\s*(?:Book\s+[\d.]+\s*-\s*)?|Book\s+[\d.]+\s*-\s*)"))
    cut = T.trim(F.regexp_replace(stem, pattern, F.lit("")))
    stem = F.when((series != "") & (F.lower(title) != F.lower(series)) & (cut != ""), cut).otherwise(stem)
    stem = F.regexp_replace(stem, r"^Book\s+[\d.]+\s*-\s*", "")
    return F.concat(F.when((series != "") & (position != ""), F.concat(F.lit("Book "), position, F.lit(" - "), stem)).otherwise(stem), F.lit(suffix))
