"""Paths as rows: parts, order, and what a path says about a book. All column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains as D
from . import text as T

# The patterns of file and folder names here and in the cascade below decide results.
PART_SUFFIX = r"(?i)[,\s]+part\s+\d+\s*$"
CHAPTER_FILE = r"(?i)^(?:ch)?\d{1,3}[a-d]?\s*[-.]\s*"
NUMBERED_FILE = r"(?i)^(?:\d+-\d+\s+|HP[.\s]*\d+\s*[-.]\s*)"
ASIN = r"^[A-Z0-9]{10}$"


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def name_of(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def parent_of(path: Column) -> Column:
    p = parts(path)
    return F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/")


def suffix_of(path: Column) -> Column:
    """Extension in lower case, without the dot."""
    return F.lower(F.regexp_extract(name_of(path), r"(?s)^.+\.([^.]+)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?s)^(.+)\.[^.]+$", "$1")


def ancestor(path: Column, up: int) -> Column:
    """Name of the folder `up` levels above the file; '' where there is none."""
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1 - up)), F.lit(""))


def order_key(path: Column) -> Column:
    """Key that sorts paths by their components, as path objects do."""
    return parts(path)


def hidden(path: Column) -> Column:
    """Whether any component starts with _ or a dot."""
    return F.exists(parts(path), lambda p: p.rlike("^[_.]"))


def has_suffix(path: Column, *suffixes: str) -> Column:
    return suffix_of(path).isin(*suffixes)


def is_part(stem: Column) -> Column:
    return stem.rlike(PART_SUFFIX) | stem.rlike(CHAPTER_FILE) | stem.rlike(NUMBERED_FILE)


def guess_author(path: Column) -> Column:
    """First folder that isn't a container; the first folder where all are."""
    folders = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    own = F.filter(folders, lambda p: ~F.lower(p).isin(*D.CONTAINERS) & ~F.lower(p).contains("audiobook"))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at(folders, F.lit(1)), F.lit(""))


def title_of_folder(name: Column) -> Column:
    return T.chain(name, [(r"(?i)^book\s+[\d.]+\s*-?\s*", ""), T.TRIM])


def is_franchise(name: Column) -> Column:
    return T.diff_author(name).isin(*D.FRANCHISES)


def asin_of_folder(name: Column) -> Column:
    """ASIN in brackets, in parentheses or at the start of a folder name; null where none stands."""
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"\[(B0[A-Z0-9]{8})\]", r"\((B0[A-Z0-9]{8})\)", r"^(B0[A-Z0-9]{8})(?:\b|_)")]
    return F.coalesce(*found)


def search_hints(path: Column) -> Column:
    """struct(title_hint, author_hint, query) for a catalog search."""
    base, parent = T.strip_hash(stem_of(path)), T.strip_hash(ancestor(path, 1))
    above = T.strip_hash(ancestor(path, 2))
    holder = F.when((parent != "") & (parent == base) & (above != ""), above).otherwise(parent)
    bare = [(r"[\[\](){}]", ""), T.COLLAPSE, T.TRIM]
    title = T.chain(T.strip_series_numbers(base), bare)
    author = F.when((holder != "") & (holder != base), T.chain(T.strip_series_numbers(holder), bare)).otherwise(F.lit(""))
    return F.struct(title.alias("title_hint"), author.alias("author_hint"), T.trim(F.concat_ws(" ", F.nullif(author, F.lit("")), title)).alias("query"))


def _first(*pairs: tuple[Column, Column], otherwise) -> Column:
    out = None
    for when, then in pairs:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def parse_columns(df, path: str):
    """The frame with author, title, series and position read from the column `path`: a cascade of folder patterns.

    Built in steps of plain columns, which Catalyst folds into one projection. Null and empty paths give empty fields.
    """
    e = F.lit("")
    c = F.col
    low = lambda x: F.lower(c(x))
    p = F.coalesce(F.col(path), e)
    df = df.withColumns({
        "_base": T.strip_hash(stem_of(p)), "_par": T.strip_hash(ancestor(p, 1)), "_gp": T.strip_hash(ancestor(p, 2)), "_ggp": T.strip_hash(ancestor(p, 3)),
    })
    generic = low("_base").isin(*D.GENERIC_NAMES)
    df = df.withColumn("_base", _first(
        (generic & (c("_par") != "") & ~low("_par").isin(*D.GENERIC_NAMES), T.strip_label(c("_par"))), (generic & (c("_gp") != ""), T.strip_label(c("_gp"))), otherwise=c("_base")))
    target = F.when(c("_par") != "", c("_par")).otherwise(c("_base"))
    df = df.withColumn("_t", T.chain(target, [(r"-#-(\d+)", r"-#$1"), (r"-#(\d+) ", r"-#$1-")]))
    # marked volumes: author-series-#N-title, the last mark counts
    marked = c("_t").rlike(r"-#\d+-")
    head = F.regexp_extract("_t", r"(?s)^(.*)-#\d+-.*$", 1)
    inner = head.rlike(r"-.+?-#\d+")
    first_author, first_series = F.regexp_extract(head, r"(?s)^([^-]*)-", 1), F.split(F.regexp_extract(head, r"(?s)^[^-]*-(.*)$", 1), r"-#\d+-")[0]
    last_author, last_series = F.regexp_extract(head, r"(?s)^(.*)-([^-]*)$", 1), F.regexp_extract(head, r"(?s)^(.*)-([^-]*)$", 2)
    df = df.withColumns({
        "_a_author": F.when(inner, first_author).when(head.contains("-"), last_author).otherwise(head), "_a_series": F.when(inner, first_series).when(head.contains("-"), last_series).otherwise(e),
        "_a_title": F.regexp_extract("_t", r"(?s)^.*-#\d+-(.*)$", 1), "_a_pos": F.regexp_extract("_t", r"(?s)^.*-#(\d+)-.*$", 1), "_marked": marked,
    })
    b2, b, g = r"^(.+?)\s+(\d{1,3})\s+-\s+(.+)$", r"^(.+?)\s+(\d{1,3})\s+(.+)$", r"^(.+?)\s+\[(\d+)\]\s+(.+)$"
    is_b2 = c("_t").rlike(b2)
    is_b = ~is_b2 & c("_t").rlike(b) & (F.length(T.trim(F.regexp_extract("_t", b, 3))) >= 3)
    is_g = ~is_b2 & ~is_b & c("_t").rlike(g)
    pick = lambda k: _first((is_b2, T.trim(F.regexp_extract("_t", b2, k))), (is_b, T.trim(F.regexp_extract("_t", b, k))), (is_g, T.trim(F.regexp_extract("_t", g, k))), otherwise=e)
    df = df.withColumns({"_series": pick(1), "_pos": pick(2), "_title": pick(3)})
    # "author - series" above
    ga, gs = T.trim(F.split("_gp", " - ", 2)[0]), T.trim(F.coalesce(F.try_element_at(F.split("_gp", " - ", 2), F.lit(2)), e))
    split_above = c("_gp").contains(" - ") & ~F.lower(gs).isin(*D.LABELS) & ~ga.rlike("[0-9]")
    df = df.withColumns({"_author": F.when(split_above, ga).otherwise(e), "_series": F.when(split_above & (c("_series") == ""), gs).otherwise(c("_series"))})
    # a folder above as author
    same = (c("_par") == c("_base")) & (c("_gp") != "")
    own = T.extract_author(c("_gp"))
    from_gp = F.when(same, T.looks_like_author(own)).otherwise((c("_gp") != "") & T.looks_like_author(c("_gp")))
    from_ggp = ~same & (c("_gp") != "") & ~T.looks_like_author(c("_gp")) & (c("_ggp") != "") & T.looks_like_author(c("_ggp"))
    none = c("_author") == ""
    df = df.withColumns({
        "_author": _first((none & from_gp, own), (none & from_ggp, T.extract_author(c("_ggp"))), otherwise=c("_author")),
        "_series": F.when(none & from_ggp & (c("_series") == ""), T.chain(c("_gp"), T.COLLECTION_SUFFIX)).otherwise(c("_series")),
    })
    left, right = T.trim(F.split("_par", "-", 2)[0]), T.trim(F.coalesce(F.try_element_at(F.split("_par", "-", 2), F.lit(2)), e))
    dash = (c("_author") == "") & (c("_series") == "") & (c("_title") == "") & c("_par").contains("-") & ~c("_par").rlike(r"-#\d+") & T.looks_like_author(left) & (F.length(right) >= 3)
    df = df.withColumns({"_author": F.when(dash, left).otherwise(c("_author")), "_title": F.when(dash, right).otherwise(c("_title"))})
    df = df.withColumn("_author", F.when((c("_author") != "") & (low("_author") == low("_series")), e).otherwise(c("_author")))
    # title of the file name, without author and series before it
    def without(title: Column, head: Column) -> Column:
        rest = T.trim(F.regexp_replace(F.substring(title, F.length(head) + 1, F.lit(100000)), "^[ -]+", ""))
        return F.when((head != "") & F.startswith(F.lower(title), F.lower(head)), rest).otherwise(title)

    named = T.chain(without(without(c("_base"), c("_author")), c("_series")), [(r"\[\d+\]", ""), (r"^\s*\[(.+)\]\s*$", "$1"), ("^\\d+\\s*[-–]?\\s*", ""), T.COLLAPSE, T.TRIM])
    df = df.withColumn("_title", F.when(c("_title") == "", named).otherwise(c("_title")))
    junk = [
        (r"\s*\{[^}]+\}", ""), (r"\s*\([^)]*\b\d+k\b[^)]*\)", ""), (r"\s*\([A-Z][a-z]+\)\s+\d+k\s+[\d.]+", ""), (r"(?i)\s*\((?:The\s+)?Audio\s*Book\)", ""), (r"(?i)\s*\(Unabridged\)", ""),
        (rf"([{T.W}])-\s", "$1 "), ("-$", ""), T.TRIM,
    ]
    df = df.withColumn("_title", T.chain(c("_title"), junk))
    paren = r"(?s)^(.*?)\s*-?\s*\(([^)]+?)(?:\s*[-,]\s*(?:Book|Day|#)\s*([\d.]+))?\).*$"
    inside = F.regexp_replace(T.trim(F.regexp_extract("_title", paren, 2)), "[ ,-]+$", "")
    before = F.regexp_replace(T.trim(F.regexp_extract("_title", paren, 1)), "[ -]+$", "")
    has = (c("_series") == "") & c("_title").rlike(paren)
    year, good = has & inside.rlike(r"^\d{4}$"), has & ~inside.rlike(r"^\d{4}$") & (F.length(inside) >= 3) & ~F.lower(inside).isin(*D.LABELS)
    df = df.withColumns({
        "_pos": _first((year & (c("_pos") == ""), inside), (good & (c("_pos") == ""), F.regexp_extract("_title", paren, 3)), otherwise=c("_pos")),
        "_series": F.when(good, inside).otherwise(c("_series")), "_title": F.when(year | good, before).otherwise(c("_title")),
    })
    df = df.withColumn("_title", F.when(c("_title") == "", T.title_fallback(c("_base"))).otherwise(c("_title")))
    m = c("_marked")
    out = {
        "author": T.trim(F.when(m, c("_a_author")).otherwise(c("_author"))),
        "title": F.regexp_replace(T.trim(F.when(m, c("_a_title")).otherwise(c("_title"))), "^[- ]+", ""),
        "series": F.regexp_replace(T.trim(F.when(m, c("_a_series")).otherwise(c("_series"))), "[- ]+$", ""),
        "position": T.position_text(F.when(m, c("_a_pos")).otherwise(c("_pos"))),
    }
    return df.withColumns(out).drop(*[x for x in df.columns if x in {"_base", "_par", "_gp", "_ggp", "_t", "_a_author", "_a_series", "_a_title", "_a_pos", "_marked", "_series", "_pos", "_title", "_author"}])
