r"""Text normalisers as column expressions.

Each chain is a list of (pattern, replacement) steps in their order. `\w` of Unicode is written [\p{L}\p{N}_], so that one pattern
means the same in Spark and in ANSI SQL engines with RE2. All functions keep null as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains as D

W = r"\p{L}\p{N}_"
TRIM = (r"^\s+|\s+$", "")
COLLAPSE = (r"\s+", " ")


def chain(col: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, col)


def trim(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return chain(col, [TRIM])


# The patterns of all chains in this module and their order decide results.
#: Title for duplicate search: before and after the author is taken off.
DEDUP_HEAD = [
    (r"^(book\s+)?\d+\s*-\s*", ""),
    (r"\[b0[a-z0-9]+\]", ""),
    (r"\[.*?\]", ""),
    (r"\(\s*(?:un)?abridged\s*\)", ""),
    (r"\(.*?\)", ""),
    (r",?\s*part\s+\d+\s*$", ""),
    (r"\s*-\s*book\s+\d+\s*$", ""),
    (r"\s*-\s*dragonlance[^-]*$", ""),
    (rf"\s*-?\s*,?\s*volume\s+[{W}]+\s*$", ""),
    (rf"\s*-\s*the\s+[{W}]+\s+saga.*$", ""),
    (rf"_book\s+[{W}]+\s*-.*$", ""),
    (r"\s*-\s*j\.?\s*r\.?\s*r\.?\s*tolkien.*$", ""),
    (r"\s*-\s*christopher\s+tolkien.*$", ""),
    (r"\s+-\s+[a-z]\.\s*[a-z]\.\s*[a-z]+\s*$", ""),
]
DEDUP_TAIL = [
    (rf"^[{W}\s]+\d+_", ""),
    ("_", " "),
    ("([a-z])-([a-z])", "$1 $2"),
    ("([a-z])-([a-z])", "$1 $2"),
    (",", ""),
    (r"^dragonlance\s*[-:]?\s*", ""),
    COLLAPSE,
    TRIM,
]


def quoted(col: Column) -> Column:
    """A column's text as a pattern, blanks standing for any number of them."""
    escaped = F.regexp_replace(col, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.regexp_replace(escaped, " ", r"\\s*")


def _dedup_plain(s: Column) -> Column:
    """Both chains; steps that need a mark or a word that the text lacks are left out, as they would change nothing.

    Only cuts at the ends are made where steps are left out by the words they need, so no such word arises on the way."""
    some = lambda *xs: reduce(lambda a, b: a | b, [s.contains(x) for x in xs])
    ends = chain(s, [DEDUP_HEAD[0], DEDUP_HEAD[-1], *DEDUP_TAIL])
    whole = some("[", "(", "part", "volume", "book", "dragonlance", "saga", "tolkien")
    return F.when(whole | s.isNull(), chain(s, DEDUP_HEAD + DEDUP_TAIL)).when(some("-", "_", ","), ends).otherwise(chain(s, DEDUP_TAIL[-2:]))


def dedup_title(col: Column, author: Column | None = None) -> Column:
    """Title for duplicate search; with an author also without its name before or after."""
    if author is None:  # by way of an array, so that the text is made once
        return F.transform(F.array(F.lower(col)), _dedup_plain)[0]
    s = chain(F.lower(col), DEDUP_HEAD)
    plain, norm = quoted(F.lower(author)), quoted(diff_author(author))
    # where there is no author the pattern can't match; the text itself stands once in each expression
    for p in (plain, norm):
        s = F.regexp_replace(s, F.when(F.coalesce(p, F.lit("")) == "", F.lit("(?!)")).otherwise(F.concat(F.lit("^"), p, F.lit(r"\s*-\s*"))), F.lit(""))
    for p in (plain, norm):
        s = F.regexp_replace(s, F.when(F.coalesce(p, F.lit("")) == "", F.lit("(?!)")).otherwise(F.concat(F.lit(r"\s*-\s*"), p, F.lit(".*$"))), F.lit(""))
    return chain(s, DEDUP_TAIL)


DIFF_AUTHOR_HEAD = [(r"^edited\s+by\s+", ""), (" & ", " and "), (r"\.", "")]


def diff_author(col: Column) -> Column:
    """Author for comparing libraries: initials joined, "&" as "and"."""
    s = chain(F.lower(trim(col)), DIFF_AUTHOR_HEAD)
    return chain(s, [(r"\b([a-z])\s+(?=[a-z]\b)", "$1"), COLLAPSE, TRIM])


INDEX_AUTHOR = [(r"([a-z])\.([a-z])", "$1. $2"), (r"([a-z])\.([a-z])", "$1. $2"), (r"\.", ""), COLLAPSE, TRIM]


def index_author(col: Column) -> Column:
    """Author for the folder index: initials apart."""
    return chain(F.lower(trim(col)), INDEX_AUTHOR)


CLEAN_AUTHOR = [(rf"(?i),?\s+[{W}]+\s*-\s*(editor|translator|narrator|foreword|introduction)\b.*$", ""), (r"(?i)\s*\((Author|Editor|Translator|Narrator)\)", ""), TRIM]


def clean_author(col: Column) -> Column:
    """Author without roles."""
    return chain(col, CLEAN_AUTHOR)


def _last_word(col: Column) -> Column:
    words = F.filter(F.split(col, r"\s+"), lambda w: w != "")
    return F.regexp_replace(F.lower(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))), r"[.,;:]+$", "")


def surname_first(col: Column) -> Column:
    """Surname of the first author, roles taken off."""
    return _last_word(F.split(clean_author(col), r",\s*|\s+and\s+")[0])


def surname_last(col: Column) -> Column:
    """Surname of the last author."""
    return _last_word(F.element_at(F.split(col, r",\s*|\s+and\s+"), -1))


COMPARE = [(r"\s*\(\d{4}\)", ""), (r"\s*\([^)]*\)", ""), (rf"[^{W}\s]", ""), COLLAPSE, TRIM, ("s$", "")]


def compare_folder(col: Column) -> Column:
    """Folder name for comparison: no years, editions, punctuation, one final s."""
    return chain(F.lower(col), COMPARE)


VERIFY_TITLE = [(rf"[^{W}\s]", ""), COLLAPSE, TRIM]


def verify_title(col: Column) -> Column:
    return chain(F.lower(col), VERIFY_TITLE)


STRIP_HASH = [(r"\s+-\s+[a-f0-9]{16}$", "")]
STRIP_LABEL = [(r"(?i)\s+-\s+(?:Audiobook|Audio|Unabridged|Abridged)$", "")]
COLLECTION_SUFFIX = [(r"\s*\[.*?\]", ""), (r"\s*\(.*?\)", ""), TRIM]
SERIES_NUMBERS = [(r"\[[0-9]+\]", ""), ("#[0-9]+-", ""), ("^[0-9]+\\s*[-–]?\\s*", ""), (r"\s[0-9]{1,3}\s", " "), COLLAPSE, TRIM]
HTML = [(r"<[^>]+>", ""), TRIM]
SANITIZE = [(r'[/\\:"*?<>|;]+', "_"), ("^[._]+", ""), ("[._]+$", ""), ("__+", "_")]
CHAPTER_TITLE = [(r'[/\\:"*?<>|;]+', " "), ("  +", " "), TRIM]
FOLDER_PART = [(r'[/\\:"*?<>|;]+', " "), (r"\s+", " "), (r"^[. ]+|[. ]+$", "")]


def strip_hash(col: Column) -> Column:
    return chain(col, STRIP_HASH)


def strip_label(col: Column) -> Column:
    return chain(col, STRIP_LABEL)


def title_fallback(col: Column) -> Column:
    t = chain(col, [(r"\[\d+\]", ""), ("^\\d+\\s*[-–]?\\s*", ""), COLLAPSE, TRIM])
    return F.when(t == "", col).otherwise(t)


def strip_series_numbers(col: Column) -> Column:
    return chain(col, SERIES_NUMBERS)


def strip_html(col: Column) -> Column:
    return chain(col, HTML)


def sanitize(col: Column, most: int = 255) -> Column:
    """A name safe as a file name, of at most `most` bytes; an extension is kept (whole, even one that is longer than that),
    characters are never cut."""
    s = chain(col, SANITIZE)
    ext = F.regexp_extract(s, r"(?s)^.+(\.[^.]+)$", 1)
    stem = F.substring(s, F.lit(1), F.length(s) - F.length(ext))
    # the bytes that there is room for, in hex, as far as they are whole characters
    room = F.greatest(F.lit(most) - F.octet_length(ext), F.lit(0))
    whole = F.regexp_extract(F.hex(F.substring(F.substring(stem, 1, most).cast("binary"), F.lit(1), room)), "^(?:[0-7].|[CD].{3}|E.{5}|F.{7})*+", 0)
    fit = F.unhex(whole).cast("string")
    return F.when(F.octet_length(s) <= most, s).otherwise(F.concat(fit, ext))


def sanitize_chapter(col: Column) -> Column:
    return chain(col, CHAPTER_TITLE)


def author_tag(col: Column) -> Column:
    """Author of an artist tag: placeholders, roles, further artists and very short names taken off; '' where none is left."""
    name = trim(col)
    starts = "^(?:" + "|".join(D.ROLE_WORDS) + ")"
    role = F.regexp_extract(name, r"(?s)^(.*?) - (.*)$", 2)
    name = F.when(name.contains(" - ") & F.lower(trim(role)).rlike(starts), trim(F.regexp_extract(name, r"(?s)^(.*?) - ", 1))).otherwise(name)
    parts = F.split(name, ", ")
    has = "|".join(D.ROLE_WORDS)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(parts[0].alias("t"), F.lit(False).alias("over")),
        lambda acc, p: F.when(acc["over"] | F.lower(p).rlike(has), F.struct(acc["t"].alias("t"), F.lit(True).alias("over"))).otherwise(F.struct(F.concat(acc["t"], F.lit(", "), p).alias("t"), F.lit(False).alias("over"))),
    )["t"]
    kept = F.when(kept.contains("; "), trim(F.split(kept, "; ")[0])).otherwise(kept)
    placeholder = F.lower(trim(col)).isin(*D.PLACEHOLDER_AUTHORS)
    return F.when(col.isNull() | placeholder | (F.length(kept) < 3), F.lit("")).otherwise(kept)


def extract_author(col: Column) -> Column:
    """Author of a folder name: brackets off, a series after " - " off."""
    cleaned = chain(col, [(r"\s*\(.*?\)", ""), TRIM, (r"\s*\[.*?\]", ""), TRIM])
    left = trim(F.split(cleaned, " - ", 2)[0])
    return F.when(cleaned.contains(" - ") & ~left.rlike(r"\d"), left).when(cleaned != "", cleaned).otherwise(col)


def looks_like_author(col: Column) -> Column:
    low = F.lower(col)
    words = F.size(F.filter(F.split(col, r"\s+"), lambda w: w != ""))
    bad = low.rlike("|".join(D.COLLECTION_WORDS)) | col.rlike("[0-9]") | (F.length(col) > 50) | (words > 5) | (words == 1) | low.rlike("^(the|a|an) ")
    return ~bad


def reply_field(col: Column, name: str) -> Column:
    """Value of the last `NAME: value` line of a reply; placeholders are null."""
    drop = "UNKNOWN" if name in ("AUTHOR", "TITLE") else "NONE|UNKNOWN|N/A"
    values = F.transform(F.regexp_extract_all(col, F.lit(rf"(?im)^\s*{name}:([^\n]*)$"), 1), lambda v: chain(v, [TRIM, (r'^"+|"+$', ""), ("^'+|'+$", "")]))
    good = F.filter(values, lambda v: (v != "") & ~v.rlike(f"(?i)^(?:{drop})$"))
    v = F.try_element_at(good, F.lit(-1))
    if name == "TITLE":
        v = chain(v, [(r"(?i)\s*\((?:The\s+)?Audio\s*Book\)", ""), (r"(?i)\s*\(Unabridged\)", ""), TRIM])
    if name == "POSITION":
        v = F.when(v.rlike(r"^\d+$"), F.regexp_replace(v, r"^0+(?=\d)", "")).otherwise(v)
    return v


def position_text(col: Column) -> Column:
    """A position without leading zeros."""
    p = trim(col)
    return F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(p)


def natural_key(col: Column) -> Column:
    """Sort key of a name: its digit runs as numbers of any length (by their number of digits, then the digits), the rest in lower case."""
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    parts = F.regexp_extract_all(F.lower(col), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p))


def hms(seconds: Column) -> Column:
    """Seconds as HH:MM:SS."""
    s = F.floor(seconds).cast("bigint")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600).cast("bigint")), two(F.floor((s % 3600) / 60).cast("bigint")), two(s % 60))


def hms_millis(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm."""
    return F.concat(hms(F.floor(ms / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def year_of(col: Column) -> Column:
    return F.substring(col, 1, 4)


def padded_date(col: Column) -> Column:
    """A date of a year or a year and month, filled up to a day."""
    return F.when(col.rlike(r"^\d{4}$"), F.concat(col, F.lit("-01-01"))).when(col.rlike(r"^\d{4}-\d{2}$"), F.concat(col, F.lit("-01"))).otherwise(col)


def exit_category(code: Column) -> Column:
    return F.when(code.isin(*D.PERMANENT_EXIT_CODES), F.lit("permanent")).otherwise(F.lit("transient"))


def hash16(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 16)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
