"""Operators over library listings: book entries, duplicates, differences, verification, structure.

Frames hold one row per file with a relative `path`; other columns pass through where it says so. Null paths are left out. Groups
that the reference workflow collects in memory are plain aggregates here, with map-side partial aggregation; ties go to the lowest
path in component order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import domains as D
from ..functions import paths as P
from ..functions import similarity as S
from ..functions import text as T
from ..util import cut
from . import fuzzy


def book_entries(files: DataFrame, *keep: str, path: str = "path") -> DataFrame:
    """path, author, norm_author, title, norm_title, is_multipart, part_group of every file at least one folder deep."""
    p = F.col(path)
    df = files.where((F.size(P.parts(p)) >= 2)).select(*keep, p.alias("path")).withColumns({"author": P.guess_author(F.col("path")), "_stem": P.stem_of(F.col("path")), "_dir": P.parent_of(F.col("path"))})
    part = F.col("_stem").rlike(P.PART_SUFFIX)
    other = F.col("_stem").rlike(P.CHAPTER_FILE) | F.col("_stem").rlike(P.NUMBERED_FILE)
    base = T.trim(F.regexp_replace("_stem", P.PART_SUFFIX, ""))
    group = F.when(part, F.concat(F.col("_dir"), F.lit("|"), F.lower(base))).when(other, F.col("_dir")).otherwise(F.lit(""))
    return df.withColumns({
        "norm_author": T.diff_author(F.col("author")), "title": F.col("_stem"), "norm_title": T.dedup_title(F.col("_stem"), F.col("author")), "is_multipart": part | other, "part_group": group,
    }).drop("_stem", "_dir")


def collapse_parts(entries: DataFrame, *keys: str) -> DataFrame:
    """One entry per group of parts: the first by path; chapter files take their folder's title. Single files pass through."""
    cols = [c for c in entries.columns if c not in keys]
    single = entries.where("part_group = ''").withColumn("from_group", F.lit(False))
    first = entries.where("part_group <> ''").groupBy(*keys, "part_group").agg(F.min_by(F.struct(*cols), P.order_key(F.col("path"))).alias("e")).select(*keys, "e.*").withColumn("from_group", F.lit(True))
    chapter = F.col("title").rlike(P.CHAPTER_FILE) | F.col("title").rlike(P.NUMBERED_FILE)
    folder = P.title_of_folder(P.ancestor(F.col("path"), 1))
    first = first.withColumn("_c", chapter).withColumn("title", F.when(F.col("_c"), folder).otherwise(F.col("title")))
    first = first.withColumn("norm_title", F.when(F.col("_c"), T.dedup_title(F.col("title"), F.col("author"))).otherwise(F.col("norm_title"))).drop("_c")
    return single.unionByName(first)


def first_of_key(df: DataFrame, key: list[str], order: list[Column], blank: Column | None = None) -> DataFrame:
    """The first row of each key in an order; rows where `blank` holds are all kept. An aggregate, not a window: no group is sorted."""
    cols = [c for c in df.columns if c not in key]
    kept = df if blank is None else df.where(~blank)
    one = kept.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*key, "_r.*").select(*df.columns)
    return one if blank is None else one.unionByName(df.where(blank))


def library_books(entries: DataFrame) -> DataFrame:
    """Books of the libraries (column library): parts collapsed. Written once, as later steps read them several times."""
    return cut(collapse_parts(book_entries(entries, "library"), "library"))


def library_diff(entries: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """status (matched or missing), author, title, norm_title, path of the source's books against the target, by equal normal title.

    entries: library, path. Books are collapsed and the source's repeats of a title dropped first (those with a blank title are kept, and
    are missing). The join is on the title key.
    """
    return _exact(library_books(entries), source, target)


def _exact(books: DataFrame, source: str, target: str) -> DataFrame:
    own = first_of_key(books.where(F.col("library") == source), ["norm_title"], [F.col("from_group"), P.order_key(F.col("path"))], F.col("norm_title") == "")
    titles = books.where((F.col("library") == target) & (F.col("norm_title") != "")).select("norm_title").distinct()
    return own.join(titles.withColumn("hit", F.lit(True)), "norm_title", "left").select(F.when(F.col("hit"), "matched").otherwise("missing").alias("status"), "author", "title", "norm_title", "path")


def library_diff_cascade(entries: DataFrame, asked: DataFrame | None = None, source: str = "source", target: str = "target") -> DataFrame:
    """As `library_diff`, with `how`: exact, fuzzy or null. What has no equal title in the target is searched for by likeness.

    The fuzzy search compares its titles with all titles of the target, which has no key; `asked` (path) tells which books it is done for,
    all by default. Books without an equal title that it isn't done for have the status unsearched.
    """
    books = library_books(entries)
    exact = cut(_exact(books, source, target))
    wanted = exact.select("path") if asked is None else asked.select("path").distinct()
    left = exact.where("status = 'missing'").join(wanted, "path", "left_semi")
    titles = books.where((F.col("library") == target) & (F.col("norm_title") != "")).select(F.col("norm_title").alias("text"))
    near = fuzzy.links(left.select(F.col("norm_title").alias("text")), titles, "token_set", same=True).where("n_links > 0").select(F.col("text").alias("norm_title"), F.lit(True).alias("near"))
    rows = exact.join(near, "norm_title", "left").join(wanted.withColumn("asked", F.lit(True)), "path", "left") if asked is not None else exact.join(near, "norm_title", "left").withColumn("asked", F.lit(True))
    how = F.when(F.col("status") == "matched", "exact").when(F.col("near") & F.col("asked"), "fuzzy")
    return rows.select(F.when(how.isNotNull(), "matched").when(F.col("asked"), "missing").otherwise("unsearched").alias("status"), how.alias("how"), "author", "title", "norm_title", "path")


def duplicate_titles(files: DataFrame, path: str = "path") -> DataFrame:
    """norm_title, n, first_path of titles that several files have."""
    rows = files.select(F.col(path).alias("path"), T.dedup_title(P.stem_of(F.col(path))).alias("norm_title"))
    # a filter on titles before they are grouped would make every title twice; told is an aggregate, so it stays above
    out = rows.groupBy("norm_title").agg(F.count("*").alias("n"), F.element_at(F.array(F.array_join(F.min(P.order_key(F.col("path"))), "/")), 1).alias("first_path"), F.max(F.col("norm_title") != "").alias("told"))
    return out.where("n > 1 and told").drop("told")


def crowded_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """parent, n, severity of folders with several audio books: info where all are parts, else warning."""
    rows = files.where(P.has_suffix(F.col(path), "m4b")).select(P.parent_of(F.col(path)).alias("parent"), P.is_part(P.stem_of(F.col(path))).alias("part"))
    out = rows.groupBy("parent").agg(F.count("*").alias("n"), F.bool_and("part").alias("all_parts")).where("n > 1")
    return out.select("parent", "n", F.when(F.col("all_parts"), "info").otherwise("warning").alias("severity"))


def author_variations(authors: DataFrame, author: str = "author") -> DataFrame:
    """surname, variants (sorted), n of surnames that several author names share."""
    rows = authors.select(F.col(author).alias("a")).where("a is not null and a <> ''").distinct().withColumn("surname", T.surname_last(F.col("a"))).where("surname <> ''")
    return rows.groupBy("surname").agg(F.array_sort(F.collect_set("a")).alias("variants"), F.count("*").alias("n")).where("n > 1")


def titles_by_author(books: DataFrame, author: str = "author", title: str = "title") -> DataFrame:
    """author, norm_title, n of titles that an author has more than once."""
    rows = books.select(F.col(author).alias("author"), T.verify_title(F.col(title)).alias("norm_title"))
    return rows.groupBy("author", "norm_title").agg(F.count("*").alias("n")).where("n > 1")


def book_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """folder, files: folders that hold files directly, below a folder of an author (files right in an author's folder are no book)."""
    rows = files.where(F.size(P.parts(F.col(path))) >= 3).select(P.parent_of(F.col(path)).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("files"))


def verify_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """what, n: authors, book folders and files of a library, and surnames that several of its authors share."""
    p = F.col(path)
    authors = files.where(F.size(P.parts(p)) >= 2).select(F.element_at(P.parts(p), 1).alias("author"))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(authors.distinct(), "authors").unionByName(count(book_folders(files, path), "folders")).unionByName(count(files, "files")).unionByName(count(author_variations(authors), "author variations"))


def common_root(files: DataFrame, path: str = "path") -> DataFrame:
    """root: the longest path prefix that all paths share; that of the least and the greatest path in component order."""
    ends = files.agg(F.min(P.order_key(F.col(path))).alias("a"), F.max(P.order_key(F.col(path))).alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return ends.select(F.array_join(F.slice("a", 1, F.coalesce(F.array_max(same), F.lit(0))), "/").alias("root"))


def topmost_folders(files: DataFrame, suffixes: tuple[str, ...] = D.AUDIO, path: str = "path", chaptered: bool = False) -> DataFrame:
    """folder: folders that hold matching files directly and have no such folder above. chaptered: folders with several finished books and
    nothing that matches count as well (a book in chapters)."""
    p = F.col(path)
    rows = files.where(P.has_suffix(p, *suffixes, "m4b")).groupBy(P.parent_of(p).alias("folder"))
    own = rows.agg(F.bool_or(P.has_suffix(p, *suffixes)).alias("some"), F.count_if(P.has_suffix(p, "m4b")).alias("done"))
    own = own.where(F.col("some") | (F.lit(chaptered) & (F.col("done") >= 2))).select("folder")
    parts = P.parts(F.col("folder"))
    above = own.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up")).where("folder <> ''")
    under = above.join(own.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return own.join(under, "folder", "left_anti")


def structure_findings(files: DataFrame, path: str = "path") -> DataFrame:
    """path, rule, severity: depth, bracketed names, unexpected files and override marks (rules S1 to S6), in one pass."""
    p, name = F.col(path), P.name_of(F.col(path))
    m4b, n = P.has_suffix(p, "m4b"), F.size(P.parts(p))
    rule = lambda r, sev: F.struct(F.lit(r).alias("rule"), F.lit(sev).alias("severity"))
    deep = m4b & (n > 2)
    odd = ~P.has_suffix(p, *D.AUDIO, *D.LEFTOVER_SOURCES, "jpg", "jpeg", "png", "webp") & ~name.isin(".author-override", ".asin", "desc.txt", "reader.txt") & ~P.hidden(p)
    rules = F.array_compact(F.array(
        F.when(m4b & (n == 1), rule("S1", "critical")), F.when(m4b & (n == 2), rule("S2", "warning")), F.when(deep & (n > 4), rule("S3", "warning")), F.when(deep & name.contains("[") & name.contains("]"), rule("S4", "warning")),
        F.when(odd, rule("S5", "info")), F.when(name == ".author-override", rule("S6", "info")),
    ))
    return files.where(p.isNotNull()).select(p.alias("path"), F.inline(rules))


def leftover_sources(files: DataFrame, path: str = "path") -> DataFrame:
    """path, severity of source audio: warning beside a finished book in its folder, critical without one."""
    p = F.col(path)
    done = files.where(P.has_suffix(p, "m4b")).select(P.parent_of(p).alias("parent")).distinct().withColumn("done", F.lit(True))
    src = files.where(P.has_suffix(p, *D.LEFTOVER_SOURCES) & ~P.hidden(p)).select(p.alias("path"), P.parent_of(p).alias("parent"))
    return src.join(done, "parent", "left").select("path", F.when(F.col("done"), "warning").otherwise("critical").alias("severity"))


def tag_findings(items: DataFrame, tags: str = "tags", key: str = "path") -> DataFrame:
    """key, rule, field, severity: findings of the tag rules T1 to T8. tags: map of lower-case names; null where probing failed."""
    t = lambda k: T.trim(F.coalesce(F.col(tags)[k], F.lit("")))
    low = lambda k: F.lower(t(k))
    rule = lambda r, f, sev: F.struct(F.lit(r).alias("rule"), F.lit(f).alias("field"), F.lit(sev).alias("severity"))
    commas = F.length(t("album_artist")) - F.length(F.replace(t("album_artist"), F.lit(","), F.lit("")))
    rules = [F.when(t(k) == "", rule("T2", k, "critical")) for k in D.MANDATORY_TAGS] + [F.when(low(k).isin(*D.SUSPICIOUS), rule("T3", k, "warning")) for k in D.SUSPICIOUS_CHECKED]
    rules += [
        F.when((t("title") != "") & (t("album_artist") != "") & (low("title") == low("album_artist")), rule("T4", "title", "warning")), F.when(low("genre") == "audiobook", rule("T5", "genre", "warning")),
        F.when(commas > 1, rule("T6", "album_artist", "warning")), F.when(t("media_type") == "", rule("T7", "media_type", "warning")),
    ]
    rules += [F.when(t(k) == "", rule("T8", k, "info")) for k in D.RECOMMENDED_TAGS]
    found = F.when(F.col(tags).isNull(), F.array(rule("T1", "", "critical"))).otherwise(F.array_compact(F.array(*rules)))
    return items.select(key, F.inline(found))


def severity_summary(findings: DataFrame, fixable: Column | None = None) -> DataFrame:
    """total, critical, warning, info (and fixable) counts of findings."""
    s = F.col("severity")
    extra = [F.count_if(fixable).alias("fixable")] if fixable is not None else []
    return findings.agg(F.count("*").alias("total"), *(F.count_if(s == x).alias(x) for x in ("critical", "warning", "info")), *extra)


def near_folders(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """parent, desired, actual of every two folder names below one parent that compare equal or near. wanted: parent, desired; folders: parent, actual.

    Near names have equal sets of words but for stop words, or, with many words, all but one (or, with very many, some) in common; so they
    share a key of words, and no other names are compared.
    """
    w = wanted.select("parent", "desired").distinct().withColumn("dn", T.compare_folder(F.col("desired")))
    f = folders.select("parent", "actual").distinct().withColumn("an", T.compare_folder(F.col("actual")))

    def words_keys(name: str) -> Column:
        all_ = F.array_sort(S.tokens(F.col(name)))
        told = F.concat(F.lit("n:"), F.array_join(F.array_except(all_, F.array(*map(F.lit, D.STOP_WORDS))), " "))
        n = F.size(all_)
        but_one = F.transform(all_, lambda _, i: F.concat(F.lit("s:"), F.array_join(F.filter(all_, lambda __, j: j != i), " ")))
        whole = F.array(F.concat(F.lit("s:"), F.array_join(all_, " ")))
        each = F.transform(all_, lambda x: F.concat(F.lit("t:"), x))
        none = F.array().cast("array<string>")
        return F.explode(F.array_distinct(F.concat(F.array(told), F.when(n >= 6, F.concat(whole, but_one)).otherwise(none), F.when(n >= 11, each).otherwise(none)))).alias("word")

    share = w.select("parent", "desired", "dn", words_keys("dn")).join(f.select("parent", "actual", "an", words_keys("an")), ["parent", "word"]).select("parent", "desired", "dn", "actual", "an").distinct()
    return share.where(S.near_match(F.col("dn"), F.col("an"))).select("parent", "desired", "actual")


def folder_reuse(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """parent, desired, result: the folder to use below a parent: itself, else one that compares equal, else a near one, else itself.

    wanted: parent, desired; folders: parent, actual. Compared within a parent only; ties go to the lowest name.
    """
    w = wanted.select("parent", "desired").distinct().withColumn("dn", T.compare_folder(F.col("desired")))
    f = folders.select("parent", "actual").distinct().withColumn("an", T.compare_folder(F.col("actual")))
    exact = w.join(f.select("parent", F.col("actual").alias("desired")), ["parent", "desired"], "left_semi").select("parent", "desired", F.col("desired").alias("actual"), F.lit(0).alias("rank"))
    equal = w.join(f.withColumnRenamed("an", "dn"), ["parent", "dn"]).select("parent", "desired", "actual", F.lit(1).alias("rank"))
    near = near_folders(wanted, folders).withColumn("rank", F.lit(2))
    best = exact.unionByName(equal).unionByName(near).groupBy("parent", "desired").agg(F.min_by("actual", F.struct("rank", "actual")).alias("actual"))
    return w.join(best, ["parent", "desired"], "left").select("parent", "desired", F.coalesce("actual", "desired").alias("result"))


def match_authors(wanted: DataFrame, existing: DataFrame, aliases: DataFrame) -> DataFrame:
    """desired, result: the library's author folder for a typed author: by alias (raw, then without roles), by surname with equal
    initials, equal folder form, or as the only one of the surname; else unchanged.

    wanted: desired; existing: author; aliases: variant, canonical (one row per variant). Ties go to the lowest folder name.
    """
    w = wanted.select("desired").where("desired is not null and desired <> ''").distinct().withColumn("cleaned", T.clean_author(F.col("desired")))
    w = w.withColumn("surname", T.surname_first(F.col("desired")))
    a = aliases.select("variant", "canonical").where("canonical is not null and canonical <> ''")
    w = w.join(a.select(F.col("variant").alias("desired"), F.col("canonical").alias("by_raw")), "desired", "left").join(a.select(F.col("variant").alias("cleaned"), F.col("canonical").alias("by_clean")), "cleaned", "left")
    e = existing.select("author").where("author is not null and author <> ''").distinct().withColumn("surname", T.surname_first(F.col("author")))
    pair = w.join(e, "surname")
    rank = F.when(F.col("author") == F.col("desired"), 0).when(F.col("author") == F.col("cleaned"), 1).when(T.index_author(F.col("author")) == T.index_author(F.col("cleaned")), 2).when(T.compare_folder(F.col("author")) == T.compare_folder(F.col("cleaned")), 3).otherwise(4)
    best = pair.where("surname <> ''").groupBy("desired").agg(F.min(F.struct(rank.alias("rank"), F.col("author").alias("author"))).alias("m"), F.count("*").alias("n"))
    w = w.join(best, "desired", "left")
    by_name = F.when((F.col("m.rank") < 4) | (F.col("n") == 1), F.col("m.author"))
    return w.select("desired", F.coalesce("by_raw", F.when(F.col("cleaned") != F.col("desired"), F.col("by_clean")), by_name, "desired").alias("result"))


def latest_alias(aliases: DataFrame) -> DataFrame:
    """variant, canonical: the last alias saved for each variant; equal pairs and null canonicals aren't aliases."""
    rows = aliases.where("variant is not null and canonical is not null and variant <> canonical")
    return rows.groupBy("variant").agg(F.max_by("canonical", F.struct("created_at", "canonical")).alias("canonical"))


def position_bonus(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The frame with bonus: 10 less 2 for every row before it in its group, 0 at least."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("bonus", F.greatest(F.lit(10) - 2 * (F.row_number().over(w) - 1), F.lit(0)))
