"""Queries of the library, catalog and state operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import domains as D
from ..functions import paths as P
from ..functions import similarity as S
from ..functions import text as T
from ..operators import catalog as C
from ..operators import fuzzy as Z
from ..operators import library as L
from ..operators import nested as N
from ..operators import state as St
from ..sources import scan, sinks
from ..util import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_chain(expr: str, steps: list[tuple[str, str]]) -> str:
    """The same chain of replacements in SQL."""
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(re.sub(r'[$]([0-9])', r'\\\1', to))}, 'g')"
    return expr


def names(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


# SQL of path and name expressions
PARTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
NAME = f"coalesce({PARTS}[-1], '')"
PARENT = f"coalesce(array_to_string({PARTS}[1:-2], '/'), '')"
EXT = f"lower(regexp_extract({NAME}, '(?s)^.+\\.([^.]+)$', 1))"
STEM = f"regexp_replace({NAME}, '(?s)^(.+)\\.[^.]+$', '\\1')"
LAST_WORD = "regexp_replace(lower(coalesce(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')[-1], '')), '[.,;:]+$', '')"
GUESS = f"coalesce(list_filter({PARTS}[1:-2], lambda x: lower(x) not in {names(D.CONTAINERS)} and not contains(lower(x), 'audiobook'))[1], {PARTS}[1:-2][1], '')"
NORM = sql_chain(sql_chain("lower({0})", T.DEDUP_HEAD), T.DEDUP_TAIL)


def dedup(expr: str) -> str:
    return NORM.replace("{0}", expr)


def last_word(expr: str) -> str:
    return LAST_WORD.replace("{0}", expr)


# paths

@query(f"select entry_id, {PARENT} as parent, {NAME} as name, {STEM} as stem, {EXT} as ext, len({PARTS}) as depth from library_entries")
def path_parts(s, d):
    p = c("path")
    return table(s, d, "library_entries").select("entry_id", P.parent_of(p).alias("parent"), P.name_of(p).alias("name"), P.stem_of(p).alias("stem"), P.suffix_of(p).alias("ext"), F.size(P.parts(p)).cast("bigint").alias("depth"))


@query(f"select distinct path, array_to_string({PARTS}[1:i-1], '/') as parent, {PARTS}[i] as child from library_entries, range(1, 12) t(i) where i <= len({PARTS})")
def path_components(s, d):
    rows = table(s, d, "library_entries").select("path", P.parts(c("path")).alias("p")).distinct()
    return rows.select("path", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).select("path", F.array_join(F.slice("p", F.lit(1), c("i") - 1), "/").alias("parent"), F.element_at("p", c("i")).alias("child")).distinct()


@query(f"select entry_id, {GUESS} as author from library_entries")
def guess_author(s, d):
    return table(s, d, "library_entries").select("entry_id", P.guess_author(c("path")).alias("author"))


@query(f"select entry_id, row_number() over (order by {PARTS}, entry_id) as rank from library_entries")
def path_order(s, d):
    rows = table(s, d, "library_entries").select("entry_id", P.order_key(c("path")).alias("k"))
    return sinks.numbered(rows, "k", "entry_id").select("entry_id", "rank")


@query("""select book_hash, source_path as path, regexp_matches(source_path, '/[_.]') or regexp_matches(source_path, '^[_.]') as hidden from books group by all""")
def hidden_paths(s, d):
    return table(s, d, "books").select("book_hash", c("source_path").alias("path"), P.hidden(c("source_path")).alias("hidden")).distinct()


@query(f"""with f as (select distinct {PARENT} as folder from library_entries where {EXT} in {names(D.AUDIO)})
select folder from f where not exists (select 1 from f g where g.folder <> f.folder and (g.folder = '' or starts_with(f.folder, g.folder || '/')))""")
def topmost_folders(s, d):
    return L.topmost_folders(table(s, d, "library_entries"))


@query(f"""with m as (select min({PARTS}) as a, max({PARTS}) as b from (select source_path as path from books))
select coalesce(array_to_string(a[1:coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: a[1:i] = b[1:i])), 0)], '/'), '') as root from m""")
def common_path_prefix(s, d):
    return L.common_root(table(s, d, "books"), "source_path")


_HASH = lambda x: sql_chain(x, T.STRIP_HASH)
_BARE = lambda x: f"regexp_replace(regexp_replace(regexp_replace({sql_chain(x, T.SERIES_NUMBERS)}, '[\\[\\](){{}}]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""with p as (select entry_id, {_HASH(STEM)} as base, {_HASH(f"coalesce({PARTS}[-2], '')")} as par, {_HASH(f"coalesce({PARTS}[-3], '')")} as gp from library_entries),
h as (select *, case when par <> '' and par = base and gp <> '' then gp else par end as holder from p), t as (select entry_id, {_BARE('base')} as title_hint, case when holder <> '' and holder <> base then {_BARE('holder')} else '' end as author_hint from h)
select *, trim(concat_ws(' ', nullif(author_hint, ''), title_hint)) as query from t""")
def search_hints(s, d):
    return table(s, d, "library_entries").select("entry_id", P.search_hints(c("path")).alias("h")).select("entry_id", "h.*")


# text

@query(f"select entry_id, {dedup('title')} as norm, {sql_chain('lower(title)', T.VERIFY_TITLE)} as verify_norm, {sql_chain('lower(title)', T.COMPARE)} as folder_norm from library_entries")
def normalize_title(s, d):
    t = c("title")
    return table(s, d, "library_entries").select("entry_id", T.dedup_title(t).alias("norm"), T.verify_title(t).alias("verify_norm"), T.compare_folder(t).alias("folder_norm"))


AUTHOR_TOKENS = sql_chain(sql_chain("lower(" + sql_chain("author", [T.TRIM]) + ")", T.DIFF_AUTHOR_HEAD), [T.COLLAPSE, T.TRIM])


@query(f"""with a as (select distinct author, string_split({AUTHOR_TOKENS}, ' ') as t from library_entries)
select author, trim(array_to_string(list_transform(t, lambda x, i: x || case when regexp_matches(x, '^[a-z]$') and regexp_matches(coalesce(t[i + 1], ''), '^[a-z]($|[^\\p{{L}}\\p{{N}}_])') then '' else ' ' end), '')) as diff_norm,
{sql_chain("lower(" + sql_chain("author", [T.TRIM]) + ")", T.INDEX_AUTHOR)} as index_norm, {sql_chain("author", T.CLEAN_AUTHOR)} as cleaned, {last_word("regexp_split_to_array(" + sql_chain("author", T.CLEAN_AUTHOR) + ", ',\\s*|\\s+and\\s+')[1]")} as surname_first,
{last_word("regexp_split_to_array(author, ',\\s*|\\s+and\\s+')[-1]")} as surname_last from a""")
def normalize_author(s, d):
    a = c("author")
    rows = table(s, d, "library_entries").select("author").distinct()
    return rows.select("author", T.diff_author(a).alias("diff_norm"), T.index_author(a).alias("index_norm"), T.clean_author(a).alias("cleaned"), T.surname_first(a).alias("surname_first"), T.surname_last(a).alias("surname_last"))


LOOKS = f"""not (regexp_matches(lower(author), {q('|'.join(D.COLLECTION_WORDS))}) or regexp_matches(author, '[0-9]') or length(author) > 50 or len(list_filter(regexp_split_to_array(author, '\\s+'), lambda x: x <> '')) > 5
or len(list_filter(regexp_split_to_array(author, '\\s+'), lambda x: x <> '')) = 1 or regexp_matches(lower(author), '^(the|a|an) '))"""


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _after(x: str, mark: str) -> str:
    """What follows the first mark, '' without one."""
    return f"case when contains({x}, '{mark}') then substr({x}, position('{mark}' in {x}) + {len(mark)}) else '' end"


def _owner(x: str) -> str:
    cleaned = _trimmed(f"regexp_replace({_trimmed(f"regexp_replace({x}, '\\s*\\(.*?\\)', '', 'g')")}, '\\s*\\[.*?\\]', '', 'g')")
    left = _trimmed(f"split_part({cleaned}, ' - ', 1)")
    return f"case when contains({cleaned}, ' - ') and not regexp_matches({left}, '[0-9]') then {left} when {cleaned} <> '' then {cleaned} else {x} end"


def _person(x: str) -> str:
    return LOOKS.replace("author", x)


def _headless(title: str, head: str) -> str:
    return f"case when {head} <> '' and starts_with(lower({title}), lower({head})) then {_trimmed(f"regexp_replace(substr({title}, length({head}) + 1), '^[ -]+', '')")} else {title} end"


GENERIC_SQL = "('file', 'mp3', 'audiobook', 'audio', 'book', 'track', 'output', 'part1', 'part2', 'part 1', 'part 2', 'disc1', 'disc2')"
LABEL_SQL = "('audiobook', 'audio', 'unabridged', 'abridged')"
_LABEL = lambda x: f"regexp_replace({x}, '(?i)\\s+-\\s+(?:Audiobook|Audio|Unabridged|Abridged)$', '', 'g')"
_B2, _B, _G = "'^(.+?)\\s+([0-9]{1,3})\\s+-\\s+(.+)$'", "'^(.+?)\\s+([0-9]{1,3})\\s+(.+)$'", "'^(.+?)\\s+\\[([0-9]+)\\]\\s+(.+)$'"
_pick = lambda k: f"case when b2 then {_trimmed(f'regexp_extract(t, {_B2}, {k})')} when b1 then {_trimmed(f'regexp_extract(t, {_B}, {k})')} when g then {_trimmed(f'regexp_extract(t, {_G}, {k})')} else '' end"
_PAREN = "'(?s)^(.*?)\\s*-?\\s*\\(([^)]+?)(?:\\s*[-,]\\s*(?:Book|Day|#)\\s*([0-9.]+))?\\).*$'"
_NAMED = _headless(f"({_headless('base', 'author')})", "series")
PARSE_SQL = f"""with c0 as (select entry_id, {_HASH(STEM)} as base0, {_HASH(f"coalesce({PARTS}[-2], '')")} as par, {_HASH(f"coalesce({PARTS}[-3], '')")} as gp, {_HASH(f"coalesce({PARTS}[-4], '')")} as ggp from library_entries),
c1 as (select *, case when lower(base0) in {GENERIC_SQL} and par <> '' and lower(par) not in {GENERIC_SQL} then {_LABEL('par')} when lower(base0) in {GENERIC_SQL} and gp <> '' then {_LABEL('gp')} else base0 end as base from c0),
c2 as (select *, regexp_replace(regexp_replace(case when par <> '' then par else base end, '-#-([0-9]+)', '-#\\1', 'g'), '-#([0-9]+) ', '-#\\1-', 'g') as t from c1),
c3 as (select *, regexp_matches(t, '-#[0-9]+-') as marked, regexp_extract(t, '(?s)^(.*)-#[0-9]+-.*$', 1) as head, regexp_matches(t, {_B2}) as b2 from c2),
c4 as (select *, regexp_matches(head, '-.+?-#[0-9]+') as inner_, not b2 and regexp_matches(t, {_B}) and length({_trimmed(f'regexp_extract(t, {_B}, 3)')}) >= 3 as b1 from c3),
c5 as (select *, not b2 and not b1 and regexp_matches(t, {_G}) as g, case when inner_ then regexp_extract(head, '(?s)^([^-]*)-', 1) when contains(head, '-') then regexp_extract(head, '(?s)^(.*)-([^-]*)$', 1) else head end as ma,
case when inner_ then regexp_split_to_array(regexp_extract(head, '(?s)^[^-]*-(.*)$', 1), '-#[0-9]+')[1] when contains(head, '-') then regexp_extract(head, '(?s)^(.*)-([^-]*)$', 2) else '' end as ms, regexp_extract(t, '(?s)^.*-#[0-9]+-(.*)$', 1) as mt, regexp_extract(t, '(?s)^.*-#([0-9]+)-.*$', 1) as mp from c4),
c6 as (select *, {_pick(1)} as series0, {_pick(2)} as pos0, {_pick(3)} as title0, {_trimmed("split_part(gp, ' - ', 1)")} as ga, {_trimmed(_after('gp', ' - '))} as gs from c5),
c7 as (select *, contains(gp, ' - ') and lower(gs) not in {LABEL_SQL} and not regexp_matches(ga, '[0-9]') as above, par = base and gp <> '' as same, {_owner('gp')} as own, {_owner('ggp')} as own2 from c6),
c8 as (select *, case when above then ga else '' end as a1, case when above and series0 = '' then gs else series0 end as s1, case when same then {_person('own')} else gp <> '' and {_person('gp')} end as from_gp, not same and gp <> '' and not {_person('gp')} and ggp <> '' and {_person('ggp')} as from_ggp from c7),
c9 as (select *, case when a1 = '' and from_gp then own when a1 = '' and from_ggp then own2 else a1 end as a2, case when a1 = '' and from_ggp and s1 = '' then {_trimmed("regexp_replace(regexp_replace(gp, '\\s*\\[.*?\\]', '', 'g'), '\\s*\\(.*?\\)', '', 'g')")} else s1 end as s2,
{_trimmed("split_part(par, '-', 1)")} as dl, {_trimmed(_after('par', '-'))} as dr from c8),
d1 as (select *, a2 = '' and s2 = '' and title0 = '' and contains(par, '-') and not regexp_matches(par, '-#[0-9]+') and {_person('dl')} and length(dr) >= 3 as dash from c9),
d2 as (select *, case when dash then dl else a2 end as a3, case when dash then dr else title0 end as t1 from d1), d3 as (select * , case when a3 <> '' and lower(a3) = lower(s2) then '' else a3 end as author, s2 as series from d2),
d4 as (select *, case when t1 = '' then {_trimmed(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NAMED}, '\\[[0-9]+\\]', '', 'g'), '^\\s*\\[(.+)\\]\\s*$', '\\1', 'g'), '^[0-9]+\\s*[-–]?\\s*', ''), '\\s+', ' ', 'g')")} else t1 end as t2 from d3),
d5 as (select *, {_trimmed("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t2, '\\s*\\{[^}]+\\}', '', 'g'), '\\s*\\([^)]*\\b[0-9]+k\\b[^)]*\\)', '', 'g'), '\\s*\\([A-Z][a-z]+\\)\\s+[0-9]+k\\s+[0-9.]+', '', 'g'), '(?i)\\s*\\((?:The\\s+)?Audio\\s*Book\\)', '', 'g'), '(?i)\\s*\\(Unabridged\\)', '', 'g'), '([\\p{L}\\p{N}_])-\\s', '\\1 ', 'g'), '-$', '')")} as t3 from d4),
d6 as (select *, series = '' and regexp_matches(t3, {_PAREN}) as has, regexp_replace({_trimmed(f'regexp_extract(t3, {_PAREN}, 2)')}, '[ ,-]+$', '') as ins, regexp_replace({_trimmed(f'regexp_extract(t3, {_PAREN}, 1)')}, '[ -]+$', '') as bef from d5),
d7 as (select *, has and regexp_matches(ins, '^[0-9]{{4}}$') as yr, has and not regexp_matches(ins, '^[0-9]{{4}}$') and length(ins) >= 3 and lower(ins) not in {LABEL_SQL} as good from d6),
d8 as (select *, case when yr and pos0 = '' then ins when good and pos0 = '' then regexp_extract(t3, {_PAREN}, 3) else pos0 end as p4, case when good then ins else series end as s4, case when yr or good then bef else t3 end as t4 from d7),
d9 as (select *, {_trimmed("regexp_replace(regexp_replace(regexp_replace(base, '\\[[0-9]+\\]', '', 'g'), '^[0-9]+\\s*[-–]?\\s*', ''), '\\s+', ' ', 'g')")} as fb from d8),
e1 as (select *, case when t4 = '' then case when fb = '' then base else fb end else t4 end as t5, {_trimmed("case when marked then mp else p4 end")} as p5 from d9)
select entry_id, {_trimmed("case when marked then ma else author end")} as author, regexp_replace({_trimmed("case when marked then mt else t5 end")}, '^[- ]+', '') as title, regexp_replace({_trimmed("case when marked then ms else s4 end")}, '[- ]+$', '') as series,
case when regexp_matches(p5, '^[0-9]+$') then regexp_replace(p5, '^0+([0-9])', '\\1') else p5 end as position from e1"""


@query(PARSE_SQL)
def parse_path_fields(s, d):
    rows = table(s, d, "library_entries").select("entry_id", "path")
    return P.parse_columns(rows, "path").select("entry_id", "author", "title", "series", "position")


@query(f"select distinct author, {LOOKS} as looks from library_entries")
def looks_like_author(s, d):
    return table(s, d, "library_entries").select("author").distinct().select("author", T.looks_like_author(c("author")).alias("looks"))


SAFE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[/\\\\:\"*?<>|;]+', '_', 'g'), '^[._]+', ''), '[._]+$', ''), '__+', '_', 'g')"


@query(f"""with n as (select source_path as v from books where source_path is not null union select text from documents where text is not null), s as (select v, {SAFE} as s from n), x as (select *, regexp_extract(s, '(?s)^.+(\\.[^.]+)$', 1) as ext from s),
y as (select *, left(s, length(s) - length(ext)) as stem from x)
select v as value, case when strlen(s) <= 255 then s else left(stem, coalesce(list_max(list_filter(range(0, 256), lambda k: strlen(left(stem, k)) + strlen(ext) <= 255)), 0)) || ext end as safe,
regexp_replace(regexp_replace(regexp_replace(v, '[/\\\\:"*?<>|;]+', ' ', 'g'), '  +', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as chapter from y""")
def sanitize_name(s, d):
    """Every source path and every text of a document as a file name and as a chapter title: names of any length, the long ones cut to 255 bytes."""
    values = table(s, d, "books").select(c("source_path").alias("value")).unionByName(table(s, d, "documents").select(c("text").alias("value")))
    return values.where("value is not null").distinct().select("value", T.sanitize(c("value")).alias("safe"), T.sanitize_chapter(c("value")).alias("chapter"))


@query(f"select doc_id, {sql_chain('text', T.HTML)} as plain from documents where text is not null")
def strip_html(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.strip_html(c("text")).alias("plain"))


@query(f"select distinct title, {sql_chain('title', T.SERIES_NUMBERS)} as stripped from library_entries")
def strip_series_numbers(s, d):
    return table(s, d, "library_entries").select("title").distinct().select("title", T.strip_series_numbers(c("title")).alias("stripped"))


@query("""select entry_id, printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) as hms, printf('%02d:%02d:%02d.%03d', m // 3600000, (m % 3600000) // 60000, (m % 60000) // 1000, m % 1000) as hms_ms
from (select entry_id, floor(duration_s)::bigint as s, floor(duration_s * 1000)::bigint as m from library_entries where duration_s is not null)""")
def hms_render(s, d):
    rows = table(s, d, "library_entries").where("duration_s is not null")
    return rows.select("entry_id", T.hms(c("duration_s")).alias("hms"), T.hms_millis(F.floor(c("duration_s") * 1000).cast("bigint")).alias("hms_ms"))


NATURAL = "list_transform(regexp_extract_all(lower({0}), '([0-9]+|[^0-9]+)'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(length(regexp_replace(p, '^0+([0-9])', '\\1'))::varchar, 10, '0') || regexp_replace(p, '^0+([0-9])', '\\1') else p end)"


@query(f"select name, row_number() over (order by {NATURAL.format('name')}, name) as rank from (select distinct regexp_extract(path, '[^/]+$') as name from library_entries where regexp_extract(path, '[^/]+$') <> '')")
def natural_sort_rank(s, d):
    """Every file name, of any script: digit runs of any length as numbers, the rest by code points of its lower case."""
    rows = table(s, d, "library_entries").select(P.name_of(c("path")).alias("name")).where("name <> ''").distinct()
    return sinks.numbered(rows, T.natural_key(c("name")), "name").select("name", "rank")


@query(f"select path, row_number() over (order by {NATURAL.format('path')}, path) as rank from (select distinct path from library_entries)")
def version_sort_rank(s, d):
    """Whole paths in natural order."""
    return sinks.numbered(table(s, d, "library_entries").select("path").where("path is not null").distinct(), T.natural_key(c("path")), "path").select("path", "rank")


@query("""select book_hash, substr(sha256(source_path || chr(10)), 1, 16) as h from books group by all""")
def item_hash16(s, d):
    return table(s, d, "books").select("book_hash", T.hash16(F.concat(c("source_path"), F.lit("\n"))).alias("h")).distinct()


@query("""with f as (select """ + PARENT + """ as folder, path from library_entries where """ + EXT + f""" in {names(D.AUDIO)} group by all)
select folder, substr(sha256(folder || chr(10) || string_agg(path, chr(10) order by string_split(path, '/')) || chr(10)), 1, 16) as h from f group by folder""")
def folder_hash(s, d):
    rows = table(s, d, "library_entries").where(P.has_suffix(c("path"), *D.AUDIO)).select(P.parent_of(c("path")).alias("folder"), "path").distinct()
    listed = rows.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct(P.order_key(c("path")).alias("k"), "path"))), lambda x: x["path"]).alias("p"))
    return listed.select("folder", T.hash16(F.concat(c("folder"), F.lit("\n"), F.array_join("p", "\n"), F.lit("\n"))).alias("h"))


def _reply(name: str, drop: str) -> str:
    lines = f"list_transform(regexp_extract_all(r, '(?im)^\\s*{name}:([^\\n]*)$', 1), lambda v: regexp_replace(regexp_replace(regexp_replace(v, '^\\s+|\\s+$', '', 'g'), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g'))"
    return f"list_filter({lines}, lambda v: v <> '' and not regexp_matches(v, '(?i)^(?:{drop})$'))[-1]"


@query(f"""with q as (select distinct book_hash, 'AUTHOR: ' || coalesce(parsed_author, 'UNKNOWN') || chr(10) || 'TITLE: "' || coalesce(parsed_title, 'UNKNOWN') || '"' || chr(10) || 'SERIES: ' || coalesce(parsed_series, 'NONE') || chr(10) || 'POSITION: ' || coalesce(parsed_position, 'N/A') as r from books),
f as (select book_hash, {_reply('AUTHOR', 'UNKNOWN')} as author, {_reply('TITLE', 'UNKNOWN')} as t, {_reply('SERIES', 'NONE|UNKNOWN|N/A')} as series, {_reply('POSITION', 'NONE|UNKNOWN|N/A')} as p from q)
select book_hash, author, regexp_replace(regexp_replace(regexp_replace(t, '(?i)\\s*\\((?:The\\s+)?Audio\\s*Book\\)', '', 'g'), '(?i)\\s*\\(Unabridged\\)', '', 'g'), '^\\s+|\\s+$', '', 'g') as title, series, case when regexp_matches(p, '^[0-9]+$') then regexp_replace(p, '^0+([0-9])', '\\1') else p end as position from f where author is not null""")
def kv_reply_parse(s, d):
    reply = F.concat(F.lit("AUTHOR: "), F.coalesce("parsed_author", F.lit("UNKNOWN")), F.lit("\nTITLE: \""), F.coalesce("parsed_title", F.lit("UNKNOWN")), F.lit("\"\nSERIES: "), F.coalesce("parsed_series", F.lit("NONE")), F.lit("\nPOSITION: "), F.coalesce("parsed_position", F.lit("N/A")))
    rows = table(s, d, "books").select("book_hash", reply.alias("r")).distinct()
    return rows.select("book_hash", *[T.reply_field(c("r"), n.upper()).alias(n) for n in ("author", "title", "series", "position")]).where("author is not null")


# library products

ENTRY = f"""with e0 as (select entry_id, library, path, {GUESS} as author, {STEM} as title, {PARENT} as dir from library_entries where len({PARTS}) >= 2),
e as (select *, regexp_matches(title, {q(P.PART_SUFFIX)}) as part, regexp_matches(title, {q(P.CHAPTER_FILE)}) or regexp_matches(title, {q(P.NUMBERED_FILE)}) as other from e0)"""


@query(ENTRY + f""" select entry_id, author, title, part or other as is_multipart, case when part then dir || '|' || lower({sql_chain(f"regexp_replace(title, {q(P.PART_SUFFIX)}, '')", [T.TRIM])}) when other then dir else '' end as part_group from e""")
def book_entries(s, d):
    return L.book_entries(table(s, d, "library_entries"), "entry_id").select("entry_id", "author", "title", "is_multipart", "part_group")


def _quoted(expr: str) -> str:
    return f"replace(regexp_replace({expr}, '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g'), ' ', '\\s*')"


def _diff_author(a: str) -> str:
    tokens = f"string_split({AUTHOR_TOKENS.replace('author', a)}, ' ')"
    return f"trim(array_to_string(list_transform({tokens}, lambda x, i: x || case when regexp_matches(x, '^[a-z]$') and regexp_matches(coalesce({tokens}[i + 1], ''), '^[a-z]($|[^\\p{{L}}\\p{{N}}_])') then '' else ' ' end), ''))"


def _with_author(source: str, title: str, out: str) -> str:
    """Steps that add the duplicate-search title `out` of a title and its author to the rows of `source`."""
    steps = [f"{out}0 as (select *, {sql_chain(f'lower({title})', T.DEDUP_HEAD)} as v, {_quoted('lower(author)')} as p1, {_quoted('norm_author')} as p2 from {source})"]
    for i, (p, before, after) in enumerate((("p1", "^", "\\s*-\\s*"), ("p2", "^", "\\s*-\\s*"), ("p1", "\\s*-\\s*", ".*$"), ("p2", "\\s*-\\s*", ".*$"))):
        steps.append(f"{out}{i + 1} as (select * exclude (v), case when coalesce({p}, '') = '' then v else regexp_replace(v, '{before}' || {p} || '{after}', '', 'g') end as v from {out}{i})")
    return ", ".join(steps) + f", {out} as (select * exclude (v, p1, p2), {sql_chain('v', T.DEDUP_TAIL)} as {out}_norm from {out}4)"


IS_CHAPTER = f"(regexp_matches(title, {q(P.CHAPTER_FILE)}) or regexp_matches(title, {q(P.NUMBERED_FILE)}))"
COLLAPSED = f"""{ENTRY}, g as (select library, path, author, title, {_diff_author('author')} as norm_author, case when part then dir || '|' || lower({sql_chain(f"regexp_replace(title, {q(P.PART_SUFFIX)}, '')", [T.TRIM])}) when other then dir else '' end as part_group from e),
u as (select library, path, author, title, norm_author, false as from_group from g where part_group = '' union all
select library, path, author, case when {IS_CHAPTER} then {sql_chain(f"regexp_replace({PARTS}[-2], '(?i)^book\\s+[0-9.]+\\s*-?\\s*', '')", [T.TRIM])} else title end, norm_author, true from (select *, row_number() over (partition by library, part_group order by {PARTS}) as rn from g where part_group <> '') where rn = 1),
{_with_author('u', 'title', 'n')}, b as (select * exclude (n_norm), n_norm as norm_title from n)"""


@query(f"{COLLAPSED} select library, path, author, title, norm_title from b")
def collapse_multipart(s, d):
    return L.collapse_parts(L.book_entries(table(s, d, "library_entries"), "library"), "library").select("library", "path", "author", "title", "norm_title")


@query(f"""{COLLAPSED}, o as (select * from (select *, row_number() over (partition by norm_title order by from_group, {PARTS}) as rn from b where library = 'source') where rn = 1 or norm_title = '')
select case when norm_title <> '' and exists (select 1 from b t where t.library = 'target' and t.norm_title = o.norm_title) then 'matched' else 'missing' end as status, author, title, norm_title, path from o""")
def library_diff_exact(s, d):
    return L.library_diff(table(s, d, "library_entries"))


@query(f"""with t as (select path, {dedup(STEM)} as norm_title from library_entries)
select norm_title, count(*) as n, array_to_string(min(list_filter(string_split(path, '/'), lambda x: x <> '')), '/') as first_path from t where norm_title <> '' group by norm_title having count(*) > 1""")
def duplicate_titles(s, d):
    return L.duplicate_titles(table(s, d, "library_entries"))


@query(f"""select {PARENT} as parent, count(*) as n, case when bool_and(regexp_matches({STEM}, {q(P.PART_SUFFIX)}) or regexp_matches({STEM}, {q(P.CHAPTER_FILE)}) or regexp_matches({STEM}, {q(P.NUMBERED_FILE)})) then 'info' else 'warning' end as severity
from library_entries where {EXT} = 'm4b' group by 1 having count(*) > 1""")
def dir_multi_items(s, d):
    return L.crowded_folders(table(s, d, "library_entries"))


@query("""select * exclude (rn) from (select doc_id, text, row_number() over (partition by text order by doc_id) as rn from documents where text is not null) where rn = 1 or text = ''""")
def dedup_first(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text")
    return L.first_of_key(docs, ["text"], [c("doc_id")], c("text") == "")


@query(f"""with a as (select distinct parsed_author as a, {last_word("regexp_split_to_array(parsed_author, ',\\s*|\\s+and\\s+')[-1]")} as surname from books where parsed_author is not null and parsed_author <> '')
select surname, list_sort(list(a)) as variants, count(*) as n from a where surname <> '' group by surname having count(*) > 1""")
def author_variations(s, d):
    return L.author_variations(table(s, d, "books"), "parsed_author")


@query(f"select author, {sql_chain('lower(title)', T.VERIFY_TITLE)} as norm_title, count(*) as n from library_entries group by 1, 2 having count(*) > 1")
def dup_titles_by_author(s, d):
    return L.titles_by_author(table(s, d, "library_entries"))


@query(f"""select count(distinct {PARTS}[1]) as authors, count(distinct {PARENT}) as folders, count(*) as files, count(distinct path) as paths from library_entries""")
def verify_totals(s, d):
    p = c("path")
    return table(s, d, "library_entries").agg(F.countDistinct(F.element_at(P.parts(p), 1)).alias("authors"), F.countDistinct(P.parent_of(p)).alias("folders"), F.count("*").alias("files"), F.countDistinct("path").alias("paths"))


MATCH_FILES = "(select path from library_entries union all select source_path as path from books)"


@query(f"""select path, r.rule, r.severity from (select path, unnest(list_filter([case when m4b and n = 1 then {{'rule': 'S1', 'severity': 'critical'}} end, case when m4b and n = 2 then {{'rule': 'S2', 'severity': 'warning'}} end,
case when m4b and n > 4 then {{'rule': 'S3', 'severity': 'warning'}} end, case when m4b and n > 2 and contains(name, '[') and contains(name, ']') then {{'rule': 'S4', 'severity': 'warning'}} end,
case when ext not in {names((*D.AUDIO, *D.LEFTOVER_SOURCES, 'jpg', 'jpeg', 'png', 'webp'))} and name not in ('.author-override', '.asin', 'desc.txt', 'reader.txt') and not hidden then {{'rule': 'S5', 'severity': 'info'}} end,
case when name = '.author-override' then {{'rule': 'S6', 'severity': 'info'}} end], lambda x: x is not null)) as r
from (select path, {EXT} as ext, {NAME} as name, len({PARTS}) as n, {EXT} = 'm4b' as m4b, len(list_filter({PARTS}, lambda x: regexp_matches(x, '^[_.]'))) > 0 as hidden from {MATCH_FILES}))""")
def structure_rules(s, d):
    files = table(s, d, "library_entries").select("path").unionByName(table(s, d, "books").select(c("source_path").alias("path")))
    return L.structure_findings(files)


TAGS = "select book_hash, parsed_author as album_artist, parsed_title as title, parsed_series as album, parsed_genre as genre, parsed_narrator as composer, parsed_year as date, parsed_description as description from books"


@query(f"""with b as ({TAGS}), t as (select book_hash, coalesce({sql_chain('album_artist', [T.TRIM])}, '') as aa, coalesce({sql_chain('title', [T.TRIM])}, '') as ti, coalesce({sql_chain('album', [T.TRIM])}, '') as al,
coalesce({sql_chain('genre', [T.TRIM])}, '') as ge, coalesce({sql_chain('composer', [T.TRIM])}, '') as co, coalesce({sql_chain('date', [T.TRIM])}, '') as da, coalesce({sql_chain('description', [T.TRIM])}, '') as de from b)
select book_hash, 'T2' as rule, 'artist' as field, 'critical' as severity from t where aa = '' union all select book_hash, 'T2', 'album_artist', 'critical' from t where aa = '' union all select book_hash, 'T2', 'album', 'critical' from t where al = ''
union all select book_hash, 'T2', 'title', 'critical' from t where ti = '' union all select book_hash, 'T2', 'genre', 'critical' from t where ge = '' union all select book_hash, 'T2', 'sort_album', 'critical' from t where ti = ''
union all select book_hash, 'T3', 'artist', 'warning' from t where lower(aa) in {names(D.SUSPICIOUS)} union all select book_hash, 'T3', 'album_artist', 'warning' from t where lower(aa) in {names(D.SUSPICIOUS)}
union all select book_hash, 'T3', 'title', 'warning' from t where lower(ti) in {names(D.SUSPICIOUS)} union all select book_hash, 'T3', 'album', 'warning' from t where lower(al) in {names(D.SUSPICIOUS)}
union all select book_hash, 'T4', 'title', 'warning' from t where ti <> '' and lower(ti) = lower(aa) union all select book_hash, 'T5', 'genre', 'warning' from t where lower(ge) = 'audiobook'
union all select book_hash, 'T6', 'album_artist', 'warning' from t where length(aa) - length(replace(aa, ',', '')) > 1 union all select book_hash, 'T7', 'media_type', 'warning' from t
union all select book_hash, 'T8', 'composer', 'info' from t where co = '' union all select book_hash, 'T8', 'date', 'info' from t where da = '' union all select book_hash, 'T8', 'comment', 'info' from t where de = '' union all select book_hash, 'T8', 'description', 'info' from t where de = ''""")
def tag_rules(s, d):
    b = table(s, d, "books")
    m = {"artist": "parsed_author", "album_artist": "parsed_author", "title": "parsed_title", "album": "parsed_series", "genre": "parsed_genre", "sort_album": "parsed_title", "composer": "parsed_narrator", "date": "parsed_year", "comment": "parsed_description", "description": "parsed_description"}
    tags = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), c(v))])
    return L.tag_findings(b.select("book_hash", tags.alias("tags")), key="book_hash")


@query(f"""with f as {MATCH_FILES} select count(*) as total, count(*) filter (len({PARTS}) = 1) as critical, count(*) filter (len({PARTS}) = 2) as warning, count(*) filter (len({PARTS}) > 4) as info from f where {EXT} = 'm4b' and (len({PARTS}) < 3 or len({PARTS}) > 4)""")
def severity_summary(s, d):
    p = c("path")
    files = table(s, d, "library_entries").select("path").unionByName(table(s, d, "books").select(c("source_path").alias("path"))).where(P.has_suffix(p, "m4b"))
    n = F.size(P.parts(p))
    return L.severity_summary(files.where((n < 3) | (n > 4)).select(F.when(n == 1, "critical").when(n == 2, "warning").otherwise("info").alias("severity")))


@query(f"""with f as (select path, {PARENT} as parent, {EXT} as ext from (select source_path || '/' || (case when file_count > 1 then 'part1.mp3' else 'book.m4b' end) as path from books)), done as (select distinct parent from f where ext = 'm4b')
select path, case when done.parent is null then 'critical' else 'warning' end as severity from f left join done using (parent) where ext in {names(D.LEFTOVER_SOURCES)} and not regexp_matches(path, '(^|/)[_.]')""")
def sibling_semi_anti(s, d):
    b = table(s, d, "books").select(F.concat(c("source_path"), F.lit("/"), F.when(c("file_count") > 1, "part1.mp3").otherwise("book.m4b")).alias("path"))
    return L.leftover_sources(b)


@query("""select variant, arg_max(canonical, struct_pack(a := created_at, b := canonical)) as canonical from author_aliases where variant is not null and canonical is not null and variant <> canonical group by variant""")
def alias_latest(s, d):
    return L.latest_alias(table(s, d, "author_aliases"))


@query("""with a as (select variant, arg_max(canonical, struct_pack(a := created_at, b := canonical)) as canonical from author_aliases where variant is not null and canonical is not null and variant <> canonical group by variant)
select author, coalesce(a.canonical, author) as canonical from (select distinct parsed_author as author from books where parsed_author is not null) b left join a on a.variant = b.author""")
def alias_lookup(s, d):
    a = L.latest_alias(table(s, d, "author_aliases"))
    b = table(s, d, "books").where("parsed_author is not null").select(c("parsed_author").alias("author")).distinct()
    return b.join(a.withColumnRenamed("variant", "author"), "author", "left").select("author", F.coalesce("canonical", "author").alias("canonical"))


@query(f"""with al as (select variant, arg_max(canonical, struct_pack(a := created_at, b := canonical)) as canonical from author_aliases where variant is not null and canonical is not null and variant <> canonical group by variant), al2 as (select * from al where canonical <> ''),
w as (select desired, {sql_chain('desired', T.CLEAN_AUTHOR)} as cleaned from (select distinct parsed_author as desired from books where parsed_author <> '')), w2 as (select *, {last_word("regexp_split_to_array(cleaned, ',\\s*|\\s+and\\s+')[1]")} as surname from w),
e as (select name as author, {sql_chain("lower(" + sql_chain("name", [T.TRIM]) + ")", T.INDEX_AUTHOR)} as ix, {sql_chain('lower(name)', T.COMPARE)} as cf, {last_word("regexp_split_to_array(" + sql_chain("name", T.CLEAN_AUTHOR) + ", ',\\s*|\\s+and\\s+')[1]")} as surname from (select distinct name from author_ref where name <> '')),
p as (select desired, case when author = desired then 0 when author = cleaned then 1 when ix = {sql_chain("lower(" + sql_chain("cleaned", [T.TRIM]) + ")", T.INDEX_AUTHOR)} then 2 when cf = {sql_chain('lower(cleaned)', T.COMPARE)} then 3 else 4 end as rank, author from w2 join e using (surname) where surname <> ''),
b as (select desired, min(struct_pack(rank := rank, author := author)) as m, count(*) as n from p group by desired)
select w2.desired, coalesce(a1.canonical, case when cleaned <> w2.desired then a2.canonical end, case when m.rank < 4 or n = 1 then m.author end, w2.desired) as result from w2 left join al2 a1 on a1.variant = w2.desired left join al2 a2 on a2.variant = cleaned left join b on b.desired = w2.desired""")
def surname_match(s, d):
    return L.match_authors(table(s, d, "books").select(c("parsed_author").alias("desired")), table(s, d, "author_ref").select(c("name").alias("author")), L.latest_alias(table(s, d, "author_aliases")))


@query(f"""with w as (select distinct norm_author as parent, title as desired, {sql_chain('lower(title)', T.COMPARE)} as dn from library_entries where library = 'source'), f as (select distinct norm_author as parent, title as actual, {sql_chain('lower(title)', T.COMPARE)} as an from library_entries where library = 'target'),
p as (select w.parent, desired, actual, dn, an, list_distinct(list_filter(regexp_split_to_array(dn, '\\s+'), lambda t: t <> '')) as x, list_distinct(list_filter(regexp_split_to_array(an, '\\s+'), lambda t: t <> '')) as y from w join f using (parent)), t as (select *, case when len(x) <= len(y) then x else y end as small, case when len(x) <= len(y) then y else x end as large, len(list_intersect(x, y)) as nb from p),
r as (select *, case when desired = actual then 0 when dn = an then 1 when len(x) < 2 and len(y) < 2 then null when nb = len(small) and len(small) >= 2 and len(list_filter(large, lambda v: not list_contains(small, v) and v not in {names(D.STOP_WORDS)})) = 0 then 2
when len(x) + len(y) > 0 and nb / (len(x) + len(y) - nb) >= 0.85 then 2 end as rank from t), b as (select parent, desired, arg_min(actual, struct_pack(r := rank, a := actual)) as actual from r where rank is not null group by all)
select w.parent, w.desired, coalesce(b.actual, w.desired) as result from w left join b using (parent, desired)""")
def folder_reuse(s, d):
    e = table(s, d, "library_entries")
    return L.folder_reuse(e.where("library = 'source'").select(c("norm_author").alias("parent"), c("title").alias("desired")), e.where("library = 'target'").select(c("norm_author").alias("parent"), c("title").alias("actual")))


@query(f"""with w as (select distinct parsed_series as a, parsed_title as b from books where parsed_series is not null and parsed_title is not null), t as (select a, b, list_distinct(list_filter(regexp_split_to_array(lower(a), '\\s+'), lambda x: x <> '')) as x, list_distinct(list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda x: x <> '')) as y from w)
select a, b, len(list_intersect(x, y)) as both, len(x) + len(y) - len(list_intersect(x, y)) as either from t""")
def token_jaccard(s, d):
    w = table(s, d, "books").select(c("parsed_series").alias("a"), c("parsed_title").alias("b")).where("a is not null and b is not null").distinct()
    x, y = S.tokens(F.lower("a")), S.tokens(F.lower("b"))
    return w.select("a", "b", F.size(F.array_intersect(x, y)).cast("bigint").alias("both"), F.size(F.array_union(x, y)).cast("bigint").alias("either"))


@query()
def title_similarity(s, d):
    w = table(s, d, "books").select(c("parsed_series").alias("a"), c("parsed_title").alias("b")).where("a is not null and b is not null").distinct()
    a, b = F.lower("a"), F.lower("b")
    return w.select("a", "b", F.round(S.ratio(a, b), 6).alias("ratio"), F.round(S.token_sort_ratio(a, b), 6).alias("sorted"), F.round(S.token_set_ratio(a, b), 6).alias("sets"), F.round(S.partial_ratio(a, b), 6).alias("part"), S.near_match(a, b).alias("near"))


@query()
def near_duplicate_titles(s, d):
    """Search: titles of the entries whose id is divisible by 20 against all titles, by ratio."""
    e = table(s, d, "library_entries").select("entry_id", T.dedup_title(c("title")).alias("text"))
    return Z.links(e.where("entry_id % 20 = 0"), e)


@query()
def library_diff_fuzzy(s, d):
    """Search: source titles of the entries whose id is divisible by 20 against all target titles; a link means matched."""
    e = table(s, d, "library_entries").select("entry_id", "library", T.dedup_title(c("title"), c("author")).alias("text"))
    out = Z.links(e.where("library = 'source' and entry_id % 20 = 0"), e.where("library = 'target'"), "token_set", same=True)
    return out.select("text", F.when(c("n_links") > 0, "matched").otherwise("missing").alias("status"), "n_links")


# sums, windows, top-k

@query("select part_group, count(*) as files, sum(size_bytes) as bytes, sum(floor(duration_s)::bigint) as seconds from library_entries where part_group <> '' group by part_group")
def part_sums(s, d):
    return table(s, d, "library_entries").where("part_group <> ''").groupBy("part_group").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum(F.floor("duration_s").cast("bigint")).alias("seconds"))


@query("select author, arg_max(entry_id, struct_pack(a := size_bytes, b := -entry_id)) as largest from library_entries group by author")
def largest_per_group(s, d):
    return table(s, d, "library_entries").groupBy("author").agg(F.max_by("entry_id", F.struct("size_bytes", -c("entry_id"))).alias("largest"))


@query("""with g as (select parsed_author, list(struct_pack(t := parsed_series, s := parsed_position) order by book_hash) as l from (select distinct book_hash, parsed_author, parsed_series, parsed_position from books where parsed_author is not null and parsed_series is not null) group by parsed_author)
select parsed_author, (list_position(list_transform(l, lambda x: coalesce(try_cast(x.s as double), 999)), list_min(list_transform(l, lambda x: coalesce(try_cast(x.s as double), 999)))) - 1)::int as best, len(l) as n from g""")
def min_position_series(s, d):
    """The series with the lowest number among those of an author's books, by the operator that picks a record's series."""
    b = table(s, d, "books").where("parsed_author is not null and parsed_series is not null").select("book_hash", "parsed_author", "parsed_series", "parsed_position").distinct()
    own = b.groupBy("parsed_author").agg(F.array_sort(F.collect_list(F.struct("book_hash", c("parsed_series").alias("title"), c("parsed_position").alias("sequence")))).alias("l"))
    return own.select("parsed_author", C.best_series(c("l")).alias("best"), F.size("l").cast("bigint").alias("n"))


@query("select vec_id, list_max(embedding) as best, len(embedding) as n from embeddings")
def best_array_score(s, d):
    return table(s, d, "embeddings").select("vec_id", F.array_max("embedding").alias("best"), F.size("embedding").cast("bigint").alias("n"))


@query("""with f as (select part_group as book, row_number() over (partition by part_group order by string_split(path, '/'), entry_id) as pos, floor(coalesce(duration_s, 0) * 1000)::bigint as ms from library_entries where part_group <> ''),
r as (select book, pos, ms, sum(ms) over (partition by book order by pos) as end_ms, count(*) over (partition by book) as n from f) select book, pos, (end_ms - ms)::bigint as start_ms, end_ms::bigint as end_ms from r where n > 1""")
def chapter_offsets(s, d):
    w = Window.partitionBy("part_group").orderBy(P.order_key(c("path")), "entry_id")
    files = table(s, d, "library_entries").where("part_group <> ''").select(c("part_group").alias("book"), F.row_number().over(w).cast("bigint").alias("pos"), F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"))
    return St.chapters(files)


@query("select l_orderkey, l_linenumber, greatest(10 - 2 * (row_number() over (partition by l_orderkey order by l_linenumber) - 1), 0)::int as bonus from lineitem")
def position_bonus(s, d):
    return L.position_bonus(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", [c("l_linenumber")]).withColumn("bonus", c("bonus").cast("int"))


@query()
def topk_candidates(s, d):
    """The best three catalog products for each record title among those of one asin, by score."""
    rows = N.products(table(s, d, "catalog_raw"))
    own = table(s, d, "books").where("parsed_asin is not null").groupBy(c("parsed_asin").alias("asin")).agg(F.min("parsed_title").alias("hint"), F.min("parsed_author").alias("who"))
    scored = C.scored(rows.join(own, "asin"), c("hint"), c("who"), c("record_id"), ["asin"])
    rank = F.row_number().over(Window.partitionBy("asin").orderBy(F.desc("score"), "record_id"))
    return scored.withColumn("rank", rank).where("rank <= 3").select("asin", "record_id", "rank", F.round("score", 6).alias("score"))


@query("""with u as (select 1 as q, parsed_asin as asin, book_hash from books where parsed_language = 'en' union all select 2, parsed_asin, book_hash from books where file_count > 1)
select asin, min(struct_pack(q := q, b := book_hash)).q as q, min(struct_pack(q := q, b := book_hash)).b as book_hash from u where asin is not null group by asin""")
def multi_query_union(s, d):
    b = table(s, d, "books").select(c("parsed_asin").alias("asin"), "book_hash", "parsed_language", "file_count")
    u = b.where("parsed_language = 'en'").select(F.lit(1).alias("q"), "asin", "book_hash").unionByName(b.where("file_count > 1").select(F.lit(2).alias("q"), "asin", "book_hash"))
    return L.first_of_key(u.where("asin is not null"), ["asin"], [c("q"), c("book_hash")]).select("asin", "q", "book_hash")


# catalog

@query("""select record_id, payload->>'$.asin' as asin, payload->>'$.title' as title, coalesce(payload->>'$.publisher', '') as publisher, substr(payload->>'$.releaseDate', 1, 4) as year
from (select record_id, case when json_valid(payload) then payload end as payload from catalog_raw) where payload is not null and payload->>'$.asin' is not null""")
def json_fields(s, d):
    g = lambda p: F.get_json_object("payload", p)
    valid = F.try_parse_json("payload").isNotNull()
    return table(s, d, "catalog_raw").where(valid & g("$.asin").isNotNull()).select("record_id", g("$.asin").alias("asin"), g("$.title").alias("title"), F.coalesce(g("$.publisher"), F.lit("")).alias("publisher"), T.year_of(g("$.releaseDate")).alias("year"))


BOOK = "coalesce(parsed_author, '') as a, coalesce(parsed_series, '') as s, coalesce(parsed_title, '') as t, coalesce(parsed_position, '') as p"


@query(f"""with b as (select distinct book_hash, {BOOK} from books), k as (select *, {sql_chain('a', T.SANITIZE)} as ca, {sql_chain('s', T.SANITIZE)} as cs0, case when t = '' then 'Unknown' else {sql_chain('t', T.SANITIZE)} end as ct from b), m as (select *, case when lower(cs0) = lower(ct) then '' else cs0 end as cs, regexp_matches(p, '^[0-9]{{4}}$') as yr from k)
select book_hash, concat_ws('/', case when ca <> '' then ca else '_unsorted' end, nullif(cs, ''), case when cs <> '' and p <> '' and not yr then 'Book ' || p || ' - ' || ct else ct end, case when yr and cs = '' then p end) as dest,
case when s <> '' and p <> '' then s || ', Book ' || p when s <> '' then s else t end as album, case when s <> '' and p <> '' then s || ' ' || p || ' - ' || t when s <> '' then s || ' - ' || t else t end as sort_album from m""")
def dest_path(s, d):
    e = lambda x: F.coalesce(c(x), F.lit(""))
    a, se, t, p = e("parsed_author"), e("parsed_series"), e("parsed_title"), e("parsed_position")
    return table(s, d, "books").select("book_hash", C.destination(a, se, t, p).alias("dest"), C.album(t, se, p).alias("album"), C.sort_album(t, se, p).alias("sort_album")).distinct()


@query("""with b as (select distinct book_hash, coalesce(parsed_author, '') as a, coalesce(parsed_narrator, '') as n, coalesce(parsed_title, '') as t, coalesce(parsed_series, '') as s, coalesce(parsed_position, '') as p, coalesce(parsed_year, '') as y, coalesce(parsed_genre, '') as g, coalesce(parsed_publisher, '') as pu from books)
select book_hash, k as key, v as value from (select book_hash, unnest(['artist', 'album_artist', 'album', 'title', 'genre', 'media_type', 'sort_album', 'pgap', 'composer', 'date', 'publisher', 'show', 'grouping', 'SHOWMOVEMENT', 'MOVEMENTNAME', 'MOVEMENT']) as k,
unnest([case when n <> '' then a || ', ' || n else a end, a, case when s <> '' and p <> '' then s || ', Book ' || p when s <> '' then s else t end, t, case when g <> '' then g else 'Audiobook' end, '2', case when s <> '' and p <> '' then s || ' ' || p || ' - ' || t when s <> '' then s || ' - ' || t else t end, '1',
nullif(n, ''), nullif(y, ''), nullif(pu, ''), nullif(s, ''), case when s <> '' and p <> '' then s || ', Book #' || p when s <> '' then s end, case when s <> '' then '1' end, nullif(s, ''), case when s <> '' and p <> '' then p end]) as v from b) where v is not null""")
def tag_map(s, d):
    m = C.tag_map(author=c("parsed_author"), narrator=c("parsed_narrator"), title=c("parsed_title"), series=c("parsed_series"), position=c("parsed_position"), year=c("parsed_year"), genre=c("parsed_genre"), publisher=c("parsed_publisher"), asin=F.lit(""), description=F.lit(""), copyright=F.lit(""))
    rows = table(s, d, "books").select("book_hash", "parsed_author", "parsed_narrator", "parsed_title", "parsed_series", "parsed_position", "parsed_year", "parsed_genre", "parsed_publisher").distinct()
    return rows.select("book_hash", F.explode(m).alias("key", "value"))


@query(f"""select book_hash, len(list_distinct(list_filter([lower({sql_chain("coalesce(parsed_author, '')", [T.TRIM])}), lower({sql_chain("coalesce(parsed_publisher, '')", [T.TRIM])})], lambda x: x not in {names(D.CONFLICT_PLACEHOLDERS)}))) <> 1 as conflict from books""")
def conflict_flag(s, d):
    return table(s, d, "books").select("book_hash", C.conflicting(c("parsed_author"), c("parsed_publisher")).alias("conflict"))


# state

@query(f"""with b as (select distinct book_hash, mode from books), s as (select unnest({list(D.STAGES)}) as stage, unnest(range(0, 8)) as ord)
select book_hash, stage, ord::int as ord, case when mode <> 'convert' and ord < 3 then 'completed' else 'pending' end as status from b, s""")
def stage_rows(s, d):
    return St.stage_rows(table(s, d, "books").select("book_hash", "mode").distinct())


LATEST = "select * exclude (rn) from (select book_hash, mode, status, error_stage, updated_at, row_number() over (partition by book_hash order by updated_at desc, status desc) as rn from books) where rn = 1"
MODE_SQL = " union all ".join(f"select {q(m)} as mode, {q(st)} as stage, {i} as ord, {D.STAGES.index(st)} as pos" for m, own in D.MODE_STAGES.items() for i, st in enumerate(own))


@query(f"""with b as ({LATEST}), m as ({MODE_SQL}), x as (select b.book_hash, m.stage, m.ord, m.pos < coalesce(list_position({list(D.STAGES)}, b.error_stage) - 1, case when b.status = 'completed' then 8 else 3 end) as done from b join m using (mode))
select book_hash, arg_min(stage, ord) filter (not done) as next from x group by book_hash""")
def next_stage(s, d):
    b = _latest_books(s, d)
    stop = F.coalesce(F.array_position(F.array(*map(F.lit, D.STAGES)), c("error_stage")) - 1, F.when(c("status") == "completed", F.lit(8)).otherwise(F.lit(3)))
    st = b.select("book_hash", stop.alias("stop"), F.posexplode(F.array(*map(F.lit, D.STAGES))).alias("i", "stage")).select("book_hash", "stage", F.when(c("i") < c("stop"), "completed").otherwise("pending").alias("status"))
    return St.next_stage(st, b)


def _latest_books(s, d):
    rows = table(s, d, "books").select("book_hash", "mode", "status", "error_stage", "updated_at")
    best = rows.groupBy("book_hash").agg(F.max(F.struct("updated_at", "status", "mode", "error_stage")).alias("r"))
    return best.select("book_hash", "r.mode", "r.status", "r.error_stage", "r.updated_at")


@query(f"select book_hash, status, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') as updated from ({LATEST})")
def latest_state(s, d):
    return _latest_books(s, d).select("book_hash", "status", T.iso_utc(c("updated_at")).alias("updated"))


@query("""select error_stage as item, count(*) as failures, arg_max(error_message, struct_pack(a := error_timestamp, b := error_message)) as last_error, case when bool_or(error_exit_code in (2, 3)) or count(*) >= 3 then 'failed' else 'retry' end as state
from books where error_stage is not null and error_message is not null group by error_stage""")
def retry_state(s, d):
    return St.retry_state(table(s, d, "books").where("error_stage is not null and error_message is not null").select(c("error_stage").alias("item"), c("error_timestamp").alias("ts"), c("error_exit_code").alias("code"), c("error_message").alias("message")))


@query("""with b as (select distinct book_hash, mode from books), u as (select distinct book_id as book_hash, 'organize' as mode from queue_triggers where book_id is not null)
select * from b where book_hash not in (select book_hash from u) union all select * from u""")
def state_upsert(s, d):
    b = table(s, d, "books").select("book_hash", "mode").distinct()
    u = table(s, d, "queue_triggers").where("book_id is not null").select(c("book_id").alias("book_hash"), F.lit("organize").alias("mode")).distinct()
    return St.upserted(b, u, ["book_hash"])


@query("""select distinct trigger_id, list_position(p, x) - 1 as first_pos, x as path from (select trigger_id, list_filter(list_transform(string_split(book_paths, '|'), lambda v: trim(v)), lambda v: v <> '') as p from queue_triggers), unnest(p) t(x)""")
def queue_paths(s, d):
    return St.queue_paths(table(s, d, "queue_triggers").select("trigger_id", "book_paths").distinct()).groupBy("trigger_id", "path").agg(F.min("pos").cast("bigint").alias("first_pos")).select("trigger_id", "first_pos", "path")


@query("""with p as (select distinct trigger_id, unnest(list_filter(list_transform(string_split(book_paths, '|'), lambda v: trim(v)), lambda v: v <> '')) as path from queue_triggers), k as (select distinct source_path as path from books)
select trigger_id, count(*) as paths, bool_and(k.path is not null) as ok from p left join k using (path) group by trigger_id""")
def trigger_outcome(s, d):
    p = St.queue_paths(table(s, d, "queue_triggers").select("trigger_id", "book_paths").distinct()).select("trigger_id", "path").distinct()
    k = table(s, d, "books").select(c("source_path").alias("path")).distinct().withColumn("known", F.lit(True))
    return p.join(k, "path", "left").groupBy("trigger_id").agg(F.count("*").alias("paths"), F.bool_and(F.coalesce("known", F.lit(False))).alias("ok"))


@query(f"""with f as (select {PARENT} as parent, max(modified_at) as newest from library_entries where library = 'source' group by 1), n as (select max(modified_at) as now from library_entries),
k as (select distinct {PARENT} as parent from library_entries where library = 'target') select parent, newest from f, n where epoch(now) - epoch(newest) >= 120 and parent not in (select parent from k)""")
def unprocessed_stable(s, d):
    e = table(s, d, "library_entries").select("library", P.parent_of(c("path")).alias("parent"), c("modified_at").alias("mtime"))
    now = e.agg(F.max("mtime").alias("now"))  # one row
    stable = St.stable_folders(e.where("library = 'source'").crossJoin(F.broadcast(now)), c("now"))
    return stable.join(e.where("library = 'target'").select("parent").distinct(), "parent", "left_anti").select("parent", "newest")


@query("""select book_hash, coalesce(abs(total_duration - d) / nullif(d, 0) * 100, 100) <= 5 as ok, case when target_bitrate is null then 128 else least(target_bitrate // 1000, 128)::int end as kbps
from (select book_hash, total_duration, target_bitrate, round(total_duration / 10) * 10 as d from books where total_duration is not null)""")
def duration_check(s, d):
    b = table(s, d, "books").where("total_duration is not null")
    return b.select("book_hash", St.within_tolerance(c("total_duration"), F.round(c("total_duration") / 10) * 10).alias("ok"), St.target_bitrate(c("target_bitrate")).alias("kbps"))


@query("""with st as (select l_orderkey as k, l_linenumber::varchar as stage, max(l_linestatus) as status from orders join lineitem on o_orderkey = l_orderkey group by all)
select o_orderkey as k, o_orderstatus as status, o_orderpriority as priority, string_agg(stage || '=' || st.status, ',' order by stage) as stages from orders join st on st.k = o_orderkey group by all""")
def nested_record(s, d):
    """Orders and their lines as nested records, every field and stage of which is read back."""
    books = table(s, d, "orders").select(c("o_orderkey").cast("string").alias("book_hash"), "o_orderstatus", "o_orderpriority")
    stages = table(s, d, "lineitem").select(c("l_orderkey").cast("string").alias("book_hash"), c("l_linenumber").cast("string").alias("stage"), c("l_linestatus").alias("status"))
    nested = St.nested_books(books, stages).where("stages is not null")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return nested.select(c("book_hash").cast("bigint").alias("k"), c("metadata")["o_orderstatus"].alias("status"), c("metadata")["o_orderpriority"].alias("priority"), listed.alias("stages"))


@query("""select regexp_extract(line, '^\\s+->\\s+(.+)$', 1) as path, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents union all select '    -> ' || path from library_entries) where regexp_extract(line, '^\\s+->\\s+(.+)$', 1) <> '' group by 1""")
def log_dest_verify(s, d):
    lines = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).unionByName(table(s, d, "library_entries").select(F.concat(F.lit("    -> "), "path").alias("value")))
    return scan.destinations(lines).groupBy("path").agg(F.count("*").alias("n"))


@query()
def audit_report(s, d):
    """The whole audit: findings of tags, structure, crowded folders, duplicates, near duplicates (of the queries of `near_duplicate_titles`)
    and leftover sources, counted by check and severity."""
    files = cut(table(s, d, "library_entries").select("path").distinct())  # read three times; no filter moves below it
    tags = tag_rules(s, d).select(F.lit("tags").alias("check"), "severity")
    parts = [
        tags, L.structure_findings(files).select(F.lit("structure").alias("check"), "severity"), L.crowded_folders(files).select(F.lit("duplicates").alias("check"), "severity"),
        L.duplicate_titles(files).select(F.lit("duplicates").alias("check"), F.lit("warning").alias("severity")),
        near_duplicate_titles(s, d).where("n_links > 0").select(F.lit("near duplicates").alias("check"), F.lit("info").alias("severity")), sibling_semi_anti(s, d).select(F.lit("sources").alias("check"), "severity"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("check", "severity").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
