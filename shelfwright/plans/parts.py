"""Queries of the small operators (predicates, parsers, sources, plans of effects), each with the SQL that gives the same rows.

Sources that the test tables lack (probe output, markers, server listings, search responses) are made from columns of the tables first, as
JSON or text, and then read by the operators; the SQL takes the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as T
from ..operators import catalog as C
from ..operators import library as L
from ..operators import state as St
from ..sources import scan, sinks
from ..util import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _books(s, d, *fields: str) -> DataFrame:
    return table(s, d, "books").select("book_hash", *fields).distinct()


def _text(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


# predicates

@query("select distinct author, trim(regexp_replace(replace(replace(lower(trim(author)), ' & ', ' and '), '.', ''), '\\s+', ' ', 'g')) in ('dragonlance', 'forgotten realms', 'star wars', 'warhammer', 'dungeons & dragons', 'magic the gathering') as franchise from (select author from library_entries union all select unnest(['Dragonlance', 'Star  Wars', 'Star Trek', 'Dungeons & Dragons']))")
def franchise_folders(s, d):
    made = s.createDataFrame([("Dragonlance",), ("Star  Wars",), ("Star Trek",), ("Dungeons & Dragons",)], "author string")
    return table(s, d, "library_entries").select("author").unionByName(made).distinct().select("author", P.is_franchise(c("author")).alias("franchise"))


FOLDER = "case when file_count = 1 then coalesce(parsed_title, '') || ' [' || 'B0' || upper(left(book_hash, 8)) || ']' when file_count = 2 then coalesce(parsed_title, '') || ' (B0' || upper(left(book_hash, 8)) || ')' when file_count = 3 then 'B0' || upper(left(book_hash, 8)) || '_x' else coalesce(parsed_title, '') || ' B0' || left(book_hash, 8) end"


@query(f"""with f as (select distinct book_hash, {FOLDER} as folder from books) select book_hash, coalesce(nullif(regexp_extract(folder, '\\[(B0[A-Z0-9]{{8}})\\]', 1), ''), nullif(regexp_extract(folder, '\\((B0[A-Z0-9]{{8}})\\)', 1), ''), nullif(regexp_extract(folder, '^(B0[A-Z0-9]{{8}})(?:\\b|_)', 1), '')) as asin,
regexp_matches(upper(left(book_hash, 10)), '^[A-Z0-9]{{10}}$') as form from f""")
def folder_ids(s, d):
    return _books(s, d, "file_count", "parsed_title").select("book_hash", P.asin_of_folder(F.expr(FOLDER)).alias("asin"), F.upper(F.left(c("book_hash"), F.lit(10))).rlike(P.ASIN).alias("form"))


@query("""select distinct book_hash, case when coalesce(cover_art_size, 0) <= 0 then 1 when codec is null then 2 when coalesce(total_duration, 0) <= 0 then 3 when codec <> 'aac' then 4 when coalesce(bitrate not like '%k%', true) then 5
when target_bitrate is not null and (cover_art_size < floor(floor(target_bitrate * floor(total_duration) / 8) * 90 / 100) or cover_art_size > floor(floor(target_bitrate * floor(total_duration) / 8) * 110 / 100)) then 6 else 0 end as failed from books""")
def integrity_checks(s, d):
    b = _books(s, d, "cover_art_size", "codec", "total_duration", "bitrate", "target_bitrate")
    container = F.when(c("bitrate").contains("k"), "mov,mp4,m4a")
    return b.select("book_hash", St.integrity(c("cover_art_size"), c("codec").isNotNull(), c("total_duration"), c("codec"), container, c("target_bitrate")).alias("failed"))


@query("select distinct book_hash, coalesce(error_exit_code, 0) = 0 and coalesce(codec <> '', false) as valid from books")
def audio_validity(s, d):
    return _books(s, d, "error_exit_code", "codec").select("book_hash", scan.valid_audio(F.coalesce("error_exit_code", F.lit(0)), c("codec")).alias("valid")).distinct()


@query("select distinct book_hash from books where parsed_author is null or not regexp_matches(parsed_author, '\\S')")
def untagged_books(s, d):
    return scan.untagged(_books(s, d, "parsed_author").withColumn("tags", F.create_map(F.lit("artist"), c("parsed_author")))).select("book_hash")


# small texts

ROLES = "introduction|narrator|narrated|read|performed|foreword|afterword|translated|edited|abridged|unabridged|producer|director"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""with a as (select distinct parsed_author as a, {STRIP.format('parsed_author')} as n from books where parsed_author is not null), r as (select *, {STRIP.format("regexp_extract(n, '(?s)^(.*?) - (.*)$', 2)")} as role from a),
m as (select a, string_split(case when contains(n, ' - ') and regexp_matches(lower(role), '^(?:{ROLES})') then {STRIP.format("regexp_extract(n, '(?s)^(.*?) - ', 1)")} else n end, ', ') as p, lower(n) in ('unknown', 'various', 'various artists', 'n/a', 'none') as none_ from r),
k as (select *, array_to_string(p[1:coalesce(list_position(list_transform(p[2:], lambda x: regexp_matches(lower(x), '{ROLES}')), true), len(p))], ', ') as kept0 from m), f as (select *, case when contains(kept0, '; ') then {STRIP.format("split_part(kept0, '; ', 1)")} else kept0 end as kept from k)
select a as author, case when none_ or length(kept) < 3 then '' else kept end as cleaned from f""")
def author_tags(s, d):
    return table(s, d, "books").where("parsed_author is not null").select(c("parsed_author").alias("author")).distinct().select("author", T.author_tag(c("author")).alias("cleaned"))


@query("select distinct book_hash, array_to_string(list_filter([parsed_narrator, '', parsed_year], lambda x: x is not null and x <> ''), '/') as genre from books")
def ladder_genre(s, d):
    ladder = F.array(*[F.struct(x.alias("name")) for x in (c("parsed_narrator"), F.lit(""), c("parsed_year"))])
    return _books(s, d, "parsed_narrator", "parsed_year").select("book_hash", C.genre(F.array(F.struct(ladder.alias("ladder")))).alias("genre"))


DATE = "case when file_count = 1 then parsed_year when file_count = 2 then parsed_year || '-07' else parsed_year || '-07-09' end"


@query(f"with y as (select distinct book_hash, {DATE} as v from books where parsed_year is not null) select book_hash, case when regexp_matches(v, '^[0-9]{{4}}$') then v || '-01-01' when regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}$') then v || '-01' else v end as date from y")
def padded_dates(s, d):
    return _books(s, d, "parsed_year", "file_count").where("parsed_year is not null").select("book_hash", T.padded_date(F.expr(DATE)).alias("date"))


# sources

@query("""select distinct book_hash, coalesce(parsed_title, 'none') as title, total_duration as duration_s, (file_count * 1000)::bigint as bitrate, codec, 2::int as channels, 44100::int as sample_rate, 'mov,mp4' as container, coalesce(chapter_count, 0)::int as n_chapters from books where codec is not null and coalesce(chapter_count, 0) < 50""")
def probe_output(s, d):
    b = _books(s, d, "parsed_title", "total_duration", "file_count", "codec", "chapter_count").where("codec is not null and coalesce(chapter_count, 0) < 50")
    n = F.coalesce("chapter_count", F.lit(0))
    made = F.struct(
        F.struct(F.create_map(F.lit("TITLE"), F.coalesce("parsed_title", F.lit("none"))).alias("tags"), c("total_duration").cast("string").alias("duration"), (c("file_count") * 1000).cast("string").alias("bit_rate"), F.lit("mov,mp4").alias("format_name")).alias("format"),
        F.array(F.struct(c("codec").alias("codec_name"), F.lit(2).alias("channels"), F.lit("44100").alias("sample_rate"))).alias("streams"),
        F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("id"))).alias("chapters"),
    )
    out = scan.probe_fields(b.select("book_hash", F.to_json(made).alias("json")))
    return out.select("book_hash", c("tags")["title"].alias("title"), "duration_s", "bitrate", "codec", "channels", "sample_rate", "container", "n_chapters")


@query("select distinct source_path as dir, upper(trim(parsed_asin)) as value from books where regexp_matches(upper(trim(parsed_asin)), '^[A-Z0-9]{10}$') and file_count is not null")
def marker_ids(s, d):
    b = table(s, d, "books").where("parsed_asin is not null and file_count is not null").select(F.concat("source_path", F.lit("/.asin")).alias("path"), F.concat(F.lit(" "), F.lower("parsed_asin"), F.lit("\n")).alias("content"))
    files = b.unionByName(b.select(F.regexp_replace("path", "asin$", "other").alias("path"), "content")).distinct()
    return scan.markers(files, ".asin").select(F.concat(F.lit("/"), "dir").alias("dir"), "value")


@query("""with n as (select max(fetched_at) as now from catalog_raw), g as (select asin, provider, payload, fetched_at from (select *, case when json_valid(payload) then payload end as ok from catalog_raw), n where ok is not null and asin is not null and epoch(now) - epoch(fetched_at) < 30 * 86400),
b as (select asin, provider, arg_max(payload, struct_pack(a := fetched_at, b := payload)) as payload from g group by all) select asin, arg_min(provider, case when provider = 'primary' then 0 else 1 end) as provider, arg_min(payload, case when provider = 'primary' then 0 else 1 end) as payload from b group by asin""")
def fresh_records(s, d):
    raw = table(s, d, "catalog_raw").where("asin is not null")
    now = raw.agg(F.max("fetched_at").alias("now"))
    rows = table(s, d, "catalog_raw").where("asin is not null").crossJoin(F.broadcast(now)).withColumn("fetched_at", c("fetched_at").cast("timestamp"))
    of = lambda p: rows.where(c("provider") == p).select("asin", "fetched_at", "payload", "now")
    return scan.cached_records(of("primary"), of("fallback"), c("now").cast("timestamp"))


@query("select entry_id::varchar as rating_key, title, norm_author as parent_title, case when library = 'source' then author end as grandparent_title, coalesce(norm_author, '') = '' and (library <> 'source' or coalesce(author, '') = '') as stale from library_entries")
def server_listing(s, d):
    e = table(s, d, "library_entries")
    item = F.struct(c("entry_id").cast("string").alias("ratingKey"), "title", c("norm_author").alias("parentTitle"), F.when(c("library") == "source", c("author")).alias("grandparentTitle"))
    return scan.server_items(e.select(F.to_json(F.struct(F.struct(F.array(item).alias("Metadata")).alias("MediaContainer"))).alias("json")))


@query("""select distinct book_hash, 0 as pos, coalesce(parsed_title, '') as title, coalesce(parsed_author, '') as author_str, case when coalesce(try_cast(parsed_position as double), 999) <= 5 then parsed_series else 'Other' end as series, substr(parsed_year, 1, 4) as year, regexp_replace(coalesce(parsed_description, ''), '^\\s+|\\s+$', '', 'g') as description
from books where parsed_series is not null and parsed_year is not null and coalesce(parsed_author, 'x') <> ''""")
def search_response(s, d):
    b = _books(s, d, "parsed_title", "parsed_author", "parsed_series", "parsed_position", "parsed_year", "parsed_description").where("parsed_series is not null and parsed_year is not null and coalesce(parsed_author, 'x') <> ''")
    product = F.struct(
        c("parsed_title").alias("title"), F.array(F.struct(c("parsed_author").alias("name"))).alias("authors"),
        F.array(F.struct(F.lit("Other").alias("title"), F.lit("5.5").alias("sequence")), F.struct(c("parsed_series").alias("title"), c("parsed_position").alias("sequence"))).alias("series"),
        F.concat("parsed_year", F.lit("-03-01")).alias("release_date"), F.concat(F.lit("<p>"), _text("parsed_description"), F.lit("</p>")).alias("publisher_summary"),
    )
    # the flat form has no key of its own: the book's hash stands as the asin
    made = b.select(F.to_json(F.struct(F.array(product.withField("asin", c("book_hash"))).alias("products"))).alias("json"))
    return C.flat_products(made).select(c("asin").alias("book_hash"), "pos", "title", "author_str", "series", "year", "description")


DIRS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
COMPARED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(actual), '\\s*\\([0-9]{4}\\)', '', 'g'), '\\s*\\([^)]*\\)', '', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 's$', '')"


@query(f"with f as (select distinct array_to_string({DIRS}[1:i - 1], '/') as parent, {DIRS}[i] as actual from library_entries, range(1, 12) t(i) where i < len({DIRS})) select parent, {COMPARED} as norm, max(actual) as actual from f group by 1, 2")
def folder_index(s, d):
    return scan.index_tables(table(s, d, "library_entries"))["folders"]


@query(f"""with f as (select array_to_string({DIRS}[1:-2], '/') as folder, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ext from (select path from library_entries union all select source_path || '/1.mp3' from books where file_count > 1)),
q as (select folder from f group by folder having bool_or(ext in ('mp3', 'm4a', 'flac', 'ogg', 'wma')) or count(*) filter (ext = 'm4b') >= 2) select folder from q where not exists (select 1 from q g where g.folder <> q.folder and (g.folder = '' or starts_with(q.folder, g.folder || '/')))""")
def books_to_convert(s, d):
    files = table(s, d, "library_entries").select("path").unionByName(table(s, d, "books").where("file_count > 1").select(F.concat("source_path", F.lit("/1.mp3")).alias("path")))
    return L.topmost_folders(files, ("mp3", "m4a", "flac", "ogg", "wma"), chaptered=True)


# plans and reports

@query("""with f as (select part_group as book, path, row_number() over (partition by part_group order by string_split(path, '/'), entry_id) as pos from library_entries where part_group <> '') select book, string_agg('file ''' || replace(path, '''', '''\\''''') || '''', chr(10) order by pos) as text from f group by book""")
def concat_lists(s, d):
    w = Window.partitionBy("part_group").orderBy(P.order_key(c("path")), "entry_id")
    return sinks.concat_list(table(s, d, "library_entries").where("part_group <> ''").select(c("part_group").alias("book"), F.row_number().over(w).alias("pos"), "path"))


@query("""with f as (select part_group as book, title, row_number() over (partition by part_group order by entry_id) as pos, floor(coalesce(duration_s, 0) * 1000)::bigint as ms from library_entries where part_group <> ''), r as (select *, sum(ms) over (partition by book order by pos) as e, count(*) over (partition by book) as n from f)
select book, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - ms)::bigint || chr(10) || 'END=' || e::bigint || chr(10) || 'title=' || title, chr(10) order by pos) as text from r where n > 1 group by book""")
def chapter_texts(s, d):
    w = Window.partitionBy("part_group").orderBy("entry_id")
    files = table(s, d, "library_entries").where("part_group <> ''").select(c("part_group").alias("book"), F.row_number().over(w).alias("pos"), "title", F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"))
    return St.chapter_text(St.chapters(files).join(files.select("book", "pos", "title"), ["book", "pos"]))


@query("""select entry_id, case when path = norm_author || '/' || title then 'in_place' when entry_id % 2 = 0 then 'skip' else 'move' end as action from library_entries""")
def move_actions(s, d):
    e = table(s, d, "library_entries").select("entry_id", c("path").alias("source"), F.concat_ws("/", "norm_author", "title").alias("dest"), c("size_bytes").alias("size"), F.when(c("entry_id") % 2 == 0, c("size_bytes")).alias("dest_size"))
    # the plan keeps source and destination only: the id stands in the source
    plan = St.move_plan(e.withColumn("source", F.when(c("source") == c("dest"), c("source")).otherwise(F.concat("source", F.lit("#"), c("entry_id").cast("string")))))
    return plan.select(F.regexp_extract("source", "#([0-9]+)$", 1).cast("bigint").alias("entry_id"), "action")


@query("select path, case when max(size_bytes) = max(size_bytes // 2 * 2) then 'delete' else 'copy' end as action from library_entries group by path")
def archive_actions(s, d):
    e = table(s, d, "library_entries").groupBy("path").agg(F.max("size_bytes").alias("size"))
    return sinks.archive_plan(e, e.select("path", (F.floor(c("size") / 2) * 2).alias("size")))


@query("with f as (select distinct source_path as source, mode as name from books where status = 'failed') select source, case when row_number() over (partition by name order by source) = 1 and name <> 'convert' then name else name || '_' || (row_number() over (partition by name order by source) - 1 + case when name = 'convert' then 2 else 0 end) end as dest from f")
def quarantine_names(s, d):
    failed = table(s, d, "books").where("status = 'failed'").select(c("source_path").alias("source"), c("mode").alias("name")).distinct()
    return sinks.quarantine_plan(failed, s.createDataFrame([("convert",), ("convert",), ("other",)], "name string"))


@query("select distinct path, case when ends_with(path, '4b') and path like '%a%' then 'would rename' else 'missing' end as action from library_entries where title like '%e%'")
def fix_actions(s, d):
    e = table(s, d, "library_entries")
    findings = e.select("path", F.lit("rename").alias("fix_action"), c("title").contains("e").alias("fixable"))
    return sinks.fix_plan(findings, e.where(c("path").contains("a") & c("path").endswith("4b")).select("path").distinct())


@query("select distinct book_hash, mode from books where book_hash not in (select book_id from queue_triggers where book_id is not null)")
def untriggered_books(s, d):
    return St.without(_books(s, d, "mode"), table(s, d, "queue_triggers").select(c("book_id").alias("book_hash")), "book_hash")


FINDINGS = f"""with f as (select distinct path, len({DIRS}) as n from library_entries where path like '%.m4b'), g as (select path, 'structure' as "check", case when n = 1 then 'critical' when n = 2 then 'warning' when n > 4 then 'info' else 'other' end as severity from f)"""


@query(FINDINGS + """ select path, row_number() over (order by case severity when 'critical' then 0 when 'warning' then 1 when 'info' then 2 else 3 end, path) as place from g""")
def findings_order(s, d):
    return sinks.numbered(_findings(s, d), "check", sinks.severity_rank(), "path").select("path", c("rank").alias("place"))


@query(FINDINGS + """ select '- **' || severity || '** `' || path || '`: depth' as value from g""")
def markdown_report(s, d):
    return sinks.markdown(_findings(s, d))


@query(FINDINGS + """ select '{"library_root":"/lib","summary":{"total_issues":' || count(*) || ',"critical":' || count(*) filter (severity = 'critical') || ',"warning":' || count(*) filter (severity = 'warning') || ',"info":' || count(*) filter (severity = 'info') || '}}' as value from g""")
def json_summary(s, d):
    return sinks.json_report(_findings(s, d), "/lib")


@query(FINDINGS + """ select '[' || upper(severity) || '] ' || path || ': depth' as value from g""")
def text_report(s, d):
    return sinks.text_report(_findings(s, d))


@query("select '- ' || author || ' - ' || title || ' (`' || path || '`)' as value from library_entries where library = 'source' and is_multipart")
def diff_report(s, d):
    missing = table(s, d, "library_entries").where("library = 'source' and is_multipart").select("author", "title", "path")
    return sinks.diff_report(missing)


def _findings(s, d) -> DataFrame:
    f = table(s, d, "library_entries").where(c("path").endswith(".m4b")).select("path").distinct()
    n = F.size(P.parts(c("path")))
    return f.select("path", F.lit("structure").alias("check"), F.when(n == 1, "critical").when(n == 2, "warning").when(n > 4, "info").otherwise("other").alias("severity"), F.lit("depth").alias("message"))


@query("""with f as (select part_group as book, size_bytes, floor(coalesce(duration_s, 0) * 1000)::bigint as ms from library_entries where part_group <> '') select book, count(*) as files, sum(ms)::bigint as total_ms, (count(*) > 1)::int as chaptered, sum(size_bytes) * 3 <= 5000000000 as room from f group by book""")
def conversion_prep(s, d):
    from ..operators import stages as G

    w = Window.partitionBy("part_group").orderBy(T.natural_key(P.name_of(c("path"))), "entry_id")
    e = table(s, d, "library_entries").where("part_group <> ''").select(c("part_group").alias("book"), F.row_number().over(w).alias("pos"), F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"), "size_bytes")
    totals = e.groupBy("book").agg(F.count("*").alias("files"), F.sum(F.floor(c("duration_s") * 1000).cast("bigint")).alias("total_ms"))
    chaptered = St.chapters(e).groupBy("book").agg(F.lit(1).alias("chaptered"))
    room = G.headroom(e.select(c("book").alias("item"), c("size_bytes").alias("size")), F.lit(5_000_000_000)).select(c("item").alias("book"), c("ok").alias("room"))
    return totals.join(chaptered, "book", "left").join(room, "book").select("book", "files", "total_ms", F.coalesce("chaptered", F.lit(0)).alias("chaptered"), "room")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
