"""Queries of the state machine, metadata resolution and organizing, each with the SQL that gives the same rows.

The SQL is written out in full, patterns included, so that it doesn't share what it checks with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import catalog as C
from ..operators import library as L
from ..operators import nested as N
from ..operators import organize as O
from ..operators import resolve as R
from ..operators import stages as G
from ..operators import state as St
from ..sources import scan, sinks
from ..util import table

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


STAGE_LIST = "['validate', 'concat', 'convert', 'asin', 'metadata', 'organize', 'archive', 'cleanup']"
FIELDS = ("mode", "file_count", "source_path", "parsed_title", "parsed_author", "parsed_series", "parsed_position", "parsed_narrator", "parsed_year", "parsed_description", "parsed_asin", "total_duration", "chapter_count", "codec", "bitrate", "cover_art_size")
ONE_BOOK = "select book_hash, " + ", ".join(f"arg_max({f}, struct_pack(a := updated_at, b := status)) as {f}" if f == "source_path" else f"min({f}) as {f}" for f in FIELDS) + " from books group by book_hash"


def _books(s, d) -> DataFrame:
    """One row per book: rows of one hash agree in these fields."""
    b = table(s, d, "books")
    latest = F.max_by("source_path", F.struct("updated_at", "status")).alias("source_path")
    return b.groupBy("book_hash").agg(*[latest if f == "source_path" else F.min(f).alias(f) for f in FIELDS])


# state machine

@query(f"""with b as (select distinct book_hash, mode from books), s as (select unnest({STAGE_LIST}) as stage, unnest(range(0, 8)) as ord), st as (select book_hash, stage, case when mode <> 'convert' and ord < 3 then 'completed' else 'pending' end as status from b, s),
ch as (select book_hash, coalesce(error_stage, 'organize') as stage, max(struct_pack(ts := updated_at, status := status)) as c from books group by all)
select book_hash, stage, coalesce(c.status, st.status) as status, case when c.status = 'completed' then c.ts end as completed_at from st left join ch using (book_hash, stage)""")
def set_stage(s, d):
    b = table(s, d, "books")
    stages = St.stage_rows(b.select("book_hash", "mode").distinct()).withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    return G.set_stage(stages, b.select("book_hash", F.coalesce("error_stage", F.lit("organize")).alias("stage"), "status", c("updated_at").alias("ts")))


TRIGGERS = "select book_id as book_hash, max(struct_pack(t := event_time, i := trigger_id, title := book_title, author := author_name)) as u from queue_triggers where book_id is not null group by book_id"


def _updates(s, d) -> tuple[DataFrame, DataFrame]:
    base = table(s, d, "books").groupBy("book_hash").agg(F.min("parsed_title").alias("parsed_title"), F.min("parsed_author").alias("parsed_author"), F.max("updated_at").alias("updated_at"))
    last = table(s, d, "queue_triggers").where("book_id is not null").groupBy(c("book_id").alias("book_hash")).agg(F.max(F.struct("event_time", "trigger_id", "book_title", "author_name", "source")).alias("u"))
    changes = last.select("book_hash", F.create_map(F.lit("parsed_title"), c("u.book_title"), F.lit("parsed_author"), c("u.author_name"), F.lit("no_field"), c("u.source")).alias("metadata"))
    return G.nested_update(base, changes, "book_hash", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))


@query(f"""with b as (select book_hash, min(parsed_title) as t, min(parsed_author) as a, max(updated_at) as old from books group by book_hash), u as ({TRIGGERS})
select book_hash, case when u is null then t else u.title end as parsed_title, case when u is null then a else u.author end as parsed_author, case when u is null then old else timestamp '2026-01-01' end as updated_at from b left join u using (book_hash)""")
def nested_update(s, d):
    return _updates(s, d)[0]


@query(f"with u as ({TRIGGERS}) select book_hash from u where book_hash not in (select book_hash from books)")
def update_missing(s, d):
    return _updates(s, d)[1].select("book_hash")


@query("select book_hash, source_path, mode, status from books where status = 'failed' and mode = 'convert'")
def list_books(s, d):
    return G.listed(table(s, d, "books"), "failed", "convert")


@query("select book_hash, source_path, mode, status from books where mode = 'organize'")
def list_books_by_mode(s, d):
    return G.listed(table(s, d, "books"), "", "organize")


RUN = f"""with b as ({ONE_BOOK}), e as (select book_hash, case when mode = 'organize' and file_count > 1 then 'convert' else mode end as mode, file_count = 1 as simple from b),
m as (select 'convert' as mode, {STAGE_LIST} as st union all select 'enrich', ['asin', 'metadata', 'organize', 'cleanup'] union all select 'metadata', ['asin', 'metadata', 'cleanup'] union all select 'organize', ['asin', 'metadata', 'organize']),
r as (select book_hash, case when simple then list_filter(st, lambda x: x not in ('organize', 'archive')) else st end as st from e join m using (mode)),
done as (select book_hash, case when max(case when status = 'completed' then 1 else 0 end) = 1 then 8 when min(error_stage) is not null then list_position({STAGE_LIST}, min(error_stage)) - 1 else 3 end as n from books group by book_hash)"""


def _statuses(s, d) -> DataFrame:
    """book_hash, stage, status as far as a book has come: all stages, those before its failed one, or the first three."""
    names = F.array(*[F.lit(x) for x in ("validate", "concat", "convert", "asin", "metadata", "organize", "archive", "cleanup")])
    come = table(s, d, "books").groupBy("book_hash").agg(F.max(F.when(c("status") == "completed", 1).otherwise(0)).alias("all"), F.min("error_stage").alias("failed"))
    n = F.when(c("all") == 1, 8).when(c("failed").isNotNull(), F.array_position(names, c("failed")) - 1).otherwise(3)
    return come.select("book_hash", n.alias("n"), F.posexplode(names).alias("i", "stage")).select("book_hash", "stage", F.when(c("i") < c("n"), "completed").otherwise("pending").alias("status"))


def _files(books: DataFrame) -> DataFrame:
    return books.select("book_hash", F.concat("source_path", F.lit("/"), F.when(c("file_count") > 1, "part1.mp3").otherwise("book.m4b")).alias("path"))


def _run_plan(s, d, force: bool) -> DataFrame:
    b = _books(s, d)
    books = b.select("book_hash", "mode", F.when(c("file_count") == 1, "simple").otherwise("normal").alias("level"))
    return G.run_plan(books, _statuses(s, d), _files(b), force)


@query(RUN + f" select book_hash, (i - 1)::int as ord, st[i] as stage, case when list_position({STAGE_LIST}, st[i]) <= n then 'skip' else 'run' end as action from r join done using (book_hash), range(1, 9) t(i) where i <= len(st)")
def run_plan(s, d):
    return _run_plan(s, d, False)


@query(RUN + " select book_hash, (i - 1)::int as ord, st[i] as stage, 'run' as action from r, range(1, 9) t(i) where i <= len(st)")
def run_plan_forced(s, d):
    return _run_plan(s, d, True)


@query(RUN + f""", st as (select book_hash, unnest({STAGE_LIST}) as stage, unnest(range(1, 9)) as i from b), x as (select st.book_hash, stage, codec, chapter_count, file_count, b.source_path from st join done using (book_hash) join b using (book_hash) where i <= n)
select book_hash, stage, case stage when 'validate' then coalesce(file_count, 0) < 2 when 'concat' then chapter_count is null when 'convert' then codec is null or codec <> 'aac' when 'metadata' then codec is not null and codec <> 'aac' else false end as stale from x""")
def stale_stages(s, d):
    b = _books(s, d)
    out = b.select("book_hash", F.when(c("codec").isNotNull(), F.concat(c("book_hash"), F.lit(".m4b"))).alias("output_file"))
    artifacts = b.where("file_count >= 2").select("book_hash", F.lit("audio_files.txt").alias("name")).unionByName(b.where("chapter_count is not null").select("book_hash", F.lit("files.txt").alias("name")))
    existing = b.where("codec = 'aac'").select(F.concat(c("book_hash"), F.lit(".m4b")).alias("path"))
    return G.stale(_statuses(s, d).join(out, "book_hash"), artifacts, existing)


@query("select author as item, (sum(size_bytes) * 3)::bigint as needed, sum(size_bytes) * 3 <= 5000000000 as ok from library_entries group by author")
def disk_headroom(s, d):
    return G.headroom(table(s, d, "library_entries").select(c("author").alias("item"), c("size_bytes").alias("size")), F.lit(5_000_000_000))


@query(f"""with b as ({ONE_BOOK}) select book_hash, case when cover_art_size is null then 'missing' when cover_art_size = 0 then 'empty' when coalesce(codec, '') <> 'aac' then 'codec' when coalesce(position('k' in bitrate), 0) = 0 then 'container'
when file_count > 1 and coalesce(chapter_count, -1) <> file_count then 'chapters' end as failure from b""")
def output_checks(s, d):
    container = F.when(c("bitrate").contains("k"), "mov,mp4")
    return _books(s, d).select("book_hash", G.output_failure(c("cover_art_size"), c("codec"), container, c("chapter_count"), c("file_count")).alias("failure"))


@query("select mode, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) as total from books group by mode")
def batch_counts(s, d):
    return G.batch_counts(table(s, d, "books"), "mode")


@query("select distinct trigger_id, book_paths as path from queue_triggers where lower(regexp_extract(book_paths, '\\.([^./]+)$', 1)) in ('mp3', 'm4a', 'flac', 'ogg', 'wma')")
def convertible_files(s, d):
    kinds = F.array_except(F.array(*map(F.lit, ("mp3", "m4a", "m4b", "flac", "ogg", "wma"))), F.array(F.lit("m4b")))
    return table(s, d, "queue_triggers").where(F.array_contains(kinds, P.suffix_of(c("book_paths")))).select("trigger_id", c("book_paths").alias("path")).distinct()


@query("select book_hash, octet_length(cover_art) as bytes, octet_length(cover_art) = cover_art_size as right_size, coalesce(starts_with(hex(cover_art), 'FFD8FF'), false) as jpeg from books where cover_art is not null group by all")
def cover_blobs(s, d):
    b = table(s, d, "books").where("cover_art is not null")
    return b.select("book_hash", F.octet_length("cover_art").cast("bigint").alias("bytes"), (F.octet_length("cover_art") == c("cover_art_size")).alias("right_size"), scan.is_jpeg(c("cover_art")).alias("jpeg")).distinct()


# files and names

@query("""with f as (select distinct path, size_bytes, array_to_string(string_split(path, '/')[1:-2], '/') as book from library_entries)
select book, arg_min(path, struct_pack(k := case when lower(path) like '%.m4b' then 0 else 1 end, s := case when lower(path) like '%.m4b' then -size_bytes else 0 end, p := string_split(path, '/'))) as path
from f where regexp_matches(lower(path), '\\.(mp3|m4a|m4b|flac|ogg|wma)$') group by book""")
def audio_choice(s, d):
    e = table(s, d, "library_entries").select(P.parent_of(c("path")).alias("book"), "path", c("size_bytes").alias("size"))
    return R.audio_file(e.distinct())


@query("""with b as (select distinct book_hash, case when file_count > 1 then book_hash || '.m4b' end as converted, case when codec = 'aac' then book_hash || '.tagged.m4b' end as tagged, source_path from books),
x as (select *, parsed as ok from b, (select 1 as parsed)) select book_hash as book, case when tagged is not null then tagged when converted is not null and left(book_hash, 1) < '8' then converted else source_path || '/1.mp3' end as path from x""")
def source_choice(s, d):
    b = table(s, d, "books").select("book_hash", F.when(c("codec") == "aac", F.concat("book_hash", F.lit(".tagged.m4b"))).alias("tagged"), F.when(c("file_count") > 1, F.concat("book_hash", F.lit(".m4b"))).alias("converted"), "source_path").distinct()
    own = b.select(c("book_hash").alias("book"), F.concat("source_path", F.lit("/1.mp3")).alias("path"), F.lit(1).alias("size"))
    there = b.select(c("tagged").alias("path")).unionByName(b.where("left(book_hash, 1) < '8'").select(c("converted").alias("path")))
    return R.source_file(b.select(c("book_hash").alias("book"), "tagged", "converted"), own, there)


@query("""with f as (select array_to_string(string_split(path, '/')[1:-2], '/') as book, arg_min(path, string_split(path, '/')) as path from library_entries group by 1),
t as (select book, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]+$', ''), '\\s+-\\s+[a-f0-9]{16}$', ''), '^[0-9]{4}\\s*-\\s*', ''), ' ' || chr(9)) as title from f)
select book, case when lower(title) in ('file', 'mp3', 'audiobook', 'audio', 'book', 'track', 'output', 'part1', 'part2', 'part 1', 'part 2', 'disc1', 'disc2') or regexp_matches(title, '^[0-9]+$') then '' else title end as title from t""")
def title_of_files(s, d):
    return R.title_of_files(table(s, d, "library_entries").select(P.parent_of(c("path")).alias("book"), "path"))


@query("""with s as (select distinct library, array_to_string(string_split(path, '/')[2:-2], '/') as dir, regexp_extract(path, '[^/]+$') as name from library_entries)
select s.dir, s.name from s where library = 'source' and exists (select 1 from (select distinct array_to_string(string_split(path, '/')[1:-2], '/') as dir, regexp_extract(path, '[^/]+$') as name from library_entries where library = 'target') t where t.dir = s.dir and t.name = s.name)""")
def registered_files(s, d):
    e = table(s, d, "library_entries")
    parts = P.parts(P.parent_of(c("path")))
    source = e.where("library = 'source'").select(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("dir"), P.name_of(c("path")).alias("name")).distinct()
    return O.registered(source, e.where("library = 'target'").select(P.parent_of(c("path")).alias("dir"), P.name_of(c("path")).alias("name")))


@query("""with m as (select author, title, min(norm_title) as n from library_entries where library = 'target' group by all), s as (select distinct author, title from library_entries where library = 'source')
select author as dir, title as name, coalesce(m.n, title) as dest_name from s left join m using (author, title)""")
def renamed_files(s, d):
    e = table(s, d, "library_entries")
    names = e.where("library = 'target'").select(c("author").alias("dir"), c("title").alias("name"), c("norm_title").alias("to"))
    return O.renamed(e.where("library = 'source'").select(c("author").alias("dir"), c("title").alias("name")).distinct(), names)


@query("select entry_id, row_number() over (partition by norm_title order by entry_id) > 1 and norm_title is not null as repeated from library_entries")
def batch_repeats(s, d):
    return O.first_in_batch(table(s, d, "library_entries").select("entry_id", "norm_title"), "norm_title", "entry_id").select("entry_id", "repeated")


@query("""with b as (select distinct book_hash, parsed_series as s, split_part(parsed_title, ' ', 1) as o from books where parsed_series is not null and parsed_title is not null), r as (select *, regexp_replace(substr(s, length(o) + 1), '^[:_ \\-]+', '') as rest from b)
select book_hash, case when o <> '' and starts_with(lower(s), lower(o)) and rest <> '' then rest else s end as series from r""")
def series_override(s, d):
    b = table(s, d, "books").where("parsed_series is not null and parsed_title is not null").select("book_hash", "parsed_series", F.split("parsed_title", " ")[0].alias("o")).distinct()
    return b.select("book_hash", O.series_without(c("parsed_series"), c("o")).alias("series"))


@query("select array_to_string(string_split(path, '/')[1:-2], '/') as folder, count(*) as files from library_entries where len(string_split(path, '/')) >= 3 group by 1")
def book_folders(s, d):
    return L.book_folders(table(s, d, "library_entries"))


# resolution

@query("select doc_id, case when p between 1 and 3 then p end as pick from (select doc_id, try_cast(regexp_extract(text, '[0-5]') as int) as p from documents)")
def chosen_number(s, d):
    return table(s, d, "documents").select("doc_id", R.chosen_number(c("text"), F.lit(3)).alias("pick"))


@query(f"""with b as ({ONE_BOOK}), k as (select asin, case when min(provider) = 'primary' and count(*) = 1 then 'valid' when count(*) = 1 then 'unreachable' else 'invalid' end as state from catalog_raw where asin is not null group by asin),
x as (select book_hash as item, 1 as rank, 'manual' as source, upper(trim(parsed_asin)) as asin from b where file_count > 2 union all select book_hash, 3, 'audible_search', parsed_asin from b),
y as (select x.*, k.state from x left join k using (asin) where regexp_matches(asin, '^[A-Z0-9]{{10}}$')), l as (select item, bool_or(state = 'unreachable') as lost from y group by item),
u as (select y.*, case when state = 'valid' then rank when coalesce(lost, false) and rank = 1 then rank + 10 end as use from y join l using (item)), m as (select item, min(struct_pack(u := use, a := asin, s := source)) as b from u where use is not null group by item)
select item, b.a as asin, b.s as source from m""")
def discovered_ids(s, d):
    items = _books(s, d).select(c("book_hash").alias("item"), F.lit(None).cast("string").alias("override"), F.when(c("file_count") > 2, c("parsed_asin")).alias("marker"), P.name_of(c("source_path")).alias("folder"), c("parsed_asin").alias("searched"))
    known = table(s, d, "catalog_raw").where("asin is not null").groupBy("asin").agg(F.min("provider").alias("p"), F.count("*").alias("n"))
    return R.discovered_ids(items, known.select("asin", F.when((c("p") == "primary") & (c("n") == 1), "valid").when(c("n") == 1, "unreachable").otherwise("invalid").alias("state")))


@query(f"""with b as ({ONE_BOOK}), p as (select asin, provider, payload from (select *, case when json_valid(payload) then payload end as ok from catalog_raw) where ok is not null),
r as (select asin, provider, try_cast(payload->>'$.chapters.runtimeLengthMs' as bigint) as ms from p where coalesce(json_array_length(payload, '$.chapters.chapters'), 0) > 0), x as (select asin, min(struct_pack(k := case when provider = 'primary' then 0 else 1 end, p := provider, ms := ms)) as r from r where asin is not null group by asin)
select book_hash as book, x.r.p as provider, case when x.r is null then 'none' when x.r.ms is null then 'no_runtime' when x.r.ms > 0 and abs(total_duration - x.r.ms / 1000) / (x.r.ms / 1000) * 100 <= 5 then 'import' else 'mismatch' end as action from b left join x on x.asin = b.parsed_asin""")
def chapter_import(s, d):
    g = lambda p: F.get_json_object("payload", p)
    raw = table(s, d, "catalog_raw").where(F.try_parse_json("payload").isNotNull() & c("asin").isNotNull())
    records = raw.select("asin", F.when(c("provider") == "primary", 0).otherwise(1).alias("rank"), "provider", g("$.chapters.runtimeLengthMs").try_cast("bigint").alias("runtime_ms"), F.coalesce(F.json_array_length(g("$.chapters.chapters")), F.lit(0)).alias("n_chapters"))
    return R.chapter_import(_books(s, d).select(c("book_hash").alias("book"), c("parsed_asin").alias("asin"), c("total_duration").alias("duration_s")), records)


@query("select asin as book, record_id as place from (select *, row_number() over (partition by asin order by record_id) as rn from catalog_raw where asin is not null) where rn <= 2")
def first_results(s, d):
    raw = table(s, d, "catalog_raw").where("asin is not null").select(c("asin").alias("book"), c("record_id").alias("place"), "asin")
    return R.first_results(raw, 2).select("book", "place")


@query()
def metadata_resolution(s, d):
    """Every book's metadata from its path, tags and catalog records, brought to the library's authors."""
    b = _books(s, d)
    path = P.parse_columns(b.select(c("book_hash").alias("book"), "source_path"), "source_path").select("book", P.stem_of(c("source_path")).alias("stem"), "author", "title", "series", "position")
    tags = b.select(c("book_hash").alias("book"), T.author_tag(c("parsed_author")).alias("tag_author"), c("parsed_title").alias("tag_title"))
    products = N.products(table(s, d, "catalog_raw"))
    found = b.where("parsed_asin is not null").select(c("book_hash").alias("book"), c("parsed_asin").alias("asin")).join(products, "asin")
    none = F.lit("")
    candidates = found.select("book", c("record_id").alias("place"), "asin", "title", "authors", none.alias("series"), none.alias("position"), none.alias("narrator"))
    return R.resolved(path, tags, candidates, table(s, d, "author_ref").select(c("name").alias("author")), L.latest_alias(table(s, d, "author_aliases")))


@query(f"""with b as ({ONE_BOOK}) select book_hash as book, parsed_series as series, parsed_position as position, parsed_author as author, parsed_narrator || ' / ' || coalesce(parsed_year, 'none') as genre_path, 'https://www.audible.com/pd/' || parsed_asin as url, parsed_asin is not null as has_primary,
false as adult from b where parsed_title is not null and parsed_narrator is not null""")
def normalized_products(s, d):
    name = lambda x: F.struct(x.alias("name"))
    b = _books(s, d).where("parsed_title is not null and parsed_narrator is not null")
    product = F.struct(
        c("parsed_asin").alias("asin"), c("parsed_title").alias("title"), F.array(F.struct(c("parsed_asin").alias("asin"), c("parsed_author").alias("name"))).alias("authors"),
        F.array(F.struct(c("parsed_series").alias("title"), c("parsed_position").alias("sequence"))).alias("series"), F.array(F.struct(F.array(name(c("parsed_narrator")), name(F.coalesce("parsed_year", F.lit("none")))).alias("ladder"))).alias("category_ladders"),
    )
    out = R.normalized_products(b.select(c("book_hash").alias("book"), F.to_json(F.struct(product.alias("product"))).alias("json")), "book")
    g = lambda p: F.get_json_object("record", p)
    return out.select("book", g("$.seriesPrimary.name").alias("series"), g("$.seriesPrimary.position").alias("position"), g("$.authors[0].name").alias("author"), g("$.genrePath").alias("genre_path"), g("$.audibleUrl").alias("url"), g("$.primaryAuthor.asin").isNotNull().alias("has_primary"), (g("$.isAdult") == "true").alias("adult"))


# organizing

CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[/\\\\:\"*?<>|;]+', '_', 'g'), '^[._]+', ''), '[._]+$', ''), '__+', '_', 'g')"
DEST = f"""k as (select *, {CLEAN.format("coalesce(parsed_author, '')")} as ca, {CLEAN.format("coalesce(parsed_series, '')")} as cs, case when coalesce(parsed_title, '') = '' then 'Unknown' else {CLEAN.format("coalesce(parsed_title, '')")} end as ct, coalesce(parsed_position, '') as po from b),
z as (select *, case when lower(cs) = lower(ct) then '' else cs end as s2, regexp_matches(po, '^[0-9]{{4}}$') as yr from k),
dst as (select *, concat_ws('/', case when ca <> '' then ca else '_unsorted' end, nullif(s2, ''), case when s2 <> '' and po <> '' and not yr then 'Book ' || po || ' - ' || ct else ct end, case when yr and s2 = '' then po end) as dest from z)"""
INDEX = "ix as (select distinct array_to_string(string_split(path, '/')[1:-2], '/') as dest, regexp_extract(path, '[^/]+$') as name from library_entries where library = 'target')"


def _manifest(s, d) -> DataFrame:
    fields = ("author", "title", "series", "position", "narrator", "year", "description")
    return _books(s, d).select(c("book_hash").alias("book"), "source_path", "file_count", *[c(f"parsed_{f}").alias(f) for f in fields])


def _index(s, d) -> DataFrame:
    return table(s, d, "library_entries").where("library = 'target'").select(P.parent_of(c("path")).alias("dir"), P.name_of(c("path")).alias("name"))


NAMED = f"""q as (select *, {CLEAN.format("base")} as st, '(?i)^' || regexp_replace({CLEAN.format("sr")}, '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g') || '\\s*(?:[:_,\\-]+\\s*(?:Book\\s+[0-9.]+\\s*-\\s*)?|Book\\s+[0-9.]+\\s*-\\s*)' as pat from f),
n as (select *, case when sr <> '' and lower(base) <> lower(sr) and trim(regexp_replace(st, pat, '')) <> '' then trim(regexp_replace(st, pat, '')) else st end as st2 from q)"""


@query(f"""with f as (select distinct book_hash, parsed_title as base, coalesce(parsed_series, '') as sr, coalesce(parsed_position, '') as po from books where parsed_title <> ''), {NAMED}
select book_hash, case when sr <> '' and po <> '' then 'Book ' || po || ' - ' else '' end || regexp_replace(st2, '^Book\\s+[0-9.]+\\s*-\\s*', '') || '.m4b' as name from n""")
def library_filename(s, d):
    e = lambda x: F.coalesce(c(x), F.lit(""))
    return table(s, d, "books").where("parsed_title <> ''").select("book_hash", C.file_name(e("parsed_title"), e("parsed_series"), e("parsed_position")).alias("name")).distinct()


@query(f"""with b as ({ONE_BOOK}), {DEST}, {INDEX}, f as (select *, case when coalesce(trim(parsed_title), '') <> '' then parsed_title else '01' end as base, coalesce(parsed_series, '') as sr from dst),
{NAMED},
p as (select *, case when sr <> '' and po <> '' then 'Book ' || po || ' - ' else '' end || regexp_replace(st2, '^Book\\s+[0-9.]+\\s*-\\s*', '') || case when file_count > 1 then '.mp3' else '.m4b' end as name, row_number() over (partition by regexp_extract(rtrim(source_path, '/'), '[^/]+$') order by book_hash) as rn from n)
select book_hash as book, dest, p.name, case when file_count is null then 'no_file' when rn > 1 then 'repeated' when ix.name is not null then 'exists' else 'copy' end as action from p left join ix using (dest, name)""")
def organize_plan(s, d):
    b = _manifest(s, d).withColumns({"seq": c("book"), "source_dir": c("source_path"), "source_name": F.when(c("file_count").isNotNull(), F.when(c("file_count") > 1, "01.mp3").otherwise("01.m4b"))})
    return O.organize_plan(b, _index(s, d))


@query()
def organize_plan_reuse(s, d):
    """The plan with folders of the library, and of earlier books of the batch, reused where they compare equal or near."""
    b = _manifest(s, d).withColumns({"seq": c("book"), "source_dir": c("source_path"), "source_name": F.when(c("file_count").isNotNull(), F.when(c("file_count") > 1, "01.mp3").otherwise("01.m4b"))})
    return O.organize_plan(b, _index(s, d), folders=scan.index_tables(table(s, d, "library_entries").where("library = 'target'"))["folders"].select("parent", "actual"))


@query(f"""with b as ({ONE_BOOK}), {DEST}, {INDEX}, f as (select dest, min(name) as name from ix where lower(name) like '%.m4b' group by dest)
select book_hash as book, dest, f.name, coalesce(parsed_author, '') as artist, case when coalesce(parsed_series, '') <> '' and po <> '' then parsed_series || ', Book ' || po when coalesce(parsed_series, '') <> '' then parsed_series else parsed_title end as album,
nullif(parsed_narrator, '') as composer, nullif(parsed_year, '') as date, nullif(parsed_series, '') as grouping from dst join f using (dest) where coalesce(parsed_title, '') <> ''""")
def retag_plan(s, d):
    out = O.retag_plan(_manifest(s, d), _index(s, d))
    return out.select("book", "dest", "name", *[c("tags")[k].alias(k) for k in ("artist", "album", "composer", "date", "grouping")])


@query(f"""with b as ({ONE_BOOK}), x as (select book_hash as book, 'desc.txt' as name, parsed_description as text from b union all select book_hash, 'reader.txt', parsed_narrator from b) select * from x where regexp_matches(text, '\\S')""")
def companion_files(s, d):
    return O.companion_files(_manifest(s, d))


@query()
def reuse_in_order(s, d):
    """Series folders of all books in one batch, in order of their hash; folders of earlier books are reused."""
    b = table(s, d, "books").where("parsed_author is not null and parsed_series is not null").groupBy(c("parsed_author").alias("parent"), c("parsed_series").alias("desired")).agg(F.min("book_hash").alias("seq"))
    e = table(s, d, "library_entries").where("library = 'target'").select(c("author").alias("parent"), F.element_at(P.parts(c("path")), 2).alias("actual"))
    return O.reuse_in_order(b, e)


# reports

@query()
def library_diff_cascade(s, d):
    """Equal titles of all source books; of the rest, those whose file's id is divisible by 20 are searched for among all target titles."""
    e = table(s, d, "library_entries")
    return L.library_diff_cascade(e, e.where("entry_id % 20 = 0").select("path"))


@query("""with p as (select string_split(path, '/') as p, title from library_entries), a as (select distinct p[1] as a from p where len(p) >= 2), w as (select a, regexp_replace(lower(coalesce(list_filter(regexp_split_to_array(regexp_split_to_array(a, ',\\s*|\\s+and\\s+')[-1], '\\s+'), lambda x: x <> '')[-1], '')), '[.,;:]+$', '') as n from a where a <> '')
select 'authors' as what, count(distinct p[1]) as n from p where len(p) >= 2 union all select 'folders', count(distinct array_to_string(p[1:-2], '/')) from p where len(p) >= 3 union all select 'files', count(*) from p
union all select 'author variations', count(*) from (select n from w where n <> '' group by n having count(*) > 1)""")
def verify_library(s, d):
    return L.verify_counts(table(s, d, "library_entries"))


@query("""with l as (select distinct path from library_entries), r as (select list_reduce(list_transform([min(string_split(path, '/')), max(string_split(path, '/'))], lambda x: x), lambda a, b: list_transform(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]), lambda i: a[i])) as root from l)
select array_to_string(root, '/') as root, (select count(*) from l) as destinations from r""")
def verify_log(s, d):
    lines = table(s, d, "library_entries").select(F.explode(F.array(F.concat(F.lit("    -> "), c("path")), F.concat(F.lit("  [copy] "), c("path")))).alias("value"))
    found = scan.destinations(lines).distinct()
    return L.common_root(found).crossJoin(found.agg(F.count("*").alias("destinations")))


@query("select k, any_value(v) as v from (select regexp_extract(line, '^\\s*(?:export\\s+)?([A-Za-z_][A-Za-z0-9_]*)=', 1) as k, trim(regexp_extract(line, '=(.*)$', 1), ' ''\"') as v from (select 'KEY_' || left(book_hash, 6) || '=\"' || mode || '\"' as line from books group by all)) group by k")
def env_settings(s, d):
    lines = table(s, d, "books").select(F.explode(F.array(F.concat(F.lit("KEY_"), F.left(c("book_hash"), F.lit(6)), F.lit('="'), c("mode"), F.lit('"')), F.lit("# NO=1"), F.lit("X=${HOME}/x"), F.lit("  "))).alias("value")).distinct()
    return scan.env_settings(lines).select(c("key").alias("k"), c("value").alias("v"))


@query("""select entry_id, row_number() over (order by lower(author), author, lower(title), title, entry_id) as place from library_entries""")
def author_title_order(s, d):
    return sinks.numbered(table(s, d, "library_entries"), F.lower("author"), "author", F.lower("title"), "title", "entry_id").select("entry_id", c("rank").alias("place"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
