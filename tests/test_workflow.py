import json
import random

from pyspark.sql import functions as F

from shelfwright.operators import library as L
from shelfwright.operators import organize as O
from shelfwright.operators import resolve as R
from shelfwright.operators import stages as G
from shelfwright.sources import scan, sinks


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# stages

def test_set_stage(spark):
    st = spark.createDataFrame([("h", "asin", "pending", None), ("h", "organize", "completed", 5), (None, "asin", "pending", None)], "book_hash string, stage string, status string, completed_at int")
    ch = spark.createDataFrame([("h", "asin", "failed", 3), ("h", "asin", "completed", 7), ("h", "asin", "completed", 7), ("h", "organize", "running", 9), ("x", "asin", "failed", 1), (None, "asin", "failed", 1)], "book_hash string, stage string, status string, ts int")
    assert rows(G.set_stage(st, ch), "book_hash", "stage", "status", "completed_at") == [("h", "asin", "completed", 7), ("h", "organize", "running", None), (None, "asin", "pending", None)]
    assert rows(G.set_stage(st, ch.where("false")), "stage", "completed_at") == [("asin", None), ("asin", None), ("organize", 5)]


def test_nested_update(spark):
    base = spark.createDataFrame([("a", "T", 1, "old"), ("b", "U", 2, "old")], "k string, title string, n int, updated_at string")
    ch = spark.createDataFrame([("a", {"title": None, "n": "5", "nothing": "x"}), ("z", {"title": "y"})], "k string, metadata map<string,string>")
    new, missing = G.nested_update(base, ch, "k", F.lit("now"))
    assert new.columns == base.columns and rows(new, "k", "title", "n", "updated_at") == [("a", None, 5, "now"), ("b", "U", 2, "old")]
    assert rows(missing, "k") == [("z",)]


def test_listed(spark):
    b = spark.createDataFrame([("a", "/a", "convert", "failed", 1), ("b", "/b", "convert", None, 1)], "book_hash string, source_path string, mode string, status string, x int")
    assert G.listed(b).count() == 2 and rows(G.listed(b, "failed", ""), "book_hash") == [("a",)] and G.listed(b, mode="organize").count() == 0


def test_run_plan(spark):
    books = spark.createDataFrame([("a", "organize", "normal"), ("b", "organize", "simple"), ("c", "nothing", "normal")], "book_hash string, mode string, level string")
    files = spark.createDataFrame([("a", "x/1.mp3"), ("b", "x/1.mp3"), ("b", "x/1.m4b"), ("b", None)], "book_hash string, path string")
    st = spark.createDataFrame([("a", "validate", "completed"), ("b", "asin", "completed")], "book_hash string, stage string, status string")
    got = rows(G.run_plan(books, st, files), "book_hash", "ord", "stage", "action")
    assert [x for x in got if x[0] == "b"] == [("b", 0, "asin", "skip"), ("b", 1, "metadata", "run")]
    assert len([x for x in got if x[0] == "a"]) == 8 and ("a", 0, "validate", "skip") in got and not [x for x in got if x[0] == "c"]
    assert G.run_plan(books, st, files, force=True).where("action = 'skip'").count() == 0


def test_forced_run_needs_no_status(spark):
    """A forced run joins no statuses, which are eight rows a book and whose size Spark takes for that of one: it sent them all to every task."""
    books, st, files = (spark.createDataFrame([], x) for x in ("book_hash string, mode string, level string", "book_hash string, stage string, status string", "book_hash string, path string"))
    joins = lambda force: G.run_plan(books, st, files, force)._jdf.queryExecution().analyzed().toString().count("Join ")
    assert (joins(False), joins(True)) == (2, 1)


def test_stale(spark):
    st = spark.createDataFrame([("a", s, "completed", o) for s, o in (("validate", None), ("concat", None), ("convert", ""), ("metadata", ""), ("asin", None))] + [("b", "convert", "completed", "/o"), ("b", "metadata", "completed", "/gone"), ("b", "concat", "pending", None)], "book_hash string, stage string, status string, output_file string")
    art = spark.createDataFrame([("a", "files.txt"), ("a", "files.txt")], "book_hash string, name string")
    got = rows(G.stale(st, art, spark.createDataFrame([("/o",)], "path string")), "book_hash", "stage", "stale")
    assert got == [("a", "asin", False), ("a", "concat", False), ("a", "convert", True), ("a", "metadata", False), ("a", "validate", True), ("b", "convert", False), ("b", "metadata", True)]


def test_checks(spark):
    h = G.headroom(spark.createDataFrame([("a", 10), ("a", None), ("b", 40)], "item string, size bigint"), F.lit(30))
    assert rows(h, "item", "needed", "ok") == [("a", 30, True), ("b", 120, False)]
    o = spark.createDataFrame([(None, "aac", "mov", 1, 1), (0, "aac", "mov", 1, 1), (5, None, "mov", 1, 1), (5, "aac", None, 1, 1), (5, "aac", "mp4", None, 2), (5, "aac", "mp4", None, 1)], "s int, c string, f string, n int, k int")
    assert [r[0] for r in o.select(G.output_failure(F.col("s"), F.col("c"), F.col("f"), F.col("n"), F.col("k"))).collect()] == ["missing", "empty", "codec", "container", "chapters", None]
    assert rows(G.batch_counts(spark.createDataFrame([("completed",), ("failed",), (None,)], "status string")), "completed", "failed", "total") == [(1, 1, 3)]


# resolution

def test_files_of_books(spark):
    f = spark.createDataFrame([("a", "a/2.m4b", 5), ("a", "a/1.m4b", 5), ("a", "a/0.mp3", 90), ("b", "b/9 x.mp3", 1), ("b", "b/10.mp3", None), ("c", "c/x.txt", 1), ("d", "d/1991 - Title.mp3", 1), ("e", "e/track.mp3", 1)], "book string, path string, size bigint")
    assert rows(R.audio_file(f), "book", "path") == [("a", "a/1.m4b"), ("b", "b/10.mp3"), ("d", "d/1991 - Title.mp3"), ("e", "e/track.mp3")]
    assert rows(R.title_of_files(f), "book", "title") == [("a", ""), ("b", ""), ("d", "Title"), ("e", "")]
    b = spark.createDataFrame([("a", "t", "c"), ("b", "gone", "c"), ("d", "", None), ("z", None, None)], "book string, tagged string, converted string")
    assert rows(R.source_file(b, f, spark.createDataFrame([("t",), ("c",)], "path string")), "book", "path") == [("a", "t"), ("b", "c"), ("d", "d/1991 - Title.mp3")]


def test_resolved(spark):
    books = spark.createDataFrame([("a", "glass tide", "Pa", "glass tide", "", ""), ("b", "s", "", "other thing", "", "3"), ("c", "file", "", "file", "", "")], "book string, stem string, author string, title string, series string, position string")
    tags = spark.createDataFrame([("a", "Tag Author", "x"), ("c", "Tag Author", "Tag Title")], "book string, tag_author string, tag_title string")
    cand = spark.createDataFrame(
        [("a", 0, "A1", "glass tides", ["Cat Author"], "S", "2", "N"), ("a", 1, "A2", "unlike", ["X"], "", "", ""), ("a", 2, "A1", "glass tide", ["Late"], "", "", ""), ("b", 0, "B1", "zzz", ["Cat Author"], "S", "1", "N")],
        "book string, place int, asin string, title string, authors array<string>, series string, position string, narrator string",
    )
    got = {r["book"]: r for r in R.resolved(books, tags, cand).collect()}
    assert got["a"][1:7] == ("Cat Author", "glass tide", "S", "2", "A1", "N") and got["a"]["conflict"]
    assert got["b"][1:7] == ("", "other thing", "", "3", "", "") and got["c"][1:4] == ("Tag Author", "Tag Title", "")
    authors, aliases = spark.createDataFrame([("Catherine Author",), ("Tag Author",)], "author string"), spark.createDataFrame([("Cat Author", "Catherine Author")], "variant string, canonical string")
    assert rows(R.resolved(books, tags, cand, authors, aliases), "book", "author") == [("a", "Catherine Author"), ("b", ""), ("c", "Tag Author")]
    assert R.resolved(books.where("false"), tags, cand).count() == 0 and R.resolved(books, tags, cand.where("false")).where("asin <> ''").count() == 0


def test_replies_come_first(spark):
    books = spark.createDataFrame([("a", "s", "Pa", "tide", "Ser", ""), ("b", "s", "Pb", "sea", "", "")], "book string, stem string, author string, title string, series string, position string")
    tags = spark.createDataFrame([("a", "Tag", "x"), ("b", "Tag", "x")], "book string, tag_author string, tag_title string")
    none = spark.createDataFrame([], "book string, place int, asin string, title string, authors array<string>, series string, position string, narrator string")
    said = spark.createDataFrame([("a", None, "The Tide", " ", "2"), ("b", "", None, None, None)], "book string, author string, title string, series string, position string")
    assert rows(R.resolved(books, tags, none, replies=said), "book", "author", "title", "series", "position") == [("a", "Pa", "The Tide", "Ser", "2"), ("b", "Tag", "sea", "", "")]
    c = spark.createDataFrame([("a", p, f"A{p}") for p in (3, 1, 2)] + [("b", 9, "B")], "book string, place int, asin string")
    assert rows(R.first_results(c, 2), "asin") == [("A1",), ("A2",), ("B",)] and R.first_results(c).count() == 4


def test_best_candidate_threshold(spark):
    books = spark.createDataFrame([("a", "abcdefghij")], "book string, title string")
    c = lambda t: spark.createDataFrame([("a", 0, "X", t, [])], "book string, place int, asin string, title string, authors array<string>")
    assert R.best_candidate(books, c("abcdefghij")).count() == 1  # 60 + 10 for the first place
    assert R.best_candidate(books, c("abcdefghzz")).count() == 0  # 48 + 10


def test_chosen_number(spark):
    v = spark.createDataFrame([("2",), ("Result 7, no: 3!",), ("0",), ("5",), ("none",), (None,)], "r string")
    assert [r[0] for r in v.select(R.chosen_number(F.col("r"), F.lit(4))).collect()] == [2, 3, None, None, None, None]


def test_discovered_ids(spark):
    ok, lost, bad = "B0AAAAAAAA", "B0LLLLLLLL", "B0XXXXXXXX"
    known = spark.createDataFrame([(ok, "valid"), (lost, "unreachable"), (bad, "invalid")], "asin string, state string")
    items = spark.createDataFrame(
        [("a", " b0llllllll ", ok, None, None), ("b", None, bad, f"x [{ok}]", None), ("c", None, lost, None, ok), ("d", None, bad, f"[{lost}]", None), ("e", "short", None, None, None), ("f", bad, None, None, lost)],
        "item string, override string, marker string, folder string, searched string",
    )
    got = rows(R.discovered_ids(items, known), "item", "asin", "source")
    assert got == [("a", lost, "cli_override"), ("b", ok, "folder_regex"), ("c", ok, "audible_search"), ("d", bad, "manual")]


def test_chapter_import(spark):
    books = spark.createDataFrame([("a", "A", 100.0), ("b", "B", 100.0), ("c", "C", 100.0), ("d", None, 100.0), ("e", "A", None)], "book string, asin string, duration_s double")
    rec = spark.createDataFrame([("A", 1, "second", 1, 3), ("A", 0, "first", 103_000, 2), ("B", 0, "first", 103_000, 0), ("B", 1, "second", 120_000, 2), ("C", 0, "first", None, 2)], "asin string, rank int, provider string, runtime_ms bigint, n_chapters int")
    assert rows(R.chapter_import(books, rec), "book", "provider", "action") == [("a", "first", "import"), ("b", "second", "mismatch"), ("c", "first", "no_runtime"), ("d", None, "none"), ("e", "first", "mismatch")]


def test_normalized_products(spark):
    p = {"product": {"asin": "A", "title": "T", "authors": [{"name": "X"}, {"asin": "", "name": "Z"}, {"asin": "Q", "name": "Y"}], "category_ladders": [{"ladder": [{"name": "b"}, {"name": "a"}]}, {"ladder": [{"name": "a"}]}], "product_images": {"500": "s", "1000": "l"}, "content_metadata": {"chapter_info": {"chapters": [{"title": "1", "length_ms": 5}]}}}}
    df = spark.createDataFrame([(1, json.dumps(p)), (2, "{}"), (3, "no json"), (4, None), (5, '{"product": {"asin": "B"}}')], "id int, json string")
    got = {r["id"]: json.loads(r["record"]) for r in R.normalized_products(df, "id").collect()}
    assert set(got) == {1, 5}
    a = got[1]
    assert a["genres"] == [{"name": "a"}, {"name": "b"}] and a["genrePath"] == "b / a" and a["image"] == "l" and a["primaryAuthor"] == {"asin": "Q", "name": "Y"} and a["seriesPrimary"] is None
    assert a["chapters"]["isAccurate"] is True and a["chapters"]["chapters"][0]["lengthMs"] == 5 and got[5]["chapters"] is None and got[5]["authors"] == [] and got[5]["isAdult"] is False


# organizing

def test_names_and_maps(spark):
    s = spark.createDataFrame([("Dragon: Lost", "dragon"), ("Dragon", "Dragon"), ("Other", "Dragon"), (None, "x"), ("A", None)], "s string, o string")
    assert [r[0] for r in s.select(O.series_without(F.col("s"), F.col("o"))).collect()] == ["Lost", "Dragon", "Other", None, "A"]
    f = spark.createDataFrame([("d", "a", 1), ("d", "b", 2)], "dir string, name string, size int")
    assert rows(O.registered(f, spark.createDataFrame([("d", "a"), ("d", "a")], "dir string, name string")), "name", "size") == [("a", 1)]
    assert rows(O.renamed(f, spark.createDataFrame([("d", "a", "z"), ("d", "a", "y")], "dir string, name string, to string")), "name", "dest_name") == [("a", "y"), ("b", "b")]
    b = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "seq int, key string")
    assert rows(O.first_in_batch(b, "key", "seq"), "seq", "repeated") == [(1, False), (2, True), (3, False), (4, False)]


def test_organize_plan(spark):
    b = spark.createDataFrame(
        [("a", 1, "in/x", "old.m4b", "Ann Lee", "Tide", "Glass", "2"), ("b", 2, "other/x", "old.mp3", "Ann Lee", "Tide", "Glass", "2"), ("c", 3, "in/y", None, "", "", "", ""), ("d", 4, "in/z", "1991 - Barrayar.m4b", None, None, None, None), ("e", 5, "Ann Lee/Sea", "Sea.m4b", "Ann Lee", "Sea", "", "")],
        "book string, seq int, source_dir string, source_name string, author string, title string, series string, position string",
    )
    ix = spark.createDataFrame([("Ann Lee/Sea", "Sea.m4b")], "dir string, name string")
    got = rows(O.organize_plan(b, ix), "book", "dest", "name", "action")
    assert got[0] == ("a", "Ann Lee/Glass/Book 2 - Tide", "Book 2 - Tide.m4b", "copy") and got[1][3] == "repeated" and got[2][3] == "no_file" and got[3][1:] == ("_unsorted/Unknown", "Barrayar.m4b", "copy") and got[4][3] == "exists"
    again = {r["book"]: r["action"] for r in O.organize_plan(b, ix, reorganize=True).collect()}
    assert again == {"a": "move", "b": "move", "c": "no_file", "d": "move", "e": "ok"}
    assert O.organize_plan(b, ix, override="Zed").where("book = 'a'").first()["dest"].startswith("Zed/")


def test_destinations_reuse_folders(spark):
    b = spark.createDataFrame([("a", 1, "Lee, Ann/The Glass Sea"), ("b", 2, "Lee Ann/Glass Sea"), ("c", 3, "Bob Day/X"), ("d", 4, "bob day/Y/Z")], "book string, seq int, dest string")
    have = spark.createDataFrame([("", "LEE ANN"), ("LEE ANN", "Old")], "parent string, actual string")
    got = dict(rows(O.reused_destination(b, have), "book", "dest"))
    assert got == {"a": "LEE ANN/The Glass Sea", "b": "LEE ANN/The Glass Sea", "c": "Bob Day/X", "d": "Bob Day/Y/Z"}
    assert O.reused_destination(b, have).columns == b.columns


def test_retag_and_companions(spark):
    b = spark.createDataFrame([("a", "Ann Lee", "Sea", "", "", "N", ""), ("b", "Ann Lee", "", "", "", "", ""), ("c", "X", "Y", "", "", "", "")], "book string, author string, title string, series string, position string, narrator string, year string")
    got = O.retag_plan(b, spark.createDataFrame([("Ann Lee/Sea", "z.m4b"), ("Ann Lee/Sea", "a.m4b"), ("X/Y", "a.mp3")], "dir string, name string")).collect()
    assert [(r["book"], r["name"]) for r in got] == [("a", "a.m4b")] and got[0]["tags"] == {"artist": "Ann Lee", "album_artist": "Ann Lee", "album": "Sea", "title": "Sea", "genre": "Audiobook", "media_type": "2", "composer": "N"}
    c = spark.createDataFrame([("a", "text", None), ("b", " ", "N")], "book string, description string, narrator string")
    assert rows(O.companion_files(c), "book", "name", "text") == [("a", "desc.txt", "text"), ("b", "reader.txt", "N")]


def test_reuse_in_order(spark):
    """Against the same done row by row."""
    rng = random.Random(3)
    words = ["the", "glass", "tide", "sea", "of", "north", "a"]
    wanted = sorted({(rng.choice("PQ"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for _ in range(60)})
    rng.shuffle(wanted)
    w = spark.createDataFrame([(p, d, i) for i, (p, d) in enumerate(wanted)], "parent string, desired string, seq int")
    have = spark.createDataFrame([("P", "Glass Tide")], "parent string, actual string")
    pairs = w.select("parent", "desired")
    near = {(r["parent"], r["desired"], r["actual"]) for r in L.near_folders(pairs, pairs.withColumnRenamed("desired", "actual")).collect()}
    first = {(r["parent"], r["desired"]): r["result"] for r in L.folder_reuse(pairs, have).collect() if (r["parent"], r["result"]) == ("P", "Glass Tide")}
    made, want = [], {}
    for p, d in wanted:
        if (p, d) in first:
            want[p, d] = first[p, d]
            continue
        use = next((m for q, m in made if q == p and (p, d, m) in near), None)
        want[p, d] = use or d
        if use is None:
            made.append((p, d))
    got = {(r["parent"], r["desired"]): r["result"] for r in O.reuse_in_order(w, have).collect()}
    assert got == want and len(made) < len(wanted) - len(first)
    assert O.reuse_in_order(w.where("false"), have).count() == 0


# sources, sinks and the difference of libraries

def test_settings_and_numbers(spark):
    v = spark.createDataFrame([("A=1",), ("# B=2",), (" export C = 'x y' ",), ("D=${A}",), ("no line",), ('E="q=r"',), (None,), ("A=0",)], "value string")
    assert rows(scan.env_settings(v), "key", "value") == [("A", "1"), ("C", "x y"), ("E", "q=r")]
    n = spark.createDataFrame([(x,) for x in (5, 3, None, 9)], "x int")
    assert rows(sinks.numbered(n, "x"), "rank", "x") == [(1, None), (2, 3), (3, 5), (4, 9)]
    assert sinks.numbered(n.where("false"), "x").count() == 0


def test_diff_cascade(spark):
    e = spark.createDataFrame(
        [("source", "in/Ann Lee/Glass Tide/Glass Tide.m4b"), ("source", "old/Bob Day/Glass Tide/Glass Tide.m4b"), ("source", "in/Ann Lee/Winter Sea Song/Winter Sea Song.m4b"), ("source", "in/Ann Lee/Nothing Like It/Nothing Like It.m4b"), ("target", "Ann Lee/Glass Tide/Glass Tide.m4b"), ("target", "Ann Lee/Sea Song Winter Tales/Sea Song Winter Tales.m4b")],
        "library string, path string",
    )
    got = rows(L.library_diff_cascade(e), "norm_title", "status", "how")
    assert got == [("glass tide", "matched", "exact"), ("nothing like it", "missing", None), ("winter sea song", "matched", "fuzzy")]  # the title that repeats stands once
    some = L.library_diff_cascade(e, spark.createDataFrame([("in/Ann Lee/Nothing Like It/Nothing Like It.m4b",)], "path string"))
    assert rows(some, "norm_title", "status") == [("glass tide", "matched"), ("nothing like it", "missing"), ("winter sea song", "unsearched")]
    assert L.library_diff_cascade(e.where("library = 'source'")).where("status = 'matched'").count() == 0
