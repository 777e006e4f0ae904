import json

from pyspark.sql import functions as F

from shelfwright.operators import catalog as C
from shelfwright.operators import library as L
from shelfwright.operators import nested as N
from shelfwright.operators import packed as K
from shelfwright.operators import state as St


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# nested records

PAYLOADS = [
    (1, {"asin": "A", "authors": [{"name": "Ann"}, None, {"name": " "}, {"name": "Bob"}], "seriesPrimary": {"name": "S"}, "chapters": [{"title": "1", "chapters": [{"title": "x"}, {}, {"title": "y"}]}, None]}),
    (2, {"product": {"authors": "Ann", "seriesPrimary": "", "chapters": {"isAccurate": True, "chapters": [{"lengthMs": 0}]}}}),
    (3, {"response": {"product": {"authors": json.dumps([{"name": "Ann"}]), "seriesPrimary": [{"name": "S"}, {"name": "T"}], "chapters": json.dumps({"chapters": [{"title": "q"}]})}}}),
    (4, "not json"), (5, None), (6, {"authors": None, "seriesPrimary": {}, "chapters": []}),
]


def raw(spark):
    data = [(i, json.dumps(p) if not isinstance(p, (str, type(None))) else p, "x", 7) for i, p in PAYLOADS]
    return spark.createDataFrame(data + data[:1], "record_id bigint, payload string, child string, node_path int")


def test_nested_found(spark):
    want = [(1, "author", "1"), (1, "author", "4"), (1, "chapter", "1"), (1, "chapter", "1.1"), (1, "chapter", "1.3"), (1, "series", "1"), (2, "author", "1"), (2, "chapter", "1"), (3, "author", "1"), (3, "chapter", "1"), (3, "series", "1"), (3, "series", "2")]
    assert rows(N.found(raw(spark)), "record_id", "child", "node_path") == want


def test_nested_found_needs_identities(spark, monkeypatch):
    """Workers run in other processes, so the digest is replaced where nodes are made here."""
    import pandas as pd

    def objects(payloads):
        one = pd.concat(N._nodes(iter([pd.DataFrame({"record_id": [i for i, _ in payloads], "payload": [p for _, p in payloads]})])))
        return one.groupby(one["object_hash"]).agg(kinds=("child", "nunique"), filled=("filled", "nunique"))

    data = [(i, json.dumps(p)) for i, p in PAYLOADS if isinstance(p, dict)]
    good = objects(data)
    assert (good["kinds"] == 1).all() and (good["filled"] == 1).all()  # an identity tells what it is and whether it is filled
    monkeypatch.setattr(N, "_digest", lambda *_: b"same")
    bad = objects(data)
    assert len(bad) == 1 and bad["filled"].iloc[0] == 2


def test_nested_identities(spark):
    a = N.flat_table(raw(spark), "author")
    assert {r["object_hash"] for r in a.where("name = 'Ann'").collect()}.__len__() == 1  # one object in three records and forms
    assert N.object_store(raw(spark)).where("child = 'author'").count() <= 3 + 1
    c = {r["node_path"]: r for r in N.flat_table(raw(spark), "chapter").where("record_id = 1").collect()}
    assert c["1.1"]["parent_hash"] == c["1"]["object_hash"] and c["1.3"]["ordinal"] == 3 and c["1.1"]["parent_path"] == "1"
    empty = raw(spark).where("false")
    assert N.found(empty).count() == 0 and N.flat_table(empty, "series").count() == 0


# packed values

def items(spark, value, **kw):
    df = spark.createDataFrame([("h", value)], "k string, v string")
    return [r["item"] for r in K.explode_packed(df, "k", "v", **kw).orderBy("pos").collect()]


def test_packed_names(spark):
    for value, want in {
        "A B; C D;": ["A B", "C D"], "Tolvane, Oona; Mirrin, Kofi": ["Tolvane, Oona", "Mirrin, Kofi"], "Tolvane, Oona": ["Tolvane, Oona"], "A B, Jr.": ["A B, Jr."], "A B, C D & E F": ["A B", "C D", "E F"],
        "A B,C D, and E F": ["A B", "C D", "E F"], "A B with C D": ["A B", "C D"], '"A B", C D, "E F, Jr."': ["A B", "C D", "E F, Jr."], '"A ""Al"" B", C D': ['A "Al" B', "C D"], 'A "Al" B': ['A "Al" B'],
        '["A B", "C D"]': ["A B", "C D"], "A B ;; C D": ["A B", "C D"], "A B\nC D": ["A B", "C D"], "A B · C D | E F/G H": ["A B", "C D", "E F", "G H"], "A B, A B": ["A B", "A B"], "": [], None: [], " ; ": [], 'A "B': ['A "B'],
    }.items():
        assert items(spark, value, names=True) == want, value


def test_packed_genres(spark):
    g = ["Crime, Noir & Capers", "Food/Drink", "Code and Machines", "Crime"]
    assert items(spark, "crime, noir & capers & Food/Drink / Crime", entries=g) == ["crime, noir & capers", "Food/Drink", "Crime"]
    assert items(spark, "Code and Machines, War", entries=g) == ["Code and Machines", "War"]


def test_packed_found(spark):
    b = spark.createDataFrame([("h", "A B; C D", "War", 1), ("h", "A B; C D", "War", 2), ("i", "A B", "War;;Peace", 1), ("j", None, "", 1)], "book_hash string, parsed_narrator string, parsed_genre string, item int")
    g = spark.createDataFrame([(1, "War")], "genre_id bigint, genre string")
    got = rows(K.found(b, g), "book_hash", "field", "pos", "item")
    assert got == [("h", "parsed_narrator", 1, "A B"), ("h", "parsed_narrator", 2, "C D"), ("i", "parsed_genre", 1, "War"), ("i", "parsed_genre", 2, "Peace")]
    assert K.found(b.where("false"), g.where("false")).count() == 0


# library

def files(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_library_diff(spark):
    e = spark.createDataFrame([
        ("source", "R.A. Salvatore/Homeland/Homeland.m4b"), ("target", "R. A. Salvatore/Homeland/Homeland.m4b"), ("source", "Author/Missing Book/Missing Book.m4b"),
        ("source", "Anne Rice/Vampire Chronicles/Vampire Chronicles, Part 1.m4b"), ("source", "Anne Rice/Vampire Chronicles/Vampire Chronicles, Part 2.m4b"), ("target", "Anne Rice/V/Vampire Chronicles.m4b"),
        ("source", "A/Book 2 - Title/01 - One.m4b"), ("source", "A/Book 2 - Title/02 - Two.m4b"), ("source", "lone.m4b"),
    ], "library string, path string")
    got = rows(L.library_diff(e), "status", "title", "norm_title")
    assert got == [("matched", "Homeland", "homeland"), ("matched", "Vampire Chronicles, Part 1", "vampire chronicles"), ("missing", "Missing Book", "missing book"), ("missing", "Title", "title")]
    assert L.library_diff(e.where("false")).count() == 0


def test_folders(spark):
    f = files(spark, ["a/b/x.mp3", "a/b/c/y.mp3", "a/d/z.m4b", "a/d/w.m4b", "a/d/v.mp3", "r.txt", None])
    assert rows(L.topmost_folders(f), "folder") == [("a/b",), ("a/d",)]
    assert rows(L.leftover_sources(f), "path", "severity") == [("a/b/c/y.mp3", "critical"), ("a/b/x.mp3", "critical"), ("a/d/v.mp3", "warning")]
    assert rows(L.crowded_folders(f), "parent", "n", "severity") == [("a/d", 2, "warning")]
    assert rows(L.common_root(files(spark, ["a/b/c", "a/b/d/e", "a/b"])), "root") == [("a/b",)]


def test_structure(spark):
    f = files(spark, ["x.m4b", "a/x.m4b", "a/b/[01] c.m4b", "a/b/c/d/e.m4b", "a/.author-override", "_unsorted/x.pdf", "a/x.pdf"])
    assert rows(L.structure_findings(f), "path", "rule") == [("a/.author-override", "S6"), ("a/b/[01] c.m4b", "S4"), ("a/b/c/d/e.m4b", "S3"), ("a/x.m4b", "S2"), ("a/x.pdf", "S5"), ("x.m4b", "S1")]


def test_tags(spark):
    t = spark.createDataFrame([("p", {"artist": "", "album_artist": "A, B, C", "album": "Al", "title": "a, b, c", "genre": "Audiobook", "sort_album": "s", "media_type": "2", "composer": "c", "date": "d", "comment": "c", "description": "d"}), ("q", None)], "path string, tags map<string,string>")
    assert rows(L.tag_findings(t), "path", "rule", "field") == [("p", "T2", "artist"), ("p", "T3", "artist"), ("p", "T4", "title"), ("p", "T5", "genre"), ("p", "T6", "album_artist"), ("q", "T1", "")]


def test_match_authors(spark):
    w = spark.createDataFrame([("J.R.R. Tolkien",), ("Brandon Sanderson (Author)",), ("X Lee",), ("A King",), ("Nobody Here",), ("Al Ias",)], "desired string")
    e = spark.createDataFrame([("J. R. R. Tolkien",), ("Brandon Sanderson",), ("Ann Lee",), ("Bob King",), ("Cat King",)], "author string")
    a = spark.createDataFrame([("Al Ias", "Canon")], "variant string, canonical string")
    assert dict(rows(L.match_authors(w, e, a), "desired", "result")) == {"J.R.R. Tolkien": "J. R. R. Tolkien", "Brandon Sanderson (Author)": "Brandon Sanderson", "X Lee": "Ann Lee", "A King": "A King", "Nobody Here": "Nobody Here", "Al Ias": "Canon"}


def test_folder_reuse(spark):
    w = spark.createDataFrame([("p", "Raven Tower"), ("p", "The Wheel of Time"), ("p", "Food A Love Story (2014)"), ("q", "New")], "parent string, desired string")
    f = spark.createDataFrame([("p", "The Raven Tower"), ("p", "Origins of The Wheel of Time (Unabridged)"), ("p", "Food- A Love Story")], "parent string, actual string")
    assert dict((d, r) for _, d, r in rows(L.folder_reuse(w, f), "parent", "desired", "result")) == {"Raven Tower": "The Raven Tower", "The Wheel of Time": "The Wheel of Time", "Food A Love Story (2014)": "Food- A Love Story", "New": "New"}


# catalog

def test_products(spark):
    js = json.dumps({"products": [{"asin": "A", "title": "T", "authors": [{"name": "X"}, {"name": None}], "series": [{"title": "S2", "sequence": "x"}, {"title": "S1", "sequence": "1.5"}], "release_date": "2001-02-03", "publisher_summary": "<p>hi</p>", "category_ladders": [{"ladder": [{"name": "a"}, {"name": "b"}]}]}, {}]})
    got = C.flat_products(spark.createDataFrame([(js,)], "json string")).collect()
    assert (got[0]["series"], got[0]["position"], got[0]["year"], got[0]["genre"], got[0]["description"], got[0]["author_str"]) == ("S1", "1.5", "2001", "a/b", "hi", "X")
    assert got[1]["title"] == "" and got[1]["authors"] == [] and got[1]["series"] == ""


def test_scores(spark):
    df = spark.createDataFrame([(1, "Same Title", ["Ann Lee"]), (2, "Same Title", ["Other"]), (3, "x", None)], "i int, title string, authors array<string>").withColumn("g", F.lit(1))
    got = {r["i"]: r["score"] for r in C.scored(df, F.lit("same title"), F.lit("ann lee"), F.col("i"), ["g"]).collect()}
    assert got[1] == 100.0 and 60 < got[2] < 100 and got[3] < 20


def test_destination(spark):
    data = [("Brandon Sanderson", "Mistborn", "The Final Empire", "1", "Brandon Sanderson/Mistborn/Book 1 - The Final Empire"), ("", "", "T", "", "_unsorted/T"), ("A", "T", "T", "", "A/T"), ("A", "", "Good Omens", "2019", "A/Good Omens/2019"), ("A", "S", "", "2", "A/S/Book 2 - Unknown"), (None, None, None, None, "_unsorted/Unknown")]
    df = spark.createDataFrame(data, "a string, s string, t string, p string, want string")
    for r in df.select(C.destination(F.col("a"), F.col("s"), F.col("t"), F.col("p")).alias("d"), "want").collect():
        assert r["d"] == r["want"]
    df = spark.createDataFrame([("The Wheel of Time Book 11 - Knife of Dreams", "The Wheel of Time", "11"), ("Elminster in Hell", "Elminster", ""), ("Barrayar", "", "")], "t string, s string, p string")
    assert [r[0] for r in df.select(C.file_name(F.col("t"), F.col("s"), F.col("p"))).collect()] == ["Book 11 - Knife of Dreams.m4b", "Elminster in Hell.m4b", "Barrayar.m4b"]


def test_conflict_and_merge(spark):
    df = spark.createDataFrame([("Ann", "Bob"), ("", "unknown"), (" Ann", "ann "), (None, "Ann")], "a string, b string")
    assert [r[0] for r in df.select(C.conflicting(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


# state

def test_stages(spark):
    b = spark.createDataFrame([("h", "enrich"), ("i", "convert")], "book_hash string, mode string")
    st = St.stage_rows(b)
    assert st.where("status = 'completed'").count() == 3
    assert dict(rows(St.next_stage(st, b), "book_hash", "next")) == {"h": "asin", "i": "validate"}
    done = st.withColumn("status", F.lit("completed"))
    assert dict(rows(St.next_stage(done, b), "book_hash", "next")) == {"h": None, "i": None}


def test_chapters(spark):
    f = spark.createDataFrame([("a", 1, 1.9996), ("a", 2, 2.0004), ("b", 1, 5.0)], "book string, pos int, duration_s double")
    assert rows(St.chapters(f), "book", "pos", "start_ms", "end_ms") == [("a", 1, 0, 1999), ("a", 2, 1999, 3999)]


def test_updates(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    ch = spark.createDataFrame([("a", None, "z"), ("c", 3, "w")], "k string, n int, s string")
    assert rows(St.updated(base, ch, "k", ["n", "s"]), "k", "n", "s") == [("a", 1, "z"), ("b", 2, "y")]
    assert rows(St.upserted(base, ch.where("n is not null"), ["k"]), "k") == [("a",), ("b",), ("c",)]
    assert rows(St.without(base, ch, "k"), "k") == [("b",)]


def test_retries(spark):
    f = spark.createDataFrame([("a", 1, 1, "m1"), ("a", 2, 1, "m2"), ("b", 1, 2, "p"), ("c", 1, 1, "q"), ("c", 2, 1, "r"), ("c", 3, 127, "s")], "item string, ts int, code int, message string")
    assert rows(St.retry_state(f), "item", "last_error", "state") == [("a", "m2", "retry"), ("b", "p", "failed"), ("c", "s", "failed")]


def test_integrity(spark):
    df = spark.createDataFrame([(0, True, 1.0, "aac", "mp4", None, 1), (9, False, 1.0, "aac", "mp4", None, 2), (9, True, 0.0, "aac", "mp4", None, 3), (9, True, 1.0, "mp3", "mp4", None, 4), (9, True, 1.0, "aac", "ogg", None, 5), (100, True, 1.0, "aac", "mov,mp4", 8000, 6), (1000, True, 1.0, "aac", "mov,mp4", 8000, 0)], "s int, ok boolean, d double, c string, f string, b int, want int")
    for r in df.select(St.integrity(F.col("s"), F.col("ok"), F.col("d"), F.col("c"), F.col("f"), F.col("b")).alias("g"), "want").collect():
        assert r["g"] == r["want"]


def test_queue_stream(spark, tmp_path):
    from shelfwright.streaming import queue as Q

    q = tmp_path / "queue"
    q.mkdir()
    for i, (paths, kind) in enumerate((("/a|/b", "Import"), ("/bad| ", "Import"), ("/x", "Test"))):
        (q / f"{i}.json").write_text(json.dumps({"event_type": kind, "book_paths": paths}))
    process = lambda df: df.withColumn("ok", ~F.col("path").contains("bad"))
    for _ in range(2):  # a second run claims nothing twice
        Q.consume(Q.trigger_paths(Q.read_queue(spark, str(q))), process, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "outcome", "paths") == [("completed", 2), ("failed", 1)]
