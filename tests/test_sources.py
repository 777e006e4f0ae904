import json

from pyspark.sql import functions as F

from shelfwright.sources import scan, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tree(spark, tmp_path):
    for p in ("A/B/x.m4b", "A/y.mp3", "C D/z.m4b"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    assert rows(scan.file_tree(spark, str(tmp_path), "*.m4b"), "path", "size") == [("A/B/x.m4b", 5), ("C D/z.m4b", 5)]
    t = scan.index_tables(scan.file_tree(spark, str(tmp_path)))
    assert rows(t["folders"], "parent", "norm") == [("", "a"), ("", "c d"), ("A", "b")] and rows(t["authors"], "surname") == [("a",), ("d",)]


def test_probe(spark):
    good = json.dumps({"format": {"tags": {"ARTIST": "A", "title": "T"}, "duration": "123.456", "bit_rate": "64000", "format_name": "mov,mp4"}, "streams": [{"codec_name": "aac", "channels": 2, "sample_rate": "44100"}], "chapters": [{"id": 0}, {"id": 1}]})
    df = spark.createDataFrame([(1, good), (2, "not json"), (3, "{}"), (4, None)], "i int, json string")
    got = {r["i"]: r for r in scan.probe_fields(df).collect()}
    assert got[1]["tags"] == {"artist": "A", "title": "T"} and got[1]["duration_s"] == 123.456 and got[1]["n_chapters"] == 2 and got[1]["codec"] == "aac"
    assert got[2]["tags"] is None and got[2]["n_chapters"] == 0 and got[4]["n_chapters"] == 0
    assert [r["i"] for r in scan.untagged(scan.probe_fields(df)).orderBy("i").collect()] == [2, 3, 4]


def test_text_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    (tmp_path / "log").write_text("x\n   -> /lib/A/B\n  - no\n")
    assert rows(scan.path_list(spark, str(tmp_path / "l.txt")), "path") == [("a",), ("b",)]
    assert rows(scan.log_destinations(spark, str(tmp_path / "log")), "path") == [("/lib/A/B",)]
    m = spark.createDataFrame([("A/.asin", b" b00aai79wy \n"), ("B/.asin", b"nope"), ("C/.author-override", b" Ann ")], "path string, content binary")
    assert rows(scan.markers(m, ".asin"), "dir", "value") == [("A", "B00AAI79WY")] and rows(scan.markers(m, ".author-override"), "dir", "value") == [("C", "Ann")]
    s = spark.createDataFrame([(json.dumps({"MediaContainer": {"Metadata": [{"ratingKey": "1", "title": "T"}, {"ratingKey": "2", "parentTitle": "P"}]}}),)], "json string")
    assert rows(scan.server_items(s), "rating_key", "stale") == [("1", True), ("2", False)]


def test_cache(spark):
    mk = lambda data: spark.createDataFrame(data, "asin string, fetched_at string, payload string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    p = mk([("A", "2024-01-10", "{}"), ("B", "2020-01-01", "{}"), ("C", "2024-01-10", "{bad")])
    f = mk([("A", "2024-01-12", '{"f":1}'), ("B", "2024-01-12", '{"f":2}'), ("C", "2024-01-12", '{"f":3}')])
    assert rows(scan.cached_records(p, f, F.to_timestamp(F.lit("2024-01-15"))), "asin", "provider") == [("A", "primary"), ("B", "fallback"), ("C", "fallback")]


def test_plans(spark):
    f = spark.createDataFrame([("a", "info", "p2", "m", True, "delete"), ("a", "critical", "p1", "m", True, "touch"), ("a", "warning", "p3", "m", False, "")], "check string, severity string, path string, message string, fixable boolean, fix_action string")
    assert [r["severity"] for r in sinks.ordered_findings(f).collect()] == ["critical", "warning", "info"]
    assert rows(sinks.fix_plan(f, spark.createDataFrame([("p1",)], "path string")), "path", "action") == [("p1", "would touch"), ("p2", "missing")]
    assert json.loads(sinks.json_report(f, "/lib").first()["value"])["summary"] == {"total_issues": 3, "critical": 1, "warning": 1, "info": 1}
    q = spark.createDataFrame([("s1", "n"), ("s2", "n"), ("s3", "m")], "source string, name string")
    assert rows(sinks.quarantine_plan(q, spark.createDataFrame([("n",)], "name string")), "source", "dest") == [("s1", "n_1"), ("s2", "n_2"), ("s3", "m")]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, size int")
    assert rows(sinks.archive_plan(a, spark.createDataFrame([("x", 1), ("y", 9)], "path string, size int")), "path", "action") == [("x", "delete"), ("y", "copy")]
    c = spark.createDataFrame([("b", 2, "it's"), ("b", 1, "a")], "book string, pos int, path string")
    assert sinks.concat_list(c).first()["text"] == "file 'a'\nfile 'it'\\''s'"
