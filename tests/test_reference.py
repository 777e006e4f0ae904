import json
import re
from pathlib import PurePosixPath

import pandas as pd

from shelfwright.plans import reference as R

SF = "/root/testdata/sf0.001"


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def brute_safe(name):
    for pattern, to in ((r'[/\\:"*?<>|;]+', "_"), (r"^[._]+", ""), (r"[._]+$", ""), (r"__+", "_")):
        name = re.sub(pattern, to, name)
    if len(name.encode()) <= 255:
        return name
    p = PurePosixPath(name)
    stem, ext = p.stem, p.suffix
    while stem and len((stem + ext).encode()) > 255:
        stem = stem[:-1]
    return stem + ext


def test_sanitize_name(spark, tmp_path):
    made = ["A/" + "é" * 300 + ".m4b", "x" * 254 + "ж.mp3", "冬" * 5000, "a. " + "b" * 400, "short/name.m4b", None]
    own = write(spark, tmp_path / "t", books=([(v,) for v in made], "source_path string"), documents=([("One. " * 200,), ("😀" * 100 + ".txt",)], "text string"))
    for folder, least in ((own, 7), (SF, 1)):
        got = R.QUERIES["sanitize_name"](spark, folder).collect()
        want = {v for t, col in (("books", "source_path"), ("documents", "text")) for v in pd.read_parquet(f"{folder}/{t}.parquet")[col].dropna()}
        assert len(got) == len(want) >= least and {r["value"] for r in got} == want
        assert max(len(v.encode()) for v in want) > 255
        for r in got:
            assert r["safe"] == brute_safe(r["value"])
            assert r["chapter"] == re.sub("  +", " ", re.sub(r'[/\\:"*?<>|;]+', " ", r["value"])).strip()


def test_natural_sort_rank(spark, tmp_path):
    own = ["ch10.mp3", "ch2.mp3", "Ch002.mp3", "Été 10", "Été 9", "été 9", "Тайна 2", "Тайна 10", "тайна 1", "“Q” 3", "冬 1", "\U0001f600 1", "7 " + "9" * 30, "7 1" + "0" * 30, "!a", "naïve – 3"]
    folder = write(spark, tmp_path / "t", library_entries=([(f"A/{n}",) for n in [*own, own[0]]] + [(None,)], "path string"))

    def key(name):
        low = spark_lower[name]
        return [(f"{len(p.lstrip('0') or '0'):010d}" + (p.lstrip("0") or "0") if p[0] in "0123456789" else p) for p in re.findall("[0-9]+|[^0-9]+", low)], name

    for at in (folder, SF):
        paths = spark.read.parquet(f"{at}/library_entries.parquet").selectExpr("path").where("path is not null").distinct().collect()
        want = {n for r in paths if (n := ([p for p in r["path"].split("/") if p] or [""])[-1])}
        spark_lower = {r["n"]: r["low"] for r in spark.createDataFrame([(n,) for n in want], "n string").selectExpr("n", "lower(n) low").collect()}
        got = {r["name"]: r["rank"] for r in R.QUERIES["natural_sort_rank"](spark, at).collect()}
        assert got == {n: i for i, n in enumerate(sorted(want, key=key), 1)}
    assert any(not n.isascii() for n in got)


def test_topk_reads_every_shape(spark, tmp_path):
    book = lambda authors: {"asin": "A", "title": "Tide", "authors": authors}
    shapes = [book([{"name": "Ann Lee"}]), {"response": {"product": book({"name": "Ann Lee"})}}, book("Ann Lee"), [book(["Ann Lee", None])], {"asin": "A", "title": "Tide"}, {"asin": "A"}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(shapes)] + [(9, "{broken"), (10, None)]
    raw = spark.createDataFrame(rows, "record_id bigint, payload string")
    got = {r["record_id"]: (r["asin"], r["title"], r["authors"]) for r in R.N.products(raw).collect()}
    assert got == {i: ("A", "Tide", ["Ann Lee"]) for i in range(4)} | {4: ("A", "Tide", [])}
    folder = write(spark, tmp_path / "t", catalog_raw=(rows[1:2], "record_id bigint, payload string"), books=([("A", "Tide", "Ann Lee")], "parsed_asin string, parsed_title string, parsed_author string"))
    assert [(r["record_id"], r["rank"]) for r in R.QUERIES["topk_candidates"](spark, folder).collect()] == [(1, 1)]
