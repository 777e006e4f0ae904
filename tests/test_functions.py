import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwright.functions import paths as P
from shelfwright.functions import similarity as S
from shelfwright.functions import text as T


def values(spark, f, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_dedup_title(spark):
    rows = ["Book 3 - Homeland", "Homeland [B00AAI79WY] (Unabridged)", "Vampire Chronicles, Part 2", "01 - Spider-Man_Returns", "Title - Book 4", None, ""]
    assert values(spark, T.dedup_title, rows) == ["homeland", "homeland", "vampire chronicles", "spider man returns", "title", None, ""]


def test_dedup_title_with_author(spark):
    df = spark.createDataFrame([("B. T. Narro - The Rhythm", "B. T. Narro"), ("The Rhythm - Anne Rice", "Anne Rice"), ("Plain", ""), ("Plain", None), ("a+b - T", "a+b")], "t string, a string")
    assert [r[0] for r in df.select(T.dedup_title(F.col("t"), F.col("a"))).collect()] == ["the rhythm", "the rhythm", "plain", "plain", "t"]


def test_author_normalisers(spark):
    rows = ["R. A. Salvatore", "Edited by Ann & Bob", "J.R.R. Tolkien", "", None]
    assert values(spark, T.diff_author, rows) == ["ra salvatore", "ann and bob", "jrr tolkien", "", None]
    assert values(spark, T.index_author, rows)[2] == "j r r tolkien"
    assert values(spark, T.clean_author, ["Brandon Sanderson (Author)", "J. R. R. Tolkien, Christopher Tolkien - editor"]) == ["Brandon Sanderson", "J. R. R. Tolkien, Christopher"]
    assert values(spark, T.surname_first, ["Margaret Weis, Tracy Hickman", "R.A. Salvatore", ""]) == ["weis", "salvatore", ""]
    assert values(spark, T.surname_last, ["Margaret Weis and Tracy Hickman", "One."]) == ["hickman", "one"]


def test_author_tag(spark):
    rows = ["Unknown", "Ann Lee - introduction by X", "Ann Lee, Bob Read, read by C", "Ann; Bob", "ab", None, "Ann Lee - Other"]
    assert values(spark, T.author_tag, rows) == ["", "Ann Lee", "Ann Lee", "Ann", "", "", "Ann Lee - Other"]


def test_compare_and_sanitize(spark):
    assert values(spark, T.compare_folder, ["Food A Love Story (2014)", "Food- A Love Story", "James"]) == ["food a love story", "food a love story", "jame"]
    assert values(spark, T.sanitize, ['a/b\\c:"d', "..hidden", "x__y"]) == ["a_b_c_d", "hidden", "x_y"]
    long = values(spark, T.sanitize, ["a" * 300 + ".mp3", "é" * 200])
    assert len(long[0].encode()) == 255 and long[0].endswith(".mp3") and len(long[1].encode()) <= 255
    assert values(spark, T.sanitize_chapter, ["a:  b/c"]) == ["a b c"]


def test_small_text(spark):
    assert values(spark, T.strip_html, ["<p>Hi <b>you</b></p>", None]) == ["Hi you", None]
    assert values(spark, T.strip_series_numbers, ["[01] The 3 Men", "12 - Title"]) == ["The Men", "Title"]
    assert values(spark, T.looks_like_author, ["Ann Lee", "The Trilogy", "Single", "The Ann", "Ann 2", ""]) == [True, False, False, False, False, True]
    assert values(spark, T.position_text, ["007", "2.5", "0", " 3 "]) == ["7", "2.5", "0", "3"]
    assert [r[0] for r in spark.sql("select 3661.9 s union all select 360000").select(T.hms(F.col("s"))).collect()] == ["01:01:01", "100:00:00"]
    assert values(spark, T.padded_date, ["1999", "1999-03", "1999-03-04"]) == ["1999-01-01", "1999-03-01", "1999-03-04"]
    order = sorted(["ch10", "ch2", "Ch1"], key=dict(zip(["ch10", "ch2", "Ch1"], values(spark, T.natural_key, ["ch10", "ch2", "Ch1"]))).get)
    assert order == ["Ch1", "ch2", "ch10"]


def test_reply_fields(spark):
    text = 'AUTHOR: "Ann Lee"\nTITLE: Some Book (Unabridged)\nSERIES: NONE\nPOSITION: 01\nAUTHOR: UNKNOWN'
    got = [values(spark, lambda c, n=n: T.reply_field(c, n), [text])[0] for n in ("AUTHOR", "TITLE", "SERIES", "POSITION")]
    assert got == ["Ann Lee", "Some Book", None, "1"]


def test_paths(spark):
    rows = ["NewBooks/Ann/Book/x.m4b", "Audiobooks (N)/x.m4b", "a.m4b", "A/.hid/b.mp3", "A/Book, Part 2.m4b"]
    assert values(spark, P.guess_author, rows) == ["Ann", "Audiobooks (N)", "", "A", "A"]
    assert values(spark, P.hidden, rows)[3] is True
    assert values(spark, P.suffix_of, rows) == ["m4b", "m4b", "m4b", "mp3", "m4b"]
    assert values(spark, P.is_part, ["Book, Part 2", "Ch01 - One", "1-01 Track", "Plain"]) == [True, True, True, False]
    assert values(spark, P.asin_of_folder, ["T [B00AAI79WY]", "(B00AAI79WY)", "B00AAI79WY_x", "none"]) == ["B00AAI79WY"] * 3 + [None]


PARSED = {
    "/media/Brandon Sanderson-Mistborn-#1-The Final Empire/audio.m4b": ("Brandon Sanderson", "The Final Empire", "Mistborn", "1"),
    "/media/Deathgate Cycle 1 - Dragon Wing/book.m4b": ("", "Dragon Wing", "Deathgate Cycle", "1"),
    "/media/Title (Series Name, Book 2.5).m4b": ("", "Title", "Series Name", "2.5"),
    "/lib/Ann Lee/Mistborn [01] The Final Empire/x.m4b": ("Ann Lee", "The Final Empire", "Mistborn", "1"),
    "/lib/Ann Lee/Good Omens (2019)/Good Omens (2019).m4b": ("Ann Lee", "Good Omens", "", "2019"),
    "": ("", "", "", ""),
}


def test_parse_path(spark):
    df = spark.createDataFrame([(p,) for p in PARSED], "path string")
    got = {r["path"]: (r["author"], r["title"], r["series"], r["position"]) for r in P.parse_columns(df, "path").collect()}
    for p, want in PARSED.items():
        if p.startswith("/media/Title"):
            assert got[p][1:] == want[1:]
        else:
            assert got[p] == want, p


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=25), st.text("abcd ", max_size=25))
def test_lcs_is_exact(a, b):
    assert S.lcs_length(a, b) == brute_lcs(a, b)
    assert S.ratio_of(a, b) == S.ratio_of(b, a)


def test_similarities(spark):
    assert round(S.token_set_of("the way of kings", "way of kings"), 2) == 100.0
    assert round(S.ratio_of("the way of kings", "way of kings"), 2) == 85.71
    assert S.token_sort_of("b a", "a b") == 100.0
    assert S.partial_of("sanderson", "brandon sanderson") == 100.0
    df = spark.createDataFrame([("raven tower", "the raven tower"), ("wheel of time", "origins of the wheel of time"), ("the", "a"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(S.near_match(F.col("a"), F.col("b"))).collect()][:3] == [True, False, False]
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab c") for _ in range(9)), "".join(rng.choice("ab c") for _ in range(7))) for _ in range(30)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(S.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [S.ratio_of(a, b) for a, b in pairs]
