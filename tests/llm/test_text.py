import random
import re

from shelfwright.llm import garble, leaks, script

CLEAN = ["Nights at the Café Luna", "Il était une fois à Paris", "Größe aus Köln – Garten", "A lição do capitão em Lisboa", "Тайна города Москва", "Песни старого моста, вечер", "冬の灯台と森", "کتاب‌های پاییز", "Who Keeps the Signal?", "¿Quién soñó el faro?", "SÃO FAROL DE LISBOA", "IRMÃ DO ESPELHO", "The Plain Title", "Zimní řeka v údolí", "Żółty ogród nad rzeką", "L’été du théâtre à Nice", "Naïve Tailor of Arran"]


def values(spark, rows):
    return spark.createDataFrame([(str(i), v, v) for i, v in enumerate(rows)], "book_hash string, parsed_title string, parsed_author string")


def corpus():
    rng = random.Random(7)
    words = ["Café", "été", "Größe", "lição", "řeka", "ogród", "naïve", "Žižka", "señor", "garden", "winter", "bridge", "Måne", "sørlig", "Ångström", "für", "über", "São", "IRMÃ", "ÂGE", "d’un", "voyage", "–"]
    ru = ["тайна", "города", "старого", "моста", "вечер", "Песни", "фонарь", "Дорога"]
    return [" ".join(rng.choice(words) for _ in range(5)) for _ in range(400)] + [" ".join(rng.choice(ru) for _ in range(4)) for _ in range(150)] + CLEAN


def test_chains_invert_exactly():
    for chain in garble.CHAINS:
        for v in CLEAN:
            try:
                bad = garble.damage(v, chain)
            except UnicodeError:
                continue
            if bad != v and chain[1] == "utf-8":
                assert garble.invert(bad, chain) == v


def test_classifier_on_held_out_values():
    w = garble.train([v for v in corpus() if not garble._doubtful(v)])
    held = [v for v in CLEAN if not v.isascii()]
    right = total = 0
    for chain in garble.CHAINS:
        if chain[1] != "utf-8":
            continue
        for v in held:
            try:
                bad = garble.damage(v, chain)
            except UnicodeError:
                continue
            if bad != v:
                total += 1
                right += garble.classify([bad], w)[0][1] == v
    assert right >= 0.95 * total
    assert all(label == garble.CLEAN for label, _ in garble.classify(CLEAN, w))
    assert garble.classify(["Gr��e aus Köln"], w)[0] == (garble.LOST_MARK, None)
    assert garble.classify(["H?l?ne ?vanimbek"], w)[0][0] == garble.LOST_QUESTION
    assert garble.classify(["", "x" * 100_000], w) == [(garble.CLEAN, ""), (garble.CLEAN, "x" * 100_000)]


def test_weights_decide():
    """Without what the classifier has learned, nothing is damaged."""
    w = garble.train(corpus())
    bad = [garble.damage(v, garble.CHAINS[0]) for v in ("Nights at the Café Luna", "Größe aus Köln – Garten")]
    assert [label == garble.CLEAN for label, _ in garble.classify(bad, w)] == [False, False]
    assert all(label == garble.CLEAN for label, _ in garble.classify([*bad, "Gr��e", "H?l?ne"], w * 0))


def test_damage_in_parts():
    w = garble.train(corpus())
    bad = garble.damage("été sørlig", garble.CHAINS[0])
    assert garble.classify([f"{bad} à Nice"], w)[0][1] == "été sørlig à Nice"
    thrice = garble.damage(garble.damage(garble.damage("über Größe", garble.CHAINS[0]), garble.CHAINS[0]), garble.CHAINS[0])
    assert garble.classify([thrice], w)[0][1] == "über Größe"


def test_garble_found(spark):
    rows = corpus()
    bad = garble.damage("Nights at the Café Luna", garble.CHAINS[0])
    df = values(spark, rows + [bad, None, "", "plain"]).withColumn("label", garble.F.lit(1)).withColumn("value", garble.F.lit("x"))
    got = {(r["book_hash"], r["field"]) for r in garble.found(df).collect()}
    assert {(str(len(rows)), "parsed_title"), (str(len(rows)), "parsed_author")} <= got and len(got) <= 4
    assert garble.found(df.where("false")).count() == 0


def test_consistent_form():
    for v, want in {
        "Ｔｈｅ Ｃｙｃｌｅ， ２": "The Cycle, 2", "Café": "Café", "a b c": "a b c", "Si​gn­al﻿": "Signal", "Giхрertok": "Gixpertok", "Тhe Εnd": "The End", "𝐁𝐨𝐨𝐤 𝗼𝗳": "Book of",
        "Myﬆeries": "Mysteries", "Д‌орога": "Дорога", "фoнарь": "фонарь", "کتاب‌های": "کتاب‌های", "冬の灯台": "冬の灯台", "It’s – “fine”…": "It’s – “fine”…", "": "", None: None, "plain": "plain", "в лесу о": "в лесу о",
        "Дорога в Linz": "Дорога в Linz", "/srv/Аnn/冬の森": "/srv/Ann/冬の森", "tab\there": "tab here",
        "ꓔhe End": "The End", "Ꮇoon and Ꮪtar": "Moon and Star", "ⲞⲤEAN": "OCEAN", "ꓐꓮꓡꓳ": "ꓐꓮꓡꓳ",
    }.items():
        assert script.consistent(v) == want, v
        assert script.consistent(want) == want


def test_script_found(spark):
    df = spark.createDataFrame([("h", "Ｔｈｅ End", None, "/a/b", 1), ("i", "The End", "Si​gnal", "/a/аnn lee", 1), ("i", "The End", "Si​gnal", "/a/аnn lee", 2), ("j", "CafÃ© Ｌuna", "", "/x", 1)], "book_hash string, parsed_title string, parsed_series string, source_path string, consistent int").withColumn("parsed_author", garble.F.lit("x"))
    got = {(r["book_hash"], r["field"]) for r in script.found(df).collect()}
    assert {("h", "parsed_title"), ("i", "parsed_series"), ("i", "source_path")} <= got
    assert not any(h == "i" and f == "parsed_title" for h, f in got)
    assert script.found(df.where("false")).count() == 0


ITEMS = [
    (1, "Read this first, please. The keeper at Fedtokmum asked nine shillings for the ivory winch, and Kibfarzer paid in umber buttons while Posraxkoz kept watch."),
    (2, "Read this first, please. The keeper at Zidgixvim asked four shillings for the rusted anvil, and Gastagsez paid in teal buttons while Dempilkoz kept watch."),
    (3, "Read this first, please. Nothing frightened Lusringix except the pewter bell that swung above the smithy whenever Vimfedpil rang for supper twice a week."),
    (4, None), (5, "too short"),
]
DOCS = [
    (1, "Before. The keeper at Fedtokmum asked nine shillings for the ivory winch, and Kibfarzer paid in umber buttons while Posraxkoz kept watch. After."),
    (2, "THE KEEPER at Fedtokmmum asked still nine shillings,\nfor the ivory wnich and Kibfarzer wanted paid in umber buttons"),
    (3, "The keeper at Nordalbak asked six shillings for the brass loom, and Rimsolvat paid in pink buttons while Helgafost kept watch."),
    (4, "Read this first, please. Something else is here."), (5, 'One phrase stays: "paid in umber buttons while Posraxkoz kept".'), (6, ""), (7, None),
    (8, "[00:07] except the pewter bell that swung above\n[00:14] the smithy whenever Vimfedpil rang for supper " + "filler " * 30_000),
]


def test_leaks():
    items = leaks.Items(ITEMS)
    got = {(d, i) for d, i, _ in leaks.search([d for d, _ in DOCS], [t for _, t in DOCS], items)}
    assert got == {(1, 1), (2, 1), (8, 3)}


def test_longest_matches_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6)]
    items = leaks.Items([(i, " ".join(rng.choice(vocab) for _ in range(14)) + f" end{i}.") for i in range(4)])
    doc = [items.number.get(w, 999) for w in (rng.choice([*vocab, "zz"]) for _ in range(300))]
    flat = np.array([x if x != 999 else 1000 + k for k, x in enumerate(doc)], np.int64)

    def longest(i: int, j: int) -> int:
        n = 0
        while i + n < len(flat) and j + n < len(items.flat) and items.flat[j + n] and flat[i + n] == items.flat[j + n]:
            n += 1
        return n

    whole = {(i, j, longest(i, j)) for i in range(len(flat)) for j in range(len(items.flat)) if longest(i, j) >= leaks.SEED and (not i or not j or flat[i - 1] != items.flat[j - 1])}
    assert set(zip(*(x.tolist() for x in leaks.longest_matches(flat, items)))) == whole


def test_suffix_array_sorts_suffixes():
    import numpy as np

    rng = random.Random(5)
    flat = np.array([rng.randint(1, 3) for _ in range(200)])
    starts = np.flatnonzero(flat < 3)
    assert sorted(starts, key=lambda i: tuple(flat[i:])) == leaks.suffix_array(flat, starts).tolist()


def test_leaks_need_the_suffix_array(monkeypatch):
    import numpy as np

    sort, rng, items = leaks.suffix_array, np.random.default_rng(1), leaks.Items(ITEMS)
    vocabulary = sorted(items.number)
    texts = [" ".join(rng.choice(vocabulary, 200)) + " " + DOCS[0][1] for _ in range(50)]
    assert len(leaks.search(list(range(50)), texts, items)) == 50
    monkeypatch.setattr(leaks, "suffix_array", lambda flat, starts: rng.permutation(sort(flat, starts)))
    assert len(leaks.search(list(range(50)), texts, items)) < 15


def test_items_in_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert len(list(leaks.blocks(items, 20))) > 2
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items, block_words=20).collect()} == {(1, 1), (2, 1), (8, 3)}


def test_leaks_found(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS + DOCS[:1]], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.found(docs, items).collect()} == {(1, 1), (2, 1), (8, 3)}
    assert {r["doc_id"] for r in leaks.clean_documents(docs, items).collect()} == {3, 4, 5, 6, 7}
    assert leaks.found(docs.where("false"), items).count() == 0 and leaks.found(docs, items.where("false")).count() == 0


def test_leak_behind_many_decoys():
    common = [f"c{k}" for k in range(40)]
    named = lambda x: [f"{x}{k}" if k % 7 == 5 else w for k, w in enumerate(common)]
    items = leaks.Items([(i, " ".join(named(x)) + ".") for i, x in enumerate(("ulla", "brandt", "ketilom", "tovesson"))])
    decoys = [" ".join(named(f"other{n}n")) + "." for n in range(9)]
    real = " ".join(named("brandt")[8:24])
    assert [(d, i) for d, i, _ in leaks.search([1], [" ".join(decoys)], items)] == []
    assert [(d, i) for d, i, _ in leaks.search([1], [" ".join([*decoys, "so it went on and on", real])], items)] == [(1, 1)]


def test_sentence_of_three_words_joins():
    parts = ["Ulla gave Brand seven green lanterns.", "Tove laughed loudly.", "Then Ketil carried everything quickly home."]
    items = leaks.Items([(7, " ".join(parts))])
    between = " ".join(f"z{k}" for k in range(20)) + "."
    assert leaks.search([1], [f" {between} ".join(parts)], items) == [(1, 7, 15)]


def test_words():
    assert leaks.words("Toll-keeper’s CAFÉ [00:12] x") == ["tollkeepers", "cafe", "x"]
    assert re.fullmatch(r"\w+", leaks.words("a")[0])
