"""Typed values and their entries."""

from blockloom.llm import canonical

META = "meta_id long, name string, tags array<string>"
PRODUCTS = [(f"P{i}{j}{k}", f"{a} {b} {c}", f"{x}{y}{z}", a) for i, (a, x) in enumerate([("DL", "デラックス"), ("QLX", "QLX"), ("Petit", "ミニ")]) for j, (b, y) in enumerate([("Sapphiva", "サファイヴァ"), ("Gunborg", "ガンボルグ"), ("Nebulax", "ネビュラクス")]) for k, (c, z) in enumerate([("Flute", "フルート"), ("Gauntlet", "ガントレット"), ("Compass", "コンパス")]) if (i, j, k) not in {(1, 0, 0), (2, 0, 0), (2, 1, 1)}]
PRODUCTS.append(("V2", "DL Gunborg Flute ver.2", "デラックスガンボルグフルート ver.2", "DL"))
TAGS = [("masked-voyager", "Masked Voyager", "仮面ボイジャー", "#1"), ("wave-one", "Wave One", "第一弾", "#2"), ("wave-three", "Wave Three", "第三弾", "#3"), ("sword", "Sword", "剣", "#4")]


def found(spark, rows):
    products = spark.createDataFrame(PRODUCTS, "ref_id string, name string, name_ja string, product_line string")
    tags = spark.createDataFrame(TAGS, "tag_id string, label string, label_ja string, color string")
    got = canonical.match_values(spark.createDataFrame(rows, META), products, tags)
    return {(r.meta_id, r.field, r.pos): r.ref_id for r in got.collect()}


def test_names(spark):
    names = {
        "DL Sapphiva Flute": None, "dl sapphiva flute": "P000", "[ＤＬ　Sapphiva Flute]": "P000", "Sapphiva Flute DL - scan": "P000", "DL Saphiva Flte": "P000", "DL_Sapphiva_Flute (JP)": "P000", "Sapphiva Flute": "P000",
        "QLX Sapphiva Flute": "unmatched", "Gunborg Compass": "unmatched", "the DL Gunborg Gau.": "P011", "デラックスサファイヴァフルート 取扱説明書": "P000", "DL Gunborg Flute ver.2 Manual": "V2", "dl gunborg flute": "P010", "DL Gunborg Flute ver.3": "unmatched",
        "Petit Wyndecker Teapot": "unmatched", "DL Gunborg Teapot": "unmatched", "untitled": "unmatched", "DLGunborgGauntlet": "P011",
    }
    got = found(spark, [(i, n, None) for i, n in enumerate(names)])
    assert got == {(i, "name", -1): ref for i, ref in enumerate(names.values()) if ref}


def test_tags_and_edges(spark):
    rows = [(1, None, ["sword", "Sword", "#剣", None, " ", "wvae-one", "Wave Two", "VoyagerMasked", "misc", "sword!"]), (2, " ", []), (3, "", None), (1, None, ["Sword"])]
    got = found(spark, rows)
    assert got == {(1, "tags", 1): "sword", (1, "tags", 2): "sword", (1, "tags", 5): "wave-one", (1, "tags", 6): "unmatched", (1, "tags", 7): "masked-voyager", (1, "tags", 8): "unmatched", (1, "tags", 9): "sword", (1, "tags", 0): "sword"}
    assert found(spark, []) == {}
    assert found(spark, [(1, "x" * 50_000, None)]) == {(1, "name", -1): "unmatched"}


def test_entries_far_down_by_cosine():
    products = [{"ref_id": f"P{n}", "name": f"DL Gunborg Flute ver.{n}", "name_ja": "", "product_line": "DL"} for n in range(1, 60)]
    index = canonical.Index(canonical.product_entries(products), "name")
    assert index.match("DL Gunborg Flute ver.4 7")[0] == "P47"


def test_products_that_the_list_lacks():
    """A combination of words of the list that no entry has is not the entry next to it."""
    products = [{"ref_id": "A", "name": "DL Gunborg Bolt", "name_ja": "", "product_line": "DL"}, {"ref_id": "B", "name": "DL Nebulax Belt", "name_ja": "", "product_line": "DL"}]
    index = canonical.Index(canonical.product_entries(products), "name")
    got = {v: index.match(v)[0] for v in ("DL Gunborg Bolt", "DL Gunborg Belt", "DL Gunborg Betl", "DL Gunborg Bolr", "dl nebulax belt", "DL Nebulax Bolt", "Neb. Belt", "DLGunborgBlot")}
    assert got == {"DL Gunborg Bolt": "A", "DL Gunborg Belt": "unmatched", "DL Gunborg Betl": "unmatched", "DL Gunborg Bolr": "A", "dl nebulax belt": "B", "DL Nebulax Bolt": "unmatched", "Neb. Belt": "B", "DLGunborgBlot": "A"}


def test_edits_of_words_in_any_order():
    import random
    from itertools import permutations

    rng = random.Random(2)
    for _ in range(60):
        form = tuple("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))
        typed = list("".join(rng.sample(form, len(form))))
        for _ in range(rng.randint(0, 2)):
            typed[rng.randrange(len(typed))] = rng.choice("abcd")
        typed = "".join(typed)
        plain = min(canonical.edits("".join(p), typed, 3) for p in permutations(form))
        got = canonical.edits_of_words(form, typed, 3)
        assert plain <= got <= plain + 1 and (got == plain or plain > 0)  # letters swapped over a word's end are two edits
    many = tuple("abcdefghij"[i] * 3 for i in range(9))  # more words than orders could be tried of
    assert canonical.edits_of_words(many, "".join(reversed(many)), 3) == 0 and canonical.edits_of_words(many, "".join(reversed(many))[:-1] + "x", 3) == 1
