"""Scalar functions against plain Python."""

import html as html_module
import re
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import fix, geometry, rules, text, wrap

SAMPLES = ["", " ", "　全角　", "A\tB\n", "Mega  Blade (Rev.2)", "Toy - 12 Pieces", "仮面ライダー ベルト", "_x_", "①②", "a--b  c-", "\x1fx\x1c", None]


def one(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_strip_and_collapse(spark):
    assert one(spark, SAMPLES, text.strip(F.col("s"))) == [None if s is None else s.strip() for s in SAMPLES]
    assert one(spark, SAMPLES, text.collapse(F.col("s"))) == [None if s is None else " ".join(s.split()) for s in SAMPLES]


def plain_slug(name):
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", name.lower())).strip("-")


def test_slug(spark):
    rows = [s for s in SAMPLES if s is not None]
    assert one(spark, rows, text.slug(F.col("s"))) == [plain_slug(s) for s in rows]
    assert one(spark, ["Mega  Blade (Rev.2)", "Toy - 12 Pieces"], text.slug(F.col("s"))) == ["mega-blade-rev2", "toy-12-pieces"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ9é 　\t-_.あ①!", max_size=12), min_size=1, max_size=20))
def test_strip_and_slug_of_any_text(spark, rows):
    assert one(spark, rows, text.strip(F.col("s"))) == [s.strip() for s in rows]
    assert one(spark, rows, text.slug(F.col("s"))) == [plain_slug(s) for s in rows]


@pytest.mark.parametrize(
    ("base", "expected"),
    [
        ("plain", ["plain"]),
        ("belt-v2", ["belt-v2", "belt"]),
        ("memorial-set", ["memorial-set", "memorial", ]),
        ("memorial-x", ["memorial-x", "memorial-x"]),
        ("a-set-memorial-set", ["a-set-memorial-set", "a-set-memorial", "a-memorial"]),
        ("go-next", ["go-next", "go-NEXT", "go"]),
    ],
)
def test_slug_variants(spark, base, expected):
    assert one(spark, [base], text.slug_variants(F.col("s")))[0] == expected


def test_quote_and_titles(spark):
    rows = ["a b/c?d=é&~*+()'", "仮面", ""]
    assert one(spark, rows, text.quote(F.col("s"))) == [urllib.parse.quote(s) for s in rows]
    rows = ["bar's 3d-baz", "ＡＢc", "x", ""]
    assert one(spark, rows, text.title_case(F.col("s"))) == [s.title() for s in rows]
    assert one(spark, ["https://x.test/blog/new-toy-3/"], text.url_title(F.col("s"))) == ["New Toy 3"]


def test_entities(spark):
    rows = ["&amp;quot;", 'a "b" & <c>', "&quot;x&quot; &amp; y"]
    assert one(spark, rows, text.decode_entities(F.col("s"))) == [s.replace("&quot;", '"').replace("&amp;", "&") for s in rows]
    assert one(spark, rows, text.escape_html(F.col("s"))) == [html_module.escape(s, quote=False) for s in rows]


def test_lists(spark):
    rows = ["1. First 2. Second", "intro 1. a 2. b", "no list", "1. only", "• a • b", "(1) x (2) y", ""]
    assert one(spark, rows, text.split_list(F.col("s"))) == [["1. First", "2. Second"], ["1. a", "2. b"], ["no list"], ["1. only"], ["• a", "• b"], ["(1) x", "(2) y"], [""]]
    got = one(spark, ["1. x", "① y", "- z", "plain", "(3)w"], text.list_mark(F.col("s")))
    assert [(m.mark, m.rest) for m in got] == [("1. ", "x"), ("① ", "y"), ("- ", "z"), ("", "plain"), ("(3)", "w")]


def test_json_and_keys(spark):
    assert one(spark, ['ok {"a": {"b": 1}} end', "none", "} {", None], text.embedded_json(F.col("s"))) == ['{"a": {"b": 1}}', None, None, None]
    got = one(spark, ["3-14", "x-1", "-1-2", "1-", "99999999999-1", None], text.block_key(F.col("s")))
    assert [(k.page_idx, k.block_idx) for k in got] == [(3, 14), *[(None, None)] * 5]


def test_noise(spark):
    noise = ["12", "①⑳", "3.", "３）", "★※", "©™", "A", "ABCD", "", "　", None]
    kept = ["ABCDE", "これは文です。", "ab", "A1"]
    assert one(spark, noise, rules.is_noise(F.col("s"))) == [True] * len(noise)
    assert one(spark, kept, rules.is_noise(F.col("s"))) == [False] * len(kept)


def test_dropped(spark):
    got = one(spark, ["(1)", "（1）", ".!?", "7", "©", "BANDAI", "Bandai", " ", "ok", None], rules.dropped_by(F.col("s")))
    assert got == ["page_number", None, "punctuation", "single", "mark", "maker", None, "blank", None, None]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("The complete selection modification of a rider's belt", ["csm", "kamen-rider"]),
        ("dx overrider", ["dx", "kamen-rider"]),
        ("Memorial box, 戦隊 3", ["memorial", "sentai"]),
        ("An ultra-fine replica", ["ultraman"]),
        ("Screwdriver", ["kamen-rider"]),
        ("仮面csm", []),
        (None, []),
    ],
)
def test_tags(spark, name, expected):
    assert one(spark, [name], rules.tags_of(F.col("s"), F.lit(None).cast("string")))[0] == expected


def clamp(b):
    x, y = max(0.0, min(1.0, b[0])), max(0.0, min(1.0, b[1]))
    return [x, y, max(0.01, min(1 - x, b[2])), max(0.01, min(1 - y, b[3]))]


def test_boxes(spark):
    good = [[-0.5, 0.2, 2.0, 0.0], [1.0, 1.0, 0.5, 0.5], [0.1, 0.2, 0.3, 0.4]]
    bad = [[0.1, 0.2], [0.1, 0.2, 0.3, float("nan")], [0.1, None, 0.3, 0.4], None, []]
    assert one(spark, good, geometry.clamp(F.col("b")), "b array<double>") == [clamp(b) for b in good]
    assert one(spark, bad, geometry.clamp(F.col("b")), "b array<double>") == [None] * len(bad)
    assert one(spark, [[0.1234, 0.5, 0.0099, 0.9999]], geometry.pixels(F.col("b"), 1000, 1000), "b array<double>") == [[123, 500, 9, 999]]
    rows = [[0.00005, 0.00015, 0.12345, 1.0], None, [None, 0.5, 0.5, 0.5]]
    assert one(spark, rows, geometry.round4(F.col("b")), "b array<double>") == [[round(v, 4) for v in rows[0]], None, [None, 0.5, 0.5, 0.5]]


def test_round4_of_any_number(spark):
    import random

    rng = random.Random(5)
    rows = [[rng.uniform(-2, 2), rng.randint(-20000, 20000) / 1e4 + 0.00005, rng.uniform(0, 1) * 1e12, 0.00025] for _ in range(300)] + [[], [float("inf")]]
    assert one(spark, rows, geometry.round4(F.col("b")), "b array<double>") == [[v if v == float("inf") else round(v, 4) for v in b] for b in rows]


def test_shown_and_forms(spark):
    assert one(spark, [[0.125, 0.994, 0.995, 1.0]], geometry.shown(F.col("b")), "b array<double>") == [["0.13", "0.99", "1.00", "1.00"]]
    got = one(spark, [10, 10_000_000, 10_000_001], geometry.image_form(F.col("n")), "n long")
    assert [(f.mime, f.quality) for f in got] == [("image/png", None), ("image/png", None), ("image/jpeg", 95)]


def test_wrapping(spark):
    assert wrap.start_size(4) == 10 and wrap.start_size(26) == 13 and wrap.start_size(90) == 14
    # 10 points: 5 pixels a character; the first line has the full width, later ones hang under the text
    assert wrap.wrap_item("1. aaa bbb ccc", 35, 10) == [("1. aaa bbb", 0), ("ccc", 15)]
    assert wrap.wrap_item("1. aaa bbb ccc ddd", 35, 10) == [("1. aaa bbb", 0), ("ccc", 15), ("ddd", 15)]
    assert wrap.wrap_item("aaa bbb toolongword c", 35, 10) == [("aaa bbb", 0), ("toolongword", 0), ("c", 0)]
    assert wrap.wrap_item("• ", 35, 10) == [] and wrap.wrap_item("", 35, 10) == []
    assert wrap.fit(["a b"], 5, 28) == (12, [("a", 0), ("b", 0)])  # two lines of 12 + 2 fit 28 pixels, of 14 + 2 don't
    assert wrap.fit(["a b c d"], 5, 20)[0] == 7  # none fits
    df = spark.createDataFrame([("1. aa 2. bb cc", 30, 40), (None, 1, 1), ("x", None, 3), ("", 5, 5)], "t string, w int, h int")
    got = [r[0] for r in df.select(wrap.fit_text(text.split_list(F.col("t")), F.col("w"), F.col("h"))).collect()]
    assert (got[0].size, [(x.line, x.indent) for x in got[0].lines]) == (11, [("1. aa", 0), ("2. bb", 0), ("cc", 21)])
    assert [(g.size, g.lines) for g in got[1:]] == [(None, None), (None, None), (10, [])]


def test_fixed_text(spark):
    good = ["plain", None, "é", "日本"]
    assert one(spark, good + ["Ã©", "æ—¥æœ¬"], fix.fix_text(F.col("s"))) == good + ["é", "日本"]


def test_anchors_and_polygons(spark):
    df = spark.createDataFrame([("こんにちは", [(None, 2), (3, 5)]), ("abc", [])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(geometry.anchored(F.col("t"), F.col("s"))).collect()] == ["こんちは", ""]
    v = spark.createDataFrame([([(0.1, 0.2), (0.5, 0.2), (0.5, 0.6), (0.1, 0.6)],), ([(0.1, 0.2)],)], "v array<struct<x:double,y:double>>")
    got = [r[0] for r in v.select(geometry.from_polygon(F.col("v"))).collect()]
    assert got[1] is None and got[0] == pytest.approx([0.1, 0.2, 0.4, 0.4])
