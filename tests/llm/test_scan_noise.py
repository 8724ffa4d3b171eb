"""Scan noise: planted traces in a made corpus."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import scan_noise

SCHEMA = "row_id long, manual string, page_idx int, text string, translation string"
PARTS = ["button", "lever", "carrying grip", "storage case", "silver ring", "clock face", "front panel"]
JP = ["ボタン", "レバー", "持ち手", "収納箱", "銀色リング", "時計盤", "前面パネル"]
SENTENCES = ["Pressing the {} plays the warning tone.", "Always switch off the {} after use.", "Wipe dirt from the {} with a soft, dry cloth.", "Insert the {} all the way into the holder.", "The tip of the {} is sharp, so never point it at people."]
JP_SENTENCES = ["{}を押すと警告音が鳴ります。", "使用後は{}の電源を必ず切ってください。", "{}の汚れは、乾いた柔らかい布でふき取ってください。", "{}を奥まで差し込んでください。", "{}の先端は鋭いので、人に向けないでください。"]


def scan(df):
    """Traces of all values, those of repeated lines too."""
    return scan_noise.Scan(df).drafts(False).select("row_id", "field", F.explode("found").alias("f")).select("row_id", "field", "f.*")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(3000):
        ks = [(rng.randrange(5), rng.randrange(7)) for _ in range(3)]
        out.append((i, f"m{i % 40}", i % 7, "".join(JP_SENTENCES[a].format(JP[b]) for a, b in ks), " ".join(SENTENCES[a].format(PARTS[b]) for a, b in ks)))
    return out


NOISY = [
    (9001, None, "Always switch off the but-\nton after use.\nInsert the lever all the way into the holder.", {("translation", "hyphen")}),
    (9002, None, "Pressing the 1ever plays the\nwarning tone.", {("translation", "misread")}),
    (9003, None, "Insert the rnagic.\nAlways switch 0ff the front pane1 after use.", {("translation", "misread")}),
    (9004, "第3章　遊び方\n使用後はボタンの電源を\n必ず切ってください。\n- 12 -", None, {("text", "header"), ("text", "page_no")}),
    (9005, None, "Chapter 4   How to play\nAlways switch off the lever\nafter use.\nPage 3 of 9", {("translation", "header"), ("translation", "page_no")}),
    (9006, "使用後はレバ|の電源を必ず切ってくだざい。", None, {("text", "misread")}),
    (9007, None, "Always switch off the si¬\nlver ring after use.\n17", {("translation", "hyphen"), ("translation", "page_no")}),
    (9008, None, "~ Grand Toy ~\nAlways switch off the lever after use.", {("translation", "header")}),
]
SOUND = [(9101, "ボタン\n7\nレバー\n12", "button\n7\nlever\n12"), (9102, "12", "12"), (9103, "第3章　遊び方", "Chapter 4   Title"), (9104, None, None), (9105, "", " "), (9106, "①", "- 5 -"), (9107, None, "Always switch off the lever after\nuse.")]


def test_planted(spark, rows):
    df = spark.createDataFrame(rows + [(i, "m1", 1, a, b) for i, a, b, _ in NOISY] + [(i, "m1", 1, a, b) for i, a, b in SOUND], SCHEMA)
    got = {}
    for r in scan(df).collect():
        got.setdefault(r.row_id, set()).add((r.field, r.noise))
    assert got == {i: truth for i, _, _, truth in NOISY}


def test_repaired(spark, rows):
    meta = spark.createDataFrame([(1, "m1", "s")], "meta_id long, manual string, source string")
    df = spark.createDataFrame(rows + [(i, "m1", 1, a, b) for i, a, b, _ in NOISY], SCHEMA)
    fixed = {(r.row_id, r.field): r.repaired for r in scan_noise.repaired_values(df, meta).collect()}
    assert fixed[9001, "translation"] == "Always switch off the button after use. Insert the lever all the way into the holder."
    assert fixed[9002, "translation"] == "Pressing the lever plays the warning tone."
    assert fixed[9004, "text"] == "使用後はボタンの電源を必ず切ってください。"
    assert fixed[9006, "text"] == "使用後はレバーの電源を必ず切ってください。"


def test_repaired_beside_line_breaks(spark, rows):
    meta = spark.createDataFrame([(1, "m1", "s")], "meta_id long, manual string, source string")
    wrapped = ["使用後はレバ\n|の電源を必ず切ってください。", "使用後はレバ|\nの電源を必ず切ってください。", "使用後はレ\nバ|の電源を必ず切ってくだ\nざい。", "使用後はレバ|の\n電源を必ず切ってくだざ\nい。"]
    df = spark.createDataFrame(rows + [(9200 + i, "m1", 1, a, None) for i, a in enumerate(wrapped)], SCHEMA)
    fixed = {r.row_id: r.repaired for r in scan_noise.repaired_values(df, meta).collect()}
    assert fixed == {9200 + i: "使用後はレバーの電源を必ず切ってください。" for i in range(len(wrapped))}
    lines = {(r.row_id, r.line_no) for r in scan(df).where("noise = 'misread'").collect()}
    assert lines == {(9200, 1), (9201, 0), (9202, 1), (9202, 2), (9203, 0), (9203, 1)}


def test_misread_at_the_edge_of_a_batch(spark, rows):
    model = scan_noise.Model(scan_noise.char_model(spark.createDataFrame(rows, SCHEMA)))
    for value in ("ポタンを押すと警告音が鳴ります。", "使用後はボタンの電源を必ず切ってくだざい。", "使用後はボタンの電源を必ず切ってくださいo"):
        alone = list(scan_noise._suspects(model, pa.array([value])))
        ((_, _, reads),) = alone
        assert alone == [(0, value, reads)] and reads
        assert list(scan_noise._suspects(model, pa.array([None, value, ""]))) == [(1, value, reads)]
    assert list(scan_noise._suspects(model, pa.array(["ボタンを押すと警告音が鳴ります。"]))) == []


def test_repeated_lines_are_none(spark, rows):
    meta = spark.createDataFrame([(1, "m1", "s")], "meta_id long, manual string, source string")
    own = [(9000 + i, "m1", 100 + i, f"使用後はレバーの電源を必ず切ってください。\n{i}ページ", None) for i in range(40)]
    df = spark.createDataFrame(rows[:500] + own, SCHEMA)
    assert scan(df).where("row_id >= 9000 AND noise = 'page_no'").count() == 40
    assert scan_noise.noisy_values(df, meta).where("row_id >= 9000").count() == 0


def test_empty(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_confusion_prices(spark, rows):
    """What the corpus shows often costs less; what it never shows costs more."""
    df = spark.createDataFrame(rows + [(9300 + i, "m1", 1, None, f"Always switch off the front pane1 after use. {s}") for i, s in enumerate(SENTENCES)], SCHEMA)
    made = scan_noise.Scan(df)
    plain = scan_noise.Scan(spark.createDataFrame(rows, SCHEMA))
    assert made.prices["1", "l"] < plain.prices["1", "l"] <= scan_noise.DEAREST
    assert set(made.prices) == set(scan_noise.ALTERNATIVES)


def test_tables_grow_with_the_corpus():
    assert scan_noise.sized(10) == scan_noise.sized(scan_noise.BASE_ROWS) == scan_noise.ORDERS
    large = scan_noise.sized(100 * scan_noise.BASE_ROWS)
    assert large[5] == 24 and large[1] == 16 and max(scan_noise.sized(10**15).values()) == scan_noise.MOST_BITS


def test_very_long_words(spark, rows):
    long = "x" * 30_000 + "pane1" + "y" * 30_000
    df = spark.createDataFrame(rows + [(9400, "m1", 1, None, long + "\nAlways switch off the but-\nton after use.")], SCHEMA)
    assert {(r.row_id, r.noise) for r in scan(df).collect()} == {(9400, "hyphen")}
