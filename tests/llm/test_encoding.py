"""Wrongly read text: exact round trips."""

import pytest

from blockloom.llm import encoding

SCHEMA = "row_id long, text string, translation string"
TEXTS = ["ハンドルの取り付け方を説明書で確認してください。", "電池を交換するときは、回転盤のネジを緩めてください。", "使用温度範囲は5°Cから45°Cまでです。", "収納箱と保護袋の音声が交互に再生されます。"]
ENGLISH = ["Don’t touch the card — it is 5 × 5 cm.", "Put the Château Rouge sticker on the back, “let’s go”.", "The Übergrün belt is only for São Blue.", "It works from 5 °C to 45 °C."]


@pytest.fixture(scope="module")
def clean():
    return [(i, TEXTS[i % 4] + TEXTS[i // 4 % 4], ENGLISH[i % 4] + " " + ENGLISH[i // 4 % 4]) for i in range(400)]


def misread(text, true, wrong):
    raw = text.encode(true)
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)


@pytest.mark.parametrize(("true", "wrong"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "iso8859_2"), ("utf-8", "cp1250"), ("cp932", "cp1252"), ("euc_jp", "latin-1")])
def test_lossless_round_trip(spark, clean, true, wrong):
    bad = [(1000 + i, misread(t, true, wrong), None) for i, t in enumerate(TEXTS[:2] + TEXTS[3:])]
    bad += [(2000, TEXTS[0] + misread(TEXTS[1], true, wrong), None)]
    if true == "utf-8":
        bad += [(3000 + i, None, misread(t, true, wrong)) for i, t in enumerate(ENGLISH[:2])]
        bad += [(4000, misread(misread(TEXTS[0], true, wrong), true, wrong), None)]
    got = {r.row_id: r for r in encoding.garbled_values(spark.createDataFrame(clean + bad, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in bad}  # correctly written accents are none
    for i, t in enumerate(TEXTS[:2] + TEXTS[3:]):
        assert got[1000 + i].restored == t and got[1000 + i].certain
    assert got[2000].restored == TEXTS[0] + TEXTS[1]
    if true == "utf-8":
        assert got[3000].restored == ENGLISH[0] and got[3000].field == "translation"
        assert got[4000].restored == TEXTS[0]


@pytest.mark.parametrize("wrong", ["cp932", "gbk"])
def test_lost_bytes(spark, clean, wrong):
    bad = [(1000 + i, t.encode("utf-8").decode(wrong, "replace"), None) for i, t in enumerate(TEXTS)]
    got = {r.row_id: r for r in encoding.garbled_values(spark.createDataFrame(clean + bad, SCHEMA)).collect()}
    assert set(got) == {1000, 1001, 1002, 1003}
    assert sum(got[1000 + i].restored == t for i, t in enumerate(TEXTS)) >= 2


def test_japanese_bytes_read_as_chinese(spark, clean):
    bad = [(1000 + i, t.encode("cp932").decode("gbk"), None) for i, t in enumerate(TEXTS[:2])]
    got = {r.row_id: r for r in encoding.garbled_values(spark.createDataFrame(clean + bad, SCHEMA)).collect()}
    assert {i: r.restored for i, r in got.items()} == {1000: TEXTS[0], 1001: TEXTS[1]}


def test_words_fill_lost_bytes(spark, clean):
    """Of the characters that fit a lost byte the one counts that makes a word of the corpus."""
    model = encoding.char_model(spark.createDataFrame(clean, SCHEMA))
    text = TEXTS[0].encode("utf-8").decode("cp1252", "replace").replace("\x81", "\ufffd")
    got = encoding.restore(model, text)
    assert got is not None and got[0] == TEXTS[0] and got[1]


def test_what_no_encoding_explains(spark, clean):
    """Garbling that is left is told: the value is found, but nothing is offered as restored."""
    half = TEXTS[0] + misread(TEXTS[1], "utf-8", "cp1252") + "\x85\x9a"
    got = encoding.garbled_values(spark.createDataFrame(clean + [(1000, half, None)], SCHEMA)).collect()
    assert [(r.row_id, r.restored, r.certain) for r in got] == [(1000, None, False)]


def test_edges(spark, clean):
    rows = clean[:50] + [(900, None, None), (901, "", " "), (902, "é", "Señal Verde"), (903, "�", None)]
    assert encoding.garbled_values(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert encoding.garbled_values(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = clean[:50] + [(900, misread(TEXTS[0], "utf-8", "cp1252") * 40, None)] * 2
    assert encoding.garbled_values(spark.createDataFrame(twice, SCHEMA)).count() == 2
