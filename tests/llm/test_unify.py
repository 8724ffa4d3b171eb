"""Look-alike text in one form."""

from blockloom.llm import unify

SCHEMA = "row_id long, manual string, page_idx int, text string, translation string"


def pairs(spark, rows):
    return {tuple(r) for r in unify.look_alike_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_characters():
    same = {"ｶﾞｰﾄﾞ": "ガード", "ガード": "ガード", "Ａ１（x）": "A1(x)", "a b　c": "a b c", "a​b­c": "abc", "⾳声": "音声", "é": "é", "ﬁn": "fin", "x‑y": "x-y"}
    for given, expected in same.items():
        assert unify.unify_characters(given) == expected
    for visible in ("①", "5²", "é", "が", "a\nb", "A"):
        assert unify.unify_characters(visible) == visible


def test_pairs(spark):
    rows = [
        (1, "m", 0, "ガード", "The card"), (2, "m", 0, "ｶﾞｰﾄﾞ", "Thе сard"), (3, "m", 0, "カード", "the card"), (4, "m", 1, "ｶﾞｰﾄﾞ", "The card"), (5, "m", 0, "ガード", None),
        (6, "m", 0, " ", "​"), (7, "m", 0, "　", ""), (8, None, 0, "ｶﾞｰﾄﾞ", None), (9, "m", None, "ｶﾞｰﾄﾞ", None), (10, "m", 0, "①", "a b"), (11, "m", 0, "1", "ab"), (12, "m", 0, "スロッ卜", "x"), (13, "m", 0, "スロット", "x"),
    ]
    assert pairs(spark, rows) == {(1, 2, "text"), (2, 5, "text"), (1, 2, "translation"), (12, 13, "text")}


def test_words_decide(spark):
    rows = [(1, "m", 0, "x", "соmраss сот"), (2, "m", 0, "y", "compass"), (3, "m", 0, "привет", "мир"), (4, "m", 0, "カタロ口", "z")]
    got = {r.row_id: (r.text, r.translation) for r in unify.unified_translations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1][1] == "compass сот"  # 'cot' is no word here
    assert got[3] == ("привет", "мир") and got[4][0] == "カタロ口"


def test_repairs_in_their_place(spark):
    """A token that is accepted changes no token that holds it; words of suspicious values count."""
    rows = [(1, "m", 0, "x", "bа bаngq end"), (2, "m", 0, "y", "ba end"), (3, "m", 0, "z", "zоrble"), (4, "m", 0, "w", "zorble\u200b"), (5, "m", 0, "v", "qоx and zorble\u200b qо")]
    got = {r.row_id: r.translation for r in unify.unified_translations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "ba bаngq end" and got[3] == got[4] == "zorble"
    assert got[5] == "qоx and zorble qо"  # parts of mixed tokens are no words
    assert pairs(spark, rows) == {(3, 4, "translation")}


def test_classes(spark):
    rows = [(i, "m", 0, ("ガード", "ｶﾞｰﾄﾞ", "plain")[i % 3], None) for i in range(30)]
    got = unify.look_alike_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 20 and len({r.class_id for r in got}) == 1 and len({r.form_id for r in got}) == 2
    assert len(pairs(spark, rows)) == 100


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert unify.look_alike_pairs(empty).count() == 0 and unify.unified_translations(empty).count() == 0
    long = "あ" * 200_000
    rows = [(1, "m", 0, long, None), (2, "m", 0, long + "​", None), (2, "m", 0, long + "​", None)]
    assert pairs(spark, rows) == {(1, 2, "text")}
    extra = spark.createDataFrame([(1, "m", 0, "Ａ", None, "v", 1), (2, "m", 0, "A", None, "w", 2)], SCHEMA + ", value string, page int")
    assert unify.look_alike_pairs(extra).count() == 1
